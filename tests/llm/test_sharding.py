import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from docspark.llm.common import table
from docspark.llm.sharding import ROUNDS, SEED, assign_shards, permuted, sides, write_shards
from docspark.operators.numbering import number_rows


def keyed(v, i):
    h = 42
    for x in (v, SEED, i):
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute(r, n):
    a, b = sides(n)
    while True:
        left, right = divmod(r, b)
        for i in range(2 * ROUNDS):
            if i % 2 == 0:
                left = (left + keyed(right, i) % a) % a
            else:
                right = (right + keyed(left, -i - 1) % b) % b
        r = left * b + right
        if r < n:
            return r


def test_permutation_is_the_brute_force_one_and_a_bijection(spark):
    for n in (1, 2, 3, 7, 50, 101, 1000):
        got = [r.p for r in spark.range(n).withColumn("p", permuted(F.col("id"), n)).orderBy("id").collect()]
        assert got == [brute(r, n) for r in range(n)]
        assert sorted(got) == list(range(n))


def test_shards_match_brute_force_whatever_the_partitions(spark, sf):
    df = table(spark, sf, "documents")
    rows = df.collect()
    want = {}
    for r, d in enumerate(sorted(rows, key=lambda d: d.doc_id)):
        p, b = brute(r, len(rows)), d.text.encode()
        want[d.doc_id] = (len(b) + 1, zlib.crc32(b), "rows", p % 8, p // 8, None)
    for parts in (1, 5):
        got = {r[0]: tuple(r[1:]) for r in assign_shards(df.repartition(parts)).collect()}
        assert got == want


def test_slots_are_gapless_and_counts_near_equal(spark, docs):
    df = docs([(i % 5 if i % 7 else None, None if i % 3 else "x" * i) for i in range(83)])
    shards = {}
    for r in assign_shards(df).collect():
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.size >= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_empty_repeats_and_numbers(spark, docs):
    assert assign_shards(docs([])).collect() == []
    assert [r.slot for r in assign_shards(docs([(1, "a")] * 3), 1).orderBy("slot").collect()] == [0, 1, 2]
    got = number_rows(spark.range(50).repartition(7), ["id"]).orderBy("id").collect()
    assert [r.row_number for r in got] == list(range(50))


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    write_shards(docs([(i, f"t{i}") for i in range(20)]), str(tmp_path / "s"), 4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert {r.doc_id for r in got.collect()} == set(range(20)) and got.select("shard").distinct().count() == 4
