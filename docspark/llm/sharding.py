"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only).

Rows are numbered 0..n-1 in the order of their id.  A keyed bijection of 0..n-1 moves row r to position p;
its shard is ``p mod k`` and its slot there ``p div k``.  Both are computable from r, n and the seed alone:
no state, no shuffle of the texts, and shards differ by one row at most.

The bijection is an additive Feistel network over Z_a x Z_b with a*b just over n.  Images at or beyond n
are permuted again until they fall below n (cycle walking).  There are m = a*b - n < a values outside, a
walk passes through each at most once, so a walk of m steps always ends; at most m rows walk at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.numbering import number_rows

ROUNDS = 4
SEED = 20240229


def sides(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _feistel(x: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def keyed(v: Column, i: Column) -> Column:
        return F.xxhash64(v, F.lit(seed).cast("long"), i)

    def round_(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + F.pmod(keyed(acc["r"], i), la), la)
        return F.struct(left.alias("l"), acc["r"].alias("r"))

    def half(acc: Column, i: Column) -> Column:
        right = F.pmod(acc["r"] + F.pmod(keyed(acc["l"], -i - 1), lb), lb)
        return F.struct(acc["l"].alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / lb).cast("long").alias("l"), F.pmod(x, lb).alias("r"))
    steps = F.array(*[F.lit(i).cast("long") for i in range(2 * rounds)])
    return F.aggregate(
        steps, start,
        lambda acc, i: F.when(i % 2 == 0, round_(acc, i)).otherwise(half(acc, i)),
        lambda acc: acc["l"] * lb + acc["r"],
    )


def permuted(row_number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The position in 0..n-1 of a row number in 0..n-1, under the permutation keyed by ``seed``."""
    a, b = sides(n)
    first = _feistel(row_number, a, b, seed, rounds)
    outside = a * b - n
    if not outside:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)), first,
        lambda at, _: F.when(at < F.lit(n), at).otherwise(_feistel(at, a, b, seed, rounds)),
    )
    return F.when(first < F.lit(n), first).otherwise(walk)


def assign_shards(
    df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """Shard and slot of every row of ``df``.

    Result: ``<id_col>``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32`` (unsigned), ``law``
    ('rows'), ``shard`` (int), ``slot`` (long, gapless from 0 in each shard), ``grown_shard`` (null: the
    law has no incremental form).

    Defined cases: a null text counts as empty (size 1, crc 0); a null id sorts first; equal ids are
    ordered by crc and size, and whole repeats are interchangeable; an empty table gives no rows; other
    columns of ``df``, whatever their names, are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = number_rows(slim, ["_id", "text_crc32", "size"], "shard-rows")
    n = rows.count()
    rows = rows.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return rows.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of ``df`` written under ``path`` in one folder ``shard=i`` each, sorted by slot in a file.

    ``id_col`` must be unique.  A shard is dealt to several tasks by slot range, so that no task holds one whole.
    """
    at = assign_shards(df, n_shards, id_col, text_col).select(id_col, "shard", "slot")
    (
        df.join(at, id_col)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
