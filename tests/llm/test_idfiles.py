import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docspark.llm.common import table
from docspark.llm.idfiles import read_ids, write_ids
from docspark.llm.rangecoder import BLOCK, CorruptSegment, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("case", range(11))
def test_round_trip(case):
    rng = np.random.default_rng(case)
    ids = [
        [], [5], [7] * 10, [7] * (5 * BLOCK), rng.integers(0, 60000, 30000), rng.integers(0, 3, BLOCK),
        rng.integers(0, 2**31, 2 * BLOCK + 1), list(range(65536)), [1, 2] * BLOCK, rng.zipf(1.3, 20000) % 49408, [2**32 - 1, 0],
    ][case]
    ids = np.array(ids, dtype="<u4")
    assert (decode(encode(ids)) == ids).all() and len(decode(encode(ids))) == len(ids)


def test_predictable_ids_take_little_room_and_blocks_stand_alone():
    ids = np.array([3, 9, 4, 9, 5] * 10000, dtype="<u4")
    assert len(encode(ids)) < len(ids)
    assert encode(ids)[:4] == b"DSR2"


def order_0_bytes(ids):
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return -(p * np.log2(p)).sum() * len(ids) / 8


def test_contexts_take_the_ids_well_under_their_order_0_entropy():
    # every id tells much of the next one, and the second half of each block repeats its first
    rng = np.random.default_rng(3)
    steps = rng.zipf(1.6, 400_000) % 300
    ids = (np.cumsum(steps) * 7919 % 1500).astype("<u4")
    assert len(encode(ids)) < 0.7 * order_0_bytes(ids)
    noise = rng.integers(0, 1000, BLOCK // 2).astype("<u4")
    copied = np.concatenate([np.roll(noise, i)[: BLOCK // 2] for i in range(40) for _ in range(2)])
    assert len(encode(copied)) < 0.85 * order_0_bytes(copied)


def test_real_ids_take_much_less_than_their_order_0_entropy(spark, sf):
    from docspark.llm.tokens import encoder

    texts = [r.text for r in table(spark, sf.replace("0.001", "0.01"), "documents").select("text").collect()]
    ids = np.frombuffer(b"".join(encoder(PATH, False).ids(texts)), "<u4")
    assert len(encode(ids)) < 0.86 * order_0_bytes(ids)  # 0.84; 0.75 for ten times as many documents


def test_more_than_65536_distinct_ids():
    ids = np.random.default_rng(1).permutation(200_000).astype("<u4")
    ids = np.concatenate([ids, ids[:1000] * 20_000])
    assert (decode(encode(ids)) == ids).all()


def test_damage_is_found():
    segment = bytearray(encode(np.arange(3 * BLOCK, dtype="<u4") % 500))
    with pytest.raises(CorruptSegment):
        decode(bytes(segment[:-4]))
    segment[-9] ^= 1
    with pytest.raises(CorruptSegment):
        decode(bytes(segment))
    with pytest.raises(CorruptSegment):
        decode(b"nothing")


def checked(rows, docs):
    whole, at = Tokenizer.from_file(PATH), 0
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = np.array(whole.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens


def test_files_give_back_the_table(spark, sf, tmp_path):
    df = table(spark, sf, "documents")
    for i, size in enumerate((8_000_000, 1000)):
        write_ids(df.repartition(3), str(tmp_path / f"f{i}"), PATH, segment_ids=size)
        checked(read_ids(spark, str(tmp_path / f"f{i}")).collect(), {d.doc_id: d.text for d in df.collect()})


def test_odd_tables(spark, docs, tmp_path):
    texts = dict(enumerate([None, "", "  \n", "Word's ß İ\t<|endoftext|> é", "x" * 40000, "a b " * 5000, "a", "a"]))
    write_ids(docs(list(texts.items())), str(tmp_path / "a"), PATH)
    checked(read_ids(spark, str(tmp_path / "a")).collect(), texts)
    got = read_ids(spark, str(tmp_path / "a"), with_ids=True).where("doc_id = 0").collect()
    assert got[0].ids == b"\x01\0\0\0"
    write_ids(docs([(2, "b")] * 3 + [(None, "c")]), str(tmp_path / "b"), PATH)
    got = read_ids(spark, str(tmp_path / "b")).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (2, 2), (2, 4), (2, 6)]
    write_ids(docs([]), str(tmp_path / "c"), PATH)
    assert read_ids(spark, str(tmp_path / "c")).collect() == []
