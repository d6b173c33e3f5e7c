import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docspark.llm.common import table, written
from docspark.llm.packing import pack, pack_documents, plan_rounds, sequences, token_pieces
from docspark.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    """Sequences that plain best-fit decreasing opens, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def rooms_of(plan, capacity):
    used = defaultdict(list)
    for n, first, k, each, seq, offset in plan:
        for r in range(k):
            used[seq + r // each].append((offset + n * (r % each), n))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    return sorted(capacity - sum(n for _, n in p) for p in used.values())


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.choice([1, 3, rng.randint(1, capacity)]) for _ in range(rng.choice([0, 1, 50, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    assert rooms_of(plan_rounds(counts, capacity), capacity) == best_fit(lengths, capacity)


def checked(rows, texts, capacity=1024):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids) and (len(by_doc[doc]) == 1 or len(ids) > capacity)
    for places in by_seq.values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_documents_are_packed_whole_and_tight(spark, sf):
    df = table(spark, sf, "documents")
    rows = pack_documents(df, PATH).collect()
    n = checked(rows, {d.doc_id: d.text for d in df.collect()})
    assert n == len(best_fit([r.length for r in rows], 1024))


def test_odd_texts(spark, docs):
    texts = [None, "", " ", "\n\n  a", "a\t\n b  c\x1c d", "x\r\ny", "word " * 3000, "é" * 5000, "<|endoftext|> a  <|endoftext|>\n", "a  \n  b   "]
    texts += ["same text"] * 40
    rows = pack_documents(docs(list(enumerate(texts))), PATH).collect()
    checked(rows, dict(enumerate(texts)))


def test_chunks_equal_whole_texts():
    rng = random.Random(1)
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        whole, mine = Tokenizer.from_file(public_tokenizers.path(name)), encoder(public_tokenizers.path(name), spaces)
        parts = ["-", "_", "[", "**", "a", "B", "it's", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", " ", "ΟΔΟΣ", "1", "23", "!", "'", "ll", "<|endoftext|>", "ſ", "ÉTÉ", "über", "Straße", "ÿ×", "ç", "ª", "𝄞", ".", ",", "\x00", "\x85"]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
        got = mine.ids(texts)
        for t, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_repeats_empty_and_bad_lengths(spark, docs):
    assert pack_documents(docs([]), PATH).collect() == []
    got = pack_documents(docs([(1, "a b")] * 3 + [(None, "c")]), PATH).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 2000)], "k int, length long"), ["k"])


def test_sequences_hold_the_ids(spark, docs):
    df = docs([(i, f"word {i} " * i) for i in range(12)])
    pieces = written(token_pieces(df, PATH, with_ids=True), "t")
    got = sequences(pack_documents(df, PATH), pieces).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(x for i in range(12) for x in whole.encode(f"word {i} " * i, add_special_tokens=False).ids + [2])
    assert sorted(x for r in got for x in r.ids) == want and all(len(r.ids) == sum(r.lengths) for r in got)
