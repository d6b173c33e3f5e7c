import itertools
import random

import public_tokenizers
import pytest
import sentencepiece

from docspark.llm.common import table
from docspark.llm.pieces import SPACE, Lattice, decode, decode_pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every(lattice, s):
    """All segmentations of ``s``, best first."""
    paths = {0: [(0.0, [])]}
    into, _, _ = lattice._edges(s)
    for j in range(1, len(s) + 1):
        paths[j] = [(score + more, ids + list(new)) for i, more, new in into[j] for score, ids in paths[i]]
    return sorted(paths[len(s)], key=lambda p: -p[0])


@pytest.fixture(scope="module")
def lattice():
    return Lattice.load(MODEL)


@pytest.fixture(scope="module")
def toy():
    rng = random.Random(3)
    pieces = {"".join(p) for k in (1, 2, 3) for p in itertools.product("ab" + SPACE, repeat=k) if rng.random() < 0.6}
    return Lattice({p: (300 + i, float(-rng.randint(1, 60))) for i, p in enumerate(sorted(pieces | {"a"}))}, list(range(256)))


@pytest.mark.parametrize("seed", range(8))
def test_n_best_are_the_best_of_all(lattice, toy, seed):
    rng = random.Random(seed)
    for solver, letters in ((toy, "ab" + SPACE), (lattice, "thein é𝄞.")):
        for _ in range(25):
            s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))).replace(" ", SPACE)
            want, n = every(solver, s), rng.choice([1, 2, 3, 7, 40])
            got = solver.n_best(s, n)
            assert [x for x, _ in got] == pytest.approx([x for x, _ in want[:n]])
            assert len({tuple(p) for _, p in got}) == len(got)
            known = {(round(x, 6), tuple(p)) for x, p in want}
            assert all((round(x, 6), tuple(p)) in known for x, p in got)


@pytest.mark.parametrize("seed", range(6))
def test_whole_texts_from_chunks(lattice, seed):
    """The n best of a text, put together from chunks, are those of the lattice over the text uncut."""
    rng = random.Random(seed)
    for _ in range(20):
        text = "".join(rng.choice(["a", "the", " ", "  ", "in.", ",", "\n", "a-b", "(", "é", "it", "世"]) for _ in range(rng.randint(1, 5)))
        want = every(lattice, SPACE + text.replace(" ", SPACE))
        for n in (1, 2, 3, 5, 9):
            assert [x for x, _ in lattice.encode(text, n)] == pytest.approx([x for x, _ in want[:n]])


def test_decoding_is_the_library_s(lattice, spark, sf):
    model, spelling = sentencepiece.SentencePieceProcessor(model_file=MODEL), lattice.spelling()
    for d in table(spark, sf, "documents").limit(60).collect():
        for _, ids in lattice.encode(d.text, 3):
            assert decode(ids, spelling) == d.text == model.decode(list(memoryview(ids).cast("I")))


def test_the_table_round_trips(spark, sf):
    df = table(spark, sf, "documents")
    rows = encode_pieces(df, MODEL, with_ids=True)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == df.count() and all(r.decoded for r in got.values())
    assert all(r.scores == sorted(r.scores, reverse=True) and len(r.ids) == 3 for r in got.values())
    texts = {d.doc_id: d.text for d in df.collect()}
    back = decode_pieces(rows.selectExpr("doc_id", "ids[1] as ids", "'x' as other"), MODEL).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_odd_texts(spark, docs):
    texts = [None, "", " ", "   lead", "tail  ", "\x00\n\t\r", "𝄞é世界", "a" * 3000, "word " * 20000, "x" + SPACE + "y", "퟿￾"]
    got = {r.doc_id: r for r in encode_pieces(docs(list(enumerate(texts))), MODEL).collect()}
    assert [got[i].decoded for i in range(len(texts))] == [t is None or SPACE not in t for t in texts]
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].scores == [0.0]
    assert encode_pieces(docs([]), MODEL).collect() == []
    assert len(encode_pieces(docs([(1, "a")] * 3 + [(None, "a")]), MODEL).collect()) == 4
