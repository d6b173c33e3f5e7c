import random
import re

import numpy as np
import pytest

from docspark.llm.common import table
from docspark.llm.components import components
from docspark.llm.jaccard import _Signer, band_edges, bitmap, block_pairs, jaccard_components, linked, member_sets, overlap_bound
from docspark.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(texts, n, num, den):
    sets = {d: shingles(t, n) for d, t in texts.items()}
    group = {d: d for d in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                group[q] = p
    return {d: (len(sets[d]), find(d)) for d in texts}


def near_copies(seed, count, words=(1, 3, 12, 40, 150)):
    """Texts in families that differ by a few words, around the threshold, with a passage many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    while len(texts) < count:
        base = [rng.choice(vocabulary) for _ in range(rng.choice(words) + rng.randint(0, 5))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            one = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                one[rng.randrange(len(one))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                one.append(passage)
            texts.append(" ".join(one))
    return dict(enumerate(texts[:count]))


@pytest.mark.parametrize("n,num,seed", [(3, 90, 1), (5, 80, 2), (3, 70, 3)])
def test_groups_match_brute_force(spark, docs, n, num, seed):
    texts = near_copies(seed, 260)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(list(texts.items())), n=n, num=num).collect()}
    assert got == brute(texts, n, num, 100)


def test_groups_of_the_table(spark, sf):
    df = table(spark, sf, "documents")
    texts = {d.doc_id: d.text for d in df.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, n=3, num=90).collect()}
    assert got == brute(texts, 3, 90, 100)


def test_tiles_of_several_blocks(spark, docs, monkeypatch):
    from docspark.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 200)
    texts = near_copies(7, 220, (30, 40))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(list(texts.items())), n=3, num=80).collect()}
    assert got == brute(texts, 3, 80, 100)


def test_odd_tables(spark, docs):
    long = " ".join(f"v{i % 3000}" for i in range(9000))
    texts = dict(enumerate([None, "", " \n", "one", "One", "one two", "ONE\ttwo", "Ärger x", "ärger x", "a\xa0b", long, long + " tail", "q r s t", "q r s t", "q r s"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(list(texts.items())), n=3, num=90).collect()}
    assert got == brute(texts, 3, 90, 100)
    assert jaccard_components(docs([])).collect() == []
    got = jaccard_components(docs([(5, "a b c d"), (5, "x y z w"), (5, "a b c d"), (None, "a b c d"), (None, "k l m n")]), n=3).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (5, 5)]


def test_a_star_that_needs_its_tiles(spark, docs):
    """A chain of near copies: neighbours link, the ends do not."""
    words = [f"c{i}" for i in range(100)]
    texts = {}
    for i in range(12):
        texts[(i * 7) % 12] = " ".join(words)
        words[i * 8] = f"changed{i}"
        words[i * 8 + 1] = f"also{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(list(texts.items())), n=3, num=90).collect()}
    assert got == brute(texts, 3, 90, 100) and len({c for _, c in got.values()}) == 1


@pytest.mark.parametrize("num", [70, 80, 90, 95])
def test_linked_sets_share_a_signature(num):
    rng, signer = np.random.default_rng(num), _Signer(num, 100)
    tried = 0
    for _ in range(3000):
        n = int(rng.choice([2, 5, 9, 10, 11, 14, 20, 30, 80, 300]))
        x = np.unique(mix(rng.integers(0, 2**62, n).astype(np.uint64)))
        cut = rng.integers(0, max(1, n // 5) + 1)
        more = mix(rng.integers(0, 2**62, int(rng.integers(0, max(1, n // 5) + 1))).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[cut:], more]))
        both = len(np.intersect1d(x, y))
        assert overlap_bound(bitmap(x), bitmap(y), len(x), len(y)) >= both
        if len(y) and 100 * both >= num * (len(x) + len(y) - both) and both < max(len(x), len(y)):
            tried += 1
            assert set(signer.sign(x).tolist()) & set(signer.sign(y).tolist())
        assert linked(x, y, num, 100) == (100 * both >= num * (len(x) + len(y) - both))
    assert tried > 40


def test_blocks_miss_no_link():
    texts = near_copies(9, 120, (40,))
    sets = member_sets(list(texts.values()), 3)
    rows = [{"rep": i, "label": i % 7, "n": len(h), "bits": bitmap(h).tobytes(), "first": []} for i, h in enumerate(sets)]
    within, across = set(block_pairs(rows, None, 90, 100)), set(block_pairs(rows[:50], rows[50:], 90, 100))
    links = 0
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if linked(x, sets[j], 90, 100) and i % 7 != j % 7:
                links += 1
                assert (i, j) in within and ((i, j) in across or not i < 50 <= j)
    for r in rows:
        r["first"] = [5, 9]
    assert block_pairs(rows, None, 90, 100, 9) == [] and set(block_pairs(rows, None, 90, 100, 5)) == within
    assert links > 20 and all(i % 7 != j % 7 for i, j in within | across)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)] + [(500, 500 + i) for i in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200} | {500 + i: 500 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_band_edges_cover_all_sizes():
    edges = band_edges(1000)
    assert edges[0] == 1 and edges[-1] > 1000 and all(a < b for a, b in zip(edges, edges[1:]))


def test_links_and_their_counts_equal_brute_force(spark, docs):
    from docspark.llm.jaccard import jaccard_links

    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(60)] for _ in range(4)]
    texts = {}
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        texts[i] = " ".join(words)
    texts |= {100: "", 101: None, 102: "one two", 103: "one two", 104: "word"}
    pairs, members = jaccard_links(docs(list(texts.items())), n=3, num=70, den=100)
    sets = {i: brute_set(t, 3) for i, t in texts.items()}
    want = {i: sum(j != i and bool(s) and bool(o) and 100 * len(s & o) >= 70 * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    got = members.collect()
    assert {r.doc_id: r.n_links for r in got} == want
    classes = {r.class_id: sets[r.doc_id] for r in got if r.class_id is not None}
    linked = {(a, b) for a in classes for b in classes if a < b and 100 * len(classes[a] & classes[b]) >= 70 * len(classes[a] | classes[b])}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == linked and len(linked) > 20


def test_ten_thousand_rows_without_an_id(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = spark.range(10_000).selectExpr("cast(null as long) as doc_id", f"concat('{words} ', case when id % 2 = 0 then 'a' else concat('b', id div 100) end) as text")
    got = jaccard_components(rows, n=3, num=50, den=100)
    assert got.where("component_id is null").count() == 10_000


def brute_set(text, n):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
