import math
import random
from collections import Counter

import numpy as np
import pytest

from docspark.llm import lexical
from docspark.llm.lexical import best_of_block, build_index, gains, search, terms_of, tiers_of


def split(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [run] if run else []
            run = ""
        else:
            run += c.lower() if c.isascii() else c
    return out


def plain(docs, items, k=10):
    """Every item's best documents by brute force: (item, rank, doc, score)."""
    counts = [(d, Counter(split(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    many, terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * many // terms
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score and d is not None:
                found.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, rows, items, k=10):
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'x' as term", "9 as score")
    got = search(build_index(docs(rows)), asked, k=k)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "x-y", "été", "日本", "A1"]
    pick = lambda m: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(m))
    rows = [(i, pick(rng.choice([0, 1, 5, 30, 300]))) for i in range(n)]
    return rows, [(i, pick(rng.choice([1, 4, 20]))) for i in range(12)]


def test_terms():
    for t in ("", None, "A-b c_D\x00e", "É1 ²x y 日本,語 \x7f~a", "no'n"):
        assert [x.decode() for x in terms_of(t)] == split(t)


@pytest.mark.parametrize("few", [0, 3, 64])
def test_search_equals_brute_force(spark, docs, monkeypatch, few):
    monkeypatch.setattr(lexical, "FEW", few)  # 0: to the last tier, or out by proof; 64: nearly all completed alone
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 40)
    rows, items = corpus(few, 300)
    rows += [(d + 500, t) for d, t in rows[:40]] + rows[:5] + [(None, "w1 w2 w3"), (900, None), (901, "..."), (902, "w1 " * 5000)]
    items += [(50, None), (51, "nowhere"), (52, ""), (0, "w1 w1 w9"), (None, "w3 x")]
    assert found(spark, docs, rows, items) == plain(rows, items)
    assert found(spark, docs, rows, items, k=2) == plain(rows, items, 2)


def test_rounds_give_the_same(spark, docs, monkeypatch):
    rows, items = corpus(5, 80)
    monkeypatch.setattr(lexical, "ROUND_BYTES", 2000)
    assert found(spark, docs, rows, items) == plain(rows, items)


def test_nothing_to_find(spark, docs):
    assert found(spark, docs, [], [(1, "a")]) == [] and found(spark, docs, [(1, "a b"), (2, None)], []) == []
    assert found(spark, docs, [(1, None)], [(1, "a")]) == []


def test_tiers_hold_every_posting_and_true_bounds():
    rng = np.random.default_rng(1)
    starts = np.concatenate([[0], np.cumsum(rng.integers(1, 30, 50))])
    docs = np.concatenate([np.sort(rng.choice(40, int(n), replace=False)) for n in np.diff(starts)])
    sizes = rng.integers(1, 500, 40)
    gain = gains(rng.integers(1, 9, len(docs)), docs, sizes, 40, int(sizes.sum()))
    tiers = tiers_of(starts, docs, gain, 40)
    assert len(tiers) == 4 and 0 < len(tiers[0]["docs"]) < len(docs) / 8
    for term in range(50):
        lists = [list(zip(t["docs"][t["starts"][term] : t["starts"][term + 1]], t["gains"][t["starts"][term] : t["starts"][term + 1]])) for t in tiers]
        assert sorted(x for part in lists for x in part) == sorted(zip(docs[starts[term] : starts[term + 1]], gain[starts[term] : starts[term + 1]]))
        for i, t in enumerate(tiers):
            assert t["bounds"][term] == max((g for part in lists[i + 1 :] for _, g in part), default=0)


def test_proof_spares_the_lower_tiers():
    # one document holds a rare term; a common one is everywhere with small gains
    n = 3000
    docs, starts = np.concatenate([[7], np.arange(n)]), np.array([0, 1, n + 1])
    tiers = tiers_of(starts, docs, np.concatenate([[900_000], np.full(n, 1000)]), n)
    read = []

    def tier(i):
        read.append(i)
        return tuple(tiers[i][c] for c in ("starts", "docs", "gains", "bounds"))

    lazily = [lambda i=i: tier(i) for i in range(4)]
    got = best_of_block(lazily, n, np.array([0, 1]), np.array([7000, 100]), 1, 1)
    assert [x.tolist() for x in got] == [[7], [6_300_100_000]] and read == [0, 1, 2, 3]
    read.clear()
    # beyond what anyone here can reach: out by the bounds of the first tier
    assert len(best_of_block(lazily, n, np.array([1]), np.array([100]), 1, 10**9)[0]) == 0 and read == [0]


def test_blocks_are_read_few_at_once(spark, docs, monkeypatch):
    # the reader holds a batch of rows as columns: 4096 blocks of megabytes are more than an executor's memory
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", {}
    before, kept = spark.conf.get(key), lexical.written

    def written(df, label):
        seen[label] = int(spark.conf.get(key))
        return kept(df, label)

    monkeypatch.setattr(lexical, "written", written)
    rows, items = corpus(7, 30)
    assert found(spark, docs, rows, items) == plain(rows, items)
    assert {seen[x] for x in ("lexical-index", "lexical-df", "lexical-best")} == {4} and spark.conf.get(key) == before
