"""What of the queries passes through the driver does not grow with the number of blocks."""

import random

import pytest

from docspark.llm import topk
from tests.llm.test_topk import brute, run


@pytest.fixture()
def small_broadcasts(spark):
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 << 20))
    yield
    spark.conf.set(key, before)


def test_queries_are_sent_once_and_not_once_a_block(spark, monkeypatch, small_broadcasts):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)  # 60 queries in 300 blocks: 35 KB, or 10 MB if each block has its copy
    assert run(df) == brute(rows, 5)


def test_rounds_do_not_matter(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6 + i % 2)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 400, 7)]  # copies, for ties over blocks
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 9)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "ROUND_BYTES", 500, raising=False)
    made = []
    monkeypatch.setattr(topk, "written", lambda df, label, f=topk.written: made.append(label) or f(df, label))
    assert run(df) == brute(rows, 5)
    assert made.count("topk-best") > 1


def test_a_bound_drops_only_what_does_not_reach_it():
    import numpy as np

    x = np.floor(np.random.default_rng(9).normal(size=(500, 32)) * 32).astype(np.int64)
    index, ids = topk.ImpactIndex(x), np.arange(500)
    for q in x[::50]:
        at, score = index.top(q, 5, ids)
        for least in (score[0] + 1, score[2], score[4] - 1):
            got = [p for p in zip(*index.top(q, 5, ids, -1, float(least))) if p[1] >= least]
            assert got == [p for p in zip(at, score) if p[1] >= least]
