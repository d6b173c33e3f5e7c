import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm.common import table
from docspark.llm.topk import ImpactIndex, top_k


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ok) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(df, k=5):
    return sorted(map(tuple, top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k).collect()))


def test_the_table(spark, sf):
    df = table(spark, sf, "embeddings")
    assert run(df) == brute([(r.vec_id, r.embedding) for r in df.collect()], 5)


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (100, [1.0, 2.0, 3.0]), (5, [2.0, 2.0, 2.0]), (150, []), (151, [])]
    rows += [(10 + i, [0.25, -0.75]) for i in range(9)] + [(7, [0.0, 0.0])] * 3 + [(None, [9.0, 9.0])]
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as score", "'x' as id", "2 as rank")
    assert run(df) == brute(rows, 5)
    assert run(spark.createDataFrame([], schema)) == []
    assert run(spark.createDataFrame([(0, [1.0])], schema)) == []


@pytest.mark.parametrize("seed", range(4))
def test_what_is_left_out_is_left_out_by_proof(seed):
    rng = np.random.default_rng(seed)
    n, dims = [(400, 16), (900, 64), (50, 3), (600, 8)][seed]
    x = np.floor(rng.normal(size=(n, dims)) * [40, 32, 5, 2][seed]).astype(np.int64)
    x[:20] = x[20]
    index, pruned = ImpactIndex(x), 0
    for q in x[:: max(1, n // 40)].astype(float):
        left = index.possible(q, 5)
        exact = x @ q
        assert set(np.flatnonzero(exact >= np.sort(exact)[-5])) <= set(left)
        pruned += n - len(left)
    assert seed == 2 or seed == 3 or pruned > 0


def test_very_large_components(spark):
    rows = [(i, [float((i * 37) % 11 - 5) * 10 ** (i % 7), float(i)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(df) == brute([(r.vec_id, r.embedding) for r in df.collect()], 5)


def test_blocks_do_not_matter(spark, monkeypatch):
    from docspark.llm import topk

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(230)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    assert run(df, 3) == brute(rows, 3)
