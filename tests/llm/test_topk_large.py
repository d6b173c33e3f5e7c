"""Components of any finite size take part, and their scores are exact."""

import pytest

from docspark.llm import topk
from tests.llm.test_topk import brute, run

SCHEMA = "vec_id long, embedding array<double>"


def test_components_of_1e15_and_more(spark):
    rows = [(i, [float((i * 37) % 11 - 5) / 256, float(i % 5) / 256, (1e15 + i if i % 3 else 1.0)]) for i in range(1, 90)]
    rows += [(0, [3 / 256, -1 / 256, 1 / 256]), (100, [2e15, 1 / 256, 0.0]), (150, [0.0, 0.0, 7 / 256])]
    rows = [(i, v) for i, v in rows if i != 50]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows, 5) and max(abs(s) for *_, s in got) > 2**53


def test_what_does_not_fit_is_an_error_only_where_it_counts(spark):
    low = [(0, [1e15, 1.0]), (1, [-1e15, 0.0])] + [(i, [0.0, float(i)]) for i in range(2, 9)]
    assert run(spark.createDataFrame(low, SCHEMA)) == brute(low, 5)
    for rows in ([(0, [1e15]), (1, [1e15])], [(0, [1.0]), (1, [1e30])]):
        with pytest.raises(Exception, match="does not fit a 64-bit integer"):
            run(spark.createDataFrame(rows, SCHEMA))
    assert topk.MOST == 2**63 - 1


def test_components_beyond_64_bits_take_part(spark):
    rows = [(0, [-1.0, 3.0]), (50, [0.0, -2.0]), (100, [-1e300, 0.0]), (150, [0.0, 1e304])]
    rows += [(i, [float(i), 1.0]) for i in range(1, 20)] + [(i, [1e17 * i, float(i)]) for i in range(20, 26)] + [(30, [1e304, 0.0]), (31, [1e300, -5.0]), (32, [0.0, 0.0])]
    rows = [(i, v) for i, v in rows if i not in (100, 150)] + [(i, [0.0, i / 256]) for i in (100, 150)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows, 5) and {q for q, *_ in got} == {0, 50, 100, 150}


def test_blocks_are_sized_by_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 256)
    rows = [(i, [float((i * j) % 13 - 6) for j in range(64)]) for i in range(120)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 5)
    index = topk.ImpactIndex(topk.whole(topk_matrix(rows), 256.0))
    assert index.reach.shape[1] <= 256 // 64 + 2


def topk_matrix(rows):
    import numpy as np

    return np.array([v for _, v in rows])
