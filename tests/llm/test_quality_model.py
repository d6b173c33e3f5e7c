import zlib

import numpy as np

from docspark.llm.common import table
from docspark.llm.quality_model import BITS, Ftrl, features, fit, probability, quality_scores, score


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in quality_scores(df, labels).collect()}
    assert len(got) == df.count()
    right = [got[r.doc_id].predicted == r.quality for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, sf):
    df, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    assert fit(df, labels) == fit(df.selectExpr("doc_id", "text", "'x' as lang", "1 as _label").repartition(3), other)


def test_scores_are_sparse_dot_products():
    model = Ftrl()
    for t, y in (("good words here", 1), ("BAD!! BAD!!", 0)) * 20:
        for slots, values in features([t]):
            model.learn(slots, values, y)
    w = model.weights()
    assert w.shape == (1 << BITS,) and (w != 0).sum() < 40
    good, bad = (probability(float(w[s] @ v)) for s, v in features(["good words here", "BAD!! BAD!!"]))
    assert good > 0.7 and bad < 0.3


def test_features_do_not_depend_on_the_batch():
    texts = ["a b c", None, "", "x", "a b c " * 400, "é 1 A!"]
    for one, many in zip([features([t])[0] for t in texts], features(texts)):
        assert (one[0] == many[0]).all() and np.allclose(one[1], many[1])


def test_edges(spark, docs):
    df = docs([(1, None), (2, ""), (2, ""), (None, "some words"), (3, "w " * 30000)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality_scores(df, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 1), (3, 0)], "doc_id bigint, quality int")
    assert len(quality_scores(df, odd).collect()) == 5
    assert score(docs([]), bytes(4 << BITS)).collect() == [] and fit(docs([]), odd) == bytes(4 << BITS)


def test_training_equals_a_plain_version():
    import math
    import random

    from docspark.llm.quality_model import ALPHA, BETA, L1, L2

    rng, z, n, model = random.Random(4), {}, {}, Ftrl()
    for _ in range(150):
        text = " ".join(rng.choice(["Alpha", "beta", "12", "x!", "gamma"]) for _ in range(rng.randint(0, 9)))
        label = int("Alpha" in text)
        ((slots, values),) = features([text])
        seen = [(int(i), float(v)) for i, v in zip(slots, values)]
        w = {i: 0.0 if abs(z.get(i, 0.0)) <= L1 else -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2) for i, _ in seen}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in seen)))
        old = {i: n.get(i, 0.0) for i, _ in seen}
        for i, v in seen:
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old[i] + g * g) - math.sqrt(old[i])) / ALPHA * w[i]
            n[i] = n.get(i, 0.0) + g * g
        model.learn(slots, values, label)
    for i in z:
        assert abs(model.z[i] - z[i]) < 1e-9 and abs(model.n[i] - n[i]) < 1e-9
    assert np.count_nonzero(model.n) == len([i for i in n if n[i]])


def test_kept_columns_go_along(spark, docs):
    got = score(docs([(1, "a", "s"), (None, None, "t")]), bytes(4 << BITS), keep=("doc_id", "text", "source"))
    assert got.columns == ["doc_id", "text", "source", "held_out", "score", "predicted"]
    assert sorted((str(r.doc_id), r.text, r.source, r.score) for r in got.collect()) == [("1", "a", "s", 0.5), ("None", None, "t", 0.5)]
