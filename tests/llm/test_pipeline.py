import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from docspark.llm.common import table
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_quality_rules import brute as counts
from tests.llm.test_secrets import PATTERNS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """Each stage's input and output."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in p.STAGES:
        got = p.written(stage(spark, docs, SF), "test-pipeline")
        out.append((docs, got))
        docs = got
    return out


def rows(df):
    return {d.doc_id: d for d in df.collect()}


def test_stages_have_the_documents_columns(kept):
    assert len(p.STAGES) == 5 and all(g.columns == p.COLUMNS for _, g in kept[:-1])
    sizes = [g.count() for _, g in kept[:-1]]
    assert 1000 > sizes[0] > sizes[1] > sizes[2] == sizes[3] > 300


def test_rules_stage(kept):
    before, after = map(rows, kept[0])
    for i, d in before.items():
        n, _, _, _, repeat = counts(d.text)
        assert (i in after) == (n >= 50 and 100 * repeat <= 50 * n)  # no host of this table fails
        assert i not in after or after[i] == d


def test_classifier_stage_keeps_good_documents(spark, kept):
    before, after = map(rows, kept[1])
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.doc_id in before}
    assert all(i in after for i, q in labels.items() if q == 1) and sum(i in after for i, q in labels.items() if q == 0) < 5


def test_join_stage_keeps_one_of_each_group(kept):
    before, after = map(rows, kept[2])
    want = groups({i: d.text for i, d in before.items()}, 5, 80, 100)
    assert set(after) == {c for _, c in want.values()}


def test_secret_stage_masks_live_values_only(kept):
    before, after = map(rows, kept[3])
    changed = 0
    for i, d in before.items():
        if d.text == after[i].text:
            assert d.n_chars == after[i].n_chars
            continue
        changed += 1
        assert "<secret:" in after[i].text and after[i].n_chars == len(after[i].text)
        for kind, pattern, group, least in PATTERNS[1:]:
            assert not [m for m in pattern.finditer(after[i].text) if len(m[group]) >= least]
    assert changed > 3


def test_last_stage_packs_every_document_whole(kept):
    docs, pieces = rows(kept[4][0]), kept[4][1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {}
    for r in pieces:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tokenizer.encode(d.text, add_special_tokens=False).ids) + 1 for i, d in docs.items()}
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sum(used.values()) / 1024 + 1


def test_odd_rows(spark, docs):
    good = " ".join(f"word{i} of{i}" for i in range(60))
    token = "token = Zx9qwertyuiop123"
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good + " more"), (4, good + f" {token} end"), (4, "other " + good + f" {token}")]
    df = docs(rows).select("*").drop("n_words")
    rules = p.apply_quality_rules(spark, df, SF)
    assert rules.columns == p.COLUMNS and sorted(str(r.doc_id) for r in rules.collect()) == ["3", "3", "4", "4", "None"]
    assert p.apply_quality_classifier(spark, df, SF).count() <= len(rows)
    assert p.keep_one_of_each_group(spark, rules, SF).count() >= 1
    masked = p.mask_live_secrets(spark, rules, SF).collect()
    assert len(masked) == 5 and sum("<secret:assign>" in r.text for r in masked) == 2 and not any(token in r.text for r in masked)
    assert p.pack(spark, rules, SF).count() == 5
    for _, stage in p.STAGES:
        assert stage(spark, docs([]), SF).count() == 0


def test_texts_without_a_live_secret_are_not_shuffled(spark):
    # all texts were sorted by their keys for the few that change
    live = "password=Zq8sLm2Xw9Kd"
    docs = spark.createDataFrame([(1, f"a {live} b", "en", "x", 26), (2, "plain", "en", "x", 5), (None, None, "de", "y", 0), (2, "plain", "en", "x", 5), (3, live, "fr", "z", 21)], p.table(spark, SF, "documents").select(*p.COLUMNS).schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = p.mask_live_secrets(spark, docs, SF)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.lstrip().startswith("Union") and plan.count("bitmap_construct_agg") == 2
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in got.collect() if r.text) == [(1, "a <secret:assign> b", 19), (2, "plain", 5), (2, "plain", 5), (3, "<secret:assign>", 15)]
    assert [r for r in got.collect() if r.text is None] == [(None, None, "de", "y", 0)]
