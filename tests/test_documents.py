"""Documents as one row: the arrays agree with rows of elements and pages, and with plain Python."""

import json
import random

from pyspark.sql import functions as F

from docspark import EnrichmentConfig, parse_contents
from docspark.functions.text import two_decimals
from docspark.operators import documents as D
from docspark.operators import elements as E
from docspark.operators.gate import evaluate_pages

SCHEMA = "doc_key string, file_path string, file_sha256 string, content string, pages int, elements string, text string"


def contents(spark, of):
    rows = [(k, f"{k}.pdf", f"sha{k}", c if c is None or isinstance(c, str) else json.dumps(c), 7, "e", "t") for k, c in of.items()]
    return spark.createDataFrame(rows, SCHEMA)


def blocks(rng):
    made = []
    for _ in range(rng.randint(0, 25)):
        kind = rng.choice(["text", "title", "list", "table", "footer", "image", "odd"])
        b = {"type": kind, "page_idx": rng.choice([0, 0, 1, 4, 9, -1]), "text": rng.choice(["", "some words", "a1 b2 c3", "xxxxxxxxx", "x" * 3000, " "])}
        if kind == "table":
            b |= {"text": "", "table_body": rng.choice(["", "<table><tr><td>a</td></tr></table>", "no table", None])}
        if rng.random() < 0.1:
            b["bbox"] = rng.choice([[1, "x"], [1, 2, 3, 4]])
        made.append(rng.choice([b, b, b, b, "no block", 3]))
    return made


def test_arrays_equal_rows(spark):
    rng = random.Random(4)
    of = {f"d{i}": blocks(rng) for i in range(40)}
    df = contents(spark, of)
    layer = spark.createDataFrame([(f"d{i}", p, rng.choice([10, 60, 4000])) for i in range(0, 40, 2) for p in (0, 4, 9, 11)], "doc_key string, page_idx int, n_tokens bigint")
    rows = E.explode_blocks(df).join(df.select("doc_key", "file_sha256"), "doc_key")
    rows = E.route_blocks(rows, F.col("file_sha256")).cache()
    want_pages = {(p.doc_key, p.page_idx): (p.element_count, p.quality_decision, p.vlm_used, p.reason, p.layer, p.coverage) for p in evaluate_pages(rows, layer).collect()}
    docs = D.with_elements(df.select("doc_key", "file_sha256", D.routed_blocks(F.col("content")).alias("b")), "b", "file_sha256")
    docs = D.with_decisions(D.with_pages(docs).join(D.dense_layer(layer), "doc_key", "left"), F.col("layer"))
    got = docs.collect()
    assert {(d.doc_key, p.page_idx): (p.element_count, p.quality_decision, p.vlm_used, p.reason, p.layer, p.coverage) for d in got for p in d.pages} == want_pages
    names = ("seq", "block_pos", "element_id", "type", "text", "bbox", "page_idx")
    want = sorted((r.doc_key, *(r[c] for c in names)) for r in rows.collect())
    assert sorted((d.doc_key, *(e[c] for c in names)) for d in got for e in d.elements) == want and want


def test_documents_that_fail_and_odd_rows(spark):
    fine = [{"type": "text", "text": "plain words of a text"}]
    of = {"null": None, "empty": "", "none": [], "no": {"a": 1}, "page": [*fine, {"page_idx": "x"}], "far": [{"page_idx": 1_000_000}], "gone": [{"page_idx": -1}], "fine": fine, "held": {"content_list": fine}}
    got = {r.doc_key: r for r in parse_contents(contents(spark, of)).collect()}
    codes = {k: [w.code for w in r.warnings] for k, r in got.items()}
    assert codes == {k: ["mineru_failed"] for k in ("null", "empty", "none", "no")} | {"page": ["mineru_error"], "far": ["mineru_error"], "gone": [], "fine": [], "held": []}
    assert {k: (r.page_count, len(r.pages), len(r.elements)) for k, r in got.items() if r.elements or r.pages} == {"fine": (1, 1, 1), "held": (1, 1, 1)}
    assert parse_contents(contents(spark, {"a": fine}).limit(0)).collect() == []
    twice = contents(spark, {"a": fine})
    assert len(parse_contents(twice.unionByName(twice)).collect()) == 2


def test_two_decimals_as_python(spark):
    rng = random.Random(1)
    values = [k / 1000 for k in range(300)] + [a / b for b in range(50, 400, 7) for a in range(b // 4)] + [rng.random() * 0.29 for _ in range(500)] + [0.125, 1e-12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.s == f"{r.v:.2f}" for r in df.select("v", two_decimals(F.col("v")).alias("s")).collect())


def test_no_exchange(spark):
    plan = D.parsed_documents(contents(spark, {"a": []}), EnrichmentConfig())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_counts_of_elements_add_up_to_pages(spark):
    rng, parts = random.Random(9), ["word", "Über", "7", "1,234.5", "a7", "7é", "x-y", "-", "²", "５", "\x01", "\xa0", " ", " ", "\n", "\r", "\x1c", "b" * 8, "1" * 7, "bbbb", "𝒜1"]
    text = lambda: "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\t"]) for _ in range(rng.randrange(12)))
    kinds = ["text", "title", "list", "footer", "image", "odd"]
    of = {f"d{i}": [{"type": rng.choice(kinds), "page_idx": rng.choice([0, 0, 1, 3]), "text": text()} for _ in range(rng.randrange(9))] for i in range(150)}
    df = contents(spark, of)
    names = ("page_idx", "element_count", "extracted", "garbled_token_ratio", "mean_word_length", "dict_hit_rate", "has_repeated_char_run", "ascii_printable_ratio", "failing_signals", "reason")
    rows = E.route_blocks(E.explode_blocks(df)).cache()
    want = {(p.doc_key, *(str(p[c]) for c in names)) for p in evaluate_pages(rows).collect()}
    docs = D.with_elements(df.select("doc_key", D.routed_blocks(F.col("content")).alias("b")), "b", "doc_key")
    got = D.with_decisions(D.with_pages(docs)).select("doc_key", "pages").collect()
    assert {(d.doc_key, *(str(p[c]) for c in names)) for d in got for p in d.pages} == want and want


def test_a_text_is_gone_through_once(spark):
    # words were counted by a search of their own, letters found again in each page's text, and each id hashed six times
    plan = D.parsed_documents(contents(spark, {"a": []}), EnrichmentConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha(") + plan.count("sha1(") == 1 and plan.count(r"\p{L}]++") == 1 and "rtrim(" not in plan
