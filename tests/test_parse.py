"""Files to outputs with engines that are made up."""

import json

import pytest
from pyspark.sql import functions as F

from docspark import EnrichmentConfig, parse, parse_batch, parse_contents, render_markdown
from docspark.plans.batch import throughput
from docspark.plans.cache import ResultCache
from docspark.sources.engines import Cascade, CommandEngine, page_words, run_engine
from docspark.streaming.arrivals import arriving_files, gated_texts

BLOCKS = [
    {"type": "title", "text": "Hello", "text_level": 2, "page_idx": 0}, {"type": "text", "text": "some words of a body", "page_idx": 0}, None,
    {"type": "table", "table_body": "<table><tr><td>cells of words</td></tr></table>", "page_idx": 2}, {"type": "image", "page_idx": 2},
]


class Fake:
    def run(self, files):
        if any(b == b"bad" for _, b in files.values()):
            raise RuntimeError("broken file")
        return {k: json.dumps([] if b == b"empty" else BLOCKS) for k, (_, b) in files.items()}


class Client:
    def call(self, image, prompt, mode):
        if mode == "image":
            raise RuntimeError("no")
        return {"description": f"{mode} told"}


@pytest.fixture()
def paths(tmp_path):
    for name, content in {"a[1].pdf": b"x", "b.txt": b"y", "bad.png": b"bad", "e.png": b"empty"}.items():
        (tmp_path / name).write_bytes(content)
    return [str(tmp_path / n) for n in ("a[1].pdf", "b.txt", "none.pdf", "bad.png", "a[1].pdf", "e.png")]


def test_batch_keeps_order_and_never_raises(spark, paths, tmp_path):
    config = EnrichmentConfig(enabled=True)
    cache = str(tmp_path / "cache")
    for turn in range(2):
        rows = parse_batch(spark, paths, config, Fake, cache_path=cache, client=Client).collect()
        assert [r.file_path for r in rows] == paths and [r.input_pos for r in rows] == list(range(6))
        assert [[w.code for w in r.warnings if w.code != "quality_gate_escalation"] for r in rows] == [[], ["unsupported_type"], ["file_not_found"], ["mineru_failed"], [], ["mineru_failed"]]
        assert rows[0].page_count == 3 and [p.element_count for p in rows[0].pages] == [2, 0, 2] and rows[0].elements == rows[4].elements
        assert [(e.type, e.description, e.is_enriched) for e in rows[0].elements] == [("heading", "", False), ("text", "", False), ("table", "table told", True), ("image", "", False)]
        assert rows[2].file_sha256 == "" and len(rows[0].file_sha256) == 64
    kept = ResultCache(spark, cache)
    assert kept.table().count() == 1
    kept.invalidate(kept.table().select("cache_key"))
    assert kept.table().count() == 0 and ResultCache(spark, str(tmp_path / "nowhere")).table().count() == 0


def test_batch_equals_single_and_markdown(spark, paths):
    one = parse(spark, paths[0], None, Fake)
    many = parse_batch(spark, paths[:2], None, Fake).drop("input_pos")
    assert one.collect()[0] == many.collect()[0]
    md = {r.file_path: r.markdown for r in render_markdown(many).collect()}
    assert md[paths[0]] == "## Hello\n\nsome words of a body\n\n| cells of words |\n| --- |\n" and md[paths[1]] == "\n"
    stats = throughput(many, 4.0).first()
    assert (stats.documents, stats.pages, stats.failed, stats.seconds_per_document) == (2, 3, 1, 2.0)


def test_engines_that_are_missing_are_warnings(spark, paths):
    for parser, code in (("mineru", "mineru_failed"), ("docling", "docling_failed")):
        got = parse(spark, paths[0], EnrichmentConfig(parser=parser)).first()
        assert [w.code for w in got.warnings] == [code] and got.page_count == 0


def test_bad_page_numbers_fail_their_document(spark):
    rows = [("a", "a.pdf", "1", json.dumps([{"text": "t", "page_idx": "x"}])), ("b", "b.pdf", "2", json.dumps([{"text": "t", "type": "text"}]))]
    got = {r.doc_key: r for r in parse_contents(spark.createDataFrame(rows, "doc_key string, file_path string, file_sha256 string, content string")).collect()}
    assert [w.code for w in got["a"].warnings] == ["mineru_error"] and got["b"].page_count == 1


def test_passes_and_cascade(spark):
    df = spark.createDataFrame([(f"k{i}", f"/x/f{i % 2}.pdf", b"bad" if i == 4 else b"ok") for i in range(9)], "doc_key string, path string, content binary")
    got = {r.doc_key: r for r in run_engine(df, Fake, 4).collect()}
    assert len(got) == 9 and got["k4"].error == "broken file" and got["k3"].content == json.dumps(BLOCKS)

    class Empty:
        def run(self, files):
            return {}

    assert Cascade(Empty(), Fake()).run({"k": ("n", b"x")}) == {"k": json.dumps(BLOCKS)}
    with pytest.raises(RuntimeError):
        Cascade(Empty(), Fake()).run({"k": ("n", b"bad")})
    made = CommandEngine(["sh", "-c", "mkdir -p {target} && echo '[1]' > {target}/x_content_list.json"]).run({"k": ("n.pdf", b"")})
    assert json.loads(made["k"]) == [1]


def test_docling_with_enrichment_asked(spark):
    tree = json.dumps({"body": {"children": ["#/texts/0"]}, "texts": [{"label": "paragraph", "text": "words of a text"}]})
    df = spark.createDataFrame([("k", "f.docx", "ab", tree)], "doc_key string, file_path string, file_sha256 string, content string")
    got = parse_contents(df, EnrichmentConfig(parser="docling", enabled=True)).first()
    assert [w.code for w in got.warnings] == ["enrichment_not_supported"] and got.elements[0].text == "words of a text"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, content in enumerate((b"one", b"one", b"two")):
        (tmp_path / "in" / f"{i}.png").write_bytes(content)
    q = arriving_files(spark, str(tmp_path / "in"), EnrichmentConfig()).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrived").count() == 2
    got = gated_texts(spark.createDataFrame([("fine words here",), ("a1 b2 c3",), ("",)], "text string"))
    assert [r.quality_decision for r in got.collect()] == ["keep", "promote_to_vlm", "keep"]
    assert got.where(F.col("quality_decision") == "keep").count() == 2


def test_outputs_are_put_in_their_places_without_what_nobody_asked_for(spark, paths):
    told = [F.col("page_count"), F.size("elements").alias("n")]
    whole = parse_batch(spark, paths, None, Fake)
    got = parse_batch(spark, paths, None, Fake, columns=told)
    assert got.collect() == whole.select("input_pos", *told).collect() and got.count() == len(paths)
    shuffled = [line for line in got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n") if "Exchange" in line.split("\n")[0]]
    assert shuffled and not any("elements" in line for line in shuffled)


def test_what_goes_along_with_a_file(spark, monkeypatch):
    import sys
    from types import SimpleNamespace

    class Pages(list):
        def __init__(self, content):
            super().__init__(SimpleNamespace(get_textpage=lambda t=t: SimpleNamespace(get_text_range=lambda: t)) for t in content.decode().split("\n")[1:])

    monkeypatch.setitem(sys.modules, "pypdfium2", SimpleNamespace(PdfDocument=Pages))
    assert page_words(b"%PDF-1\na b\n\nc") == [2, 0, 1] and page_words(b"a b\nc") is None
    df = spark.createDataFrame([("a", "a.pdf", b"ok", None, 1), ("b", "b.pdf", None, "gone", 2), ("c", "c.pdf", b"bad", None, 3)], "doc_key string, path string, content binary, error string, n long")
    got = {r.doc_key: r for r in run_engine(df, Fake, 2, keep=("n",), layers=True).collect()}
    assert [(r.n, r.error, r.content is None, r.layer) for _, r in sorted(got.items())] == [(1, None, False, None), (2, "gone", True, None), (3, "broken file", True, None)]


def test_a_layer_in_the_row_is_that_of_joined_rows(spark):
    words = json.dumps([{"type": "text", "text": "one two three", "page_idx": i} for i in range(3)])
    rows = spark.createDataFrame([("a", "a.pdf", "1", words, [9, 90, 900]), ("b", "b.pdf", "2", words, None)], "doc_key string, file_path string, file_sha256 string, content string, layer array<bigint>")
    tokens = rows.select("doc_key", F.posexplode("layer").alias("page_idx", "n_tokens"))
    joined = {r.doc_key: r for r in parse_contents(rows.drop("layer"), layer_tokens=tokens).collect()}
    assert {r.doc_key: r for r in parse_contents(rows).collect()} == joined
    assert [p.vlm_used for p in joined["a"].pages] == [False, True, True] and not any(p.vlm_used for p in joined["b"].pages)
