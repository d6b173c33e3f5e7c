"""Benchmark documents, corpora in parts, and picture headers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docspark import parse_contents
from docspark.functions.media import mime_type, picture_size
from docspark.operators import export
from docspark.sources import corpus
from docspark.sources.corpus import Part, in_order, line_of, read_corpus, read_manifest, write_corpus


def corpus_text(path):
    """The whole that the parts make up."""
    manifest = read_manifest(path)
    opening, closing = {"object": ("{\n", "\n}\n"), "list": ("[\n", "\n]\n")}[manifest["form"]]
    parts = [(path + "/" + p["file"], p) for p in manifest["parts"]]
    text = opening.encode() + b",\n".join(open(f, "rb").read() for f, _ in parts) + closing.encode()
    assert manifest["bytes"] == len(text) and all(os.path.getsize(f) == p["bytes"] for f, p in parts)
    return text


@pytest.fixture()
def several_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("form", ["object", "list"])
def test_a_corpus_is_one_text(spark, tmp_path, form, several_parts):
    rows = [(f"n{i:03d} é\"", json.dumps({"i": i, "t": "a\nb " * (i % 9)}, indent=i % 3, ensure_ascii=False)) for i in range(200)] + [("zz", None)]
    at = str(tmp_path / "c")
    write_corpus(spark.createDataFrame(rows, "name string, content string").repartition(5), at, form)
    told, want = json.loads(corpus_text(at)), {n: json.loads(c or "null") for n, c in rows}
    assert told == (want if form == "object" else list(want.values()))
    text = corpus_text(at)
    got = read_corpus(spark, at).orderBy("document").collect()
    assert [r.document for r in got] == list(range(201)) and len(read_manifest(at)["parts"]) > 1
    for r, (name, content) in zip(got, rows):
        assert r.name == (name if form == "object" else None) and json.loads(r.content) == want[name]
        assert text[r.start : r.start + r.length] == line_of(name, content, form)


def test_nothing_and_repeated_names(spark, tmp_path):
    write_corpus(spark.createDataFrame([], "name string, content string"), str(tmp_path / "none"))
    assert json.loads(corpus_text(str(tmp_path / "none"))) == {} and read_corpus(spark, str(tmp_path / "none")).count() == 0
    write_corpus(spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "1")], "name string, content string"), str(tmp_path / "same"), "list")
    assert json.loads(corpus_text(str(tmp_path / "same"))) == [1, 1, 2]
    with pytest.raises(Exception, match="form"):
        write_corpus(spark.createDataFrame([], "name string, content string"), str(tmp_path / "odd"), "other")


def test_a_file_for_each_document(spark, tmp_path):
    rows = [(f"d{i}", json.dumps({"i": i})) for i in range(20)]
    write_corpus(spark.createDataFrame(rows, "name string, content string"), str(tmp_path), "files")
    assert all(json.loads((tmp_path / f"{n}.json").read_text()) == json.loads(c) for n, c in rows)
    assert read_manifest(str(tmp_path))["documents"] == 20


def test_only_what_was_told_is_in_the_manifest():
    parts = [Part(2, "c", 1, 10, "x", "x"), Part(0, "a", 2, 30, "a", "b"), Part(1), None]
    made = in_order(parts, "list")
    assert [(p["file"], p["start"], p["first_document"]) for p in made["parts"]] == [("a", 2, 0), ("c", 34, 2)]
    assert (made["documents"], made["bytes"]) == (3, 47)


def test_prefix_sums(spark):
    rows = [(i, [(j * 7) % 11 for j in range(i)]) for i in (0, 1, 2, 3, 8, 9, 100)]
    got = spark.createDataFrame(rows, "i int, a array<long>").select("a", export.prefix_sums(F.col("a")).alias("s")).collect()
    assert all(r.s == [sum(r.a[: j + 1]) for j in range(len(r.a))] for r in got)


def test_a_benchmark_document_holds_everything(spark):
    blocks = [
        {"type": "title", "text": "Top", "text_level": 2}, {"type": "table", "table_body": "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "page_idx": 1, "bbox": [1, 2, 3, 4]},
        {"type": "image", "page_idx": 1}, {"type": "text", "text": "é\"", "page_idx": 1},
    ]
    df = spark.createDataFrame([("k", "/in/a b.pdf", "ab", json.dumps(blocks)), ("e", "/in/e.pdf", "cd", "[]")], "doc_key string, file_path string, file_sha256 string, content string")
    outputs = parse_contents(df)
    got = {r.name: json.loads(r.json) for r in export.bench_documents(outputs, "v1").collect()}
    doc = got["a b"]
    assert doc["source"] == {"doc_id": "a b", "filename": "a b.pdf", "mime_type": "application/pdf", "sha256": "ab", "page_count": 2, "language": "en"}
    assert (doc["schema_version"], doc["parser_version"]) == ("1.0.0", "v1")
    assert doc["pages"] == [{"page_index": i, "width": 595.0, "height": 842.0, "rotation": 0} for i in range(2)]
    assert [(e["type"], e["text"], e["char_span"]) for e in doc["elements"]] == [
        ("heading", "Top", [0, 3]), ("table", "| a | b |\n| --- | --- |\n| c |", [4, 33]), ("figure", "", [34, 34]), ("paragraph", "é\"", [35, 37]),
    ]
    assert doc["elements"][0]["level"] == 2 and doc["elements"][1]["bbox"] == {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0} and "bbox" not in doc["elements"][0]
    assert doc["elements"][1]["content"]["rows"] == 2 and len(doc["elements"][1]["content"]["cells"]) == 4 and doc["elements"][2]["content"] == {"kind": "figure", "alt_text": ""}
    assert got["e"]["pages"] == got["e"]["elements"] == [] and [w["code"] for w in got["e"]["warnings"]] == ["mineru_failed"]
    plan = export.bench_documents(spark.createDataFrame(outputs.collect(), outputs.schema))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def jpeg(*segments, end=b"\xff\xc0\x00\x11\x08\x00\x20\x00\x30\x03"):
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + (len(s) + 2).to_bytes(2, "big") + s for s in segments) + end


def test_picture_headers(spark):
    big = b"MM\x00*" + (8).to_bytes(4, "big") + b"\x00\x02" + b"\x01\x00\x00\x03\x00\x00\x00\x01\x00\x07\x00\x00" + b"\x01\x01\x00\x04\x00\x00\x00\x01\x00\x00\x00\x09"
    cases = {
        "plain": (jpeg(b"x" * 10), (48, 32)), "many": (jpeg(*[b"y" * (i % 50) for i in range(300)]), (48, 32)), "large": (jpeg(b"z" * 65_000, b"z" * 65_000), (48, 32)),
        "table before": (b"\xff\xd8\xff\xc4\x00\x05abc" + jpeg()[2:], (48, 32)), "fill": (b"\xff\xd8\xff\xff\xff\xe0\x00\x02\xff\x01" + jpeg()[2:], (48, 32)),
        "scan first": (jpeg(end=b"\xff\xda\x00\x02" + jpeg()[2:]), None), "cut": (jpeg(b"x" * 10)[:-8], None), "no length": (b"\xff\xd8\xff\xe0\x00\x00" + b"\xff" * 50, None),
        "tiff": (big, (7, 9)), "tiff without": (big[:8] + b"\x00\x00", None), "tiff cut": (big[:6], None), "png cut": (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00", None),
        "zero": (b"GIF89a\x00\x00\x01\x00", None), "empty": (b"", None), "text": (b"hello", None), "null": (None, None),
    }
    df = spark.createDataFrame([(k, c) for k, (c, _) in cases.items()], "k string, c binary").select("k", picture_size(F.col("c")).alias("s"), export.picture_page(F.col("c")).alias("p"))
    got = {r.k: r for r in df.collect()}
    assert {k: (r.s.width, r.s.height) if r.s else None for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert (got["cut"].p[0].width, got["cut"].p[0].height, got["tiff"].p[0].width) == (1700.0, 2200.0, 7.0)


def test_mime_types(spark):
    df = spark.createDataFrame([("/a/b.PDF",), ("c.tiff",), ("d",), ("e.docx",)], "p string")
    assert [r[0] for r in df.select(mime_type(F.col("p"))).collect()] == ["application/pdf", "image/tiff"] + ["application/octet-stream"] * 2


def test_a_corpus_is_written_some_bytes_at_once(spark, tmp_path, monkeypatch):
    """However long the contents are, a task is handed a few MB of them at once, and the driver samples no whole content."""
    seen = tmp_path / "seen"
    before = spark.conf.get(corpus.ARROW_BYTES)

    class Watched(corpus.CorpusWriter):
        def write(self, iterator):
            def told():
                for batch in iterator:
                    with open(seen, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            return super().write(told())

    class Source(corpus.Corpus):
        def writer(self, schema, overwrite):
            return Watched(self.options["path"], "list")

    ranges = []
    by_range = type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, *by: ranges.append(self.select(*by)) or by_range(self, *by))
    monkeypatch.setattr(corpus, "Corpus", Source)
    rows = spark.range(0, 30, 1, 1).select(F.format_string("n%02d", F.col("id") % 5).alias("name"), F.concat(F.lit('"'), F.repeat(F.lit("x"), 1_000_000 + F.col("id").cast("int")), F.lit('"')).alias("content"))
    write_corpus(rows, str(tmp_path / "c"))
    sizes = [int(n) for n in seen.read_text().split()]
    assert sum(sizes) > 30_000_000 and max(sizes) < 6_000_000
    assert max(len(v or "") for r in ranges[0].collect() for v in r) <= corpus.FIRST_SIGNS
    assert spark.conf.get(corpus.ARROW_BYTES) == before
    contents = json.loads(corpus_text(str(tmp_path / "c")))
    assert [len(c) - 1_000_000 for c in contents] == [i for k in range(5) for i in range(k, 30, 5)]
