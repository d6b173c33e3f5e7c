"""Functions and operators on single cases."""

import json
import math
import os
import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from docspark import EnrichmentConfig, record_types
from docspark.functions import blocks as B
from docspark.functions import geometry, ids, media
from docspark.functions import text as T
from docspark.functions.python_only import description, table_to_markdown, tolerant_json
from docspark.operators import clients, context, docling, elements, enrich, export, gate, render
from docspark.operators.gate import with_signals
from docspark.sources import engines, files


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


ODD = "a\x1cb\x85c\xa0 d　e\n f"


def test_tokens_and_strip_are_pythons(spark):
    texts = [ODD, "", "  ", "x", "  a b\t", "​a"]
    assert each(spark, texts, T.tokens) == [t.split() for t in texts]
    assert each(spark, texts, T.strip) == [t.strip() for t in texts]


def test_tokens_of_content_and_garble(spark):
    good, bad = ["hello", "42", "$1,234.00", "(3.5%)", "10/12/2024", "été", "²"], ["a1b", "x!", "--", "", "1a", "don't"]
    assert all(each(spark, good, T.is_content_token)) and not any(each(spark, bad, T.is_content_token))
    assert each(spark, ["a1", "1a", "ab", "12", "é1"], T.is_garbled_token) == [True, True, False, False, False]
    assert each(spark, ["aaaaaaa", "aaaaaa", "\n" * 9, "\r" * 7, "x" + "." * 7], T.has_repeated_run) == [True, False, False, True, True]


def test_printable_ratio(spark):
    assert each(spark, ["ab", "a\n", "a b", "\xa0a", ""], T.printable_ratio) == [1.0, 0.5, 1.0, 0.5, 0.0]


def test_truncation(spark):
    assert each(spark, ["a  b", "a  b c", ""], lambda v: T.truncate_words(v, 2)) == ["a  b", "a b...", ""]


def test_thinking_and_answers(spark):
    raw = ["<THINK>x\ny</think> a ", "<thinking>q</thinking>b", "<think>open", "a<think>1</think>b<think>2</think>c"]
    assert each(spark, raw, T.strip_thinking) == ["a", "b", "<think>open", "abc"] == [clients.without_thinking(t) for t in raw]
    cases = {
        '{"description": " d "}': "d", '```json\n{"description": "d"}\n```': "d", 'So {"description": "d"} ok': "d", "plain": "plain", "": "",
        '{"error": "e"}': "", "[1]": "", "{bad} {\"description\": \"d\"}": '{bad} {"description": "d"}', '{"a": 1}': "",
    }
    for answer, want in cases.items():
        assert description(answer) == want, answer
    assert json.loads(tolerant_json("[1]")) == [1]


def test_uuid5(spark):
    names = ["abc:0:1", "", "é:3:4", "x" * 300]
    assert each(spark, names, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]


def test_media_and_pictures(spark):
    heads = [b"\xff\xd8\xff1", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"RIFF1234WEBP", b"RIFF1234WAVE", b"", b"x"]
    want = ["image/jpeg", "image/png", "image/gif", "image/gif", "image/webp", "image/png", "image/png", "image/png"]
    assert each(spark, heads, media.media_type, "binary") == want == [clients.media_type_of(h) for h in heads]
    uris = ["data:image/png;base64,aGVsbG8=", "aGVsbG8=", "aGVsbG8", "a", "", "data:,*aGVs bG8=", None]
    got = each(spark, uris, media.decoded_picture)
    assert [g.bytes and bytes(g.bytes) for g in got] == [b"hello", b"hello", None, None, b"", b"hello", None]
    large = spark.range(1).select(media.decoded_picture(F.expr(f"repeat('AAAA', {media.MAX_PICTURE // 3 + 1})")).alias("p")).first().p
    assert large.bytes is None and large.too_large


def test_geometry(spark):
    rows = spark.createDataFrame([(100.0, 100.0, 2.0, 10000), (100.0, 100.0, 1.0, 10000), (0.0, 5.0, 2.0, 10), (5.0, 5.0, 2.0, 0), (1e6, 1e6, 3.0, 100)], "w double, h double, s double, m long")
    got = [r.c for r in rows.select(geometry.clamped_scale(F.col("w"), F.col("h"), F.col("s"), F.col("m")).alias("c")).collect()]
    assert [g.clamped for g in got] == [True, False, False, False, True] and math.isclose(got[0].scale, 1.0) and got[3].scale == 2.0
    box = lambda *b: F.array(*[F.lit(float(x)) for x in b])
    one = lambda b: spark.range(1).select(geometry.region_pixels(b, F.lit(100.0), F.lit(2.0), F.lit(150), F.lit(200)).alias("p")).first().p
    assert tuple(one(box(10, 10, 50, 60))) == (20, 80, 100, 180) and tuple(one(box(-5, -5, 500, 500))) == (0, 0, 150, 200)
    assert one(box(10, 10, 10, 60)) is None and one(box(200, 0, 300, 50)) is None


TABLES = {
    "<table><tr><th>a|b</th><th>c\nd</th></tr><tr><td>1</td></tr></table>": "| a\\|b | c d |\n| --- | --- |\n| 1 |",
    "<TABLE><TR><TD>x &amp; <b>y</b></TD></TR>": "| x & y |\n| --- |",
    "<tr><td>no table</td></tr>": "", "<table></table>": "", "plain": "", "": "", "<table><tr></tr><tr><td></td></tr></table>": "|  |\n| --- |",
}


@pytest.mark.parametrize("html,want", TABLES.items())
def test_tables(html, want):
    assert table_to_markdown(html) == want


def routed(spark, blocks):
    contents = spark.createDataFrame([("d", json.dumps(blocks))], "doc_key string, content string")
    return elements.route_blocks(elements.explode_blocks(contents)).orderBy("seq").collect()


def test_routing(spark):
    got = routed(spark, [
        {"type": "title", "text": "T", "text_level": 9}, {"type": "title", "text": "U", "text_level": "x"}, {"type": "title", "text": "# V"}, None, "odd", 5,
        {"type": "text", "text": 0, "content": "c"}, {"type": "text", "text": 12345}, {"type": "Text"}, {"type": None, "text": True}, {},
        {"type": "table", "table_body": "<table><tr><td>1</td></tr></table>"}, {"type": "image", "bbox": [1, 2.5, 3, 4]}, {"type": "text", "bbox": "none", "text": "z"},
    ])
    assert [(r.type, r.text) for r in got] == [
        ("heading", "###### T"), ("heading", "# U"), ("heading", "# V"), ("text", "c"), ("text", "12345"), ("unknown", ""), ("unknown", "True"), ("unknown", ""),
        ("table", "| 1 |\n| --- |"), ("image", ""), ("text", "z"),
    ]
    assert got[9].bbox == [1.0, 2.5, 3.0, 4.0] and got[10].bbox == [] and [r.seq for r in got] == list(range(11))


def test_numbers_are_given_before_blocks_are_dropped(spark):
    got = routed(spark, [{"page_idx": 1, "text": "b"}, {"page_idx": 0, "text": "a"}, {"page_idx": 0, "bbox": [1, "x"]}, {"page_idx": -1, "text": "gone"}, {"page_idx": "1", "text": "c"}])
    assert [(r.seq, r.page_idx, r.text) for r in got] == [(0, 0, "a"), (2, 1, "b"), (3, 1, "c")]
    assert got[0].element_id == str(uuid.uuid5(uuid.NAMESPACE_OID, "d:0:0"))


def test_content_lists_may_be_wrapped_or_broken(spark):
    texts = ['{"content_list": [{"type": "text"}]}', "[]", "{", "null", '"x"', None]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_key string, content string")
    assert [r.doc_key for r in elements.explode_blocks(rows).collect()] == ["0"]


def test_aliases(spark):
    block = F.parse_json(F.lit('{"img_caption": "a", "image_caption": "b", "image_footnote": "c"}'))
    got = spark.range(1).select(*[B.aliased(block, n).cast("string").alias(n) for n in ("image_caption", "image_footnote")]).first()
    assert tuple(got) == ("a", "c")


def pages(spark, rows, layer=None):
    made = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_key string, seq int, page_idx int, type string, text string")
    tokens = layer and spark.createDataFrame([("d", p, n) for p, n in layer.items()], "doc_key string, page_idx int, n_tokens long")
    return gate.evaluate_pages(made, tokens).orderBy("page_idx").collect()


def test_gate(spark):
    words = "the quick brown fox jumps over a lazy dog"
    cases = [words, " ".join(f"a{i}" for i in range(30)), "a" * 10 + " word", "\x00" * 100, "a " * 100, "", "1 + 1 = 2 ! ? ; ="]
    got = pages(spark, [(i, "text", t) for i, t in enumerate(cases)])
    assert [g.quality_decision for g in got] == ["keep", *["promote_to_vlm"] * 4, "keep", "promote_to_vlm"]
    assert "garbled_token_ratio" in got[1].reason and "repeated_char_run" in got[2].reason and got[5].failing_signals == ["empty_text"] and got[5].layer is None
    got = pages(spark, [(0, "text", words), (2, "header", "x " * 99)], {0: 100, 2: 10})
    assert (got[0].layer, got[0].quality_decision) == (1, "promote_to_vlm") and got[1].element_count == 0 and got[2].quality_decision == "keep"
    told = gate.escalations(gate.evaluate_pages(
        spark.createDataFrame([("d", 0, 0, "text", words)], "doc_key string, seq int, page_idx int, type string, text string"),
        spark.createDataFrame([("d", 0, 100)], "doc_key string, page_idx int, n_tokens long"),
    )).first()
    assert told.message == "Page 0 escalated to VLM: coverage=0.09<0.3"


def test_block_and_page_context(spark):
    rows = [("d", i, i // 2, k, t) for i, (k, t) in enumerate([("text", "a"), ("image", "b"), ("title", "c"), ("text", ""), ("text", "e f g")])]
    df = spark.createDataFrame(rows, "doc_key string, block_pos int, page_idx int, type string, text string")
    assert [r.context for r in context.block_context(df, 2, 512).orderBy("block_pos").collect()] == ["c", "a\nc", "a\ne f g", "c\ne f g", "c"]
    assert {r.context for r in context.block_context(df, 0).collect()} == {""}
    assert [r.context for r in context.page_context(df, 3).orderBy("page_idx").collect()] == ["a\nc", "a c e...", "c e f..."]


def test_rendering(spark):
    rows = [
        ("heading", "T", "", False), ("heading", "## U", "", False), ("list_item", " x ", "", False), ("equation", "e", "", False), ("image", "alt", "seen", True),
        ("image", "alt", "", False), ("table", "raw", "told", True), ("table", "<table><tr><td>1</td></tr></table>", "told", True), ("footer", "f", "", False), ("unknown", "u", "", False), ("text", "", "", False),
    ]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_key string, seq int, type string, text string, description string, is_enriched boolean")
    want = "# T\n\n## U\n\n- x\n\n$$\ne\n$$\n\n> seen\n\n> told\n\n| 1 |\n| --- |\n"
    assert render.render_documents(df).first().markdown == want
    assert render.render_documents(df.where("type = 'footer'")).first().markdown == "\n"


def test_layout_tree(spark):
    tree = {
        "body": {"children": ["#/texts/0", {"$ref": "#/groups/0"}, "#/texts/abc", "#/texts/9", {"$ref": ""}, 7, "#/tables/0"]},
        "texts": [{"label": "paragraph", "orig": "", "text": "one", "prov": [{"page_no": 2, "bbox": {"l": 1, "b": 2, "r": 3, "t": 4}}]}, {"label": "title", "orig": "two", "prov": [{"page_no": 0}]}],
        "pictures": [{"image": {"uri": "data:image/png;base64,aGVsbG8="}, "prov": [], "bbox": [1, 2]}], "groups": [{"children": [{"$ref": "#/pictures/0"}, {"$ref": "#/texts/1"}]}],
        "tables": [{"caption": "cap", "data": [["é", 1]]}],
    }
    nodes = docling.explode_nodes(spark.createDataFrame([("d", json.dumps(tree)), ("e", "{"), ("f", "{}")], "doc_key string, content string"))
    got = docling.route_leaves(docling.walk(nodes)).orderBy("seq").collect()
    assert [(r.type, r.text, r.page_idx, r.bbox) for r in got] == [
        ("text", "one", 1, [1.0, 2.0, 3.0, 4.0]), ("image", "", 0, [1.0, 2.0]), ("unknown", "two", 0, []), ("table", 'cap\n[["\\u00e9", 1]]', 0, []),
    ]
    assert bytes(got[1].image_bytes) == b"hello" and not any(r.too_large for r in got)


def test_prompts(spark):
    text = spark.range(1).select(enrich.prompt("table", F.lit(""), F.lit("CELLS")).alias("p")).first().p
    assert "(none)" in text and "CELLS" in text and "%s" not in text
    block = F.parse_json(F.lit('{"latex": "L", "content": "C"}'))
    by = [spark.range(1).select(enrich.prompt_content(block, F.lit("equation"), b).alias("p")).first().p for b in ("process", "enrich")]
    assert by == ["L", "C"]
    assert clients.Client("bedrock").request(b"GIF87a", "p")["messages"][0]["content"][0]["source"]["media_type"] == "image/gif"
    assert "error" in clients.make_client(EnrichmentConfig()).call(None, "p", "text") or True


@pytest.mark.parametrize("bad", [{"context_window": 21}, {"context_window": -1}, {"max_context_tokens": 63}, {"parser": "x"}, {"vlm_backend": "y"}, {"table_mode": "z"}, {"context_window": True}])
def test_configuration_bounds(bad):
    with pytest.raises(ValueError):
        EnrichmentConfig(**bad)


def test_configuration_and_schema(spark):
    assert EnrichmentConfig().modalities == () and EnrichmentConfig(enabled=True, table=False).modalities == ("image", "equation")
    assert "docx" in EnrichmentConfig(parser="docling").suffixes and "docx" not in EnrichmentConfig().suffixes
    assert EnrichmentConfig().fingerprint() != EnrichmentConfig(do_ocr=False).fingerprint() and set(record_types()) == {"ElementRecord", "PageRecord", "WarningRecord", "ParserOutput"}


@pytest.mark.parametrize("value,want", [(None, 8), ("1", 1), ("0", 8), ("-2", 8), ("abc", 8), ("", 8), ("4", 4)])
def test_environment_counts(monkeypatch, value, want):
    monkeypatch.delenv("DOCSPARK_BATCH_SIZE", raising=False)
    if value is not None:
        monkeypatch.setenv("DOCSPARK_BATCH_SIZE", value)
    assert engines.batch_size() == want and engines.env_count("NOT_SET_ANYWHERE", 3) == 3


def test_paths(spark):
    paths = ["/a/b.PDF", "/a.b/c", "/a/.hidden", "x.tar.gz", "/a/b."]
    assert each(spark, paths, files.suffix) == ["pdf", "", "", "gz", ""]
    assert each(spark, paths, files.stem) == ["b", "c", ".hidden", "x.tar", "b"]


def test_content_lists_are_found_by_exact_name(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    for name, text in {"a[1]_content_list.json": '[{"type": "text"}]', "a1_content_list.json": "[]", "deep/b.json": "[1]", "c_content_list.json": "{"}.items():
        (tmp_path / name).write_text(text)
    names = spark.createDataFrame([("a[1]",), ("b",), ("c",), ("none",)], "name string")
    got = {r.name: r.content for r in files.content_for_names(names, files.read_content_lists(spark, str(tmp_path))).collect()}
    assert got == {"a[1]": '[{"type": "text"}]', "b": "[1]", "c": "[]", "none": "[]"}


def test_bench_export(spark):
    rows = [("heading", "## T"), ("table", "| a | b |\n|---|---|\n| 1 |"), ("image", "alt"), ("unknown", "u")]
    df = spark.createDataFrame([("d", i, *r, "", False, [1.0, 2.0, 3.0, 4.0], 0, "id") for i, r in enumerate(rows)], "doc_key string, seq int, type string, text string, description string, is_enriched boolean, bbox array<double>, page_idx int, element_id string")
    got = [json.loads(r.json) for r in export.bench_json(export.bench_elements(df)).orderBy("seq").collect()]
    assert got[0]["level"] == 2 and got[0]["text"] == "T" and got[0]["char_span"] == [0, 1] and got[1]["char_span"][0] == 2
    assert got[1]["content"]["cells"][3] == {"row": 1, "col": 1, "text": "", "is_header": False} and got[2]["content"] == {"kind": "figure", "alt_text": "alt"}
    assert got[3]["type"] == "paragraph" and got[3]["bbox"]["y1"] == 4.0


def test_signals_over_a_brief_text(spark):
    rng, parts = random.Random(4), ["word", "Über", "日本", "7", "1,234.5", "($9.50)", "1:2", "a7", "é7", "7é", "x-y", "-", "3rd", "²", "５", "\x01", "\xa0", "\u2003", " ", "\n", "\x1c", "b" * 8, "--", ",", "𝒜", "𝒜1"]
    texts = ["", " ", "\n\xa0", "a", *["".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\t"]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]]
    digit = lambda c: unicodedata.category(c) == "Nd" or c in "²³¹"

    def number(w):
        bare = re.sub("[,./]", "", w.strip("()[].,%$:/+-"))
        return bare != "" and all(map(digit, bare))

    latin, nd = (lambda c: c.isascii() and c.isalpha()), (lambda c: unicodedata.category(c) == "Nd")
    garbled = lambda w: any(latin(a) and nd(b) or nd(a) and latin(b) for a, b in zip(w, w[1:]))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    got = {r.i: r for r in with_signals(df.withColumn("n", T.word_count(F.col("text")))).collect()}
    for i, t in enumerate(texts):
        words, r = t.split(), got[i]
        n = len(words)
        assert r.n == n, t
        assert r.garbled_token_ratio == (sum(map(garbled, words)) / n if n else 0.0), t
        assert r.mean_word_length == (sum(map(len, words)) / n if n else 0.0), t
        assert r.dict_hit_rate == (sum(w.isalpha() or number(w) for w in words) / n if n else 0.0), t
        assert r.ascii_printable_ratio == (sum(c == " " or c.isprintable() for c in t) / max(len(t), 1) if n else 1.0), t
        assert r.has_repeated_char_run == (n > 0 and re.search(r"([^\n])\1{6}", t) is not None), t


def test_no_signal_counts_in_a_list_of_all_words(spark):
    # a list of all words, each tested by expressions of its own, took most of the gate's time
    plan = with_signals(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("regexp_extract_all") == 1


def test_a_picture_is_decoded_once(spark):
    made = spark.createDataFrame([("a",)], "uri string").select(media.decoded_picture(F.col("uri")).alias("p")).select(F.sha2("p.bytes", 256), "p.too_large")
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("unbase64(") + plan.count("to_binary(") == 1 and plan.count("regexp_replace(") == 1
