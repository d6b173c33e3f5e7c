"""What fails fails alone, and says why."""

import json
import time

import pytest

from docspark import EnrichmentConfig
from docspark.functions.python_only import table_to_markdown, tolerant_json
from docspark.operators import clients, enrich
from docspark.operators import elements as E
from docspark.plans.parse import parse_contents
from docspark.sources import engines
from docspark.streaming.arrivals import gated_texts

CONTENTS = "doc_key string, file_path string, file_sha256 string, content string"


def contents(spark, *lists):
    return spark.createDataFrame([(f"d{i}", f"d{i}.pdf", "ab" * 32, json.dumps(x)) for i, x in enumerate(lists)], CONTENTS)


def test_a_page_number_beyond_all_bounds_fails_its_document_alone(spark):
    text = {"type": "text", "text": "a b"}
    got = {r.doc_key: r for r in parse_contents(contents(spark, [text | {"page_idx": 2147483646}], [text])).collect()}
    assert [w.code for w in got["d0"].warnings] == ["mineru_error"] and got["d0"].page_count == 0
    assert got["d1"].page_count == 1 and len(got["d1"].elements) == 1
    tree = {"body": {"children": ["#/texts/0"]}, "texts": [{"label": "text", "orig": "a", "prov": [{"page_no": 2147483647}]}]}
    fine = {"body": {"children": ["#/texts/0"]}, "texts": [{"label": "text", "orig": "a"}]}
    got = {r.doc_key: r for r in parse_contents(contents(spark, tree, fine), EnrichmentConfig(parser="docling")).collect()}
    assert [w.code for w in got["d0"].warnings] == ["docling_error"] and got["d1"].page_count == 1


def test_the_engines_own_words_are_told(spark):
    rows = contents(spark, []).selectExpr("*", "'no model here' as error")
    assert [(w.code, w.message) for w in parse_contents(rows).first().warnings] == [("mineru_failed", "no model here")]


def no_client():
    raise RuntimeError("no settings")


def test_enrichment_without_a_client_is_a_warning(spark):
    blocks = [{"type": "table", "text": "plain words in a table"}, {"type": "text", "text": "and some more words"}]
    out = parse_contents(contents(spark, blocks), EnrichmentConfig(enabled=True), no_client).first()
    assert [(w.code, w.message) for w in out.warnings] == [("enrichment_error", "Enrichment failed: no settings")]
    assert [e.is_enriched for e in out.elements] == [False, False]


class Sees:
    def call(self, image_bytes, prompt, mode):
        return {"description": f"{mode} {image_bytes!r} {len(prompt) > 40}"}


def test_the_model_sees_the_picture(spark):
    blocks = [{"type": "image", "page_idx": 1, "bbox": [1, 2, 3, 4]}, {"type": "equation", "text": "x=1"}, {"type": "image"}]
    files = spark.createDataFrame([("d0", bytearray(b"pdf"))], "doc_key string, content binary")
    regions = spark.createDataFrame([("d0", 0, 1, [1.0, 2.0, 3.0, 4.0]), ("d0", 2, 0, None)], "doc_key string, block_pos int, page_idx int, bbox array<double>")
    assert engines.region_rasters(files, regions).schema.simpleString() == "struct<doc_key:string,block_pos:int,picture:binary>"
    out = parse_contents(contents(spark, blocks), EnrichmentConfig(enabled=True), Sees, files=files).first()
    assert [e.description.split()[0] for e in out.elements] == ["equation", "image", "image"]
    assert out.elements[0].is_enriched and not any(w.code == "enrichment_error" for w in out.warnings)
    rows = spark.createDataFrame([("k", 0, "text", "", False, None, "a prompt", b"PNG")], "doc_key string, block_pos int, type string, description string, is_enriched boolean, image_bytes binary, prompt string, picture binary")
    assert enrich.enrich_elements(rows, Sees).first().description == "text b'PNG' False"


def test_any_type_can_be_described(spark):
    rows = contents(spark, [{"type": "list", "text": "- one"}, {"type": "text", "text": "words"}]).selectExpr("doc_key", "content")
    blocks = E.explode_blocks(rows)
    asked = enrich.with_prompts(E.route_blocks(blocks), blocks, EnrichmentConfig(enabled=True), others=("list_item",)).collect()
    assert {r.type: "This list_item" in (r.prompt or "") for r in asked} == {"list_item": True, "text": False}


def test_crop_boxes_stay_in_the_image_and_need_an_area():
    assert engines.crop_box([10, 20, 30, 40], 100, 2.0, (200, 200)) == (20, 120, 60, 160)
    assert engines.crop_box([-5, -5, 500, 500], 100, 2.0, (150, 200)) == (0, 0, 150, 200)
    for box in ([10, 10, 10, 50], [300, 0, 400, 50], [0, 500, 10, 600]):
        with pytest.raises(ValueError):
            engines.crop_box(box, 100, 2.0, (200, 200))


def test_text_blocks_of_an_answer_are_joined():
    body = {"content": [{"type": "reasoning", "text": "hm"}, {"type": "text", "text": '{"description": '}, {"type": "text", "text": '"a"}'}]}
    assert clients.Client("bedrock").read(body) == {"description": "a"}


def test_passes_wait_for_a_place(tmp_path, monkeypatch):
    monkeypatch.setattr(engines.tempfile, "gettempdir", lambda: str(tmp_path))
    from concurrent.futures import ThreadPoolExecutor

    at_once, most = [0], [0]

    def one(_):
        with engines.in_flight(2):
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
            time.sleep(0.05)
            at_once[0] -= 1

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(one, range(6)))
    assert most[0] == 2


def test_files_stay_in_their_partitions(spark):
    class Counts:
        def run(self, files):
            return {k: json.dumps([len(files)]) for k in files}

    rows = spark.createDataFrame([(str(i), f"{i}.pdf", bytearray(b"x")) for i in range(12)], "doc_key string, path string, content binary").repartition(3)
    got = engines.run_engine(rows, Counts, 100)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 12


def test_a_text_of_white_space_is_kept_in_a_stream_as_in_a_batch(spark):
    rows = gated_texts(spark.createDataFrame([("\n\t\n",), ("a1 b2 c3",)], "text string"))
    assert {r.text: r.quality_decision for r in rows.collect()} == {"\n\t\n": "keep", "a1 b2 c3": "promote_to_vlm"}


def test_tables_without_all_their_tags():
    assert table_to_markdown("<tr><td>a</td></tr>") == ""
    assert table_to_markdown("<table><tr><td>a<td>b</td></tr><tr></tr><td>c</td></tr></table>") == "| b |\n| --- |\n| c |"
    assert table_to_markdown("<table><tr><th title='x>y'>a <b>b</b>&amp;</th></td></tr>") == "| a b& |  |\n| --- | --- |"
    assert table_to_markdown("<table><tr><td>never closed") == ""


@pytest.mark.parametrize("answer, want", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('so: {"a": {"b": "}"}} and {"c": 2}', {"a": {"b": "}"}}),
    ("{not json}", {"description": "{not json}"}), ("", {"description": ""}), ("```\n[1]\n```\n", [1]), ('{"a": 1', {"description": '{"a": 1'}),
])
def test_answers(answer, want):
    assert json.loads(tolerant_json(answer)) == want


def test_open_comments_are_looked_for_once():
    began = time.time()
    assert table_to_markdown("<table>" + "<!-- x " * 150_000) == ""
    assert table_to_markdown("<!--<table>" * 3 + "--><table><tr><td>a<!-- b -->c<!----></td></tr></table><!-->") == "| ac |\n| --- |"
    assert time.time() - began < 1
