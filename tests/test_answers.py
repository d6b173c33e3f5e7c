"""Requests to a model are asked once; clients fill their requests in from a table."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docspark import EnrichmentConfig
from docspark.operators import clients, enrich
from docspark.operators.answers import Answers, request_key

ROWS = "doc_key string, type string, description string, is_enriched boolean, image_bytes binary, prompt string"


class Logging:
    """Writes each call down; ``busy`` is an error, ``down`` ends the task after some calls."""

    def __init__(self, at):
        self.at, self.n = at, 0

    def call(self, image, prompt, mode):
        self.n += 1
        if prompt == "down" and self.n > 12:
            os._exit(1)
        with open(self.at, "a") as out:
            out.write(json.dumps([prompt, mode, image.hex() if image else None]) + "\n")
        if prompt == "busy":
            return {"error": "busy"}
        if prompt == "odd":
            raise RuntimeError("no")
        return {"description": f" {mode} {prompt} {image} "}


def calls(at):
    return [json.loads(x) for x in at.read_text().splitlines()] if at.exists() else []


def asked(spark, rows):
    return spark.createDataFrame([(f"d{i}", kind, "", False, image, prompt) for i, (kind, image, prompt) in enumerate(rows)], ROWS).repartition(3)


def test_equal_requests_are_asked_once(spark, tmp_path):
    rows = [("image", b"1", "p"), ("image", b"1", "p"), ("image", b"2", "p"), ("table", b"1", "p"), ("image", None, "p"), ("image", b"1", "q")] * 5 + [("text", None, None)]
    log, kept = tmp_path / "calls", Answers(spark, str(tmp_path / "answers"))
    for turn in range(2):
        got = enrich.enrich_elements(asked(spark, rows), lambda: Logging(log), kept, "m").collect()
        assert len(got) == len(rows) and {r.doc_key: r.description for r in got} == {
            f"d{i}": f"{kind} {prompt} {image}" if prompt else "" for i, (kind, image, prompt) in enumerate(rows)
        }
        assert all(r.is_enriched == bool(r.description) for r in got)
        assert len(calls(log)) == 5 and len(set(map(str, calls(log)))) == 5
    enrich.enrich_elements(asked(spark, rows), lambda: Logging(log), kept, "another model").collect()
    assert len(calls(log)) == 10


def test_what_failed_is_asked_again(spark, tmp_path):
    log, kept = tmp_path / "calls", Answers(spark, str(tmp_path / "answers"))
    rows = [("image", b"1", p) for p in ("fine", "busy", "odd")]
    for n in (3, 5):
        got = enrich.described(asked(spark, rows), lambda: Logging(log), kept).collect()
        assert sorted(r.description for r in got) == ["", "", "image fine b'1'"] and not any(r.enrichment_error for r in got)
        assert len(calls(log)) == n

    def none():
        raise RuntimeError("no model")

    got = enrich.described(asked(spark, rows), none, kept).collect()
    assert sorted((r.description, r.enrichment_error or "") for r in got) == [("", "no model"), ("", "no model"), ("image fine b'1'", "")]


def test_a_task_that_dies_loses_few_answers(spark, tmp_path):
    log, kept = tmp_path / "calls", Answers(spark, str(tmp_path / "answers"))
    rows = [("image", bytes([i]), "fine") for i in range(30)] + [("image", b"x", "down")]
    with pytest.raises(Exception, match="(?i)worker|exit|crash"):
        enrich.enrich_elements(asked(spark, rows).coalesce(1).sortWithinPartitions("doc_key"), lambda: Logging(log), kept).collect()
    before = len(calls(log))
    got = enrich.enrich_elements(asked(spark, rows[:-1]), lambda: Logging(log), kept).collect()
    assert len(got) == 30 and all(r.is_enriched for r in got) and len(calls(log)) <= 30 + 8 and before >= 8


def test_requests_do_not_run_into_each_other(spark):
    rows = [(b"a", "p", "m"), (None, "p", "m"), (b"a", "m\np", ""), (b"a", "p", "m2"), (b"", "p", "m")]
    df = spark.createDataFrame(rows, "i binary, p string, m string").select(request_key(F.col("i"), F.col("p"), F.col("m"), "x").alias("k"))
    assert len({r.k for r in df.collect()}) == 5


def test_requests_are_filled_in(monkeypatch):
    monkeypatch.setenv("VLM_MODEL_NAME", "a {prompt} model")
    png = b"\x89PNG\r\n\x1a\n"
    made = clients.Client("openai_compatible").request(png, "say {model}")
    assert made == {
        "model": "a {prompt} model", "temperature": 0, "max_tokens": 4096,
        "messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "data:image/png;base64,iVBORw0KGgo="}}, {"type": "text", "text": "say {model}"}]}],
    }
    made = clients.Client("bedrock").request(None, "p")
    assert made["messages"] == [{"role": "user", "content": [{"type": "text", "text": "p"}]}] and (made["max_tokens"], made["temperature"]) == (8192, 0.0)
    body = {"choices": [{"message": {"content": '<think>x</think>{"description": "d"}'}}]}
    assert clients.Client("openai_compatible").read(body) == {"description": "d"} and clients.Client("openai_compatible").read({"choices": []}) == {"description": ""}
    monkeypatch.setitem(clients.PROVIDERS, "bedrock", clients.Provider({}, {}, {}, ("content",), lambda s, r: 1 / 0))
    assert clients.make_client(EnrichmentConfig(vlm_backend="bedrock")).call(None, "p", "text") == {"error": "division by zero"}
    assert clients.model_name(EnrichmentConfig()) == "openai_compatible:a {prompt} model"
