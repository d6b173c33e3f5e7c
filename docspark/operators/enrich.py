"""Descriptions of images, tables and equations from a vision model.

Prompts are built in the JVM.  A client is anything with ``call(image, prompt, mode) -> dict`` that does not raise; one
is made in each task by a factory.  Only requests that are not answered yet reach Python.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import blocks as B
from docspark.operators.answers import Answers, request_key
from docspark.operators.context import block_context
from docspark.schema import EnrichmentConfig
from docspark.staging import staged

NO_TABLE = "(only an image of the table is at hand)"
_ASK = 'Answer with JSON of the form {"description": "<your description>"}.'
_INTRO = "Text around it in the document:\n%s\n\n"
PROMPTS = {
    "image": "This picture was taken from a document.\n" + _INTRO + "Say in plain words what kind of picture it is, what it shows, "
    "which labels can be read and what stands out. " + _ASK,
    "table": "This table was taken from a document.\n" + _INTRO + "The table:\n%s\n\nSay in plain words what the table is about, what "
    "its columns and rows are and which figures matter. " + _ASK,
    "equation": "This formula was taken from a document.\n" + _INTRO + "The formula in LaTeX:\n%s\n\nSay in plain words what it states, "
    "what its symbols mean and why it matters here. " + _ASK,
    "text": "This %s was taken from a document.\n" + _INTRO + "Its content:\n%s\n\nDescribe it in plain words. " + _ASK,
}


class VLMClient(Protocol):
    def call(self, image_bytes: bytes | None, prompt: str, mode: str) -> dict[str, Any]: ...


def prompt(mode: str, context: Column, content: Column | None = None, kind: Column | None = None) -> Column:
    """The prompt of a modality; empty context reads (none)."""
    around = F.coalesce(F.nullif(context, F.lit("")), F.lit("(none)"))
    fill = [c for c in (kind, around, content) if c is not None]
    parts = PROMPTS[mode].split("%s")
    return F.concat(F.lit(parts[0]), *[x for c, p in zip(fill, parts[1:]) for x in (c, F.lit(p))])


def prompt_content(block: Column, kind: Column, by: str = "process") -> Column:
    """What a prompt quotes of a block.  ``by``: the order of fields of equations when processed, or when enriched."""
    table = F.coalesce(F.nullif(B.first_text(block, "html", "text", "table_body"), F.lit("")), F.lit(NO_TABLE))
    equation = B.first_text(block, *(("text", "latex", "content") if by == "process" else ("content", "text", "latex")))
    return F.when(kind == "table", table).when(kind == "equation", equation).otherwise(B.first_text(block, "text", "content"))


def with_prompts(elements: DataFrame, blocks: DataFrame, config: EnrichmentConfig, others: tuple[str, ...] = ()) -> DataFrame:
    """``elements`` with ``prompt`` (null where the modality is not asked for), from the blocks they were made of.

    ``others`` are further types to be described, by the prompt that names the type.
    """
    said = blocks.select("doc_key", "block_pos", "block", B.field("block", "type").alias("_type"), B.first_text(F.col("block"), "text", "content").alias("_said"))
    around = block_context(said, config.context_window, config.max_context_tokens, kind="_type", text="_said")
    rows = elements.join(around.select("doc_key", "block_pos", "block", "context"), ["doc_key", "block_pos"], "left")
    kind, content = F.col("type"), prompt_content(F.col("block"), F.col("type"))
    asked = F.when(kind == "image", prompt("image", F.col("context")))
    for mode in ("table", "equation"):
        asked = asked.when(kind == mode, prompt(mode, F.col("context"), content))
    asked = asked.when(kind.isin(*others or ("",)), prompt("text", F.col("context"), content, kind))
    return rows.withColumn("prompt", F.when(kind.isin(*config.modalities, *others, ""), asked)).drop("block", "context")


def described(elements: DataFrame, factory: Callable[[], VLMClient], answers: Answers | None = None, model: str = "") -> DataFrame:
    """``enrich_elements`` with ``enrichment_error``: why no client could be made.

    Equal requests of all documents are asked once, and those that ``answers`` knows of ``model`` not at all; a picture goes
    to the model from the first element that has the request.
    """
    picture = "picture" if "picture" in elements.columns else "image_bytes"
    asked = elements.where("prompt is not null").withColumn("_place", F.monotonically_increasing_id())
    asked = staged(asked.withColumn("_request", request_key(F.col(picture), F.col("prompt"), F.col("type"), model)), "asked")
    # a request's first element stands for it: only keys are grouped
    firsts = asked.groupBy("_request").agg(F.min("_place").alias("_place")).select("_place")
    requests = asked.join(firsts, "_place", "left_semi").select(F.col("_request").alias("request"), F.col(picture).alias("picture"), "prompt", F.col("type").alias("mode"))
    told = (answers or Answers(elements.sparkSession)).ask(requests, factory)
    told = told.select(F.col("request").alias("_request"), F.col("description").alias("_said"), F.col("error").alias("enrichment_error"))
    made = asked.join(told, "_request", "left").withColumn("description", F.coalesce("_said", F.lit("")))
    made = made.withColumn("is_enriched", F.col("description") != "").drop("_request", "_place", "_said")
    others = elements.where("prompt is null").withColumn("enrichment_error", F.lit(None).cast("string"))
    return others.unionByName(made).drop("prompt", "picture")


def enrich_elements(elements: DataFrame, factory: Callable[[], VLMClient], answers: Answers | None = None, model: str = "") -> DataFrame:
    """``elements`` (with ``prompt``) after the model has described those with a prompt.

    An answer with an error, without a description, or a call that fails leaves the element as it was.  The model sees
    ``picture`` where there is such a column, else ``image_bytes``.
    """
    return described(elements, factory, answers, model).drop("enrichment_error")


def enrichment_warnings(elements: DataFrame) -> DataFrame:
    """``warnings`` of documents whose enrichment failed, one a document."""
    failed = elements.where("enrichment_error is not null").groupBy("doc_key").agg(F.min("enrichment_error").alias("e"))
    said = F.concat(F.lit("Enrichment failed: "), "e")
    return failed.select("doc_key", F.lit(None).cast("int").alias("page_idx"), F.lit("enrichment_error").alias("code"), said.alias("message"))
