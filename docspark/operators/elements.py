"""Layout blocks to typed elements.

Tables: ``contents(doc_key, content)`` (JSON text) -> ``blocks(doc_key, block_pos, block)`` -> ``elements``.
Numbers are given before rows are dropped: a block that fails leaves a gap in the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import blocks as B
from docspark.functions.ids import element_id
from docspark.functions.python_only import table_markdown
from docspark.functions.text import heading

MOST_PAGES = 1_000_000  # a document with a page beyond has an error, as its pages are told one by one
BAD_PAGE = f"page_idx is not a whole number under {MOST_PAGES}"
ELEMENT_COLUMNS = ("element_id", "type", "text", "description", "bbox", "page_idx", "is_enriched", "image_bytes")


def parsed_content(content: Column) -> Column:
    """The list in a content text: the text itself, or the field content_list of an object.  Null if neither."""
    value = F.try_parse_json(content)
    return F.coalesce(F.try_variant_get(value, "$.content_list", "variant"), value)


def explode_blocks(contents: DataFrame, key: str = "doc_key", content: str = "content") -> DataFrame:
    """``blocks``: the objects of each content list, numbered from 0 after all else is left out."""
    items = contents.select(F.col(key).alias("doc_key"), F.try_variant_get(parsed_content(F.col(content)), "$", "array<variant>").alias("items"))
    rows = items.select("doc_key", F.posexplode("items").alias("_pos", "block")).where(B.is_object(F.col("block")))
    at = Window.partitionBy("doc_key").orderBy("_pos")
    return rows.select("doc_key", (F.row_number().over(at) - 1).alias("block_pos"), "block")


def page_of(block: Column) -> Column:
    """A block's page: 0 where it names none, null where it names no whole number under MOST_PAGES."""
    named = B.field(block, "page_idx", "int")
    return F.when(B.kind_of(block, "page_idx").isNull(), 0).otherwise(F.when(named < MOST_PAGES, named))


def number_blocks(blocks: DataFrame, page: Column) -> DataFrame:
    """``blocks`` with ``page_idx`` and ``seq``, the place by page and then by position; negative pages go."""
    at = Window.partitionBy("doc_key").orderBy("page_idx", "block_pos")
    paged = blocks.withColumn("page_idx", page).where("page_idx >= 0")
    return paged.withColumn("seq", (F.row_number().over(at) - 1).cast("int"))


def route_blocks(blocks: DataFrame, sha256: Column | None = None) -> DataFrame:
    """``elements``: doc_key, seq, block_pos and the element's columns.  ``sha256`` defaults to the document's key.

    Text that is empty in a table block is made from its ``table_body``.  Blocks with a box that cannot be read are
    dropped, their numbers are not given again.
    """
    block, sha256 = F.col("block"), F.col("doc_key") if sha256 is None else sha256
    rows = number_blocks(blocks, page_of(block)).select(
        "doc_key", "seq", "block_pos", "page_idx", B.block_type(B.field(block, "type")).alias("type"),
        B.first_text(block, "text", "content").alias("_text"), B.field(block, "table_body").alias("_body"),
        B.field(block, "text_level", "int").alias("_level"), B.bbox(block).alias("bbox"), sha256.alias("_sha"),
    )
    rows = rows.where(~B.bbox_is_bad(F.col("bbox")))
    wants = (F.col("type") == "table") & (F.col("_text") == "") & (F.coalesce("_body", F.lit("")) != "")
    # only table bodies go through Python: rows without one are united afterwards
    with_body = rows.where(wants).withColumn("_text", table_markdown("_body"))
    rows = rows.where(~wants).unionByName(with_body)
    text = F.when((F.col("type") == "heading") & (F.col("_text") != ""), heading(F.col("_text"), F.col("_level"))).otherwise(F.col("_text"))
    return rows.select(
        "doc_key", "seq", "block_pos", element_id(F.col("_sha"), F.col("page_idx"), F.col("seq")).alias("element_id"), "type",
        text.alias("text"), F.lit("").alias("description"), "bbox", "page_idx", F.lit(False).alias("is_enriched"),
        F.lit(None).cast("binary").alias("image_bytes"),
    )


def bad_documents(blocks: DataFrame) -> DataFrame:
    """``warnings`` of documents that have a block whose page is no whole number, or too large a one."""
    bad = blocks.where(page_of(F.col("block")).isNull()).select("doc_key").distinct()
    return bad.select("doc_key", F.lit(None).cast("int").alias("page_idx"), F.lit("mineru_error").alias("code"), F.lit(BAD_PAGE).alias("message"))
