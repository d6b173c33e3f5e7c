"""Elements, pages and warnings to one nested row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.elements import ELEMENT_COLUMNS
from docspark.schema import ELEMENT, PAGE, SCHEMA_VERSION, WARNING, EnrichmentConfig


def _listed(rows: DataFrame, order: str, columns: tuple[str, ...], name: str) -> DataFrame:
    item = F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("v"))
    kept = rows.groupBy("doc_key").agg(F.array_sort(F.collect_list(item), lambda a, b: (a["_o"] - b["_o"]).cast("int")).alias(name))
    return kept.withColumn(name, F.transform(name, lambda x: x["v"]))


def assemble(docs: DataFrame, elements: DataFrame, pages: DataFrame, warnings: DataFrame, config: EnrichmentConfig) -> DataFrame:
    """Outputs, one row for each of ``docs`` (doc_key, file_path, file_sha256), whatever else there is of it.

    Pages are in order, elements by page and sequence, warnings by page and code.
    """
    page_rows = pages.select("doc_key", "page_idx", "quality_decision", "element_count", "vlm_used", "page_count")
    listed_pages = _listed(page_rows, "page_idx", ("page_idx", "quality_decision", "element_count", "vlm_used"), "pages")
    counts = page_rows.groupBy("doc_key").agg(F.max("page_count").alias("page_count"))
    listed_elements = _listed(elements, "seq", ELEMENT_COLUMNS, "elements")
    told = warnings.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("page_idx", "code", "message"))).alias("warnings"))
    full = docs.join(counts, "doc_key", "left")
    for other in (listed_pages, listed_elements, told):
        full = full.join(other, "doc_key", "left")
    listed = [F.col(c).cast(f"array<{kind}>") for c, kind in (("pages", PAGE), ("elements", ELEMENT), ("warnings", WARNING))]
    return full.select(*output_of(config, F.col("page_count"), *listed))


def output_of(config: EnrichmentConfig, page_count: Column, pages: Column, elements: Column, warnings: Column) -> list[Column]:
    """The columns of an output, of a row with doc_key, file_path and file_sha256.  What is null is 0 or empty."""
    some = lambda c, name: F.coalesce(c, F.array().cast(_KINDS[name])).alias(name)
    return [
        F.col("doc_key"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("file_path"), F.col("file_sha256"),
        F.coalesce(page_count, F.lit(0)).cast("int").alias("page_count"),
        some(pages, "pages"), some(elements, "elements"), some(warnings, "warnings"), config.as_column().alias("enrichment_config"),
    ]


def warning_of(code: Column, message: Column) -> Column:
    """The one warning of a document, as ``warnings``."""
    return F.array(F.struct(F.lit(None).cast("int").alias("page_idx"), code.alias("code"), message.alias("message"))).cast(_KINDS["warnings"])


def warned(docs: DataFrame, code: Column, message: Column, config: EnrichmentConfig) -> DataFrame:
    """Outputs of documents that have nothing but one warning."""
    none = {name: F.lit(None).cast(kind) for name, kind in _KINDS.items()}
    return docs.select(*output_of(config, F.lit(0), none["pages"], none["elements"], warning_of(code, message)))


_KINDS = {"pages": f"array<{PAGE}>", "elements": f"array<{ELEMENT}>", "warnings": f"array<{WARNING}>"}
OUTPUT_COLUMNS = ["schema_version", "file_path", "file_sha256", "page_count", "pages", "elements", "warnings", "enrichment_config"]
