"""Elements to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.python_only import table_markdown
from docspark.operators.gate import ordered_join
from docspark.schema import FURNITURE


def fragment(kind: Column, text: Column, description: Column, is_enriched: Column, table: Column) -> Column:
    """The Markdown of one element, empty if it shows nothing.  ``table``: the Markdown of an HTML table in its text."""
    body = T.strip(text)
    told = F.when(is_enriched & (description != ""), F.concat(F.lit("> "), description))
    filled = lambda c: F.when(body == "", "").otherwise(c)
    return (
        F.when(kind == "heading", filled(F.when(F.startswith(body, F.lit("#")), body).otherwise(F.concat(F.lit("# "), body))))
        .when(kind.isin("text", "caption"), body)
        .when(kind == "list_item", filled(F.concat(F.lit("- "), body)))
        .when(kind == "table", F.coalesce(F.nullif(table, F.lit("")), told, body))
        .when(kind == "equation", filled(F.concat(F.lit("$$\n"), body, F.lit("\n$$"))))
        .when(kind == "image", F.coalesce(told, F.lit("")))
        .otherwise("")
    )


def with_fragments(elements: DataFrame) -> DataFrame:
    """``elements`` with ``fragment``.  Only tables whose text holds a table tag go through Python."""
    tagged = (F.col("type") == "table") & F.contains(F.lower("text"), F.lit("<table"))
    plain = elements.where(~tagged).withColumn("_table", F.lit(""))
    rows = plain.unionByName(elements.where(tagged).withColumn("_table", table_markdown(T.strip(F.col("text")))))
    made = fragment(*[F.col(c) for c in ("type", "text", "description", "is_enriched", "_table")])
    return rows.withColumn("fragment", made).drop("_table")


def render_documents(elements: DataFrame) -> DataFrame:
    """(doc_key, markdown): the elements' fragments but furniture, a blank line between, one line feed at the end."""
    shown = ~F.col("type").isin(*FURNITURE) & (F.col("fragment") != "")
    joined = with_fragments(elements).groupBy("doc_key").agg(ordered_join("seq", "fragment", shown, "\n\n").alias("_all"))
    return joined.select("doc_key", F.concat(T.strip(F.col("_all")), F.lit("\n")).alias("markdown"))
