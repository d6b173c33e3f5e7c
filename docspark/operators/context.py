"""Surrounding text for a block or a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import truncate_words

CONTEXT_TYPES = ("text", "title")


def _spoken(kind: Column, text: Column) -> Column:
    return F.when(kind.isin(*CONTEXT_TYPES) & (text != ""), text)


def block_context(rows: DataFrame, window: int = 3, max_words: int = 512, key: str = "doc_key", order: str = "block_pos", kind: str = "type", text: str = "text") -> DataFrame:
    """``rows`` with ``context``: the text of the text and title blocks up to ``window`` before and after.

    Spark frames cannot leave out the current row, so the two sides are gathered apart.  ``window`` 0 gives nothing.
    """
    if window == 0:
        return rows.withColumn("context", F.lit(""))
    by = Window.partitionBy(key).orderBy(order)
    said = _spoken(F.col(kind), F.col(text))
    before, after = (F.collect_list(said).over(by.rowsBetween(*b)) for b in ((-window, -1), (1, window)))
    both = F.concat(F.coalesce(before, F.array().cast("array<string>")), F.coalesce(after, F.array().cast("array<string>")))
    return rows.withColumn("context", truncate_words(F.array_join(both, "\n"), max_words))


def page_context(rows: DataFrame, max_words: int = 512, key: str = "doc_key", page: str = "page_idx", order: str = "block_pos", kind: str = "type", text: str = "text") -> DataFrame:
    """One row a page: ``context``, the text of the text and title blocks of the page and its neighbours, in order."""
    said = F.when(_spoken(F.col(kind), F.col(text)).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    pages = rows.groupBy(F.col(key), F.col(page)).agg(F.collect_list(said).alias("_said"))
    near = F.flatten(F.collect_list("_said").over(Window.partitionBy(key).orderBy(page).rangeBetween(-1, 1)))
    joined = F.array_join(F.transform(F.array_sort(near), lambda s: s["t"]), "\n")
    return pages.select(key, page, truncate_words(joined, max_words).alias("context"))
