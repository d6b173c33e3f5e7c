"""Elements in the schema of a document benchmark."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.media import mime_type, picture_size
from docspark.schema import BENCH_TYPES
from docspark.sources.files import stem

BENCH_VERSION = "1.0.0"  # fixed value
PAGE_SIZE = (595.0, 842.0)
IMAGE_SIZE = (1700.0, 2200.0)


def bench_type(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*BENCH_TYPES.items())])
    return F.coalesce(F.try_element_at(table, kind), F.lit("paragraph"))


def heading_level(text: Column) -> Column:
    """The number of number signs a text starts with, 1 at least."""
    return F.greatest(F.lit(1), F.length(F.regexp_extract(text, "^(#*)", 1)))


def display_text(kind: Column, text: Column) -> Column:
    """A heading without its number signs; any other text as it is."""
    marked = (kind == "heading") & F.startswith(text, F.lit("#"))
    return F.when(marked, T.strip(F.regexp_replace(text, "^#+", ""))).otherwise(text)


def table_rows(text: Column) -> Column:
    """Cells of a Markdown table, row by row, as an array of arrays; separator lines are left out."""
    lines = F.filter(F.transform(F.split(T.strip(text), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), T.strip), lambda x: (x != "") & ~x.rlike(r"^[-| :]*\z"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+\z", ""), r"\|"), T.strip))


def table_cells(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a cell: row, col, text, is_header; short rows are filled up with empty cells."""
    grid = rows.select(*keys, table_rows(F.col(text)).alias("_rows"))
    grid = grid.withColumn("_cols", F.array_max(F.transform("_rows", F.size))).select(*keys, "_cols", F.posexplode("_rows").alias("row", "_cells"))
    wide = grid.select(*keys, "row", "_cells", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("col"))
    cell = F.coalesce(F.try_element_at("_cells", F.col("col") + 1), F.lit(""))
    return wide.select(*keys, "row", "col", cell.alias("text"), (F.col("row") == 0).alias("is_header"))


def bench_elements(elements: DataFrame) -> DataFrame:
    """``elements`` with bench_type, display, level, char_start, char_end (a space between elements)."""
    rows = elements.withColumn("bench_type", bench_type(F.col("type"))).withColumn("display", display_text(F.col("bench_type"), F.col("text")))
    before = Window.partitionBy("doc_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("display") + 1).over(before), F.lit(0)).cast("long")
    level = F.when(F.col("bench_type") == "heading", heading_level(F.col("text")))
    return rows.withColumns({"level": level, "char_start": start}).withColumn("char_end", F.col("char_start") + F.length("display"))


def _bench_object(kind: Column, display: Column, start: Column, level: Column, e) -> Column:
    """An element as a benchmark object; ``e`` gives its columns by name."""
    grid, b = table_rows(display), e("bbox")
    cols = F.array_max(F.transform(grid, F.size))
    cells = F.flatten(F.transform(grid, lambda r, i: F.transform(
        F.sequence(F.lit(0), cols - 1),
        lambda c: F.struct(i.alias("row"), c.alias("col"), F.coalesce(F.try_element_at(r, c + 1), F.lit("")).alias("text"), (i == 0).alias("is_header")),
    )))
    is_table = (kind == "table") & (F.size(grid) > 0)
    alt = F.when(e("is_enriched") & (e("description") != ""), e("description")).otherwise(display)
    content = F.struct(
        F.when(is_table, "table").when(kind == "figure", "figure").otherwise("text").alias("kind"),
        F.when(is_table, F.size(grid)).alias("rows"), F.when(is_table, cols).alias("cols"), F.when(is_table, 1).alias("header_rows"),
        F.when(is_table, cells).alias("cells"), F.when(kind == "figure", alt).alias("alt_text"),
    )
    box = F.when(F.size(b) == 4, F.struct(*[b[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))
    return F.struct(
        e("element_id").alias("element_id"), kind.alias("type"), e("page_idx").alias("page_index"), F.array(start, start + F.length(display)).alias("char_span"),
        display.alias("text"), content.alias("content"), level.alias("level"), box.alias("bbox"),
    )


def bench_json(rows: DataFrame) -> DataFrame:
    """(doc_key, seq, json): each element of ``bench_elements`` as a JSON object."""
    made = _bench_object(*map(F.col, ("bench_type", "display", "char_start", "level")), F.col)
    return rows.select("doc_key", "seq", F.to_json(made).alias("json"))


def prefix_sums(values: Column) -> Column:
    """For each member of an array of numbers the sum up to it, in as many passes as its size has binary digits."""
    passes = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))))
    return F.aggregate(passes, values, lambda a, k: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("long"))))


def page_list(page_count: Column, size: tuple[float, float] = PAGE_SIZE) -> Column:
    """Pages of one size, as a benchmark document lists them."""
    pages = F.when(page_count > 0, F.sequence(F.lit(0), page_count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(pages, lambda i: F.struct(i.alias("page_index"), F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"), F.lit(0).alias("rotation")))


def picture_page(content: Column) -> Column:
    """The one page of a picture, as large as its header tells or else IMAGE_SIZE."""
    size = picture_size(content)
    side = lambda name, other: F.coalesce(size[name].cast("double"), F.lit(other)).alias(name)
    return F.array(F.struct(F.lit(0).alias("page_index"), side("width", IMAGE_SIZE[0]), side("height", IMAGE_SIZE[1]), F.lit(0).alias("rotation")))


def bench_documents(outputs: DataFrame, parser_version: str = "docspark", language: str = "en") -> DataFrame:
    """(name, json): each output as one benchmark document with its source, pages, elements and warnings.

    ``outputs`` may have ``name`` (else the file's stem), ``mime_type`` (else by the suffix) and ``page_list``, as
    ``page_list`` and ``picture_page`` make it; where that is missing, null or empty, pages have PAGE_SIZE.  A document
    stays one row, and nothing is shuffled.
    """
    file = F.regexp_extract("file_path", r"([^/]*)$", 1)
    own = lambda c, other: F.coalesce(F.col(c), other) if c in outputs.columns else other
    told = F.transform("elements", lambda e: F.struct(bench_type(e["type"]).alias("kind"), display_text(bench_type(e["type"]), F.coalesce(e["text"], F.lit(""))).alias("display")))
    rows = outputs.withColumn("_told", told)
    rows = rows.withColumn("_ends", prefix_sums(F.transform("_told", lambda t: (F.length(t["display"]) + 1).cast("long"))))

    def element(e: Column, i: Column) -> Column:
        t = F.get("_told", i)
        level = F.when(t["kind"] == "heading", heading_level(e["text"]))
        return _bench_object(t["kind"], t["display"], F.get("_ends", i) - F.length(t["display"]) - 1, level, lambda name: e[name])

    pages = page_list(F.col("page_count"))
    if "page_list" in outputs.columns:
        pages = F.when(F.size("page_list") > 0, F.col("page_list")).otherwise(pages)
    source = F.struct(
        own("name", stem(F.col("file_path"))).alias("doc_id"), file.alias("filename"), own("mime_type", mime_type(F.col("file_path"))).alias("mime_type"),
        F.col("file_sha256").alias("sha256"), F.col("page_count"), F.lit(language).alias("language"),
    )
    made = F.struct(
        F.lit(BENCH_VERSION).alias("schema_version"), F.lit(parser_version).alias("parser_version"), source.alias("source"), pages.alias("pages"),
        F.transform("elements", element).alias("elements"), F.transform("warnings", lambda w: F.struct(w["code"].alias("code"), w["message"].alias("message"))).alias("warnings"),
    )
    return rows.select(own("name", stem(F.col("file_path"))).alias("name"), F.to_json(made).alias("json"))


def page_dimensions(pages: DataFrame, size: tuple[float, float] = PAGE_SIZE) -> DataFrame:
    """(doc_key, page_idx, width, height, rotation); sizes that are not known take ``size``."""
    known = [F.col(c) if c in pages.columns else F.lit(None) for c in ("width", "height")]
    width, height = (F.coalesce(c.cast("double"), F.lit(s)) for c, s in zip(known, size))
    return pages.select("doc_key", "page_idx", width.alias("width"), height.alias("height"), F.lit(0).alias("rotation"))
