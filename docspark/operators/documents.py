"""A document as one row from its content to its output: blocks, elements and pages are arrays of the row.

Everything here is a column expression over such arrays, so nothing is exploded, staged or shuffled.  Elements are in the
order of page and block, hence a page is a slice of them, and all steps take time in proportion to the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import blocks as B
from docspark.functions import text as T
from docspark.functions.ids import element_id
from docspark.functions.python_only import tables_markdown
from docspark.operators.assemble import output_of, warning_of
from docspark.operators.elements import BAD_PAGE, ELEMENT_COLUMNS, page_of, parsed_content
from docspark.operators.gate import COUNTS, counts, decision, escalation_message, failing_signals, signals
from docspark.schema import ELEMENT, FURNITURE, PAGE, TEXT_TYPES, WARNING, EnrichmentConfig


def _put(item: Column, **more: Column) -> Column:
    """A struct with fields added."""
    for name, value in more.items():
        item = item.withField(name, value)
    return item


def routed_blocks(content: Column) -> Column:
    """The objects of a content list as structs of fields, numbered after all else is left out; null where there is no list."""
    items = F.filter(F.try_variant_get(parsed_content(content), "$", "array<variant>"), B.is_object)
    return F.transform(items, lambda b, i: F.struct(
        page_of(b).alias("page_idx"), i.alias("block_pos"), B.block_type(B.field(b, "type")).alias("type"), B.first_text(b, "text", "content").alias("text"),
        B.field(b, "table_body").alias("body"), B.field(b, "text_level", "int").alias("level"), B.bbox(b).alias("bbox"),
    ))


def _wants_body(e: Column) -> Column:
    return (e["type"] == "table") & (e["text"] == "") & (F.coalesce(e["body"], F.lit("")) != "")


def with_elements(docs: DataFrame, blocks: str, sha256: str) -> DataFrame:
    """``docs`` with ``elements``, an array by page and block, from ``blocks`` as ``routed_blocks`` gives them.

    Text that is empty in a table is made from its body.  Blocks on negative pages go before numbers are given, those with a
    box that cannot be read afterwards.
    """
    e, sha256 = F.col("_ordered"), F.col(sha256)
    docs = docs.withColumn("_ordered", F.array_sort(F.filter(blocks, lambda b: b["page_idx"] >= 0)))
    # only bodies go to Python, each at its place in an array; null where a document has none
    bodies = F.transform(e, lambda b: F.when(_wants_body(b), b["body"]))
    docs = docs.withColumn("_tables", tables_markdown(F.when(F.exists(e, _wants_body), bodies)))
    filled = F.transform(e, lambda b, i: _put(b, text=F.coalesce(F.get("_tables", i), b["text"])))
    docs = docs.withColumn("_ordered", F.when(F.col("_tables").isNull(), e).otherwise(filled))
    numbered = F.transform(e, lambda b, i: F.struct(
        i.alias("seq"), b["block_pos"].alias("block_pos"), element_id(sha256, b["page_idx"], i).alias("element_id"), b["type"].alias("type"),
        F.when((b["type"] == "heading") & (b["text"] != ""), T.heading(b["text"], b["level"])).otherwise(b["text"]).alias("text"),
        F.lit("").alias("description"), b["bbox"].alias("bbox"), b["page_idx"].alias("page_idx"), F.lit(False).alias("is_enriched"),
        F.lit(None).cast("binary").alias("image_bytes"),
    ))
    return docs.withColumn("elements", F.filter(numbered, lambda x: ~B.bbox_is_bad(x["bbox"]))).drop("_ordered", "_tables")


def element_rows(contents: DataFrame) -> DataFrame:
    """The ``elements`` of ``route_blocks``, from contents (doc_key, content; one row a document) without an exchange or a second pass."""
    docs = with_elements(contents.select("doc_key", routed_blocks(F.col("content")).alias("_blocks")), "_blocks", "doc_key")
    # not ``explode``: the filter that Spark infers from it would be pushed down, and with it all that elements are made of
    return docs.select("doc_key", F.explode_outer("elements").alias("e")).where("e is not null").select("doc_key", "e.*")


def _filled(items: Column, blank: Callable[[Column], Column]) -> Column:
    """``items``, structs in the order of ``page_idx``, with ``blank(page)`` for each page that has none, up to the last."""
    before = lambda k: F.when(k == 0, 0).otherwise(F.get(items, k - 1)["page_idx"] + 1)
    blanks = lambda g, k: F.when(g["page_idx"] > before(k), F.transform(F.sequence(before(k), g["page_idx"] - 1), blank))
    return F.flatten(F.transform(items, lambda g, k: F.when(g["page_idx"] > before(k), F.concat(blanks(g, k), F.array(g))).otherwise(F.array(g))))


def _told(e: Column) -> Column:
    """What the gate has to know of an element; the text is left out where it looks at none."""
    shown, counted = ~e["type"].isin(*FURNITURE) & (e["text"] != ""), e["type"].isin(*TEXT_TYPES)
    text = F.when(shown | counted, e["text"]).otherwise("")
    return F.struct(e["page_idx"].alias("page_idx"), shown.alias("shown"), counted.alias("counted"), text.alias("text"))


def _added(of: Column) -> Column:
    """The counts of a page from those of its elements, whose texts are joined by line feeds."""
    zero = F.struct(*[(F.lit(False) if k == "has_run" else F.lit(0).cast("bigint")).alias(k) for k in (*COUNTS, "extracted", "n_shown")])

    def add(a: Column, e: Column) -> Column:
        sums = [(a[k] + F.when(e["shown"], e[k]).otherwise(0)).alias(k) for k in COUNTS if k != "has_run"]
        run, words = a["has_run"] | (e["shown"] & e["has_run"]), a["extracted"] + F.when(e["counted"], e["n"]).otherwise(0)
        return F.struct(*sums, run.alias("has_run"), words.alias("extracted"), (a["n_shown"] + e["shown"].cast("bigint")).alias("n_shown"))

    def joined(a: Column) -> Column:
        feeds = F.greatest(a["n_shown"] - 1, F.lit(0).cast("bigint"))
        return _put(a, n_lost=a["n_lost"] + feeds, size=a["size"] + feeds).dropFields("n_shown")

    return F.aggregate(of, zero, add, joined)


def with_pages(docs: DataFrame, elements: str = "elements") -> DataFrame:
    """``docs`` with ``pages``, every page 0..last: page_idx, element_count, extracted (words of text elements), and the gate's counts.

    ``elements`` are in the order of their pages; a document without any has no page.  A text is gone through once, as an element's:
    what is counted adds up, since no word, number or run goes over a line feed.
    """
    told, starts, found = F.col("_told"), F.col("_starts"), F.col("_found")
    page = lambda i: F.get(told, i)["page_idx"]
    docs = docs.withColumn("_told", F.transform(elements, _told))
    docs = docs.withColumn("_told", F.transform(told, lambda e: _put(e, brief=T.brief(e["text"]))))
    docs = docs.withColumn("_told", F.transform(told, lambda e: _put(e, odd=T.is_odd(e["brief"]), digit=T.has_digit(e["brief"]))))
    docs = docs.withColumn("_told", F.transform(told, lambda e: _put(e, spaced=T.spaced(e["brief"], e["odd"]))))
    of = lambda e: counts(e["text"], e["brief"], e["spaced"], e["odd"], e["digit"])
    docs = docs.withColumn("_told", F.transform(told, lambda e: _put(e, **of(e)).dropFields("text", "brief", "spaced", "odd", "digit")))
    first = F.transform(told, lambda e, i: F.when((i == 0) | (page(i - 1) != e["page_idx"]), i))
    docs = docs.withColumn("_starts", F.filter(first, lambda i: i.isNotNull()))
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(told))
    docs = docs.withColumn("_found", F.transform(starts, lambda s, k: F.struct(page(s).alias("page_idx"), F.slice(told, s + 1, end(k) - s).alias("of"))))
    docs = docs.withColumn("_found", F.transform(found, lambda p: F.struct(p["page_idx"].alias("page_idx"), F.size(p["of"]).alias("element_count"), _added(p["of"]).alias("of"))))
    names = (*COUNTS, "extracted")
    flat = lambda p: F.struct(p["page_idx"].alias("page_idx"), p["element_count"].alias("element_count"), *[p["of"][k].alias(k) for k in names])
    docs = docs.withColumn("_found", F.transform(found, flat))
    none = [(F.lit(False) if k == "has_run" else F.lit(0).cast("bigint")).alias(k) for k in names]
    blank = lambda i: F.struct(i.alias("page_idx"), F.lit(0).alias("element_count"), *none)
    return docs.withColumn("pages", _filled(found, blank)).drop("_told", "_starts", "_found")


def with_decisions(docs: DataFrame, layer: Column | None = None) -> DataFrame:
    """``docs`` whose ``pages`` have the gate's decision and its signals instead of their counts.

    ``layer`` is an array: the words of each page's text layer, null where none is known.
    """
    pages = F.col("pages")
    known = lambda i: F.lit(None).cast("bigint") if layer is None else F.get(layer, i).cast("bigint")
    docs = docs.withColumn("pages", F.transform(pages, lambda p, i: _put(p, n_tokens=known(i), blank=p["n"] == 0, **signals(p))))
    docs = docs.withColumn("pages", F.transform(pages, lambda p: _put(p, failing_signals=failing_signals(p, p["n"])).dropFields(*COUNTS)))
    return docs.withColumn("pages", F.transform(pages, lambda p: _put(p, **decision(p))))


def dense_layer(layer_tokens: DataFrame) -> DataFrame:
    """(doc_key, ``layer``) from rows (doc_key, page_idx, n_tokens): an array with each page's words at its place."""
    one = F.array_sort(F.collect_list(F.struct("page_idx", F.col("n_tokens").cast("bigint").alias("n"))))
    listed = layer_tokens.where("page_idx >= 0").groupBy("doc_key").agg(one.alias("_listed"))
    blank = lambda i: F.struct(i.alias("page_idx"), F.lit(None).cast("bigint").alias("n"))
    return listed.select("doc_key", F.transform(_filled(F.col("_listed"), blank), lambda p: p["n"]).alias("layer"))


def parsed_documents(contents: DataFrame, config: EnrichmentConfig, layer_tokens: DataFrame | None = None) -> DataFrame:
    """Outputs of block contents (doc_key, file_path, file_sha256, content, and error and layer where they are known), one row each.

    ``layer`` is an array, the words of each page's text layer; ``layer_tokens``, rows of the same, have to be joined.
    """
    error = F.col("error") if "error" in contents.columns else F.lit(None).cast("string")
    own = "layer" in contents.columns and layer_tokens is None
    docs = contents.select("doc_key", "file_path", "file_sha256", *(["layer"] if own else []), error.alias("_error"), routed_blocks(F.col("content")).alias("_blocks"))
    none = F.coalesce(F.size("_blocks") <= 0, F.lit(True))
    bad = F.exists("_blocks", lambda b: b["page_idx"].isNull())
    docs = docs.withColumn("_failure", F.when(none, "mineru_failed").when(bad, "mineru_error"))
    docs = docs.withColumn("_blocks", F.when(F.col("_failure").isNull(), F.col("_blocks")))
    docs = with_pages(with_elements(docs, "_blocks", "file_sha256"))
    if layer_tokens is not None:
        docs = docs.join(dense_layer(layer_tokens), "doc_key", "left")
    docs = with_decisions(docs, F.col("layer") if "layer" in docs.columns else None)
    told = F.transform(F.filter("pages", lambda p: p["vlm_used"]), lambda p: F.struct(
        p["page_idx"].alias("page_idx"), F.lit("quality_gate_escalation").alias("code"), escalation_message(p).alias("message")
    ))
    said = F.when(F.col("_failure") == "mineru_error", BAD_PAGE).otherwise(F.coalesce("_error", F.lit("the engine produced no output")))
    cut = lambda name, columns, kind: F.transform(name, lambda x: F.struct(*[x[c].alias(c) for c in columns])).cast(f"array<{kind}>")
    return docs.select(*output_of(
        config, F.size("pages"), cut("pages", ("page_idx", "quality_decision", "element_count", "vlm_used"), PAGE), cut("elements", ELEMENT_COLUMNS, ELEMENT),
        F.when(F.col("_failure").isNull(), told.cast(f"array<{WARNING}>")).otherwise(warning_of(F.col("_failure"), said)),
    ))
