"""Queries over blocks, trees and outputs of every kind, registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import queries as Q
from docspark.functions import blocks as B
from docspark.functions import media
from docspark.operators import docling, documents, elements, enrich, export, render
from docspark.plans import batch
from docspark.schema import EnrichmentConfig
from docspark.sources import files


def text_sql(text: str) -> str:
    """A text as an SQL expression."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def json_list(*fields: Column) -> Column:
    """Aggregate: the last field, JSON texts, as one JSON array in the order of the fields before."""
    rows = F.array_sort(F.collect_list(F.struct(*[f.alias(f"_{i}") for i, f in enumerate(fields)])))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r[f"_{len(fields) - 1}"]), ","), F.lit("]"))


# Content lists


# Lines of orders as blocks of ten kinds: a table's HTML, text under another name, a stray text, a number as text, a bad
# box, a title of level 9, a picture, a page before the first, a false text of unknown type, a page footer.
@Q.register(f"""
WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS part, ((l_orderkey + l_linenumber) % 10)::INTEGER AS k, (l_partkey % 3)::INTEGER AS p FROM lineitem),
objects AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, part) - 1 AS pos, CASE WHEN k IN (3, 8) THEN 0 WHEN k = 7 THEN -1 ELSE p END AS page_idx FROM b WHERE k <> 2),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY o ORDER BY page_idx, pos) - 1)::INTEGER AS seq FROM objects WHERE page_idx >= 0)
SELECT o::VARCHAR AS doc_key, seq, page_idx,
       CASE k WHEN 0 THEN 'table' WHEN 5 THEN 'heading' WHEN 6 THEN 'image' WHEN 8 THEN 'unknown' WHEN 9 THEN 'page_number' ELSE 'text' END AS type,
       CASE k WHEN 0 THEN '| ' || part || ' | ' || n || ' |' || chr(10) || '| --- | --- |' WHEN 1 THEN 'c' || part WHEN 3 THEN (part + 1)::VARCHAR WHEN 5 THEN '###### T ' || n
         WHEN 6 THEN '' WHEN 8 THEN 'kept ' || n ELSE 'p' || part END AS text,
       CASE WHEN k = 6 THEN [n::DOUBLE, 2.0, 3.5, part::DOUBLE] ELSE []::DOUBLE[] END AS bbox,
       {Q.UUID5 % "o || ':' || page_idx || ':' || seq"} AS element_id FROM numbered WHERE k <> 4""")
def mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    said, page = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), (part % 3).cast("string")
    p, i = part.cast("string"), n.cast("string")
    kinds = [
        said('{"type":"table","table_body":"<table><tr><td>', p, "</td><td>", i, '</td></tr></table>","page_idx":', page, "}"),
        said('{"type":"text","content":"c', p, '","page_idx":', page, "}"),
        said('"stray ', i, '"'),
        said('{"type":"text","text":', (part + 1).cast("string"), "}"),
        said('{"type":"interline_equation","text":"x","bbox":[1,"a",2,3],"page_idx":', page, "}"),
        said('{"type":"title","text":"T ', i, '","text_level":9,"page_idx":', page, "}"),
        said('{"type":"image","text":"","bbox":[', i, ",2,3.5,", p, '],"page_idx":', page, "}"),
        said('{"type":"text","text":"before","page_idx":-1}'),
        said('{"type":"odd","text":false,"content":"kept ', i, '"}'),
        said('{"type":"page_number","text":"p', p, '","page_idx":', page, "}"),
    ]
    kind = F.element_at(F.array(*kinds), ((F.col("l_orderkey") + n) % 10 + 1).cast("int"))
    lists = Q.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc_key")).agg(json_list(n, part, kind).alias("content"))
    made = documents.element_rows(lists)
    return made.select("doc_key", "seq", "page_idx", "type", "text", "bbox", "element_id")


@Q.register("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'short ' || o_custkey WHEN 1 THEN 'long ' || o_custkey WHEN 2 THEN 'short ' || o_custkey END AS caption,
       CASE WHEN o_orderkey % 4 = 3 THEN 'note ' || o_custkey END AS footnote FROM orders""")
def block_aliases(spark, sf_dir):
    who, case = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    told = lambda when, text: F.when(when, F.concat(F.lit(text), who))
    block = F.parse_json(F.to_json(F.struct(
        told(case.isin(0, 2), "short ").alias("img_caption"), told(case.isin(0, 1), "long ").alias("image_caption"), told(case == 3, "note ").alias("image_footnote"),
    )))
    as_text = lambda name: F.try_variant_get(B.aliased(block, name), "$", "string").alias(name.removeprefix("image_"))
    return Q.table(spark, sf_dir, "orders").select("o_orderkey", as_text("image_caption"), as_text("image_footnote"))


# Four files to a name: two content lists, the second of which cannot be read in every other name, and two others.
@Q.register("""
WITH f AS (SELECT doc_id // 4 AS name, doc_id % 4 AS i, '["' || sha256(text) || '"]' AS content FROM documents),
good AS (SELECT * FROM f WHERE NOT (i = 1 AND name % 2 = 0) AND NOT (i = 0 AND name % 3 = 0)),
first AS (SELECT name, arg_min(content, (i > 1, content)) AS content FROM good GROUP BY name)
SELECT n.name, coalesce(first.content, '[]') AS content FROM (SELECT DISTINCT doc_id // 2 AS name FROM documents) n LEFT JOIN first USING (name)""")
def content_first_match(spark, sf_dir):
    docs, i = Q.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    name = F.floor(F.col("doc_id") / 4)
    broken = ((i == 1) & (name % 2 == 0)) | ((i == 0) & (name % 3 == 0))
    content = F.when(broken, F.lit('["')).otherwise(F.concat(F.lit('["'), F.sha2("text", 256), F.lit('"]')))
    lists = docs.select(name.alias("name"), content.alias("content"), (i < 2).alias("is_list"))
    return files.content_for_names(docs.select(F.floor(F.col("doc_id") / 2).alias("name")).distinct(), lists)


# Prompts and descriptions of blocks


def turn_contents(spark, sf_dir) -> DataFrame:
    """Conversations as content lists: texts, pictures, tables (some without a body), equations and blocks of unknown type."""
    text, case = F.coalesce("text", F.lit("")), F.col("turn") % 5
    kind = F.element_at(F.array(*map(F.lit, ("text", "table", "equation", "image", "odd"))), (case + 1).cast("int"))
    block = F.struct(
        kind.alias("type"), F.when(case.isin(0, 4), text).alias("text"), F.when((case == 1) & (F.col("conv_id") % 2 == 0), text).alias("html"),
        F.when(case == 2, text).alias("latex"),
    )
    return Q.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_key")).agg(json_list(F.col("turn"), F.to_json(block)).alias("content"))


def filled_sql(mode: str, *values: str) -> str:
    parts = enrich.PROMPTS[mode].split("%s")
    return " || ".join([text_sql(parts[0]), *[f"{v} || {text_sql(p)}" for v, p in zip(values, parts[1:])]])


_AROUND = f"coalesce(nullif({Q.CUT % (64, 64)}, ''), '(none)')"
BLOCK_PROMPTS_SQL = f"""
WITH t AS (SELECT conv_id, turn, ['text', 'table', 'equation', 'image', 'odd'][turn % 5 + 1] AS type, CASE WHEN turn % 5 IN (0, 4) THEN coalesce(text, '') ELSE '' END AS text,
  coalesce(text, '') AS said FROM conversations),
c AS (SELECT *, coalesce(array_to_string(list_filter(list(CASE WHEN type = 'text' AND text <> '' THEN text END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), lambda y: y IS NOT NULL), chr(10)), '') AS x FROM t),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, CASE type
  WHEN 'table' THEN {filled_sql('table', _AROUND, f"CASE WHEN conv_id % 2 = 0 AND said <> '' THEN said ELSE {text_sql(enrich.NO_TABLE)} END")}
  WHEN 'equation' THEN {filled_sql('equation', _AROUND, 'said')} WHEN 'odd' THEN {filled_sql('text', "'unknown'", _AROUND, 'said')} END AS prompt FROM c)"""


def prompted(spark, sf_dir) -> DataFrame:
    # pictures are switched off, blocks of unknown type are asked for
    config = EnrichmentConfig(enabled=True, image=False, context_window=2, max_context_tokens=64)
    blocks = elements.explode_blocks(turn_contents(spark, sf_dir))
    return enrich.with_prompts(elements.route_blocks(blocks), blocks, config, others=("unknown",))


@Q.register(BLOCK_PROMPTS_SQL + "SELECT conv_id::VARCHAR AS doc_key, seq, CASE type WHEN 'odd' THEN 'unknown' ELSE type END AS type, prompt FROM p")
def block_prompts(spark, sf_dir):
    return prompted(spark, sf_dir).select("doc_key", "seq", "type", "prompt")


@Q.register(BLOCK_PROMPTS_SQL + """, q AS (SELECT *, length(prompt) AS n, CASE type WHEN 'odd' THEN 'unknown' ELSE type END AS kind FROM p)
SELECT conv_id::VARCHAR AS doc_key, seq, kind AS type, CASE WHEN n % 7 <> 0 THEN kind || ' of ' || n ELSE '' END AS description, coalesce(n % 7 <> 0, false) AS is_enriched FROM q""")
def described_blocks(spark, sf_dir):
    made = enrich.enrich_elements(prompted(spark, sf_dir), Q.CountingClient)
    return made.select("doc_key", "seq", "type", "description", "is_enriched")


class SeeingClient:
    """A model that tells the size of what it sees."""

    def call(self, image_bytes, prompt, mode):
        return {"description": f"{mode} of {len(image_bytes)} bytes: {prompt}"}


@Q.register("""SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN 'image of ' || octet_length(encode(text)) || ' bytes: in ' || lang ELSE '' END AS description, doc_id % 3 <> 1 AS is_enriched FROM documents""")
def picture_descriptions(spark, sf_dir):
    """A picture of every document (its text stands for one), two thirds of them described; equal ones are asked once."""
    n = F.col("doc_id")
    prompt = F.when(n % 3 != 1, F.concat(F.lit("in "), "lang"))
    rows = Q.table(spark, sf_dir, "documents").select("doc_id", F.lit("image").alias("type"), F.lit("").alias("description"), F.lit(False).alias("is_enriched"), F.col("text").cast("binary").alias("image_bytes"), prompt.alias("prompt"))
    return enrich.enrich_elements(rows, SeeingClient, model="seeing").select("doc_id", "description", "is_enriched")


# Outputs


@Q.register("""SELECT count(*) AS documents, sum(n_chars % 7)::BIGINT AS pages, sum(n_chars % 5)::BIGINT AS elements,
       count(*) FILTER (doc_id % 3 = 0) AS failed, 120.0::DOUBLE / count(*) AS seconds_per_document FROM documents""")
def throughput(spark, sf_dir):
    code = F.when(F.col("doc_id") % 3 == 0, "docling_failed").otherwise("image_too_large")
    docs = Q.table(spark, sf_dir, "documents").select(
        (F.col("n_chars") % 7).alias("page_count"), F.array_repeat(F.col("lang"), (F.col("n_chars") % 5).cast("int")).alias("elements"),
        F.array(F.struct(code.alias("code"))).alias("warnings"),
    )
    return batch.throughput(docs, 120)


@Q.register(f"""WITH {Q.BLOCKS}, {Q.TYPED} SELECT doc_id::VARCHAR AS doc_key, pos AS place, {Q.UUID5 % "sha256(doc_id::VARCHAR) || ':' || page_idx || ':' || pos"} AS element_id,
  type, text, '' AS description, 0 AS n_bbox, page_idx, false AS is_enriched FROM typed""")
def assembled_elements(spark, sf_dir):
    rows = assembled(spark, sf_dir).select("doc_key", F.posexplode("elements").alias("place", "e"))
    one = [F.col(f"e.{c}").alias(c) for c in ("element_id", "type", "text", "description", "page_idx", "is_enriched")]
    return rows.select("doc_key", "place", *one, F.size("e.bbox").alias("n_bbox"))


def assembled(spark, sf_dir) -> DataFrame:
    from docspark.plans.parse import parse_contents

    contents = Q.document_contents(spark, sf_dir)
    return parse_contents(contents.select("doc_key", F.concat("doc_key", F.lit(".png")).alias("file_path"), F.sha2("doc_key", 256).alias("file_sha256"), "content"))


_NO_LAYER = Q.PAGES_SQL.replace("CASE WHEN doc_key % 3 = 0 THEN extracted * (doc_key % 5 + 1) END", "NULL::BIGINT")


@Q.register(_NO_LAYER + """SELECT doc_key::VARCHAR AS doc_key, page_idx AS place, page_idx, CASE WHEN poor THEN 'promote_to_vlm' ELSE 'keep' END AS quality_decision, element_count, poor AS vlm_used,
  CASE WHEN poor THEN 'quality_gate_escalation' END AS code, CASE WHEN poor THEN 'Page ' || page_idx || ' escalated to VLM: heuristic_failed: ' || failing END AS message FROM g""")
def assembled_pages(spark, sf_dir):
    """Pages of the outputs, each with its warning."""
    rows = assembled(spark, sf_dir).select("doc_key", "warnings", F.posexplode("pages").alias("place", "p"))
    told = F.filter("warnings", lambda w: w["page_idx"] == F.col("p.page_idx"))
    return rows.select("doc_key", "place", "p.page_idx", "p.quality_decision", "p.element_count", "p.vlm_used", F.get(told["code"], 0).alias("code"), F.get(told["message"], 0).alias("message"))


# Lines of orders as elements of every type; every second is described.
@Q.register(f"""
WITH e AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, ['heading', 'text', 'caption', 'list_item', 'table', 'table', 'equation', 'image', 'unknown', 'header'][(l_orderkey + l_linenumber) % 10 + 1] AS type,
  (l_orderkey + l_linenumber) % 10 AS k, (l_orderkey // 10 + l_linenumber) % 2 = 0 AS told FROM lineitem),
f AS (SELECT o, n, CASE type WHEN 'heading' THEN CASE WHEN n % 2 = 0 THEN '## h' || n ELSE '# h' || n END WHEN 'text' THEN 't ' || n WHEN 'caption' THEN 'c' || n WHEN 'list_item' THEN '- i' || n
    WHEN 'table' THEN CASE WHEN k = 4 THEN '| ' || n || ' | a' || chr(92) || '|b |' || chr(10) || '| --- | --- |' WHEN told THEN '> d' || n ELSE 'rows ' || n END
    WHEN 'equation' THEN '$$' || chr(10) || 'x_' || n || chr(10) || '$$' WHEN 'image' THEN CASE WHEN told THEN '> d' || n ELSE '' END ELSE '' END AS fragment FROM e)
SELECT o AS doc_key, coalesce(string_agg(fragment, chr(10) || chr(10) ORDER BY n) FILTER (fragment <> ''), '') || chr(10) AS markdown FROM f GROUP BY o""")
def render_kinds(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    k, i = (o + n) % 10, n.cast("string")
    at = lambda *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k + 1).cast("int"))
    cat = lambda a, b="": F.concat(F.lit(a), i, F.lit(b))
    kind = at("heading", "text", "caption", "list_item", "table", "table", "equation", "image", "unknown", "header")
    text = at(
        F.when(n % 2 == 0, cat("## h")).otherwise(cat(" h", "\n")), cat("\tt ", " "), cat("c"), cat("i"), cat("<TABLE><tr><td>", "</td><td>a|b</td></tr></TABLE>"), cat("rows "),
        cat(" x_"), "alt", "odd", "head",
    )
    told = (F.floor(o / 10) + n) % 2 == 0
    rows = Q.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return render.render_documents(rows.select(o.alias("doc_key"), n.alias("seq"), kind.alias("type"), text.alias("text"), cat("d").alias("description"), told.alias("is_enriched")))


# Trees


@Q.register("""
WITH t AS (SELECT o_orderkey AS o, o_orderkey % 4 AS m FROM orders WHERE o_orderkey % 10 <> 0),
leaf AS (SELECT *, unnest([0, 1, 2, 3]) AS seq FROM t)
SELECT o::VARCHAR AS doc_key, seq::INTEGER AS seq, CASE seq WHEN 0 THEN CASE WHEN m = 0 THEN 'heading' ELSE 'unknown' END WHEN 1 THEN 'table' WHEN 2 THEN 'list_item' ELSE 'image' END AS type,
       CASE seq WHEN 0 THEN 'first ' || o WHEN 1 THEN 'caption ' || o || chr(10) || '{"rows": ' || m || ', "name": "n' || o || '"}' WHEN 2 THEN 'last ' || o ELSE '' END AS text,
       CASE seq WHEN 0 THEN m WHEN 1 THEN 0 ELSE 2 END::INTEGER AS page_idx, CASE seq WHEN 0 THEN [1.0, 0.0, m::DOUBLE, 4.5] WHEN 2 THEN [m::DOUBLE, 2.0] ELSE []::DOUBLE[] END AS bbox,
       CASE WHEN seq = 3 THEN 'picture ' || o END AS picture FROM leaf""")
def tree_kinds(spark, sf_dir):
    """Nested groups with texts, a table and a picture; in every tenth tree the inner group holds the outer one."""
    o, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    refs = lambda *names: F.array(*[F.lit(f"#/{n}") for n in names])
    spot = lambda page, box: F.array(F.struct(page.alias("page_no"), box.alias("bbox")))
    say = lambda head: F.concat(F.lit(head), o)
    first = F.to_json(F.struct(
        F.when(m == 0, "section_header").otherwise("title").alias("label"), say("first ").alias("orig"), F.lit("other").alias("text"),
        spot(m + 1, F.struct(F.lit(1).alias("l"), F.lit(4.5).alias("t"), m.alias("r"))).alias("prov"),
    ))
    last = F.to_json(F.struct(F.lit("list_item").alias("label"), say("last ").alias("text"), F.array(m, F.lit(2)).alias("bbox"), F.array(F.struct(F.lit(3).alias("page_no"))).alias("prov")))
    data = F.struct(m.alias("rows"), say("n").alias("name"))
    inner = F.when(F.col("o_orderkey") % 10 == 0, refs("tables/0", "groups/0", "texts/-1")).otherwise(refs("tables/0", "texts/-1"))
    tree = F.struct(
        F.struct(refs("groups/0", "pictures/0").alias("children")).alias("body"),
        F.array(F.struct(refs("texts/0", "groups/1").alias("children")), F.struct(inner.alias("children"))).alias("groups"),
        F.array(F.struct(say("caption ").alias("caption"), data.alias("data"))).alias("tables"),
        F.array(F.struct(F.struct(F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(say("picture "), "UTF-8"))).alias("uri")).alias("image"), F.array(F.struct(F.lit(3).alias("page_no"))).alias("prov"))).alias("pictures"),
    )
    # the texts differ in their fields
    content = F.concat(F.lit('{"texts":['), first, F.lit(","), last, F.lit("],"), F.substr(F.to_json(tree), F.lit(2)))
    # numbers alone are dealt out: a file of them is a few tasks, and most of the work is what is made of each
    orders = Q.table(spark, sf_dir, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism)
    trees = orders.select(o.alias("doc_key"), content.alias("content"))
    made = docling.route_leaves(docling.walk_contents(trees))
    return made.select("doc_key", "seq", "type", "text", "page_idx", "bbox", F.decode("image_bytes", "UTF-8").alias("picture"))


@Q.register("SELECT r_regionkey, CASE WHEN r_regionkey <= 2 THEN (3495251 + r_regionkey) * 3 END AS n_bytes, r_regionkey > 2 AS too_large FROM region")
def picture_sizes(spark, sf_dir):
    """Pictures of up to 10 MiB and beyond."""
    data = F.repeat(F.lit("QUFB"), (F.col("r_regionkey") + 3495251).cast("int"))
    made = Q.table(spark, sf_dir, "region").select("r_regionkey", media.decoded_picture(data).alias("p"))
    return made.select("r_regionkey", F.octet_length("p.bytes").alias("n_bytes"), "p.too_large")


@Q.register(r"SELECT p_partkey::VARCHAR AS doc_key, (p_size % 9)::INTEGER AS page_idx, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 595.0 END AS width, 842.0::DOUBLE AS height, 0 AS rotation FROM part")
def page_dimensions(spark, sf_dir):
    size = F.col("p_size")
    pages = Q.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_key"), (size % 9).cast("int").alias("page_idx"), F.when(size % 2 == 0, size).alias("width"))
    return export.page_dimensions(pages)
