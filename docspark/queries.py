"""Registered queries: each runs an operator over whole driver tables, with the DuckDB SQL of the same result.

The driver's tables stand in for parsed documents: a document's lines are layout blocks (ten to a page), a web page's
tags are blocks, a conversation's turns are blocks in order.  Where a table never shows a case (odd characters, boxes,
pictures), the query derives rows for it from the table's own values, for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import blocks as B
from docspark.functions import geometry, ids, media
from docspark.functions import text as T
from docspark.operators import context, docling, documents, elements, enrich, export, gate, render
from docspark.plans import batch, cache
from docspark.schema import EnrichmentConfig
from docspark.sources import files
from docspark.sources.html import page_blocks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# White space in RE2, and what the oracles share.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"regexp_replace(regexp_replace(%s, '^{WS}+', ''), '{WS}+$', '')"
TOKENS = rf"list_filter(regexp_split_to_array(%s, '{WS}+'), lambda t: t <> '')"
UUID5 = (
    "(WITH h AS (SELECT sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(%s)) AS x) SELECT x[1:8] || '-' || x[9:12] || '-5' || "
    "x[14:16] || '-' || CASE WHEN x[17] IN ('0','4','8','c') THEN '8' WHEN x[17] IN ('1','5','9','d') THEN '9' "
    "WHEN x[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || x[18:20] || '-' || x[21:32] FROM h)"
)
# A document's lines as blocks: the first line a title, every seventh a list item, the rest text; ten lines a page.
BLOCKS = """blocks AS (
  SELECT doc_id, (i - 1)::INTEGER AS pos, lines[i] AS text, ((i - 1) // 10)::INTEGER AS page_idx,
         CASE WHEN i = 1 THEN 'title' WHEN i %% 7 = 0 THEN 'list' WHEN i %% 11 = 0 THEN 'footer' ELSE 'text' END AS type
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))""".replace("%%", "%")
TYPED = """typed AS (
  SELECT doc_id, pos, page_idx, CASE type WHEN 'title' THEN 'heading' WHEN 'list' THEN 'list_item' ELSE type END AS type,
         CASE WHEN type = 'title' AND text <> '' AND NOT starts_with(text, '#') THEN repeat('#', doc_id % 6 + 1) || ' ' || text ELSE text END AS text
  FROM blocks)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows: doc_id, pos, text, page_idx, type."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    i = F.col("pos") + 1
    kind = F.when(i == 1, "title").when(i % 7 == 0, "list").when(i % 11 == 0, "footer").otherwise("text")
    return lines.select("doc_id", "pos", "text", F.floor(F.col("pos") / 10).cast("int").alias("page_idx"), kind.alias("type"))


def document_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks as content lists: doc_key, content."""
    lines = F.split("text", "\n", -1)
    block = F.transform(lines, lambda t, i: F.struct(
        F.when(i == 0, "title").when((i + 1) % 7 == 0, "list").when((i + 1) % 11 == 0, "footer").otherwise("text").alias("type"), t.alias("text"),
        F.floor(i / 10).cast("int").alias("page_idx"), (F.col("doc_id") % 6 + 1).alias("text_level"),
    ))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.to_json(block).alias("content"))


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows of the document blocks, without the JSON step: doc_key, seq, page_idx, type, text."""
    rows = document_blocks(spark, sf_dir)
    kind, text = B.block_type(F.col("type")), F.col("text")
    marked = F.when((kind == "heading") & (text != ""), T.heading(text, (F.col("doc_id") % 6 + 1).cast("int"))).otherwise(text)
    return rows.select(F.col("doc_id").alias("doc_key"), F.col("pos").alias("seq"), "page_idx", kind.alias("type"), marked.alias("text"))


# Sources


@register("""
SELECT o_orderkey AS input_pos, path, CASE WHEN o_orderkey % 5 = 0 THEN 'file_not_found'
         WHEN lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) NOT IN ('pdf','png','jpg','jpeg','tif','tiff','webp') THEN 'unsupported_type' END AS status,
       lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS suffix
FROM (SELECT o_orderkey, '/in/[' || o_custkey || ']/f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '' ELSE '.tar.webp' END AS path
      FROM orders)""")
def file_classify(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", "", ".tar.webp"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/in/["), F.col("o_custkey").cast("string"), F.lit("]/f"), F.col("o_orderkey").cast("string"), ending)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input_pos"), path.alias("path"), (F.col("o_orderkey") % 5 != 0).alias("exists"))
    status = batch.path_status(F.col("exists"), files.is_accepted(F.col("path"), EnrichmentConfig()))
    return rows.select("input_pos", "path", status.alias("status"), files.suffix(F.col("path")).alias("suffix"))


@register("""SELECT doc_id, sha256(text) AS sha256, sha256(text)[1:32] || '_' || (1700000000000 + n_chars) AS cache_key,
       (sha256(text)[1:32] || '_' || (1700000000000 + n_chars))[1:16] || '.json' AS cache_name FROM documents""")
def content_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text").cast("binary")).alias("sha256"), "n_chars")
    key = ids.cache_key(F.col("sha256"), F.col("n_chars") + 1700000000000)
    return rows.select("doc_id", "sha256", key.alias("cache_key"), ids.cache_name(key).alias("cache_name"))


@register("""
WITH k AS (SELECT doc_id, lang, sha256(text)[1:32] || '_' || n_chars AS cache_key FROM documents),
c AS (SELECT cache_key, min(doc_id) AS cached_from FROM k WHERE lang = 'en' GROUP BY cache_key)
SELECT k.doc_id, c.cached_from, c.cached_from IS NOT NULL AS hit FROM k LEFT JOIN c USING (cache_key)""")
def cache_hit_miss(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", ids.cache_key(F.sha2("text", 256), F.col("n_chars")).alias("cache_key"))
    # the cache holds what an earlier run over the English documents left
    held = rows.where("lang = 'en'").groupBy("cache_key").agg(F.min("doc_id").alias("cached_from"))
    hits, misses = cache.split_hits(rows, held)
    missing = misses.withColumn("cached_from", F.lit(None).cast("bigint"))
    return hits.withColumn("hit", F.lit(True)).unionByName(missing.withColumn("hit", F.lit(False))).select("doc_id", "cached_from", "hit")


# Blocks to elements


@register(f"SELECT doc_id, {UUID5 % "sha256(text) || ':' || (doc_id % 7) || ':' || n_chars"} AS element_id FROM documents")
def element_id(spark, sf_dir):
    made = ids.element_id(F.sha2("text", 256), F.col("doc_id") % 7, F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("element_id"))


@register("""
SELECT raw, block_type, label_type, count(*) AS n FROM (
  SELECT raw, CASE raw WHEN 'text' THEN 'text' WHEN 'title' THEN 'heading' WHEN 'list' THEN 'list_item' WHEN 'image' THEN 'image'
           WHEN 'interline_equation' THEN 'equation' WHEN 'table_caption' THEN 'caption' ELSE 'unknown' END AS block_type,
         CASE raw WHEN 'paragraph' THEN 'text' WHEN 'section_header' THEN 'heading' WHEN 'formula' THEN 'equation' ELSE 'unknown' END AS label_type
  FROM (SELECT ['text', 'title', 'list', 'image', 'interline_equation', 'table_caption', 'Text', NULL, 'paragraph', 'section_header', 'formula'][(l_orderkey + l_linenumber) % 11 + 1] AS raw FROM lineitem))
GROUP BY ALL""")
def route_types(spark, sf_dir):
    names = ("text", "title", "list", "image", "interline_equation", "table_caption", "Text", None, "paragraph", "section_header", "formula")
    at = ((F.col("l_orderkey") + F.col("l_linenumber")) % 11 + 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.element_at(F.array(*map(F.lit, names)), at).alias("raw"))
    return rows.select("raw", B.block_type(F.col("raw")).alias("block_type"), B.label_type(F.col("raw")).alias("label_type")).groupBy("raw", "block_type", "label_type").agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT doc_id, CASE WHEN starts_with(t, '#') THEN t ELSE repeat('#', greatest(1, least(6, coalesce(lvl, 1)))) || ' ' || t END AS heading
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '#' || text ELSE text END AS t, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 12)::INTEGER - 2 END AS lvl FROM documents)""")
def heading_prefix(spark, sf_dir):
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text"))
    level = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 12 - 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.heading(text, level).alias("heading"))


@register(f"""
WITH {BLOCKS}, {TYPED}
SELECT doc_id::VARCHAR AS doc_key, (row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, pos) - 1)::INTEGER AS seq, page_idx, type, text,
       {UUID5 % "doc_id || ':' || page_idx || ':' || pos"} AS element_id FROM typed""")
def content_list_elements(spark, sf_dir):
    return documents.element_rows(document_contents(spark, sf_dir)).select("doc_key", "seq", "page_idx", "type", "text", "element_id")


@register("""
SELECT o_orderkey AS order_key, (row_number() OVER (PARTITION BY o_orderkey ORDER BY page_idx, pos) - 1)::INTEGER AS seq, page_idx, pos
FROM (SELECT o_orderkey, l_linenumber AS pos, (l_partkey % 4)::INTEGER - 1 AS page_idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE page_idx >= 0""")
def page_group_seq(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_key"), F.col("l_linenumber").alias("block_pos"), ((F.col("l_partkey") % 4) - 1).cast("int").alias("p"))
    got = elements.number_blocks(rows, F.col("p"))
    return got.select(F.col("doc_key").alias("order_key"), "seq", "page_idx", F.col("block_pos").alias("pos"))


@register("""
WITH e AS (SELECT l_orderkey, (l_partkey % 9)::INTEGER AS page_idx FROM lineitem),
s AS (SELECT l_orderkey, unnest(range(0, max(page_idx) + 1))::INTEGER AS page_idx FROM e GROUP BY l_orderkey)
SELECT s.l_orderkey AS doc_key, s.page_idx, count(e.page_idx)::INTEGER AS element_count FROM s LEFT JOIN e USING (l_orderkey, page_idx) GROUP BY ALL""")
def page_spine(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_key"), (F.col("l_partkey") % 9).cast("int").alias("page_idx"))
    counts = rows.groupBy("doc_key", "page_idx").agg(F.count(F.lit(1)).cast("int").alias("element_count"))
    spine = gate.page_spine(rows).select("doc_key", "page_idx")
    return spine.join(counts, ["doc_key", "page_idx"], "left").fillna({"element_count": 0})


# The gate

SIGNALS_SQL = """
  SELECT *, n_tok = 0 AS no_words, CASE WHEN n_tok = 0 THEN 0.0 ELSE len(list_filter(tok, lambda t: regexp_matches(t, '[A-Za-z]\\p{Nd}|\\p{Nd}[A-Za-z]')))::DOUBLE / n_tok END AS garbled_token_ratio,
         CASE WHEN n_tok = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(tok, lambda t: length(t))), 0)::DOUBLE / n_tok END AS mean_word_length,
         CASE WHEN n_tok = 0 THEN 0.0 ELSE len(list_filter(tok, lambda t: regexp_matches(t, '^\\p{L}+$') OR regexp_matches(regexp_replace(
           regexp_replace(regexp_replace(t, '^[()\\[\\].,%$:/+-]+', ''), '[()\\[\\].,%$:/+-]+$', ''), '[,./]', '', 'g'), '^[\\p{Nd}²³¹]+$')))::DOUBLE / n_tok END AS dict_hit_rate,
         n_tok > 0 AND has_run AS has_repeated_char_run,
         CASE WHEN n_tok = 0 THEN 1.0 ELSE length(regexp_replace(replace(text, ' ', 'x'), '[\\p{C}\\p{Z}]', '', 'g'))::DOUBLE / greatest(length(text), 1) END AS ascii_printable_ratio"""
FAILING_SQL = """CASE WHEN no_words THEN 'empty_text' ELSE array_to_string(list_filter([CASE WHEN garbled_token_ratio > 0.2 THEN 'garbled_token_ratio' END,
  CASE WHEN mean_word_length < 2.0 THEN 'mean_word_length' END, CASE WHEN dict_hit_rate < 0.5 THEN 'dict_hit_rate' END,
  CASE WHEN has_repeated_char_run THEN 'repeated_char_run' END, CASE WHEN ascii_printable_ratio < 0.9 THEN 'ascii_printable_ratio' END], lambda x: x IS NOT NULL), ', ') END"""
RUNS_SQL = "EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(%s, 'x{7,}')) AS r) WHERE length(r) >= 7)"


@register(f"""
WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN text || ' ' || repeat('x', 8) WHEN 2 THEN regexp_replace(text, '([a-z])[a-z]', '\\1' || '7', 'g')
         WHEN 3 THEN replace(text, 'e', chr(1)) WHEN 4 THEN regexp_replace(text, '([a-z])', '\\1 ', 'g') ELSE text END AS text FROM documents),
t AS (SELECT *, {TOKENS % 'text'} AS tok FROM s),
u AS (SELECT *, len(tok) AS n_tok, doc_id IN (SELECT doc_id FROM (
        SELECT doc_id, grp, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS grp
          FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM s) WHERE c <> chr(10)) GROUP BY doc_id, c, grp) WHERE n >= 7) AS has_run FROM t),
v AS ({SIGNALS_SQL} FROM u)
SELECT doc_id, garbled_token_ratio, mean_word_length, dict_hit_rate, has_repeated_char_run, ascii_printable_ratio, {FAILING_SQL} AS failing FROM v""")
def quality_signals(spark, sf_dir):
    text, case = F.col("text"), F.col("doc_id") % 6
    odd = (
        F.when(case == 1, F.concat(text, F.lit(" xxxxxxxx"))).when(case == 2, F.regexp_replace(text, "([a-z])[a-z]", "$17"))
        .when(case == 3, F.replace(text, F.lit("e"), F.lit("\x01"))).when(case == 4, F.regexp_replace(text, "([a-z])", "$1 ")).otherwise(text)
    )
    rows = gate.with_signals(table(spark, sf_dir, "documents").select("doc_id", odd.alias("text")))
    return rows.select("doc_id", *[c for c in rows.columns if c.endswith(("ratio", "length", "rate", "run"))], F.array_join("failing_signals", ", ").alias("failing"))


PAGES_SQL = f"""
WITH {BLOCKS}, {TYPED},
tok AS (SELECT *, {TOKENS % 'text'} AS words FROM typed),
p AS (SELECT doc_id AS doc_key, page_idx, count(*)::INTEGER AS element_count,
             coalesce(sum(len(words)) FILTER (type IN ('text', 'heading', 'list_item')), 0)::BIGINT AS extracted,
             coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (type <> 'footer' AND text <> ''), '') AS text FROM tok GROUP BY doc_id, page_idx),
l AS (SELECT *, CASE WHEN doc_key % 3 = 0 THEN extracted * (doc_key % 5 + 1) END AS layer_tokens FROM p),
c AS (SELECT *, CASE WHEN layer_tokens >= 50 THEN extracted::DOUBLE / layer_tokens END AS coverage, false AS has_run_, {TOKENS % 'text'} AS tok FROM l),
u AS (SELECT *, len(tok) AS n_tok, (doc_key, page_idx) IN (SELECT (doc_key, page_idx) FROM (
        SELECT doc_key, page_idx, count(*) AS n FROM (SELECT doc_key, page_idx, ch, i - row_number() OVER (PARTITION BY doc_key, page_idx, ch ORDER BY i) AS grp
          FROM (SELECT doc_key, page_idx, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS i FROM c) WHERE ch <> chr(10)) GROUP BY doc_key, page_idx, ch, grp) WHERE n >= 7) AS has_run FROM c),
v AS ({SIGNALS_SQL} FROM u),
w AS (SELECT *, {FAILING_SQL} AS failing, coalesce(coverage < 0.3, false) AS thin FROM v),
g AS (SELECT *, NOT thin AND NOT no_words AND failing <> '' AS poor FROM w)"""


def gated_pages(spark, sf_dir) -> DataFrame:
    """Rows of pages, from documents that are one row each until then."""
    doc, lines = F.col("doc_id"), F.split("text", "\n", -1)
    kind = lambda i: F.when(i == 0, "title").when((i + 1) % 7 == 0, "list").when((i + 1) % 11 == 0, "footer").otherwise("text")
    level = (doc % 6 + 1).cast("int")
    elements = F.transform(lines, lambda t, i: F.struct(
        F.floor(i / 10).cast("int").alias("page_idx"), B.block_type(kind(i)).alias("type"), F.when((i == 0) & (t != ""), T.heading(t, level)).otherwise(t).alias("text"),
    ))
    docs = documents.with_pages(table(spark, sf_dir, "documents").select(doc.alias("doc_key"), elements.alias("elements")))
    # a text layer is known of every third document, up to five times the words that were extracted
    words = F.when(F.col("doc_key") % 3 == 0, F.transform("pages", lambda p: p["extracted"] * (F.col("doc_key") % 5 + 1)))
    docs = documents.with_decisions(docs.withColumn("layer_words", words), F.col("layer_words"))
    # not ``explode``: the filter that Spark infers from it would be pushed down, and with it all that pages are made of
    return docs.select("doc_key", F.explode_outer("pages").alias("p")).where("p is not null").select("doc_key", "p.*")


@register(PAGES_SQL + """SELECT doc_key, page_idx, element_count, extracted, CASE WHEN thin OR poor THEN 'promote_to_vlm' ELSE 'keep' END AS quality_decision,
  CASE WHEN thin THEN 1 WHEN poor THEN 2 END AS layer, thin OR poor AS vlm_used, coverage, CASE WHEN poor THEN 'heuristic_failed: ' || failing END AS reason FROM g""")
def gate_pages(spark, sf_dir):
    return gated_pages(spark, sf_dir).select("doc_key", "page_idx", "element_count", "extracted", "quality_decision", "layer", "vlm_used", "coverage", "reason")


@register(PAGES_SQL + """SELECT doc_key, page_idx, 'quality_gate_escalation' AS code, 'Page ' || page_idx || ' escalated to VLM: ' ||
  CASE WHEN thin THEN 'coverage=' || printf('%.2f', coverage) || '<0.3' ELSE 'heuristic_failed: ' || failing END AS message FROM g WHERE thin OR poor""")
def gate_escalations(spark, sf_dir):
    return gate.escalations(gated_pages(spark, sf_dir))


@register(PAGES_SQL + """, d AS (SELECT doc_key, bool_or(thin OR poor) AS escalated, count(*) AS pages FROM g GROUP BY doc_key)
SELECT quality, toxic, escalated, count(*) AS documents, sum(pages)::BIGINT AS pages FROM d JOIN labels ON doc_id = doc_key GROUP BY ALL""")
def gate_by_label(spark, sf_dir):
    docs = gated_pages(spark, sf_dir).groupBy("doc_key").agg(F.bool_or("vlm_used").alias("escalated"), F.count(F.lit(1)).alias("pages"))
    joined = docs.join(table(spark, sf_dir, "labels"), F.col("doc_key") == F.col("doc_id"))
    return joined.groupBy("quality", "toxic", "escalated").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"))


# Context and prompts

TURNS = "t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'title' WHEN 'user' THEN 'text' ELSE 'image' END AS type, coalesce(text, '') AS text FROM conversations)"
CUT = f"CASE WHEN len({TOKENS % 'x'}) <= %d THEN x ELSE array_to_string(({TOKENS % 'x'})[1:%d], ' ') || '...' END"


def turns(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("role") == "system", "title").when(F.col("role") == "user", "text").otherwise("image")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("type"), F.coalesce("text", F.lit("")).alias("text"))


CONTEXT_SQL = """c AS (SELECT conv_id, turn, type, text, coalesce(string_agg(CASE WHEN type IN ('text', 'title') AND text <> '' THEN text END, chr(10) ORDER BY turn)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), '') AS x FROM t)"""
CONTEXT_SQL = CONTEXT_SQL.replace("string_agg(CASE WHEN type IN ('text', 'title') AND text <> '' THEN text END, chr(10) ORDER BY turn)", "array_to_string(list_filter(list(CASE WHEN type IN ('text', 'title') AND text <> '' THEN text END)").replace("EXCLUDE CURRENT ROW), '')", "EXCLUDE CURRENT ROW), lambda y: y IS NOT NULL), chr(10)), '')")


@register(f"WITH {TURNS}, {CONTEXT_SQL} SELECT conv_id, turn, {CUT % (40, 40)} AS context FROM c")
def context_block(spark, sf_dir):
    return context.block_context(turns(spark, sf_dir), 2, 40, "conv_id", "turn").select("conv_id", "turn", "context")


@register(f"""WITH {TURNS}, p AS (SELECT DISTINCT conv_id, (turn // 2)::INTEGER AS page_idx FROM t),
c AS (SELECT p.conv_id, p.page_idx, coalesce(string_agg(t.text, chr(10) ORDER BY t.turn) FILTER (t.type IN ('text', 'title') AND t.text <> ''), '') AS x
      FROM p JOIN t ON t.conv_id = p.conv_id AND abs(t.turn // 2 - p.page_idx) <= 1 GROUP BY ALL)
SELECT conv_id, page_idx, {CUT % (60, 60)} AS context FROM c""")
def context_page(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("page_idx", F.floor(F.col("turn") / 2).cast("int"))
    return context.page_context(rows, 60, "conv_id", "page_idx", "turn")


@register(f"SELECT doc_id, {CUT % (25, 25)} AS short FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' ' || text ELSE text END AS x FROM documents)")
def truncate_words(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(text, 25).alias("short"))


@register(f"WITH {TURNS}, {CONTEXT_SQL} SELECT conv_id, turn, replace({repr(enrich.PROMPTS['image'])}, '%s', coalesce(nullif({CUT % (64, 64)}, ''), '(none)')) AS prompt FROM c WHERE type = 'image'".replace('\\n', "' || chr(10) || '"))
def prompts(spark, sf_dir):
    rows = context.block_context(turns(spark, sf_dir), 2, 64, "conv_id", "turn").where("type = 'image'")
    return rows.select("conv_id", "turn", enrich.prompt("image", F.col("context")).alias("prompt"))


class CountingClient:
    """A model that says how long its prompt was, and fails on every seventh."""

    def call(self, image_bytes, prompt, mode):
        return {"error": "busy"} if len(prompt) % 7 == 0 else {"description": f"{mode} of {len(prompt)}"}


@register(f"""WITH {TURNS}, {CONTEXT_SQL},
q AS (SELECT conv_id, turn, type, text, CASE WHEN type = 'image' THEN length(replace({repr(enrich.PROMPTS['image'])}, '%s', coalesce(nullif({CUT % (64, 64)}, ''), '(none)'))) END AS n FROM c)
SELECT conv_id, turn, type, CASE WHEN n % 7 <> 0 THEN 'image of ' || n ELSE '' END AS description, coalesce(n % 7 <> 0, false) AS is_enriched FROM q""".replace('\\n', "' || chr(10) || '"))
def enrich_stub(spark, sf_dir):
    rows = context.block_context(turns(spark, sf_dir), 2, 64, "conv_id", "turn").withColumn("prompt", F.when(F.col("type") == "image", enrich.prompt("image", F.col("context"))))
    rows = rows.select("conv_id", "turn", "type", "prompt", F.lit("").alias("description"), F.lit(False).alias("is_enriched"), F.lit(None).cast("binary").alias("image_bytes"))
    return enrich.enrich_elements(rows, CountingClient).drop("image_bytes")


# Batches


@register("SELECT o_orderkey, (place // 8)::INTEGER AS chunk, place || '_' || 'f' || o_custkey AS batch_name FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)")
def chunk_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("stem"))
    return batch.plan_passes(rows, 8, "o_orderkey", "stem").select("o_orderkey", "chunk", "batch_name")


@register("""SELECT o_orderkey AS input_pos, o_custkey AS path, CASE WHEN o_custkey % 3 = 0 THEN 'invalid' WHEN o_custkey % 3 = 1 THEN 'hit' WHEN o_custkey % 5 = 0 THEN NULL ELSE 'parsed' END AS result FROM orders""")
def merge_order(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input_pos"), F.col("o_custkey").alias("path"))
    once = asked.select("path").distinct()
    buckets = [once.where(w).withColumn("result", F.lit(v)) for w, v in (("path % 3 = 0", "invalid"), ("path % 3 = 1", "hit"), ("path % 3 = 2 and path % 5 <> 0", "parsed"))]
    return batch.merge_in_order(asked, *buckets, "path", "result")


@register("""SELECT count(*) AS requested, count(*) FILTER (lang = 'fr') AS cache_hits, count(*) FILTER (lang IN ('en', 'de')) AS parsed,
       count(*) FILTER (lang IN ('en', 'de') AND n_chars < 300) AS empty_or_failed, count(*) FILTER (lang = 'de') AS fallback FROM documents""")
def batch_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    code = F.when(F.col("n_chars") < 300, "mineru_failed").otherwise("quality_gate_escalation")
    parsed = docs.where("lang in ('en', 'de')").select("doc_id", F.array(F.struct(code.alias("code"))).alias("warnings"))
    return batch.summary(docs, docs.where("lang = 'fr'"), parsed, docs.where("lang = 'de'"))


# Layout trees


def trees(spark, sf_dir) -> DataFrame:
    """One tree a region: its nations are groups under the body, their first customers texts; some references are bad."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.groupBy("n_regionkey", "n_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))
    texts = c.select("n_regionkey", "n_nationkey", F.explode("keys").alias("k"))
    ranked = texts.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "k"))).alias("t"))
    nodes = F.transform("t", lambda x: F.struct(F.when(x["k"] % 2 == 0, "paragraph").otherwise("title").alias("label"), x["k"].cast("string").alias("orig")))
    nations = F.array_sort(F.array_distinct(F.transform("t", lambda x: x["n_nationkey"])))
    ref = lambda kind, i: F.concat(F.lit(f"#/{kind}/"), i.cast("string"))
    place = F.transform("t", lambda x, i: F.struct(x["n_nationkey"].alias("n"), i.alias("i")))
    groups = F.transform(nations, lambda n: F.struct(F.transform(F.filter(place, lambda p: p["n"] == n), lambda p: ref("texts", p["i"])).alias("children")))
    kids = F.concat(F.transform(nations, lambda n, i: ref("groups", i)), F.array(F.lit("#/texts/abc"), F.lit("#/texts/99999999"), F.lit("#/texts"), F.lit("#/other/0")))
    body = F.struct(F.struct(kids.alias("children")).alias("body"), nodes.alias("texts"), groups.alias("groups"))
    return ranked.select(F.col("n_regionkey").cast("string").alias("doc_key"), F.to_json(body).alias("content"))


@register("""SELECT n_regionkey::VARCHAR AS doc_key, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) - 1)::INTEGER AS seq,
       CASE WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'unknown' END AS type, c_custkey::VARCHAR AS text, 0 AS page_idx FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tree_walk(spark, sf_dir):
    leaves = docling.walk(docling.explode_nodes(trees(spark, sf_dir)))
    return docling.route_leaves(leaves).select("doc_key", "seq", "type", "text", "page_idx")


@register("""SELECT n_regionkey::VARCHAR AS doc_key, 'groups' AS node_type, (dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS idx
FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT n_regionkey::VARCHAR, 'texts', (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) - 1)::INTEGER FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def ref_resolve(spark, sf_dir):
    nodes = docling.explode_nodes(trees(spark, sf_dir))
    return docling.resolve_refs(docling.child_refs(nodes).select("doc_key", "ref"), nodes).select("doc_key", "node_type", "idx")


# Boxes, scales, pictures


@register("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_size::DOUBLE, 0.0, p_retailprice, p_size * 2.0] WHEN 1 THEN [p_size::DOUBLE, p_retailprice] ELSE []::DOUBLE[] END AS bbox FROM part""")
def bbox_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    sides = F.to_json(F.struct(size.cast("double").alias("l"), price.alias("r"), (size * 2.0).alias("t")))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"bbox":'), sides, F.lit("}"))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.array(size.cast("double"), price).alias("bbox")))).otherwise('{"bbox":"none"}')
    box = F.parse_json(raw)
    named = geometry.bbox_from_sides(*[F.try_variant_get(box, f"$.bbox.{s}", "double") for s in "lbrt"])
    return p.select("p_partkey", F.when(B.kind_of(box, "bbox").startswith("OBJECT"), named).otherwise(B.bbox(box)).alias("bbox"))


@register("""SELECT p_partkey, CASE WHEN p_size * 100.0 * p_retailprice <= 0 OR 400000 <= 0 OR p_size * 100.0 * p_retailprice * 2.0 * 2.0 <= 400000 THEN 2.0
  ELSE 2.0 * sqrt(400000.0 / (p_size * 100.0 * p_retailprice * 2.0 * 2.0)) END AS scale, p_size * 100.0 * p_retailprice * 2.0 * 2.0 > 400000 AS clamped FROM part""")
def clamp_scale(spark, sf_dir):
    made = geometry.clamped_scale(F.col("p_size") * 100.0, F.col("p_retailprice"), F.lit(2.0), F.lit(400000))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("c")).select("p_partkey", "c.scale", "c.clamped")


@register("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS x0, l_quantity * 20 AS y0, l_quantity * 10 + l_linenumber * 30 AS x1, l_quantity * 20 + l_linenumber * 40 - 40 AS y1 FROM lineitem),
p AS (SELECT *, greatest(0.0, least(x0 * 2.0, 800.0)) AS l, greatest(0.0, least(x1 * 2.0, 800.0)) AS r, greatest(0.0, least((842.0 - y1) * 2.0, 1684.0)) AS t, greatest(0.0, least((842.0 - y0) * 2.0, 1684.0)) AS b FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN r > l AND b > t THEN trunc(l)::INTEGER END AS left_px, CASE WHEN r > l AND b > t THEN trunc(t)::INTEGER END AS top_px,
  CASE WHEN r > l AND b > t THEN trunc(r)::INTEGER END AS right_px, CASE WHEN r > l AND b > t THEN trunc(b)::INTEGER END AS bottom_px FROM p""")
def region_pixels(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    box = geometry.region_pixels(F.array(q * 10, q * 20, q * 10 + n * 30, q * 20 + n * 40 - 40), F.lit(842.0), F.lit(2.0), F.lit(800), F.lit(1684))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *[F.col(f"b.{s}").alias(f"{s}_px") for s in ("left", "top", "right", "bottom")])


@register("""SELECT doc_id, ['image/jpeg', 'image/png', 'image/gif', 'image/gif', 'image/webp', 'image/png'][doc_id % 6 + 1] AS media_type FROM documents""")
def media_type(spark, sf_dir):
    heads = ("FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "52494646AAAAAAAA57454250", "52494646AAAAAAAA00000000")
    content = F.concat(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 6 + 1).cast("int"))), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", media.media_type(content).alias("media_type"))


@register("""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN NULL ELSE sha256(text) END AS picture, false AS too_large FROM documents""")
def picture_decode(spark, sf_dir):
    data = F.base64(F.encode("text", "UTF-8"))
    case = F.col("doc_id") % 4
    uri = F.when(case == 0, F.concat(F.lit("data:image/png;base64,"), data)).when(case == 1, F.concat(data, F.lit("a"))).when(case == 2, F.concat(F.lit("data:x,\n*"), data)).otherwise(data)
    made = media.decoded_picture(uri)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("p")).select("doc_id", F.sha2("p.bytes", 256).alias("picture"), "p.too_large")


# Answers


@register(f"""SELECT conv_id, turn, {STRIP % "regexp_replace(regexp_replace('<THINK>' || text || '</think> ' || text || chr(10) || '<thinking>a</THINKING>' || turn || ' ', '<think>.*?</think>', '', 'gsi'), '<thinking>.*?</thinking>', '', 'gsi')"} AS answer FROM conversations""")
def strip_thinking(spark, sf_dir):
    raw = F.concat(F.lit("<THINK>"), "text", F.lit("</think> "), "text", F.lit("\n<thinking>a</THINKING>"), F.col("turn").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_thinking(raw).alias("answer"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'plain ' || event_type ELSE 'seen ' || event_type END AS description FROM events""")
def robust_json(spark, sf_dir):
    from docspark.functions.python_only import answer_description

    said = F.to_json(F.struct(F.concat(F.lit("seen "), "event_type").alias("description"), F.col("props").alias("p")))
    case = F.col("event_id") % 4
    raw = F.when(case == 0, said).when(case == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(case == 2, F.concat(F.lit("So: "), F.regexp_replace(said, r'\\"|[{}]', ""), F.lit(" "), F.to_json(F.struct(F.concat(F.lit("seen "), "event_type").alias("description"))))).otherwise(F.concat(F.lit("plain "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", answer_description(T.strip_thinking(raw)).alias("description"))


# Rendering and export


@register(f"""WITH {BLOCKS}, {TYPED},
f AS (SELECT doc_id, pos, type, {STRIP % 'text'} AS t FROM typed),
g AS (SELECT doc_id, pos, CASE type WHEN 'heading' THEN t WHEN 'text' THEN t WHEN 'list_item' THEN CASE WHEN t = '' THEN '' ELSE '- ' || t END ELSE '' END AS fragment FROM f)
SELECT doc_id AS doc_key, {STRIP % "coalesce(string_agg(fragment, chr(10) || chr(10) ORDER BY pos) FILTER (fragment <> ''), '')"} || chr(10) AS markdown FROM g GROUP BY doc_id""")
def render_markdown(spark, sf_dir):
    rows = document_elements(spark, sf_dir).withColumns({"description": F.lit(""), "is_enriched": F.lit(False)})
    return render.render_documents(rows)


@register(f"SELECT c_custkey, {STRIP % "replace(replace(' ' || c_name || '|' || c_mktsegment || chr(10), '|', chr(92) || '|'), chr(10), ' ')"} AS cell FROM customer")
def escape_cell(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.escape_cell(F.concat(F.lit(" "), "c_name", F.lit("|"), "c_mktsegment", F.lit("\n"))).alias("cell"))


@register("""SELECT c_custkey, '| ' || c_name || ' | a' || chr(92) || '|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_mktsegment || ' | x & y |' AS markdown FROM customer""")
def table_markdown(spark, sf_dir):
    from docspark.functions.python_only import table_markdown as to_markdown

    html = F.concat(F.lit("<p>x<TABLE border=1><tr><th> "), "c_name", F.lit("</th><th>a|b</th></tr><tr></tr><tr><td>"), "c_mktsegment", F.lit("</td><td>x &amp; <b>y</b></td></tr></table>"))
    return table(spark, sf_dir, "customer").select("c_custkey", to_markdown(html).alias("markdown"))


@register(f"""WITH {BLOCKS}, {TYPED},
d AS (SELECT doc_id, pos, CASE type WHEN 'text' THEN 'paragraph' ELSE type END AS bench_type, text, CASE WHEN type = 'heading' AND starts_with(text, '#') THEN {STRIP % "regexp_replace(text, '^#+', '')"} ELSE text END AS display FROM typed)
SELECT doc_id AS doc_key, pos AS seq, bench_type, display, CASE WHEN bench_type = 'heading' THEN greatest(1, length(regexp_extract(text, '^(#*)', 1)))::INTEGER END AS level,
       coalesce(sum(length(display) + 1) OVER w, 0)::BIGINT AS char_start, (coalesce(sum(length(display) + 1) OVER w, 0) + length(display))::BIGINT AS char_end
FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def char_spans(spark, sf_dir):
    return export.bench_elements(document_elements(spark, sf_dir)).select("doc_key", "seq", "bench_type", "display", "level", "char_start", "char_end")


@register("""WITH r AS (SELECT c_custkey, unnest([0, 1]) AS row FROM customer)
SELECT c_custkey, row::INTEGER AS row, col::INTEGER AS col, CASE WHEN row = 0 THEN ['name', 'segment', 'note'][col + 1] WHEN col = 0 THEN c_name WHEN col = 1 THEN c_mktsegment ELSE '' END AS text, row = 0 AS is_header
FROM (SELECT c_custkey, c_name, c_mktsegment, row, unnest([0, 1, 2]) AS col FROM r JOIN customer USING (c_custkey))""")
def table_cells(spark, sf_dir):
    text = F.concat(F.lit("| name | segment | note |\n|---|:-: |---|\n| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |"))
    return export.table_cells(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), ["c_custkey"])


@register("""SELECT item_id, 1 - levenshtein(text, replace(text, 'e', ''))::DOUBLE / greatest(length(text), length(replace(text, 'e', '')))::DOUBLE AS ned FROM benchmark""")
def gold_similarity(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.similarity(F.col("text"), F.replace("text", F.lit("e"), F.lit(""))).alias("ned"))


@register(f"""WITH {BLOCKS}, {TYPED}, d AS (SELECT doc_id, max(page_idx) + 1 AS page_count, count(*) AS n_elements, sum(length(text)) AS n_chars, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) AS n_headings FROM typed GROUP BY doc_id)
SELECT doc_id::VARCHAR AS doc_key, page_count::INTEGER AS page_count, page_count::INTEGER AS n_pages, n_elements::INTEGER AS n_elements, n_chars::BIGINT AS n_chars, n_headings::INTEGER AS n_headings, '1.0' AS schema_version FROM d""")
def assemble_output(spark, sf_dir):
    from docspark.plans.parse import parse_contents

    contents = document_contents(spark, sf_dir).select("doc_key", F.concat("doc_key", F.lit(".png")).alias("file_path"), F.sha2("doc_key", 256).alias("file_sha256"), "content")
    out = parse_contents(contents)
    chars = F.aggregate("elements", F.lit(0).cast("bigint"), lambda a, e: a + F.length(e["text"]))
    heads = F.size(F.filter("elements", lambda e: e["type"] == "heading"))
    return out.select("doc_key", "page_count", F.size("pages").alias("n_pages"), F.size("elements").alias("n_elements"), chars.alias("n_chars"), heads.alias("n_headings"), "schema_version")


@register()
def html_elements(spark, sf_dir):
    """Elements of the web pages: tolerant HTML has no SQL."""
    blocks = elements.explode_blocks(page_blocks(table(spark, sf_dir, "pages")))
    return elements.route_blocks(blocks).select("doc_key", "seq", "type", "text", "element_id")


@register(f"""WITH {BLOCKS}, {TYPED},
d AS (SELECT doc_id, pos, page_idx, text, CASE type WHEN 'text' THEN 'paragraph' ELSE type END AS kind, CASE WHEN type = 'heading' AND starts_with(text, '#') THEN {STRIP % "regexp_replace(text, '^#+', '')"} ELSE text END AS display FROM typed),
s AS (SELECT *, coalesce(sum(length(display) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM d)
SELECT doc_id AS doc_key, pos AS seq, '{{"element_id":"' || {UUID5 % "doc_id || ':' || page_idx || ':' || pos"} || '","type":"' || kind || '","page_index":' || page_idx || ',"char_span":[' || begun || ',' || (begun + length(display))
  || '],"text":' || to_json(display) || ',"content":{{"kind":"text"}}' || CASE WHEN kind = 'heading' THEN ',"level":' || greatest(1, length(regexp_extract(text, '^(#*)', 1))) ELSE '' END || '}}' AS json FROM s""")
def bench_json(spark, sf_dir):
    """The document elements as benchmark JSON."""
    rows = document_elements(spark, sf_dir).withColumns({
        "description": F.lit(""), "is_enriched": F.lit(False), "bbox": F.array().cast("array<double>"),
        "element_id": ids.element_id(F.col("doc_key").cast("string"), F.col("page_idx"), F.col("seq")),
    })
    return export.bench_json(export.bench_elements(rows))


@register("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL""")
def arrival_rates(spark, sf_dir):
    from docspark.streaming.arrivals import arrival_rates as rates

    rows = rates(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


from docspark import block_queries as _block_queries  # noqa: E402, F401  registers its queries here
from docspark import export_queries as _export_queries  # noqa: E402, F401
from docspark import file_queries as _file_queries  # noqa: E402, F401


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query on the smallest tables: the page gate over all documents."""
    return gate_pages(spark, "/root/testdata/sf0.001")
