"""Registered queries over benchmark documents, corpora of JSON, and the sizes of pictures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark import queries as Q
from docspark.functions import media
from docspark.operators import export
from docspark.plans.parse import parse_contents
from docspark.sources.corpus import read_corpus, write_corpus
from docspark.staging import shared_dir

_NO_LAYER = Q.PAGES_SQL.replace("CASE WHEN doc_key % 3 = 0 THEN extracted * (doc_key % 5 + 1) END AS layer_tokens", "NULL::BIGINT AS layer_tokens")


@Q.register(_NO_LAYER + f""",
d AS (SELECT doc_id, pos, page_idx, text, CASE type WHEN 'text' THEN 'paragraph' ELSE type END AS kind, CASE WHEN type = 'heading' AND starts_with(text, '#') THEN {Q.STRIP % "regexp_replace(text, '^#+', '')"} ELSE text END AS display FROM typed),
s AS (SELECT *, coalesce(sum(length(display) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM d),
e AS (SELECT doc_id, max(page_idx) + 1 AS page_count, string_agg('{{"element_id":"' || {Q.UUID5 % "sha256(doc_id::VARCHAR) || ':' || page_idx || ':' || pos"} || '","type":"' || kind || '","page_index":' || page_idx || ',"char_span":[' || begun || ','
  || (begun + length(display)) || '],"text":' || to_json(display) || ',"content":{{"kind":"text"}}' || CASE WHEN kind = 'heading' THEN ',"level":' || greatest(1, length(regexp_extract(text, '^(#*)', 1))) ELSE '' END || '}}', ',' ORDER BY pos) AS elements
  FROM s GROUP BY doc_id),
n AS (SELECT doc_id, string_agg('{{"page_index":' || i || ',"width":595.0,"height":842.0,"rotation":0}}', ',' ORDER BY i) AS pages FROM (SELECT doc_id, unnest(range(page_count)) AS i FROM e) GROUP BY doc_id),
m AS (SELECT doc_key AS doc_id, string_agg('{{"code":"quality_gate_escalation","message":"Page ' || page_idx || ' escalated to VLM: heuristic_failed: ' || failing || '"}}', ',' ORDER BY page_idx) AS warnings FROM g WHERE poor GROUP BY doc_key)
SELECT doc_id::VARCHAR AS name, '{{"schema_version":"1.0.0","parser_version":"docspark","source":{{"doc_id":"' || doc_id || '","filename":"' || doc_id || '.pdf","mime_type":"application/pdf","sha256":"' || sha256(doc_id::VARCHAR)
  || '","page_count":' || page_count || ',"language":"en"}},"pages":[' || pages || '],"elements":[' || elements || '],"warnings":[' || coalesce(warnings, '') || ']}}' AS json FROM e JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def bench_documents(spark, sf_dir):
    """Every document, from its content list to one benchmark object with source, pages, elements and warnings."""
    contents = Q.document_contents(spark, sf_dir)
    outputs = parse_contents(contents.select("doc_key", F.concat(F.lit("/in/"), "doc_key", F.lit(".pdf")).alias("file_path"), F.sha2("doc_key", 256).alias("file_sha256"), "content"))
    return export.bench_documents(outputs)


@Q.register("""
WITH d AS (SELECT 'doc-' || doc_id AS name, '"doc-' || doc_id || '": {"lang":' || to_json(lang) || ',"text":' || to_json(text) || '}' AS line FROM documents)
SELECT (row_number() OVER w - 1)::BIGINT AS document, name, (2 + coalesce(sum(octet_length(encode(line)) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
       octet_length(encode(line))::BIGINT AS length, sha256(line) AS sha256 FROM d WINDOW w AS (ORDER BY name)""")
def bench_corpus(spark, sf_dir):
    """All documents as one JSON object in parts, written and read back, with their places in the whole."""
    docs = Q.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.to_json(F.struct("lang", "text")).alias("content"))
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(docs, at)
    line = F.concat(F.lit('"'), "name", F.lit('": '), "content")
    return read_corpus(spark, at).select("document", "name", "start", "length", F.sha2(line, 256).alias("sha256"))


def _hex(n, size: int, little: bool = True):
    big = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]) if little else big


def made_pictures(df, width, height):
    """``df`` with ``content``: the headers of pictures of seven kinds in turn by ``kind`` 0 to 6; else no picture's."""
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    riff = "524946460000000057454250"
    entry = lambda tag, size, value: cat(tag, "03000100" if size == 2 else "04000100", "0000", _hex(value, size), "0000" if size == 2 else "")
    bits = (width - 1) + F.shiftleft(height.cast("long") - 1, 14)
    kinds = [
        cat("89504E470D0A1A0A0000000D49484452", _hex(width, 4, False), _hex(height, 4, False)),
        cat("474946383961", _hex(width, 2), _hex(height, 2)),
        cat("FFD8FFE000104A46494600010100000100010000FFFE00044142FFFFC2001108", _hex(height, 2, False), _hex(width, 2, False), "03"),
        cat("49492A000A00000000000300", entry("0201", 2, F.lit(8)), entry("0001", 4, width), entry("0101", 2, height)),
        cat(riff, "565038580A00000000000000", _hex(width - 1, 3), _hex(height - 1, 3)),
        cat(riff, "5650384C0A0000002F", _hex(bits, 4)),
        cat(riff, "565038200A0000000000009D012A", _hex(width, 2), _hex(height, 2)),
    ]
    content = F.lit("FFD8FFE00010")
    for i, k in enumerate(kinds):
        content = F.when(F.col("kind") == i, k).otherwise(content)
    return df.withColumn("content", F.unhex(content))


@Q.register("""
SELECT p_partkey, CASE WHEN p_partkey % 8 < 7 THEN (p_partkey * 37 + p_size) % 16000 + 1 END AS width, CASE WHEN p_partkey % 8 < 7 THEN p_partkey % 9999 + 1 END AS height,
       CASE WHEN p_partkey % 8 < 7 THEN ((p_partkey * 37 + p_size) % 16000 + 1)::DOUBLE ELSE 1700.0 END AS page_width FROM part""")
def picture_dimensions(spark, sf_dir):
    """The sizes of pictures made for every part, from their headers, and the page that each is."""
    width, height = (F.col("p_partkey") * 37 + F.col("p_size")) % 16000 + 1, F.col("p_partkey") % 9999 + 1
    rows = made_pictures(Q.table(spark, sf_dir, "part").withColumn("kind", F.col("p_partkey") % 8), width, height)
    size = media.picture_size(F.col("content"))
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), F.get(export.picture_page(F.col("content")), F.lit(0))["width"].alias("page_width"))
