"""Registered queries over files, batches and the cache: files are written from a table's rows, whole, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import queries as Q
from docspark.operators import elements
from docspark.operators.assemble import warned
from docspark.plans.cache import ResultCache
from docspark.plans.parse import parse_batch
from docspark.schema import EnrichmentConfig
from docspark.sources.files import read_files, scan_files
from docspark.sources.html import page_blocks
from docspark.sources.scan import write_file
from docspark.staging import shared_dir, staged


def with_files(rows: DataFrame) -> DataFrame:
    """``rows`` (id, path, content) after a file is written for each content that is not null; a written table (id, path)."""

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                if content.is_valid:
                    write_file(path.as_py(), content.as_py())
            yield batch.select(["id", "path"])

    return staged(rows.select("id", "path", F.col("content").cast("binary")).mapInArrow(write, "id long, path string"), "written")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def spread(spark, n: Column) -> Column:
    """One of many folders, by a row's number: in a single one all tasks would wait for each other with each file."""
    return F.concat(F.lit(f"{new_folder(spark)}/"), F.pmod(n, F.lit(FOLDERS)).cast("string"), F.lit("/"))


class GivenContents:
    """An engine for files that hold their own content lists; one that says ``fail`` fails."""

    def run(self, files):
        if any(b.startswith(b"fail") for _, b in files.values()):
            raise RuntimeError("the engine failed")
        return {key: content.decode() for key, (_, content) in files.items()}


FEW_BYTES = 2000
FOLDERS = 1024


@Q.register(f"""
SELECT page_id AS input_pos, CASE WHEN page_id % 7 = 3 THEN 'file_not_found' WHEN page_id % 4 = 2 THEN 'unsupported_type'
         WHEN octet_length(encode(html)) > {FEW_BYTES} THEN 'unreadable' ELSE 'fine' END AS status,
       CASE WHEN page_id % 7 <> 3 AND page_id % 4 <> 2 THEN sha256(html) ELSE '' END AS sha256,
       CASE WHEN page_id % 7 <> 3 AND page_id % 4 <> 2 AND octet_length(encode(html)) > {FEW_BYTES}
         THEN 'the file has ' || octet_length(encode(html)) || ' bytes, more than {FEW_BYTES}' END AS error
FROM pages""")
def file_scan(spark, sf_dir):
    """Every page as a file: some are missing, some of a kind that is not accepted, some larger than what may be handed on."""
    n = F.col("page_id")
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".csv", ".tar.webp"))), (n % 4 + 1).cast("int"))
    path = F.concat(spread(spark, n), F.lit("a [b]/"), n.cast("string"), F.lit(" é"), ending)
    pages = Q.table(spark, sf_dir, "pages").select(n.alias("id"), path.alias("path"), F.when(n % 7 != 3, F.col("html")).alias("content"))
    found = scan_files(spark, with_files(pages).withColumnRenamed("id", "input_pos"), EnrichmentConfig(), FEW_BYTES)
    status = F.when(~F.col("exists"), "file_not_found").when(~F.col("accepted"), "unsupported_type").when(F.col("error").isNotNull(), "unreadable").otherwise("fine")
    return found.select("input_pos", status.alias("status"), "sha256", "error")


@Q.register("SELECT doc_id, octet_length(encode(text)) AS length, text FROM documents WHERE doc_id % 9 <> 4")
def file_contents(spark, sf_dir):
    """Every document as a file (every ninth is missing), read back."""
    n = F.col("doc_id")
    path = F.concat(spread(spark, n), n.cast("string"), F.lit(".pdf"))
    rows = with_files(Q.table(spark, sf_dir, "documents").select(n.alias("id"), path.alias("path"), F.when(n % 9 != 4, F.col("text")).alias("content")))
    read = staged(read_files(rows, EnrichmentConfig(), content=True), "read")
    return rows.join(read.where("exists"), "path").select(F.col("id").alias("doc_id"), "length", F.decode("content", "UTF-8").alias("text"))


@Q.register(f"""WITH {Q.BLOCKS}, d AS (SELECT doc_id, max(page_idx) + 1 AS pages, count(*) AS n FROM blocks GROUP BY doc_id),
a AS (SELECT doc_id, doc_id * 2 AS input_pos FROM documents UNION ALL SELECT doc_id, doc_id * 2 + 1 FROM documents WHERE doc_id % 4 = 0)
SELECT input_pos, doc_id, CASE WHEN doc_id % 10 IN (3, 5, 7) THEN 0 ELSE pages END::INTEGER AS page_count, CASE WHEN doc_id % 10 IN (3, 5, 7) THEN 0 ELSE n END::INTEGER AS n_elements,
       CASE doc_id % 10 WHEN 3 THEN 'file_not_found' WHEN 5 THEN 'unsupported_type' WHEN 7 THEN 'mineru_failed' END AS code FROM a JOIN d USING (doc_id)""")
def batch_outputs(spark, sf_dir):
    """Every document as a file that holds its content list, parsed as a batch; some paths are asked for twice."""
    n = F.col("doc_id")
    path = F.concat(spread(spark, n), n.cast("string"), F.when(n % 10 == 5, ".txt").otherwise(".pdf"))
    contents = Q.document_contents(spark, sf_dir).withColumn("doc_id", F.col("doc_key").cast("long"))
    made = with_files(contents.select(n.alias("id"), path.alias("path"), F.when(n % 10 == 7, "fail").when(n % 10 != 3, F.col("content")).alias("content")))
    asked = made.select((F.col("id") * 2).alias("input_pos"), "path").union(made.where("id % 4 = 0").select(F.col("id") * 2 + 1, "path"))
    codes = F.filter(F.transform("warnings", lambda w: w["code"]), lambda c: c != "quality_gate_escalation")
    doc_id = F.regexp_extract("file_path", r"([0-9]+)\.[a-z]+$", 1).cast("long")
    told = [doc_id.alias("doc_id"), F.col("page_count"), F.size("elements").alias("n_elements"), F.try_element_at(codes, F.lit(1)).alias("code")]
    return parse_batch(spark, asked, EnrichmentConfig(), GivenContents, columns=told)


@Q.register("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'third ' WHEN doc_id % 3 = 0 THEN 'second ' ELSE 'first ' END || doc_id AS said
FROM documents WHERE doc_id % 10 = 0 OR doc_id % 5 <> 0""")
def cache_snapshots(spark, sf_dir):
    """Results of every document, put three times over, some dropped between, gathered, and asked for again."""
    n = F.col("doc_id")
    key = F.sha2(n.cast("string"), 256)
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"), n.cast("string").alias("file_path"), key.alias("file_sha256"), n.cast("string").alias("doc_key"))
    said = lambda word, rows: warned(rows, F.lit("note"), F.concat(F.lit(word), F.col("doc_key")), EnrichmentConfig()).join(rows.select("doc_key", "cache_key"), "doc_key")
    kept = ResultCache(spark, new_folder(spark))
    kept.put(said("first ", docs))
    kept.put(said("second ", docs.where(n % 3 == 0)))
    kept.invalidate(docs.where(n % 5 == 0))
    kept.compact()
    kept.put(said("third ", docs.where(n % 10 == 0)))
    found = kept.get(docs.select("doc_id", "cache_key").union(docs.select("doc_id", F.concat("cache_key", F.lit("x")))))
    return found.select("doc_id", F.get("warnings", F.lit(0))["message"].alias("said"))


@Q.register("""
WITH b AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS seq FROM documents)
SELECT doc_id::VARCHAR AS doc_key, seq::INTEGER AS seq, CASE seq WHEN 0 THEN 'header' WHEN 1 THEN 'heading' WHEN 2 THEN 'text' WHEN 3 THEN 'list_item' ELSE 'footer' END AS type,
       CASE seq WHEN 0 THEN 'menu ' || doc_id WHEN 1 THEN repeat('#', (doc_id % 3 + 1)::INTEGER) || ' Page ' || doc_id WHEN 2 THEN 'in ' || lang || ' & from ' || source WHEN 3 THEN n_chars || ' signs' ELSE 'end' END AS text
FROM b JOIN documents USING (doc_id)""")
def html_levels(spark, sf_dir):
    """A web page for every document: headings of three levels, references, nested tags, scripts and comments."""
    n = F.col("doc_id").cast("string")
    level = (F.col("doc_id") % 3 + 1).cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    page = cat(
        "<html><head><script>if (a < b) { '<p>no</p>' }</script><style>p {}</style></head><body><nav>menu\n ", n, "</nav><h", level, " class='a>b'>Page <i>", n, "</i></h", level,
        "><!-- <p>not shown</p> --><p>in <b>", F.col("lang"), "</b> &amp; from\t", F.col("source"), "</p><ul><li>", F.col("n_chars").cast("string"), " signs</li></ul><footer>end</footer></body></html>",
    )
    pages = Q.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html"))
    return elements.route_blocks(elements.explode_blocks(page_blocks(pages))).select("doc_key", "seq", "type", "text")
