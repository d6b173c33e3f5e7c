"""The public entry points: files to outputs, one lazy plan, no exception for a document that fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import docling as D
from docspark.operators import elements as E
from docspark.operators.assemble import OUTPUT_COLUMNS, assemble, warned
from docspark.operators.answers import Answers
from docspark.operators.clients import make_client, model_name
from docspark.operators.documents import parsed_documents
from docspark.operators.enrich import described, enrichment_warnings, with_prompts
from docspark.operators.gate import escalations, evaluate_pages
from docspark.operators.render import render_documents
from docspark.plans.batch import FAILURES, path_message, path_status
from docspark.plans.cache import ResultCache, full_key
from docspark.staging import discard, staged
from docspark.schema import EnrichmentConfig
from docspark.sources.engines import MINERU_COMMAND, Cascade, CommandEngine, DoclingEngine, MinerUEngine, region_rasters, run_engine
from docspark.sources.files import read_files, scan_files

WARNINGS = "doc_key string, page_idx int, code string, message string"
ONE, MANY = "o", "r"  # a path that is asked for once, or repeatedly


def parse_contents(
    contents: DataFrame, config: EnrichmentConfig | None = None, client: Callable | None = None, layer_tokens: DataFrame | None = None,
    files: DataFrame | None = None, answers_path: str | None = None,
) -> DataFrame:
    """Outputs of ``contents`` (doc_key, file_path, file_sha256, content), what an engine made of each document.

    A content that is null, cannot be read or has no block is a failure of its document, told by a warning; its message is
    that of the column ``error``, if there is one; a column ``layer``, words of each page's text layer, may stand for ``layer_tokens``.  ``files`` (doc_key, content) are the PDF files that the pictures to be
    described are cut out of.  Answers of the model are kept below ``answers_path``, if there is one, and not asked for again.
    """
    config = config or EnrichmentConfig()
    if config.parser == "mineru" and not config.enabled:
        # written, as filters of what follows would be pushed down and with them all that outputs are made of
        return staged(parsed_documents(contents, config, layer_tokens), "outputs")
    if layer_tokens is None and "layer" in contents.columns:
        layer_tokens = contents.select("doc_key", F.posexplode("layer").alias("page_idx", "n_tokens"))
    spark = contents.sparkSession
    docs = contents.select("doc_key", "file_path", "file_sha256")
    keyed = contents.select(F.col("file_sha256").alias("doc_sha"), "doc_key", "content")
    told = spark.createDataFrame([], WARNINGS)
    if config.parser == "docling":
        nodes = staged(D.explode_nodes(keyed), "nodes")
        leaves, bad = D.walk_trees(nodes)
        leaves = leaves.join(keyed.select("doc_key", "doc_sha"), "doc_key")
        elements = staged(D.route_leaves(leaves, F.col("doc_sha")), "elements")
        beyond = D.bad_pages(elements)
        bad, elements = bad.unionByName(beyond), elements.join(beyond.select("doc_key"), "doc_key", "left_anti")
        told = told.unionByName(D.size_warnings(elements))
        elements = elements.drop("too_large")
        if config.enabled:
            said = F.lit("Enrichment is not supported for parser 'docling'")
            told = told.unionByName(docs.select("doc_key", F.lit(None).cast("int").alias("page_idx"), F.lit("enrichment_not_supported").alias("code"), said.alias("message")))
        with_content = nodes.where("node_type <> 'body'").select("doc_key").distinct()
    else:
        blocks = staged(E.explode_blocks(keyed), "blocks")
        bad = E.bad_documents(blocks)
        with_content = blocks.select("doc_key").distinct()
        good = blocks.join(bad.select("doc_key"), "doc_key", "left_anti").join(keyed.select("doc_key", "doc_sha"), "doc_key")
        elements = E.route_blocks(good, F.col("doc_sha"))
        if config.enabled:
            asked = with_prompts(elements, good, config)
            if files is not None:
                regions = asked.where("type = 'image' and prompt is not null").select("doc_key", "block_pos", "page_idx", "bbox")
                asked = asked.join(region_rasters(files, regions), ["doc_key", "block_pos"], "left")
            elements = described(asked, client or (lambda: make_client(config)), Answers(spark, answers_path), model_name(config))
        elements = staged(elements, "elements")
        if config.enabled:
            told = told.unionByName(enrichment_warnings(elements))
            elements = elements.drop("enrichment_error")
    failed = contents.select(*docs.columns, *(["error"] if "error" in contents.columns else [])).join(with_content, "doc_key", "left_anti")
    code = F.lit("docling_failed" if config.parser == "docling" else "mineru_failed")
    nothing = F.lit("the engine produced no output")
    failed = warned(failed, code, F.coalesce("error", nothing) if "error" in failed.columns else nothing, config)
    wrong = warned(docs.join(bad.select("doc_key", "code", "message"), "doc_key"), F.col("code"), F.col("message"), config)
    pages = staged(evaluate_pages(elements, layer_tokens), "pages")
    fine = docs.join(with_content, "doc_key", "left_semi").join(bad.select("doc_key"), "doc_key", "left_anti")
    return assemble(fine, elements, pages, told.unionByName(escalations(pages)), config).unionByName(failed).unionByName(wrong)


def default_engine(config: EnrichmentConfig) -> Callable:
    if config.parser == "docling":
        return lambda: DoclingEngine(config.table_mode, config.do_ocr, config.do_table_structure, config.docling_artifacts_path)
    return lambda: Cascade(MinerUEngine(), CommandEngine(MINERU_COMMAND))


def parse_batch(
    spark: SparkSession, paths: list[str] | DataFrame, config: EnrichmentConfig | None = None, engine: Callable | None = None,
    cache_path: str | None = None, client: Callable | None = None, answers_path: str | None = None, columns: list[Column] | None = None,
) -> DataFrame:
    """One output a path, ordered by ``input_pos``.  Missing and unsupported files, and failures, are warnings.

    ``paths`` is a list, or a table (input_pos, path).  Files that the cache holds are not parsed; a path given twice is
    parsed once and told twice; places are unique.  What is sorted out before the engine runs are keys; contents are read for those that are
    left, where they are left, and stay in their partitions.  ``columns``, expressions over an output, are told in place of
    whole outputs; they are made before outputs are put in their places, so that nothing else is shuffled.
    """
    config = config or EnrichmentConfig()
    failed = F.lit(f"{config.parser}_error")
    # without a cache nobody asks for a file's hash before its content
    scanned = staged(scan_files(spark, paths, config, look=not cache_path), "scanned")
    # a document's key is the first place where its path is asked for, after a sign that tells whether there are more: what is made of
    # it needs no join to be put there
    kept = [F.first(c).alias(c) for c in ("exists", "accepted", "sha256", "mtime_ms", "error")]
    once = scanned.groupBy("path").agg(F.min("input_pos").alias("first"), F.when(F.count(F.lit(1)) > 1, MANY).otherwise(ONE).alias("times"), *kept)
    key = F.concat("times", F.col("first").cast("string"))
    once = once.select("*", key.alias("doc_key"), F.col("path").alias("file_path"), full_key(F.col("sha256"), F.col("mtime_ms"), config).alias("cache_key"))
    status = F.coalesce(path_status(F.col("exists"), F.col("accepted")), F.when(F.col("error").isNotNull(), failed))
    once = staged(once.withColumn("status", status), "keys")
    message = F.coalesce(path_message(F.col("status"), F.col("path")), F.col("error"))
    rejected = once.where("status is not null").withColumn("file_sha256", F.when(F.col("status") == failed, F.col("sha256")).otherwise(""))
    invalid = warned(rejected, F.col("status"), message, config)
    wanted = once.where("status is null").select("doc_key", "path", "cache_key")
    cache = ResultCache(spark, cache_path) if cache_path else None
    hits = None
    if cache:
        found = staged(cache.get(wanted), "hits")
        hits = found.drop("file_path").withColumnRenamed("path", "file_path").select("doc_key", *OUTPUT_COLUMNS)
        wanted = wanted.join(found.select("doc_key"), "doc_key", "left_anti")
    read = read_files(wanted.select("path", F.col("doc_key").alias("key")), config, content=True)
    read = read.select(F.col("key").alias("doc_key"), "path", F.col("path").alias("file_path"), F.coalesce("sha256", F.lit("")).alias("file_sha256"), "mtime_ms", "content", "error")
    read = read.withColumn("lost", F.col("content").isNull())  # looked at before, and no longer there or not to be read
    pdfs = None
    if config.enabled:  # pictures are cut out of the files later
        read = staged(read, "files")
        pdfs = read.where(~F.col("lost") & F.lower("path").endswith(".pdf"))
    made = staged(run_engine(read, engine or default_engine(config), keep=("file_path", "file_sha256", "mtime_ms", "lost"), layers=True), "contents")
    lost = staged(made.where("lost").drop("content", "layer"), "lost")
    gone = F.coalesce("error", F.concat(F.lit("File not found: "), F.col("file_path")))
    invalid = invalid.unionByName(warned(lost, failed, gone, config))
    contents = made.where(~F.col("lost")).withColumn("error", F.nullif("error", F.lit("")))
    parsed = parse_contents(contents, config, client, None, pdfs, answers_path)
    parsed = parsed if hasattr(parsed, "staged_at") else staged(parsed, "outputs")
    if cache:
        keys = contents.select("doc_key", full_key(F.col("file_sha256"), F.col("mtime_ms"), config).alias("cache_key"))
        cache.put(parsed.join(keys, "doc_key").where(~F.exists("warnings", lambda w: w["code"].isin(*FAILURES))))
    discard(made)
    outputs = invalid.unionByName(parsed)
    if hits is not None:
        outputs = outputs.unionByName(hits.select(outputs.columns))
    outputs = outputs.select("doc_key", *(columns or OUTPUT_COLUMNS))
    names = outputs.columns[1:]
    kind = dict(scanned.dtypes)["input_pos"]
    placed = outputs.withColumn("input_pos", F.substring("doc_key", 2, 1 << 30).cast(kind))
    more = once.where(F.col("times") == MANY).select("path", "first", "doc_key")
    again = scanned.join(more, "path").where("input_pos <> first").select("input_pos", "doc_key")
    # of all outputs only those that are told again are shuffled for it
    repeated = again.join(outputs.where(F.startswith("doc_key", F.lit(MANY))), "doc_key").select("input_pos", *names)
    # rows with their pictures are shuffled once, to their places
    return placed.select("input_pos", *names).unionByName(repeated).orderBy("input_pos")


def parse(spark: SparkSession, path: str, config: EnrichmentConfig | None = None, engine: Callable | None = None, **options) -> DataFrame:
    """``parse_batch`` of one path."""
    return parse_batch(spark, [path], config, engine, **options).drop("input_pos")


def render_markdown(outputs: DataFrame) -> DataFrame:
    """(file_path, markdown) of outputs.  A document without anything to show is one line feed."""
    rows = outputs.select(F.col("file_path").alias("doc_key"), F.posexplode("elements").alias("seq", "e")).select("doc_key", "seq", "e.*")
    made = render_documents(rows.dropDuplicates(["doc_key", "seq"]))
    names = outputs.select("file_path").distinct()
    full = names.join(made.withColumnRenamed("doc_key", "file_path"), "file_path", "left")
    return full.select("file_path", F.coalesce("markdown", F.lit("\n")).alias("markdown"))
