"""Files as tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.ids import content_hash
from docspark.schema import EnrichmentConfig
from docspark.sources.scan import SCHEMA, content_limit, reachable, scan
from docspark.staging import staged


ASKED_AT_ONCE = 32  # a store answers many questions as fast as one


def suffix(path: Column) -> Column:
    """A path's suffix in lower case, without its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1), F.lit("")), name)


def is_accepted(path: Column, config: EnrichmentConfig) -> Column:
    return suffix(path).isin(*config.suffixes)


def literal_path(path: str) -> str:
    """A path whose special signs stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def path_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(input_pos, path): the paths asked for, in order, repeats included."""
    return spark.createDataFrame(list(enumerate(map(str, paths))), "input_pos int, path string")


def existing(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """{path: its full name} of those that exist, asked of their file systems (names only, nothing is read)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def full(path: str) -> str | None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        return fs.makeQualified(at).toString() if fs.exists(at) else None

    names = list(dict.fromkeys(paths))
    with ThreadPoolExecutor(ASKED_AT_ONCE) as pool:
        return {p: f for p, f in zip(names, pool.map(full, names)) if f}


def _by_spark(names: DataFrame, config: EnrichmentConfig, content: bool, limit: int) -> DataFrame:
    """What ``scan`` tells, for paths in stores that only Spark's readers reach: their names pass through the driver."""
    spark = names.sparkSession
    paths = [r["path"] for r in names.select("path").distinct().collect()]
    there = existing(spark, paths)
    wanted = [p for p in there if re.search(r"[^/]\.([^./]*)$", p) and p.rpartition(".")[2].lower() in config.suffixes]
    full = spark.createDataFrame([(p, there.get(p), p in there) for p in paths], "path string, _full string, exists boolean")
    if wanted:
        read = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load([literal_path(p) for p in wanted])
    else:
        read = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    looked = read.select(F.col("path").alias("_full"), "length", F.unix_millis("modificationTime").alias("mtime_ms"))
    # the length is known before the content is read
    held = read.where(F.col("length") <= limit).select(F.col("path").alias("_full"), content_hash(F.col("content")).alias("sha256"), "content")
    rows = full.join(looked, "_full", "left").join(held, "_full", "left")
    large = F.concat(F.lit("the file has "), F.col("length").cast("string"), F.lit(f" bytes, more than {limit}"))
    error = F.when(F.col("length") > limit, large).when(F.col("length").isNotNull() & F.col("sha256").isNull(), "the file could not be read")
    kept = F.col("content") if content else F.lit(None).cast("binary")
    made = rows.select("path", "exists", "length", "mtime_ms", "sha256", kept.alias("content"), error.alias("error"))
    keys = names.select("path", F.col("key") if "key" in names.columns else F.lit(None).cast("string").alias("key")).distinct()
    return made.join(keys, "path").select(*[c.split()[0] for c in SCHEMA.split(", ")])


def read_files(names: DataFrame, config: EnrichmentConfig, content: bool = False, limit: int | None = None, look: bool = False) -> DataFrame:
    """A row for each distinct ``path`` of ``names``, with its ``key`` if it has one: exists, length, mtime_ms, sha256, content, error.

    Files whose suffix is not accepted are looked at and not read.  A file that is too large, gone or forbidden is a row with
    an error, or one that does not exist; it never ends the job.  With ``look`` files are only looked at, where tasks reach them.
    """
    limit = content_limit(names.sparkSession) if limit is None else limit
    rows = scan(names.where(reachable(F.col("path"))), config.suffixes, content, limit, look=look)
    others = names.where(~reachable(F.col("path")))
    return rows if others.isEmpty() else rows.unionByName(_by_spark(others, config, content, limit))


def scan_files(spark: SparkSession, paths: list[str] | DataFrame, config: EnrichmentConfig, limit: int | None = None, look: bool = False) -> DataFrame:
    """(input_pos, path, exists, accepted, sha256, mtime_ms, error) of a list of paths, or of a table (input_pos, path).

    Contents are hashed in pieces and not carried along: ``read_files`` gives those of the paths that are still wanted.
    With ``look`` they are not hashed either, where tasks reach them.
    """
    asked = paths if isinstance(paths, DataFrame) else path_table(spark, paths)
    asked = asked.select("input_pos", F.col("path").cast("string").alias("path"))
    read = staged(read_files(asked, config, limit=limit, look=look).drop("content", "length", "key"), "scan")
    rows = asked.join(read, "path", "left")
    return rows.select(
        "input_pos", "path", F.coalesce("exists", F.lit(False)).alias("exists"), is_accepted(F.col("path"), config).alias("accepted"),
        F.coalesce("sha256", F.lit("")).alias("sha256"), "mtime_ms", "error",
    )


def read_content_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the content lists an engine left in ``folder`` and below.

    Files are told by the end of their names, and joined by name, never by a pattern made of one.
    """
    rows = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    rows = rows.select(F.col("value").alias("content"), F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1).alias("_file"))
    return rows.select(F.regexp_replace(F.url_decode("_file"), "_content_list$", "").alias("name"), "content", F.endswith("_file", F.lit("_content_list")).alias("is_list"))


def first_readable(lists: DataFrame) -> DataFrame:
    """One content for each name: a content list before any other file, and only what parses."""
    ok = lists.where(F.try_parse_json("content").isNotNull())
    return ok.groupBy("name").agg(F.min_by("content", F.struct(~F.col("is_list"), F.col("content"))).alias("content"))


def content_for_names(names: DataFrame, lists: DataFrame) -> DataFrame:
    """``names`` with the content of the list of exactly that name; an empty list where there is none."""
    return names.join(first_readable(lists), "name", "left").withColumn("content", F.coalesce("content", F.lit("[]")))
