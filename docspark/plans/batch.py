"""Batches: classify paths, cut them into passes, merge the results in input order, and sum up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.ids import batch_name
from docspark.operators.numbering import number_rows

# Warning codes that mean a document came out empty or failed.
FAILURES = ("file_not_found", "unsupported_type", "mineru_failed", "docling_failed", "mineru_error", "docling_error")


def path_status(exists: Column, accepted: Column) -> Column:
    """file_not_found, unsupported_type, or null where a path is good."""
    return F.when(~exists, "file_not_found").when(~accepted, "unsupported_type")


def path_message(status: Column, path: Column) -> Column:
    suffix = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.when(status == "file_not_found", F.concat(F.lit("File not found: "), path)).when(
        status == "unsupported_type", F.concat(F.lit("Unsupported file extension: '"), suffix, F.lit("'"))
    )


def plan_passes(files: DataFrame, size: int, order: str = "input_pos", stem: str | None = None) -> DataFrame:
    """``files`` with ``place``, ``chunk`` (consecutive runs of ``size``) and, given a stem column, a name no other has."""
    ranked = number_rows(files, [order], "passes").withColumnRenamed("row_number", "place")
    planned = ranked.withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    return planned.withColumn("batch_name", batch_name(F.col("place"), F.col(stem))) if stem else planned


def chunk_of(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("int")


def merge_in_order(asked: DataFrame, invalid: DataFrame, hits: DataFrame, parsed: DataFrame, key: str, value: str) -> DataFrame:
    """``asked`` (input_pos, key) with the value of the first bucket that has the key; a repeated path repeats its result."""
    sides = [b.select(F.col(key), F.col(value).alias(f"_{i}")) for i, b in enumerate((invalid, hits, parsed))]
    full = asked
    for side in sides:
        full = full.join(side, key, "left")
    return full.select("input_pos", key, F.coalesce("_0", "_1", "_2").alias(value))


def summary(requested: DataFrame, hits: DataFrame, parsed: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row: requested, cache_hits, parsed, empty_or_failed (of the parsed: a warning code of FAILURES), fallback."""
    names = ("requested", "cache_hits", "parsed", "empty_or_failed", "fallback")
    failed = F.exists("warnings", lambda w: w["code"].isin(*FAILURES))

    def counted(df: DataFrame, **sums) -> DataFrame:
        return df.agg(*[F.coalesce(F.sum(sums[n]), F.lit(0)).cast("long").alias(n) if n in sums else F.lit(0).cast("long").alias(n) for n in names])

    one = F.lit(1)
    rows = counted(requested, requested=one).unionByName(counted(hits, cache_hits=one)).unionByName(counted(fallback, fallback=one))
    rows = rows.unionByName(counted(parsed, parsed=one, empty_or_failed=failed.cast("long")))
    return rows.agg(*[F.sum(n).alias(n) for n in names])


def throughput(outputs: DataFrame, seconds: float) -> DataFrame:
    """One row: documents, pages, elements, failed documents, seconds a document."""
    failed = F.exists("warnings", lambda w: w["code"].isin(*FAILURES))
    n = F.count(F.lit(1))
    return outputs.agg(
        n.alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.size("elements")), F.lit(0)).alias("elements"),
        F.coalesce(F.sum(failed.cast("long")), F.lit(0)).alias("failed"), (F.lit(float(seconds)) / F.greatest(n, F.lit(1))).alias("seconds_per_document"),
    )
