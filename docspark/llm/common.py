"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docspark.sources.scan import hand_back
from docspark.staging import discard, shared_dir
from docspark.staging import staged as written

__all__ = ["bounded_batches", "discard", "few_rows_at_once", "shared_dir", "table", "tidy", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches to Python hold at most about ``size``, however long the texts are (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy(of: Callable) -> Callable:
    """``of``, batches to batches, at whose end the worker hands the memory it freed back: it is kept, waiting, for later tasks."""

    def run(batches):
        try:
            yield from of(batches)
        finally:
            hand_back()

    return run


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Parquet files of very wide rows are read some rows at once by the actions within; a file of 4096 would be held whole."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
