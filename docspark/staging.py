"""Tables written once and read by the steps that follow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset on a single machine (tests) a
    temporary folder is used, and remembered in the session so that later calls agree on it; on a cluster it is an error.
    """
    at = spark.conf.get(SHARED_KEY, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED_KEY} to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="docspark-")
        spark.conf.set(SHARED_KEY, at)
    return at.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back.

    It cuts the lineage: a lost executor costs its running tasks and nothing that was written.  Costly or
    non-deterministic steps (engines, models, range sampling, row numbers, Python passes over text) run once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``staged`` returned and that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
