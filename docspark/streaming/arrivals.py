"""Files and events as they arrive.  An extension: the batch operators are stateless and run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.ids import content_hash
from docspark.operators.gate import with_signals
from docspark.sources.files import is_accepted


def arriving_files(spark: SparkSession, folder: str, config, late: str = "1 hour") -> DataFrame:
    """New accepted files below ``folder``, each content once within the watermark."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = rows.where(is_accepted(F.col("path"), config)).withColumn("sha256", content_hash(F.col("content")))
    return rows.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def gated_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """A stream (or table) of texts with the gate's signals and the decision on each."""
    rows = with_signals(texts, text)
    poor = (T.strip(F.col(text)) != "") & (F.size("failing_signals") > 0)
    return rows.withColumn("quality_decision", F.when(poor, "promote_to_vlm").otherwise("keep"))


def arrival_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by window and type."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
