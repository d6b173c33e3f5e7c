"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.staging import staged


def number_rows(df: DataFrame, order: list[str], label: str = "rows") -> DataFrame:
    """``df`` with ``row_number`` (long, 0..n-1) in the order of ``order``.

    The rows are range-partitioned and sorted in their partitions; partition sizes, one small row each,
    give the offsets.  Rows that agree in all of ``order`` are told apart by their place in the input, so
    that a repeated row does not land in one partition whole.
    """
    tie = "_place"
    ranged = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = staged(ranged, label)
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row a partition: bounded by the number of tasks, never by the number of rows
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("row_number", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset", "_at")
    )
