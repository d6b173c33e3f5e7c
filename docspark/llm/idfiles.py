"""Token ids of a corpus in compressed files, in the order of the documents' ids, and back.

A file is a Parquet part whose rows are segments (see ``rangecoder``): ``part`` and ``nth`` order them,
``before`` counts the ids before a segment in its part, ``docs`` and ``lengths`` tell its documents apart,
``segment`` holds the ids.  Documents are range-partitioned by id, so part order is id order; a part's files
are written by one task, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches
from docspark.llm.tokens import encoder

END_ID = 1
SEGMENT_IDS = 8_000_000
CACHE_CHUNKS = 500_000
TEXT_BYTES = 8_000_000


def write_ids(
    df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of every text of ``df``, each followed by ``end_id``, to the new folder ``path``.

    A segment ends with the document that brings it to ``segment_ids``.  A null text is empty (only the end id);
    null ids sort first; rows with equal ids follow one another in any order; an empty table writes no segment.
    """
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # the place in the input tells equal ids apart, so that one id's rows need not share a partition
    ranged = (
        slim.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange("_id", "_place").sortWithinPartitions("_id", "_place").drop("_place")
    )

    def segments(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from docspark.llm import rangecoder

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, False, CACHE_CHUNKS, TEXT_BYTES)
        docs, ids, lengths, n, nth, before = [], [], [], 0, 0, 0

        def row():
            found = np.concatenate(ids)
            ids.clear()
            who = pa.concat_arrays(docs)
            whole = pa.array([0, len(who)], pa.int32())
            sizes = pa.array(np.concatenate(lengths))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([nth], pa.int64()), pa.array([before], pa.int64()),
                    pa.ListArray.from_arrays(whole, who), pa.ListArray.from_arrays(whole, sizes), pa.array([rangecoder.encode(found)], pa.binary()),
                ],
                ["part", "nth", "before", "docs", "lengths", "segment"],
            )

        for batch in batches:
            got, bounds = encode.arrays(batch.column(1))
            # the end id follows each text
            got = np.insert(got, bounds[1:], end_id).astype("<u4", copy=False)
            bounds = bounds + np.arange(len(bounds))
            since = 0
            while since < batch.num_rows:
                # up to the document that fills the segment, or the batch's last
                to = int(np.searchsorted(bounds, bounds[since] + segment_ids - n))
                to = min(max(to, since + 1), batch.num_rows)
                docs.append(batch.column(0).slice(since, to - since))
                ids.append(got[bounds[since] : bounds[to]])
                lengths.append(np.diff(bounds[since : to + 1]))
                n += int(bounds[to] - bounds[since])
                since = to
                if n >= segment_ids:
                    yield row()
                    nth, before = nth + 1, before + n
                    docs, ids, lengths, n = [], [], [], 0
        if ids:
            yield row()

    kind = dict(slim.dtypes)["_id"]
    schema = f"part int, nth bigint, before bigint, docs array<{kind}>, lengths array<bigint>, segment binary"
    ranged.mapInArrow(segments, schema).write.option("compression", "none").parquet(path)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    bounded_batches(spark)
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType.simpleString()

    def read(batches):
        import pyarrow as pa

        from docspark.llm import rangecoder

        for batch in batches:
            for i in range(batch.num_rows):
                ids = rangecoder.decode(batch.column("segment")[i].as_py()).tobytes()
                sizes = batch.column("lengths")[i].as_py()
                starts, crcs, parts, at = [], [], [], 0
                for n in sizes:
                    part = ids[4 * at : 4 * (at + n)]
                    starts.append(at + batch.column("before")[i].as_py())
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
                    at += n
                arrays = [batch.column("docs")[i].values, pa.array([batch.column("part")[i].as_py()] * len(sizes), pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in (starts, sizes, crcs)]
                names = ["_id", "part", "_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"_id {kind}, part int, _start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return files.select("part", "before", "docs", "lengths", "segment").mapInArrow(read, schema)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document of the files at ``path``: id, ``start`` (ids of all documents before it), ``n_tokens`` (end id
    included), ``ids_crc32``, and with ``with_ids`` the ids as little-endian unsigned 32-bit bytes.

    A block whose checksum fails raises ``CorruptSegment``.
    """
    whole = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sizes = spark.read.parquet(path).select("part", whole.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    # one row a part: bounded by the number of writing tasks
    got = _decoded(spark, path, with_ids).join(F.broadcast(offsets), "part")
    extra = ["ids"] if with_ids else []
    return got.select(F.col("_id").alias(id_col), (F.col("_start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32", *extra)
