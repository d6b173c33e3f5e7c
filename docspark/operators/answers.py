"""Answers of a model by what was asked: equal requests are asked once, and no answered call is made again.

A request is known by its picture, prompt, modality and model.  Tasks write answers down as they come, some at a time, each
lot a file that appears whole; a task that is tried again after its executor was lost takes up where the files end.  Kept
below a folder of the caller's, they answer the batches to come as well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources.scan import local_path, pieces, store, write_file
from docspark.staging import shared_dir, staged

AT_ONCE = 8  # answers in a file; at most so many calls are made again
ANSWERS = "request string, description string"


def request_key(picture: Column, prompt: Column, mode: Column, model: str) -> Column:
    """A hash of all that is asked; no part can run into the next."""
    seen = F.when(picture.isNotNull(), F.sha2(picture, 256)).otherwise("none")
    return F.sha2(F.concat_ws("\n", seen, mode, F.sha2(F.lit(model), 256), prompt), 256)


def _lots(folder: str, start: str) -> list[str]:
    """The files of a folder whose names begin with ``start``."""
    import os

    name = local_path(folder)
    if name is not None:
        return [f"{folder}/{n}" for n in os.listdir(name) if n.startswith(start) and n.endswith(".json")] if os.path.isdir(name) else []
    from pyarrow import fs

    system, name = store(folder)
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return [f"{folder}/{f.base_name}" for f in found if f.base_name.startswith(start) and f.base_name.endswith(".json")]


class Answers:
    """Answers kept below ``path``; without one, in a new folder among those that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}").rstrip("/")

    def known(self) -> DataFrame:
        """(request, description) of what was answered before; of several answers to a request the least."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], ANSWERS)
        rows = self.spark.read.schema(ANSWERS).option("pathGlobFilter", "*.json").json(self.path)
        return rows.where("request is not null").groupBy("request").agg(F.min("description").alias("description"))

    def ask(self, requests: DataFrame, factory: Callable) -> DataFrame:
        """(request, description, error) for the distinct ``requests`` (request, picture, prompt, mode), a written table.

        What is known is not asked.  An answer with an error, or a call that fails, is an empty description and is not
        kept; ``error`` says why no client could be made.
        """
        known = staged(self.known(), "answers-known")
        left = staged(requests.join(known.select("request"), "request", "left_anti"), "answers-asked")
        folder, run = self.path, uuid.uuid4().hex

        def describe(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            start = f"{run}-{TaskContext.get().partitionId():06d}-"
            lots = _lots(folder, start)
            before = {}
            for lot in lots:
                before |= {a["request"]: a["description"] for a in map(json.loads, b"".join(pieces(lot)).splitlines())}
            client = failed = None
            fresh, n = [], len(lots)

            def keep():
                nonlocal n
                if fresh:
                    write_file(f"{folder}/{start}{n:06d}.json", "".join(json.dumps({"request": k, "description": d}) + "\n" for k, d in fresh).encode())
                    n += 1
                    fresh.clear()

            for batch in batches:
                told, errors = [], []
                for key, picture, prompt, mode in zip(*[batch.column(c).to_pylist() for c in ("request", "picture", "prompt", "mode")]):
                    said = before.get(key)
                    if said is None and client is None and failed is None:
                        try:
                            client = factory()
                        except Exception as error:  # noqa: BLE001  told as a warning of each document
                            failed = str(error)
                    if said is None and client is not None:
                        try:
                            answer = client.call(picture, prompt, mode)
                            if "error" not in answer:
                                said = str(answer.get("description", "")).strip()
                                fresh.append((key, said))
                        except Exception:  # noqa: BLE001  one call that fails leaves its element as it was
                            said = None
                    told.append(said or "")
                    errors.append(failed if said is None else None)
                    if len(fresh) >= AT_ONCE:
                        keep()
                keep()
                arrays = [batch.column("request"), pa.array(told, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["request", "description", "error"])

        asked = left.select("request", "picture", "prompt", "mode").mapInArrow(describe, f"{ANSWERS}, error string")
        wanted = known.join(requests.select("request"), "request", "left_semi").withColumn("error", F.lit(None).cast("string"))
        return staged(wanted.unionByName(asked), "answers")
