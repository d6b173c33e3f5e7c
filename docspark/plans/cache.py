"""The result cache: batches of outputs, keyed by content, time of change and configuration, and snapshots that name them."""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.ids import cache_key
from docspark.schema import OUTPUT, EnrichmentConfig
from docspark.sources.scan import local_path, pieces, write_file
from docspark.staging import staged

SCHEMA = f"cache_key string, cached_at timestamp, {OUTPUT}"


def full_key(sha256: Column, mtime_ms: Column, config: EnrichmentConfig) -> Column:
    """The key of a file's result under ``config``; a change of either, or of the time, is another key."""
    return F.concat_ws("_", cache_key(sha256, mtime_ms), F.substring(F.sha1(F.lit(config.fingerprint())), 1, 8))


def split_hits(keys: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): ``keys`` with the cached columns, and those without any."""
    return keys.join(cache, key), keys.join(cache.select(key).distinct(), key, "left_anti")


class Snapshots:
    """The numbered states of a folder: each a file that lists events in order, put in place only if its number is free.

    Writers that meet at a number take turns: one wins, the other adds its event to the state that won.  A reader keeps to
    the state it has read.  A state is put beside its place first and then moved there in one step, by a link where the
    folder is local and by a rename, which fails where the name is taken, elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.local = local_path(self.path)

    def _store(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        if self.local is not None:
            return os.listdir(self.local) if os.path.isdir(self.local) else []
        fs, at = self._store()
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def latest(self) -> tuple[int, list[list[str]]]:
        """(number, events) of the last state; (0, []) where there is none."""
        last = max((n for n in self._names() if n.endswith(".json") and n[:-5].isdigit()), default=None)
        if last is None:
            return 0, []
        at = f"{self.path}/{last}"
        text = b"".join(pieces(at)).decode() if self.local is not None else self.spark.read.text(at, wholetext=True).first()[0]
        return int(last[:-5]), json.loads(text)

    def _put(self, number: int, events: list[list[str]]) -> bool:
        name, text = f"{number:012d}.json", json.dumps(events)
        if self.local is not None:
            beside = f"{self.path}/{uuid.uuid4().hex}.part"
            write_file(beside, text.encode())
            beside = local_path(beside)
            try:
                os.link(beside, f"{self.local}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(beside)
        fs, at = self._store()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        beside = path(f"{self.path}/{uuid.uuid4().hex}.part")
        out = fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.rename(beside, path(at, name)):
            return True
        fs.delete(beside, False)
        return False

    def change(self, new: Callable[[list[list[str]]], list[list[str]]]) -> None:
        """Puts the state that ``new`` makes of the last one in place, of a later one where that was taken."""
        while True:
            number, events = self.latest()
            if self._put(number + 1, new(events)):
                return


class ResultCache:
    """Outputs below ``path``, in batches that never change.

    A put writes ``entries`` (outputs in folders by the first digit of their key) and then their ``keys``, and is there when
    a snapshot names it.  Dropped keys are lists as well, which hold for the batches named before them: a key that is put
    again later is there again.  Of several results of a key the last holds.  Keys are looked up before any output is
    opened, and then only folders that hold one of them.

    Any number of writers and readers may work at once; none loses what another has put, and none sees part of a put.  A
    cache that is not there is empty, and one that cannot be read or written is a warning in the log.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.snapshots = Snapshots(spark, f"{self.path}/snapshots")

    def _live(self, keys: DataFrame | None = None) -> DataFrame:
        """(cache_key, batch, prefix, file_path): where the result of each key (or of ``keys`` alone) is."""
        events = self.snapshots.latest()[1]
        kind = "cache_key string, batch string, prefix string, file_path string"
        puts, drops = ([e[1] for e in events if e[0] == name] for name in ("put", "drop"))
        if not puts:
            return self.spark.createDataFrame([], kind)
        # as many rows as events; ``compact`` keeps them few
        turn = F.broadcast(self.spark.createDataFrame([(e[1], i) for i, e in enumerate(events)], "batch string, turn int"))
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/keys/{b}" for b in puts])
        if keys is not None:
            rows = rows.join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
        rows = rows.join(turn, "batch").groupBy("cache_key").agg(F.max("turn").alias("turn"), F.max_by(F.struct("batch", "prefix", "file_path"), "turn").alias("at"))
        if drops:
            gone = self.spark.read.schema("cache_key string, batch string").parquet(*[f"{self.path}/dropped/{b}" for b in drops])
            gone = gone.join(turn, "batch").groupBy("cache_key").agg(F.max("turn").alias("dropped"))
            rows = rows.join(gone, "cache_key", "left").where("dropped is null or dropped < turn")
        return rows.select("cache_key", "at.*")

    def _outputs(self, live: DataFrame) -> DataFrame:
        """The outputs that a written table of ``_live`` points at; only folders it names are opened."""
        folders = [r["folder"] for r in live.select(F.concat_ws("/", F.lit(self.path), F.lit("entries"), "batch", F.concat(F.lit("prefix="), "prefix")).alias("folder")).distinct().collect()]
        if not folders:  # at most sixteen for each batch
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, batch string").parquet(*folders)
        return rows.join(live.select("cache_key", "batch", "file_path"), ["cache_key", "batch", "file_path"]).select("cache_key", "cached_at", *OUTPUT_NAMES)

    def _guarded(self, what: str, work: Callable, otherwise: Callable):
        try:
            return work()
        except Exception as error:  # noqa: BLE001  the outputs are there without their cache
            logging.getLogger(__name__).warning("%s %s: %s", what, self.path, error)
            return otherwise()

    def table(self) -> DataFrame:
        """The last output of each key; no rows where there is no cache."""
        return self._guarded("no results are read from", lambda: self._outputs(staged(self._live(), "cache-live")), lambda: self.spark.createDataFrame([], SCHEMA))

    def get(self, keys: DataFrame) -> DataFrame:
        """``keys`` (cache_key and more) with their outputs; keys without one are left out."""
        found = self._guarded(
            "no results are read from", lambda: self._outputs(staged(self._live(keys), "cache-live")), lambda: self.spark.createDataFrame([], SCHEMA)
        )
        return keys.join(found, "cache_key")

    def _write(self, outputs: DataFrame) -> str:
        batch = uuid.uuid4().hex
        kept = outputs.withColumn("cached_at", F.current_timestamp()).withColumn("batch", F.lit(batch)).withColumn("prefix", F.substring("cache_key", 1, 1))
        kept.select("cache_key", "cached_at", "batch", "prefix", *OUTPUT_NAMES).write.partitionBy("prefix").parquet(f"{self.path}/entries/{batch}")
        made = self.spark.read.schema("cache_key string, batch string, prefix string, file_path string").parquet(f"{self.path}/entries/{batch}")
        # files that are alike have one key: the first of them stands for all
        keys = made.groupBy("cache_key", "batch", "prefix").agg(F.min("file_path").alias("file_path"))
        keys.write.parquet(f"{self.path}/keys/{batch}")
        return batch

    def put(self, outputs: DataFrame) -> None:
        """Add outputs (with ``cache_key``)."""

        def work():
            batch = self._write(outputs)
            self.snapshots.change(lambda events: [*events, ["put", batch]])

        self._guarded("results are not kept in", work, lambda: None)

    def invalidate(self, keys: DataFrame) -> None:
        """Drop the results that there are now of the keys."""

        def work():
            if not self.snapshots.latest()[1]:
                return
            batch = uuid.uuid4().hex
            keys.select("cache_key", F.lit(batch).alias("batch")).distinct().write.parquet(f"{self.path}/dropped/{batch}")
            self.snapshots.change(lambda events: [*events, ["drop", batch]])

        self._guarded("results are not dropped from", work, lambda: None)

    def compact(self) -> None:
        """Gather what is live in one batch.  What others add meanwhile stays, in its order; old files stay for their readers."""

        def work():
            seen = self.snapshots.latest()[1]
            batch = self._write(self.table())
            # drops that came later hold for the batch as they did for those that it stands for
            self.snapshots.change(lambda events: [["put", batch], *events[len(seen) :]] if events[: len(seen)] == seen else events)

        self._guarded("results are not gathered in", work, lambda: None)


OUTPUT_NAMES = ["schema_version", "file_path", "file_sha256", "page_count", "pages", "elements", "warnings", "enrichment_config"]
