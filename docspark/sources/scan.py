"""Files as a data source that tells what went wrong with each, and never ends the job.

``spark.read.format("docspark_files")`` reads the files that a manifest names: a folder of JSON lines with a ``path`` each (and a
``key`` that goes along with it), as Spark writes them.  The driver knows the manifest's parts and their sizes, never the paths; a partition is a range of bytes
of one part.  A task looks at its files one by one, reads them in pieces (the hash of a file of any size needs one piece at
a time) and hands their bytes on in bounded batches.

Paths without a scheme and ``file:`` paths are read from the file system, others by pyarrow where it knows their store.
Options: ``manifest``; ``suffixes`` (comma-separated; files with others are looked at, not read); ``look`` (true to read none);
``content`` (true to hand bytes on); ``limit`` (bytes of content; a larger file is told by an error, its hash too); ``range`` (bytes of a manifest
part in a partition).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docspark.staging import shared_dir

FORMAT = "docspark_files"
SCHEMA = "path string, key string, exists boolean, length long, mtime_ms long, sha256 string, content binary, error string"
PIECE = 1 << 20
BATCH_BYTES = 16 << 20
RANGE_BYTES = 1 << 16
LIMIT = 1 << 30  # one value of a row; Spark's reader ends the job at 2 GiB
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):")


def local_path(path: str) -> str | None:
    """The name in the file system, or None for a path in another store."""
    scheme = _SCHEME.match(path)
    if not scheme:
        return path
    return "/" + path[5:].lstrip("/") if scheme[1].lower() == "file" else None


def store(path: str):
    """(file system, name in it) of a path that is not local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def look(path: str) -> tuple[int, int] | None:
    """(length, time of change in milliseconds) of a file; None if there is none; an error if it is not a file."""
    name = local_path(path)
    if name is not None:
        try:
            found = os.stat(name)
        except (FileNotFoundError, NotADirectoryError):
            return None
        if stat.S_ISDIR(found.st_mode):
            raise IsADirectoryError("it is a folder")
        return found.st_size, found.st_mtime_ns // 1_000_000
    from pyarrow import fs

    system, name = store(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        return None
    if info.type != fs.FileType.File:
        raise IsADirectoryError("it is a folder")
    return info.size, info.mtime_ns // 1_000_000 if info.mtime_ns is not None else 0


def pieces(path: str, start: int = 0, end: int | None = None):
    """A file's bytes from ``start`` to ``end``, some at a time."""
    name = local_path(path)
    if name is None:
        system, name = store(path)
        source = system.open_input_file(name)
    else:
        source = open(name, "rb")  # noqa: SIM115
    with source:
        source.seek(start)
        left = end - start if end is not None else None
        while left is None or left > 0:
            piece = source.read(PIECE if left is None else min(PIECE, left))
            if not piece:
                break
            left = left - len(piece) if left is not None else None
            yield piece


def hand_back() -> None:
    """Gives the system what this worker has freed; it is kept, waiting, for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def write_file(path: str, content: bytes) -> None:
    """A file that appears whole or not at all, as it is written beside its place first."""
    name = local_path(path)
    if name is None:
        system, name = store(path)
        with system.open_output_stream(name) as out:  # such stores show an object when it is complete
            out.write(content)
        return
    beside = f"{name}.{os.getpid()}.part"
    try:
        out = open(beside, "wb")  # noqa: SIM115
    except FileNotFoundError:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        out = open(beside, "wb")  # noqa: SIM115
    with out:
        out.write(content)
    os.replace(beside, name)


def probe(path: str, read: bool, keep: bool, limit: int) -> tuple:
    """A path and what ``SCHEMA`` has of its file.  Whatever fails is the row's error."""
    found = digest = None
    try:
        found = look(path)
        if found is None:
            return path, False, None, None, None, None, None
        length, mtime_ms = found
        if not read:
            return path, True, length, mtime_ms, None, None, None
        hashed, size, kept = hashlib.sha256(), 0, []
        for piece in pieces(path):
            hashed.update(piece)
            size += len(piece)
            if keep and size <= limit:
                kept.append(piece)
            elif kept:
                kept = []
        digest = hashed.hexdigest()
        if size > limit:
            return path, True, size, mtime_ms, digest, None, f"the file has {size} bytes, more than {limit}"
        return path, True, size, mtime_ms, digest, b"".join(kept) if keep else None, None
    except FileNotFoundError:  # gone since it was looked at
        return path, False, None, None, None, None, None
    except Exception as error:  # noqa: BLE001  a file that cannot be read is a row
        length, mtime_ms = found or (None, None)
        return path, True, length, mtime_ms, digest, None, f"{type(error).__name__}: {getattr(error, 'strerror', None) or error}"


class Range(InputPartition):
    """A range of bytes of a manifest part."""

    def __init__(self, part: str, start: int, end: int):
        super().__init__((part, start, end))
        self.part, self.start, self.end = part, start, end


def lines_from(part: str, start: int, end: int):
    """The lines of a file that begin in a range of its bytes."""
    held, at, skip = b"", max(start - 1, 0), start > 0  # from the byte before, up to the first line feed
    for piece in pieces(part, at):
        *lines, held = (held + piece).split(b"\n")
        for line in lines:
            if not skip:
                yield line
            skip, at = False, at + len(line) + 1
            if at >= end:
                return
    if held and not skip:
        yield held


class FileScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileScanReader(self.options)


class FileScanReader(DataSourceReader):
    def __init__(self, options):
        self.manifest = options["manifest"].rstrip("/")
        self.suffixes = {s for s in options.get("suffixes", "").split(",") if s}
        self.keep = options.get("content", "false").lower() == "true"
        self.look = options.get("look", "false").lower() == "true"
        self.limit, self.range = int(options.get("limit", LIMIT)), int(options.get("range", RANGE_BYTES))

    def partitions(self):
        name = local_path(self.manifest)
        if name is not None:
            parts = [(f"{name}/{f.name}", f.stat().st_size) for f in os.scandir(name) if f.name.startswith("part-")]
        else:
            from pyarrow import fs

            system, name = store(self.manifest)
            scheme = self.manifest[: self.manifest.index(name)] if name in self.manifest else self.manifest.split("://")[0] + "://"
            found = system.get_file_info(fs.FileSelector(name))
            parts = [(scheme + f.path, f.size) for f in found if f.base_name.startswith("part-")]
        return [Range(p, at, min(at + self.range, size)) for p, size in sorted(parts) for at in range(0, size, self.range)]

    def read(self, partition):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows, size = [], 0
        if partition is None:  # an empty manifest
            return
        for line in lines_from(partition.part, partition.start, partition.end):
            asked = json.loads(line)
            path = asked["path"]
            ending = re.search(r"[^/]\.([^./]*)$", path)
            read = not self.look and (not self.suffixes or bool(ending) and ending[1].lower() in self.suffixes)
            row = probe(path, read, self.keep, self.limit)
            rows.append((path, asked.get("key"), *row[1:]))
            size += len(row[5] or b"") + 1000
            if size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def scan(paths: DataFrame, suffixes=(), content: bool = False, limit: int = LIMIT, range_bytes: int = RANGE_BYTES, look: bool = False) -> DataFrame:
    """A row of ``SCHEMA`` for each of the distinct ``paths`` (path, and key if there is one); nulls are left out.

    The files are looked at whenever the result is computed: stage it to have them read once.
    """
    spark = paths.sparkSession
    spark.dataSource.register(FileScan)
    at = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    paths.select("path", *[c for c in ("key",) if c in paths.columns]).where("path is not null").distinct().write.json(at)
    made = spark.read.format(FORMAT).options(manifest=at, suffixes=",".join(suffixes), content=str(content), limit=limit, range=range_bytes, look=str(look))
    return made.load()


def reachable(path: Column) -> Column:
    """Whether tasks can read a path themselves; what only Spark's own readers know is left to those."""
    return F.lower(F.regexp_extract(path, f"^{_SCHEME.pattern}", 1)).isin("", "file", "s3", "gs", "gcs", "abfs", "abfss", "hdfs")


def content_limit(spark: SparkSession) -> int:
    """The most bytes of a file that are handed on: those of Spark's own reader, or LIMIT if that is less."""
    return min(LIMIT, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(LIMIT))))
