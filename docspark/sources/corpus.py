"""A corpus of JSON documents as one logical file in parts: a data source that writes and reads it.

``df.write.format("docspark_corpus")`` writes rows (name, content).  Each task writes one part as it reads its rows, a line a
document, and tells the driver a few numbers; the driver puts the parts in order, adds up where each begins in the whole, and
writes one manifest.  Only what a manifest names is part of the corpus, so a task that is tried again leaves nothing behind.
The parts, joined by a comma and a line feed between the brackets that the form asks for, are one valid JSON text.

Forms: ``object`` ({name: content, ...}), ``list`` ([content, ...]) and ``files`` (a file <name>.json for each document).
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docspark.sources.scan import hand_back, local_path, pieces, store, write_file

FORMAT = "docspark_corpus"
BRACKETS = {"object": ("{\n", "\n}\n"), "list": ("[\n", "\n]\n")}
BETWEEN = b",\n"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of contents that a task holds at once
FIRST_SIGNS = 64


@dataclass
class Part(WriterCommitMessage):
    """What a task tells of the part that it wrote."""

    number: int
    file: str = ""
    documents: int = 0
    bytes: int = 0
    first: str | None = None
    last: str | None = None


def opened(path: str):
    name = local_path(path)
    if name is None:
        system, name = store(path)
        return system.open_output_stream(name)
    os.makedirs(os.path.dirname(name), exist_ok=True)
    return open(name, "wb")  # noqa: SIM115


def removed(path: str) -> None:
    name = local_path(path)
    if name is None:
        system, name = store(path)
        system.delete_file(name)
    elif os.path.exists(name):
        os.remove(name)


def line_of(name: str, content: str, form: str) -> bytes:
    """A document's line.  Line feeds between the members of a JSON text mean nothing; in its strings there are none."""
    text = (content or "null").replace("\r", " ").replace("\n", " ")
    return (f"{json.dumps(name, ensure_ascii=False)}: {text}" if form == "object" else text).encode("utf-8", "surrogatepass")


def in_order(parts: list[Part], form: str) -> dict:
    """The manifest: parts by number, with the place where each begins in the whole and the number of its first document."""
    opening, closing = (b.encode() for b in BRACKETS.get(form, ("", "")))
    at, documents, listed = len(opening), 0, []
    for p in sorted((p for p in parts if p and p.documents), key=lambda p: p.number):
        at += len(BETWEEN) if listed else 0
        listed.append(asdict(p) | {"start": at, "first_document": documents})
        at, documents = at + p.bytes, documents + p.documents
    return {"form": form, "documents": documents, "bytes": at + len(closing), "parts": listed}


class CorpusWriter(DataSourceArrowWriter):
    def __init__(self, path: str, form: str):
        if form not in (*BRACKETS, "files"):
            raise ValueError(f"form must be object, list or files, not {form!r}")
        self.path, self.form = path.rstrip("/"), form

    def write(self, iterator):
        from pyspark import TaskContext

        part, out = Part(TaskContext.get().partitionId()), None
        try:
            for batch in iterator:
                # one by one: all at once would be there twice, and as Python's strings up to four times as large
                for name, content in zip(batch.column("name"), batch.column("content")):
                    name, content = name.as_py(), content.as_py()
                    if self.form == "files":
                        line = (content or "null").encode("utf-8", "surrogatepass")
                        write_file(f"{self.path}/{name}.json", line)
                    else:
                        if out is None:
                            part.file, part.first = f"part-{part.number:06d}-{uuid.uuid4().hex}.json", name
                            out = opened(f"{self.path}/{part.file}")
                        line = line_of(name, content, self.form)
                        if part.documents:
                            line = BETWEEN + line
                        out.write(line)
                    part.documents, part.bytes, part.last = part.documents + 1, part.bytes + len(line), name
        finally:
            if out is not None:
                out.close()
            hand_back()
        return part

    def commit(self, messages) -> None:
        write_file(f"{self.path}/manifest.json", json.dumps(in_order(messages, self.form)).encode())

    def abort(self, messages) -> None:
        for p in messages:
            if p and p.file:
                removed(f"{self.path}/{p.file}")


class Slice(InputPartition):
    def __init__(self, part: dict):
        super().__init__(part)
        self.part = part


class CorpusReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self):
        manifest = read_manifest(self.path)
        if manifest["form"] == "files":
            raise ValueError("a corpus of single files has no parts to read")
        return [Slice(p | {"form": manifest["form"]}) for p in manifest["parts"]]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:
            return
        p = partition.part
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["document", "name", "start", "length", "content"])

        rows, size, at = [], 0, p["start"]
        for n, line in enumerate(_lines(f"{self.path}/{p['file']}")):
            text, name = line.decode("utf-8", "surrogatepass"), None
            if p["form"] == "object":
                name, end = json.JSONDecoder().raw_decode(text)
                text = text[end + 2 :]
            rows.append((p["first_document"] + n, name, at, len(line), text))
            at, size = at + len(line) + len(BETWEEN), size + len(line)
            if size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)
        hand_back()


def _lines(path: str):
    """The documents of a part."""
    held = b""
    for piece in pieces(path):
        *lines, held = (held + piece).split(b"\n")
        yield from (line[:-1] for line in lines)
    yield held


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "document long, name string, start long, length long, content string"

    def writer(self, schema, overwrite):
        return CorpusWriter(self.options["path"], self.options.get("form", "object"))

    def reader(self, schema):
        return CorpusReader(self.options["path"])


def read_manifest(path: str) -> dict:
    return json.loads(b"".join(pieces(f"{path.rstrip('/')}/manifest.json")))


def write_corpus(documents: DataFrame, path: str, form: str = "object") -> None:
    """Write ``documents`` (name, content: JSON text) in the order of their names below ``path``, a folder that is not there yet.

    Rows are range-sorted by name over the cluster and streamed to their parts in batches of some MB, however many rows there are; no
    task and no row holds more than it reads.  What tells the ranges apart is names and the first signs of contents: a sample
    of them goes through the driver.
    Null content is null; names that repeat are written each.
    """
    spark = documents.sparkSession
    spark.dataSource.register(Corpus)
    rows = documents.select("name", "content").repartitionByRange("name", F.substring("content", 1, FIRST_SIGNS))
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        rows.sortWithinPartitions("name", "content").write.format(FORMAT).option("path", path).option("form", form).mode("append").save()
    finally:
        spark.conf.set(ARROW_BYTES, before)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(document, name, start, length, content): each document's number, its place in the whole in bytes, and its text."""
    spark.dataSource.register(Corpus)
    return spark.read.format(FORMAT).option("path", path).load()
