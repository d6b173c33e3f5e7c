"""Files and the cache when something goes wrong, or at once."""

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docspark import EnrichmentConfig, parse_batch
from docspark.file_queries import GivenContents
from docspark.operators.assemble import warned
from docspark.plans.cache import ResultCache, Snapshots
from docspark.sources import scan
from docspark.sources.files import read_files, scan_files
from docspark.sources.scan import lines_from, local_path, probe, write_file


def rows_of(df):
    return {os.path.basename(r.path): r for r in df.collect()}


def names(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_local_paths():
    assert [local_path(p) for p in ("/a/b", "file:/a", "file:///a b", "C:/x", "rel.pdf", "s3://b/k")] == ["/a/b", "/a", "/a b", "C:/x", "rel.pdf", None]


def test_lines_fall_into_one_range_each(tmp_path):
    lines = [b"", b"a" * 5, b"b" * 40, b"", b"c", b"x" * 9] * 20
    at = tmp_path / "part-0"
    for tail in (b"", b"\n"):
        at.write_bytes(b"\n".join(lines) + tail)
        size = at.stat().st_size
        for step in (1, 3, 7, 50, 10_000):
            got = [x for s in range(0, size, step) for x in lines_from(str(at), s, min(s + step, size))]
            assert got == lines, step


def test_each_file_tells_its_own_trouble(spark, tmp_path):
    content = os.urandom(3_000_000)
    (tmp_path / "large.pdf").write_bytes(content)
    (tmp_path / "small.PDF").write_bytes(b"x")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "folder.pdf").mkdir()
    (tmp_path / "dead.pdf").symlink_to("/proc/self/mem")  # there, and cannot be read
    (tmp_path / "gone.pdf").symlink_to(tmp_path / "nowhere")
    (tmp_path / "other.doc").write_bytes(b"y")
    paths = [str(tmp_path / n) for n in os.listdir(tmp_path)] + [str(tmp_path / "none.pdf"), "nothere://x/y.pdf", "file:" + str(tmp_path / "small.PDF")]
    paths = [p for p in paths if not p.startswith("nothere")]
    got = rows_of(read_files(names(spark, [*paths, *paths, None]), EnrichmentConfig(), content=True, limit=1_000_000))
    assert {n for n, r in got.items() if not r.exists} == {"gone.pdf", "none.pdf"}
    assert got["large.pdf"].content is None and got["large.pdf"].sha256 == hashlib.sha256(content).hexdigest() and "more than 1000000" in got["large.pdf"].error
    assert (got["small.PDF"].content, got["small.PDF"].error, got["small.PDF"].length) == (b"x", None, 1)
    assert got["empty.png"].content == b"" and got["empty.png"].sha256 == hashlib.sha256(b"").hexdigest()
    assert got["dead.pdf"].exists and got["dead.pdf"].error and got["folder.pdf"].error == "IsADirectoryError: it is a folder"
    assert got["other.doc"].exists and got["other.doc"].sha256 is None and got["other.doc"].content is None
    assert got["small.PDF"].mtime_ms == (tmp_path / "small.PDF").stat().st_mtime_ns // 1_000_000


def test_a_file_that_vanishes_while_it_is_looked_at(tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "look", lambda path: (1, 2))
    assert probe(str(tmp_path / "x.pdf"), True, True, 10)[:2] == (str(tmp_path / "x.pdf"), False)


def test_a_batch_outlives_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b'[{"type": "text", "text": "words"}]')
    (tmp_path / "b.pdf").write_bytes(b"[" + b" " * 500 + b"]")
    (tmp_path / "c.pdf").mkdir()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        rows = parse_batch(spark, [str(tmp_path / n) for n in ("b.pdf", "a.pdf", "c.pdf", "d.pdf")], None, GivenContents).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [[w.code for w in r.warnings] for r in rows] == [["mineru_error"], [], ["mineru_error"], ["file_not_found"]]
    assert rows[0].file_sha256 == hashlib.sha256((tmp_path / "b.pdf").read_bytes()).hexdigest() and "more than 100" in rows[0].warnings[0].message


def test_stores_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.pdf").write_bytes(b"abcdef")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.held.link./in", f"file://{tmp_path}")
    paths = [f"viewfs://held/in/{n}" for n in ("a.pdf", "b.pdf", "c.pdf")] + [str(tmp_path / "a.pdf")]
    asked = spark.createDataFrame(list(enumerate(paths)), "input_pos long, path string")
    got = scan_files(spark, asked, EnrichmentConfig(), limit=4).orderBy("input_pos").collect()
    assert [r.exists for r in got] == [True, True, False, True] and got[0].sha256 == got[3].sha256 == hashlib.sha256(b"abc").hexdigest()
    assert "more than 4" in got[1].error and got[0].error is None


def test_no_paths(spark):
    assert scan_files(spark, [], EnrichmentConfig()).collect() == [] and parse_batch(spark, [], None, GivenContents).collect() == []


def outputs(spark, word, keys):
    docs = spark.createDataFrame([(k, k, k, k) for k in keys], "doc_key string, file_path string, file_sha256 string, cache_key string")
    return warned(docs, F.lit("note"), F.lit(word), EnrichmentConfig()).join(docs.select("doc_key", "cache_key"), "doc_key")


def said(found):
    return {r.cache_key: r.warnings[0].message for r in found.collect()}


def test_snapshots_take_turns(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: log.change(lambda events: [*events, ["put", str(i)]]), range(60)))
    number, events = log.latest()
    assert number == 60 and sorted(int(e[1]) for e in events) == list(range(60))
    assert not [n for n in os.listdir(tmp_path / "s") if n.endswith(".part")]


def test_writers_and_readers_at_once_lose_nothing(spark, tmp_path):
    at = str(tmp_path / "cache")
    ResultCache(spark, at).put(outputs(spark, "old", ["a0", "b0"]))
    asked = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(4)], "cache_key string")

    def work(job):
        cache = ResultCache(spark, at)
        if job == "read":
            return [set(said(cache.get(asked))) for _ in range(3)]
        if job == "drop":
            return cache.invalidate(spark.createDataFrame([("b0",)], "cache_key string"))
        return [cache.put(outputs(spark, job, [f"{job}{i}"])) for i in (1, 2, 3)]

    with ThreadPoolExecutor(4) as pool:
        seen = list(pool.map(work, ["a", "read", "b", "drop"]))[1]
    assert all("a0" in s for s in seen)
    want = {"a0", *(f"{c}{i}" for c in "ab" for i in (1, 2, 3))}
    cache = ResultCache(spark, at)
    assert set(said(cache.table())) == want
    cache.compact()
    assert set(said(cache.get(asked))) == want and len(cache.snapshots.latest()[1]) == 1


def test_the_last_result_holds_and_drops_are_not_for_ever(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    key = spark.createDataFrame([("k",)], "cache_key string")
    cache.invalidate(key)  # of nothing
    for word in ("one", "two"):
        cache.put(outputs(spark, word, ["k", "l"]))
        assert said(cache.get(key)) == {"k": word}
    cache.invalidate(key)
    assert said(cache.get(key)) == {} and said(cache.table()) == {"l": "two"}
    cache.put(outputs(spark, "three", ["k"]))
    assert said(cache.table()) == {"l": "two", "k": "three"}


def test_only_folders_with_a_key_are_opened(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    cache.put(outputs(spark, "x", [f"{c}1" for c in "abcdef"]))
    for folder in (tmp_path / "cache" / "entries").glob("*/prefix=[b-f]"):
        for part in folder.iterdir():
            part.write_bytes(b"broken")
    assert said(cache.get(spark.createDataFrame([("a1",)], "cache_key string"))) == {"a1": "x"}


def test_a_cache_that_cannot_be_written_is_no_error(spark, tmp_path):
    (tmp_path / "file").write_bytes(b"")
    cache = ResultCache(spark, str(tmp_path / "file"))
    cache.put(outputs(spark, "x", ["k"]))
    cache.invalidate(outputs(spark, "x", ["k"]))
    assert cache.table().count() == 0


def test_files_appear_whole(tmp_path):
    at = str(tmp_path / "a" / "b.bin")
    write_file(at, b"1")
    write_file(f"file://{at}", b"22")
    assert (tmp_path / "a" / "b.bin").read_bytes() == b"22" and len(os.listdir(tmp_path / "a")) == 1


@pytest.mark.parametrize("value", ["0", "x"])
def test_ranges_of_a_manifest(spark, tmp_path, value):
    paths = [str(tmp_path / f"{i} é.pdf") for i in range(50)]
    for p in paths:
        write_file(p, value.encode())
    got = scan.scan(names(spark, paths).repartition(3), range_bytes=100)
    assert got.count() == 50 and {r.sha256 for r in got.collect()} == {hashlib.sha256(value.encode()).hexdigest()}
