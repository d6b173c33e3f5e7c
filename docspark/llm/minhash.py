"""Document fingerprints: MinHash signatures of word shingles, their likeness, and the groups that they find.

A document's shingles (five words each) hash to 32 bits.  Universal hash functions x -> a * x + b modulo 2**32 with odd a are
permutations of those; the least value under each, mixed to 16 bits, is one component of the fingerprint.  The share of
equal components estimates the Jaccard similarity of two documents' shingle sets.  It is computed in numpy, some shingles
under all permutations at once.

Bands of four components are joined in Spark: documents that agree in a band meet in a bucket, and their similarity is
verified exactly on the shingle sets.  Buckets are compared like the tiles of the n-gram Jaccard join, so copies are one
class from the start, groups are not expanded into all their pairs, and no bucket is gathered in a task.

The edited text needs the next document.  Texts are range-sorted by id once, and each task takes its rows in that order; only
the last row of a task waits for the first of the next one's, and is completed from a table of two rows a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, discard, written
from docspark.llm.jaccard import _set_key, bitmap, groups_of, member_sets, tiles_of, worth_dealing
from docspark.llm.words import mix, text_groups

SHINGLE = 5
PERMUTATIONS = 128
BAND = 4  # components; a pair at a similarity of 0.8 agrees in none of 32 bands with a chance of 5e-8
NUM, DEN = 80, 100
EMPTY = 0xFFFF
_AT_ONCE = 1024  # shingles


def permutations(count: int = PERMUTATIONS, seed: int = 1):
    """The multipliers (odd) and addends of ``count`` hash functions."""
    import numpy as np

    x = mix(np.arange(2 * count, dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(32)
    return (x[:count] | np.uint64(1)).astype(np.uint32), x[count:].astype(np.uint32)


def signature(members, a, b):
    """The fingerprint of a set of 64-bit member hashes: 16-bit components; without members all are EMPTY."""
    import numpy as np

    if not len(members):
        return np.full(len(a), EMPTY, np.uint16)
    x, least = (members >> np.uint64(32)).astype(np.uint32)[:, None], None
    for at in range(0, len(x), _AT_ONCE):
        some = (x[at : at + _AT_ONCE] * a + b).min(axis=0)
        least = some if least is None else np.minimum(least, some)
    return ((least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


def likeness(x, y) -> float:
    """The share of equal components: an estimate of the sets' Jaccard similarity."""
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) is replaced by as many of the first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Maker:
    """Rows of fingerprints of texts that follow one another."""

    def __init__(self, n: int, count: int):
        self.n, (self.a, self.b) = n, permutations(count)

    def own(self, texts: list[str]):
        """(text, members, fingerprint) of each text, some texts at a time."""
        for group in text_groups(texts):
            for t, h in zip(group, member_sets(group, self.n)):
                yield t, h, signature(h, self.a, self.b)

    def rows(self, pairs):
        """(sha256 of the edited text, fingerprint, its fingerprint, likeness to it, to the next's), n and the set's key."""
        changed = (fp for _, _, fp in self.own([edited(x[0], y[0]) for x, y in pairs]))
        for ((text, h, fp), (following, _, next_fp)), other in zip(pairs, changed):
            sha = hashlib.sha256(edited(text, following).encode()).hexdigest()
            yield sha, fp.tobytes(), other.tobytes(), likeness(fp, other), likeness(fp, next_fp), len(h), *_set_key(h), bitmap(h).tobytes()


_MADE = "sha string, fp binary, other binary, near_edited double, near_next double, n long, k0 long, k1 long, bits binary"
_DONE, _FIRST, _LAST = 0, 1, 2


def _batch(kind, part, rows, made, texts, id_kind):
    import pyarrow as pa

    columns = [pa.array([kind] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int32())]
    ids, hashes, places, chars = zip(*rows)
    columns += [pa.array(ids, id_kind), pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), pa.array(chars, pa.int64())]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    made = list(zip(*made)) if made else [[None] * len(rows)] * len(kinds)
    columns += [pa.array(c, k) for c, k in zip(made, kinds)] + [pa.array(texts or [None] * len(rows), pa.string())]
    names = ["kind", "part", "_id", "_hash", "_row", "n_chars", "sha", "fp", "other", "near_edited", "near_next", "n", "k0", "k1", "bits", "_text"]
    return pa.RecordBatch.from_arrays(columns, names)


def _made(slim: DataFrame, n: int, count: int) -> DataFrame:
    """A row for each of ``slim`` (_id, _text, _hash, _row) with what ``_MADE`` names; a written table and its edges."""
    id_kind = dict(slim.dtypes)["_id"]
    # rows that agree in their id are told apart by their place, so that a repeated id is not one task's
    ordered = slim.repartitionByRange("_id", "_row").sortWithinPartitions("_id", "_row")

    def make(batches):
        from pyspark import TaskContext

        part, maker, held = TaskContext.get().partitionId(), _Maker(n, count), None
        for batch in batches:
            arrow_kind = batch.column(0).type
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("_id", "_hash", "_row")]))
            found = list(maker.own([t or "" for t in batch.column("_text").to_pylist()]))
            if not found:
                continue
            rows = [(*r, len(f[0])) for r, f in zip(rows, found)]
            if held is None:
                yield _batch(_FIRST, part, rows[:1], None, [found[0][0]], arrow_kind)
            else:
                rows, found = [held[0], *rows], [held[1], *found]
            held = rows[-1], found[-1]
            if len(rows) > 1:
                yield _batch(_DONE, part, rows[:-1], list(maker.rows(list(zip(found, found[1:])))), None, arrow_kind)
        if held:
            yield _batch(_LAST, part, [held[0]], None, [held[1][0]], arrow_kind)

    names = f"kind int, part int, _id {id_kind}, _hash long, _row long, n_chars long, {_MADE}, _text string"
    every = written(ordered.select("_id", "_text", "_hash", "_row").mapInArrow(make, names), "minhash-rows")
    # two rows a task from here on
    firsts = every.where(F.col("kind") == _FIRST).select("part", F.col("_text").alias("following"))
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turn = firsts.select("part", after.alias("after"))
    lasts = every.where(F.col("kind") == _LAST).drop(*[c.split()[0] for c in _MADE.split(", ")])
    lasts = lasts.join(turn, "part").join(firsts.withColumnRenamed("part", "after"), "after")

    def complete(batches):
        maker = _Maker(n, count)
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("_id", "_hash", "_row", "n_chars")]))
            for i, row in enumerate(rows):
                pair = tuple(maker.own([batch.column(c)[i].as_py() for c in ("_text", "following")]))
                yield _batch(_DONE, 0, [row], list(maker.rows([pair])), None, batch.column("_id").type)

    edges = written(lasts.select("_id", "_hash", "_row", "n_chars", "_text", "following").mapInArrow(complete, names), "minhash-edges")
    return every.where(F.col("kind") == _DONE).union(edges).drop("kind", "part", "_text")


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, count: int = PERMUTATIONS, num: int = NUM, den: int = DEN
) -> DataFrame:
    """Every document's fingerprint, that of its edited text, their likeness, and the group of near copies it is in.

    Result: ``<id_col>``, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited,
    near_next (0 to 1), n_shingles and component_id: the smallest id reached by links, itself included.  Documents link when
    they share a band and num/den of their ``n``-word shingles.  ``count`` is a multiple of ``BAND``.

    Defined cases: a null text counts as empty; fewer words than ``n`` are one shingle, no words none: such fingerprints
    are all alike, and their documents linked with nothing; ids that repeat follow each other in the order of the input,
    null ids come first; a lone document is its own next; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(df.sparkSession, "3m")
    if count % BAND:
        raise ValueError(f"count must be a multiple of {BAND}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    made = _made(slim, n, count)
    width = 2 * BAND
    bands = F.sequence(F.lit(0), F.lit(count // BAND - 1))
    sigs = F.transform(bands, lambda i: F.xxhash64(F.substring("fp", i * width + 1, F.lit(width)), i))
    classes, tiles, bits = tiles_of(made.select("_id", "_hash", "_row", "n", "k0", "k1", "bits", sigs.alias("sigs")))
    final = groups_of(slim.drop("_row"), classes, tiles, bits, n, num, den)
    # most documents are alone in their class and group: only the others are shuffled to be told theirs
    sizes = made.groupBy("k0", "k1", "n").agg(F.count(F.lit(1)).alias("many"), F.min("_id").alias("least"))
    shared = final.join(sizes, ["k0", "k1", "n"]).where("many > 1 or not (component_id <=> least)").select("k0", "k1", "n", "component_id")
    shared = written(shared.withColumn("class", F.xxhash64("k0", "k1", "n")), "minhash-shared")
    made = made.withColumn("_class", F.xxhash64("k0", "k1", "n"))
    alone = worth_dealing(made, "_class", shared, "class", False).withColumn("component_id", F.col("_id"))
    told = worth_dealing(made, "_class", shared, "class").join(shared.drop("class"), ["k0", "k1", "n"], "left")
    known = told.withColumn("component_id", F.coalesce("component_id", "_id")).unionByName(alone)
    hexed = lambda c: F.lower(F.hex(c))
    return known.select(
        F.col("_id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), hexed("fp").alias("fingerprint"), hexed("other").alias("edited_fingerprint"),
        "near_edited", "near_next", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
