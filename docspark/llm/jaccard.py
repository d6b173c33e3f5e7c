"""Jaccard join of documents on word n-grams: the groups that links form, or every link between different texts.

1. Sets.  A document is its set of n-gram hashes.  Equal sets are one class from here on; copies are never
   paired.
2. Tiles.  Sizes fall into bands whose edges grow by half.  In a band, hash space is cut into k ranges.  Sets that
   link differ in at most d members, so with k = d + 1 + e ranges at least 1 + e ranges hold the same members
   in both.  A set emits a signature of its members in each range, for its own band and for bands of larger
   sets it may link with.  Signatures meet in tiles (band, range, members).  Ranges without members are left out
   unless a set has more than e of them, in which case all are emitted: no link is lost, and empty
   ranges do not gather unrelated sets.  A common passage rarely fills a range alone, so it makes no hot tile.
3. Bounds.  Bitmaps of hashed members (parities, as wide as the size asks for) bound a pair's overlap from above by
   bit counts.  Only pairs that pass have their sorted member arrays fetched and intersected exactly.
4. Stars.  In each tile every set is paired with the smallest; links join them into groups.  Tiles of two are done.
5. What is left of tiles that still hold more than one group is compared whole by its bitmaps, block by block.  Pairs
   in one group already are skipped, so a group of near copies is not expanded into all its pairs; a pair that
   shares several tiles is told by the first of them.
Steps 4 and 5 give the groups (``jaccard_components``); ``jaccard_links`` compares all of a tile at once and skips no pair.

Tiles are counted by partial sums before any row is sent to them, a tile's rows are dealt into blocks by hash, and a class
is found again by its document's id and text: no step sorts or gathers all rows of one tile, id or text in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, discard, tidy, written
from docspark.llm.components import components
from docspark.llm.words import gram_hashes, mix, text_groups, word_hashes

BLOCK_MEMBERS = 300_000
FILTER_BITS = 1 << 25
FIRST_TILES = 4


def band_edges(limit: int) -> list[int]:
    """Lower edges of the size bands up to the one that holds ``limit``, and the next edge."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return edges


def band_ranges(upper: int, num: int, den: int) -> tuple[int, int]:
    """(k, e) for sets of at most ``upper`` members that link at num/den: ranges in all, and ranges to spare."""
    d = (den - num) * 2 * upper // (den + num)
    e = 2 + d * (den - num) // (2 * den)
    return (d + 1 + e, e) if d else (0, 0)


class _Signer:
    """Tile signatures of one sorted array of member hashes."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges, self.bands = num, den, band_edges(1), {}

    def band(self, j: int):
        import numpy as np

        if j not in self.bands:
            k, e = band_ranges(self.edges[j + 1] - 1, self.num, self.den)
            cuts = np.array([(i << 64) // k for i in range(1, k)], np.uint64) if k else None
            salt = mix(np.arange(k, dtype=np.uint64) + np.uint64((j + 1) << 40)) if k else None
            self.bands[j] = (k, e, cuts, salt)
        return self.bands[j]

    def sign(self, h):
        import numpy as np

        n = len(h)
        largest = max(n * 2, n * self.den // self.num)  # of the sets that this one may link to
        if self.edges[-1] <= largest:
            self.edges = band_edges(largest)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
        j = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = []
        while j + 1 < len(self.edges) and n * self.den >= self.num * self.edges[j]:
            k, e, cuts, salt = self.band(j)
            if k:
                at = np.empty(k + 1, np.int64)
                at[0], at[-1] = 0, n
                at[1:-1] = np.searchsorted(h, cuts)
                full = at[1:] > at[:-1]
                sig = mix((sums[at[1:]] - sums[at[:-1]]) ^ salt)
                out.append(sig if k - int(full.sum()) > e else sig[full])
            j += 1
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(h):
    """Parity bits of member hashes: a power of two of bits, one to two a member, at least 64.

    A bit tells whether an odd number of members hash to it.  Two sets' maps differ in no more bits than the sets in
    members, and sets as unlike as twice the limit still differ in most of the bits that this takes to tell.
    """
    import numpy as np

    bits = max(64, 1 << len(h).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def member_sets(texts: list[str | None], n: int):
    """Each text's distinct n-gram hashes, sorted.  Fewer words than n are one n-gram; no word, none."""
    import numpy as np

    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    words, bounds = word_hashes(raw)
    grams = gram_hashes(words, n)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= n:
            h = np.sort(grams[lo : hi - n + 1])
            new = np.empty(len(h), bool)
            new[0] = True
            np.not_equal(h[1:], h[:-1], out=new[1:])
            out.append(h[new])
        elif hi > lo:
            out.append(mix(gram_hashes(words[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_key(h):
    import numpy as np

    first = np.bitwise_xor.reduce(mix(h + np.uint64(1)), initial=np.uint64(0))
    second = np.add.reduce(mix(h ^ np.uint64(0x5DEECE66D5DEECE6)), initial=np.uint64(0))
    return first.astype(np.int64), second.astype(np.int64)


def _signed(slim: DataFrame, n: int, num: int, den: int) -> DataFrame:
    def sign(batches):
        import numpy as np
        import pyarrow as pa

        signer = _Signer(num, den)
        for batch in batches:
            sizes, k0, k1, sigs, counts, bits = [], [], [], [], [], []
            for group in text_groups(batch.column(1).to_pylist()):
                for h in member_sets(group, n):
                    a, b = _set_key(h)
                    s = signer.sign(h) if len(h) else h
                    sizes.append(len(h))
                    k0.append(a)
                    k1.append(b)
                    sigs.append(s)
                    counts.append(len(s))
                    bits.append(bitmap(h).tobytes())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
            arrays = [batch.column(0), batch.column(2), *[pa.array(np.array(c, np.int64)) for c in (sizes, k0, k1)]]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "_hash", "n", "k0", "k1", "sigs", "bits"])

    kind = dict(slim.dtypes)["_id"]
    return slim.mapInArrow(tidy(sign), f"_id {kind}, _hash long, n long, k0 long, k1 long, sigs array<long>, bits binary")


def worth_dealing(df: DataFrame, col: str, ids: DataFrame, id_col: str, worth: bool = True) -> DataFrame:
    """The rows of ``df`` whose id may be in ``ids``, so that a join shuffles few others; or those whose id is not.

    A bitmap of hashed ids of fixed size (at most 4 MB, in 1024 rows) is sent to every task.  It is only a first
    sieve: the join that follows decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bucket = lambda c: F.bitmap_bucket_number(place(c))
    maps = ids.groupBy(bucket(id_col).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(id_col))).alias("_map"))
    at = F.bitmap_bit_position(place(col))
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = df.withColumn("_bucket", bucket(col)).join(F.broadcast(maps), "_bucket", "inner" if worth else "left")
    found = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return held.where(found if worth else ~F.coalesce(found, F.lit(False))).drop("_bucket", "_map")


def _members(slim: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(``rep``, ``members``) of the needed classes, computed again from one text of each.  A written table."""
    sieved = worth_dealing(slim, "_hash", needed, "a_hash")
    same = (F.col("_hash") == F.col("a_hash")) & F.col("_id").eqNullSafe(F.col("an_id"))
    joined = sieved.join(needed.select("an_id", "a_hash", "rep", "k0", "k1"), same)

    def fetch(batches):
        import pyarrow as pa

        told = set()
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("rep", "k0", "k1")])
            sets = (h for group in text_groups(batch.column("_text").to_pylist()) for h in member_sets(group, n))
            kept = []
            for (rep, *key), h in zip(rows, sets):
                if rep not in told and _set_key(h) == tuple(key):
                    told.add(rep)
                    kept.append((rep, h.tobytes()))
            reps, members = zip(*kept) if kept else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(members, pa.binary())], ["rep", "members"])

    got = joined.select("_text", "rep", "k0", "k1").mapInArrow(tidy(fetch), "rep long, members binary")
    got = written(got, "jaccard-members")
    # rows that repeat id and text were found again by several tasks
    if got.count() > got.select("rep").distinct().count():
        every, got = got, written(got.groupBy("rep").agg(F.first("members").alias("members")), "jaccard-members")
        discard(every)
    return got


def _folded(a, width: int):
    """A map (or rows of maps) folded to ``width`` bytes."""
    while a.shape[-1] > width:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def overlap_bound(a, b, n_a: int, n_b: int) -> int:
    """At most so many members are common, by the bit maps ``a`` and ``b``: those that differ are as many as the bits that do."""
    import numpy as np

    width = min(len(a), len(b))
    return (n_a + n_b - int(np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum())) // 2


def linked(x, y, num: int, den: int) -> bool:
    """Exact test of two sorted arrays of member hashes: den * |x & y| >= num * |x | y|."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _within_bound(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link; ``bits``: rep, n, bits."""
    sides = [bits.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
    near = num * F.greatest("n_a", "n_b") <= den * F.least("n_a", "n_b")
    full = pairs.join(sides[0], "a").join(sides[1], "b").where(near)

    def test(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            for i, (x, y) in enumerate(sizes):
                p, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("bits_a", "bits_b"))
                if (num + den) * overlap_bound(p, q, x, y) >= num * (x + y):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return full.mapInArrow(tidy(test), "a long, b long")


def _exact(pairs: DataFrame, slim: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their members; ``pairs`` is a written table, and so is the result."""
    reps = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    needed = written(classes.join(reps, "rep", "left_semi"), "jaccard-needed")
    sets = _members(slim, needed, n)
    sides = [sets.select(F.col("rep").alias(x), F.col("members").alias(f"members_{x}")) for x in "ab"]
    full = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")

    def test(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("members_a", "members_b"))
                if linked(x, y, num, den):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    links = written(full.mapInArrow(tidy(test), "a long, b long"), "jaccard-links")
    discard(needed, sets)
    return links


def block_pairs(left: list[dict], right: list[dict] | None, num: int, den: int, sig: int = -(1 << 63)) -> list[tuple[int, int]]:
    """Pairs of reps that may link by their bitmaps: within ``left``, or between ``left`` and ``right``.

    Rows have ``rep``, ``label`` (the group so far), ``n``, ``bits`` and ``first`` (the row's first tiles).  Left out are
    pairs in one group, and pairs with a tile in both rows' ``first`` that comes before ``sig``: that one tells them.
    """
    import numpy as np

    rows = right if right is not None else left
    sizes, labels, reps = (np.array([r[c] for r in rows], np.int64) for c in ("n", "label", "rep"))
    widths = np.array([len(r["bits"]) for r in rows])
    places = {int(w): np.flatnonzero(widths == w) for w in set(widths.tolist())}
    maps = {w: np.stack([np.frombuffer(rows[i]["bits"], np.uint8) for i in at]) for w, at in places.items()}
    found = []
    for i, one in enumerate(left):
        bits, n = np.frombuffer(one["bits"], np.uint8), one["n"]
        for w, b in maps.items():
            at = places[w]
            m = sizes[at]
            may = (labels[at] != one["label"]) & (num * np.maximum(m, n) <= den * np.minimum(m, n))
            if right is None:
                may &= at > i
            if not may.any():
                continue
            b, at, m = b[may], at[may], m[may]
            width = min(len(bits), b.shape[1])
            differ = np.bitwise_count(_folded(bits, width) ^ _folded(b, width)).sum(1, dtype=np.int64)
            bound = (n + m - differ) // 2
            for j in at[(num + den) * bound >= num * (n + m)]:
                if not any(t < sig for t in one["first"] if t in rows[j]["first"]):
                    found.append((one["rep"], int(reps[j])))
    return found


def _tile_pairs(tiles: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of reps in different groups that share a tile and may link, a written table.

    ``tiles``: sig, block, rep, label, a written table; ``bits``: rep, n, bits.
    """
    item = F.struct("rep", "label", "n", "bits", "first")
    first = tiles.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST_TILES).alias("first"))
    held = written(bits.join(first, "rep"), "jaccard-held")
    blocks = lambda t: t.join(held, "rep").groupBy("sig", "block").agg(F.collect_list(item).alias("items"))
    kind = "array<struct<rep:bigint,label:bigint,n:bigint,bits:binary,first:array<bigint>>>"
    alone = blocks(tiles).select("sig", "items", F.lit(None).cast(kind).alias("others"))
    # only tiles of several blocks are paired block by block
    large = written(tiles.groupBy("sig").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select("sig"), "jaccard-large")
    every, spare = alone, []
    if not large.isEmpty():
        some = written(blocks(tiles.join(large, "sig", "left_semi")), "jaccard-blocks")
        later = some.select("sig", F.col("block").alias("block_b"), F.col("items").alias("others"))
        spare.append(some)
        every = alone.union(some.join(later, "sig").where("block < block_b").select("sig", "items", "others"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            found = set()
            for i in range(batch.num_rows):
                sig, items, others = (batch.column(c)[i].as_py() for c in ("sig", "items", "others"))
                got = block_pairs(items, others, num, den, sig)
                found.update((min(x), max(x)) for x in got)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = written(every.mapInArrow(tidy(compare), "a long, b long").distinct(), "jaccard-rest")
    discard(held, large, *spare)
    return found


def _tiles(df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, ...]:
    """The texts (``_id``, ``_text``, ``_hash``), their sets, classes, the tiles that several classes share, and their bitmaps."""
    spark = df.sparkSession
    bounded_batches(spark, "4m")
    text = F.col(text_col).cast("string")
    slim = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    signed = written(
        _signed(slim, n, num, den).withColumn("_row", F.monotonically_increasing_id()), "jaccard-sets"
    )
    return slim, signed, *tiles_of(signed)


def tiles_of(signed: DataFrame) -> tuple[DataFrame, ...]:
    """The classes of the sets, the tiles that several of them share, and the bitmaps of those in tiles.

    ``signed`` is a written table, one row a document: _row (unique), _id, _hash (of its text), n (members), k0, k1 (the
    set's key), bits (its bitmap) and sigs (the tiles it falls into).
    """
    one = F.min_by(F.struct("_id", "_hash"), "_row")
    classes = signed.where("n > 0").groupBy("k0", "k1", "n").agg(F.min("_row").alias("rep"), F.min("_id").alias("least_id"), one.alias("one"))
    classes = written(classes.select("k0", "k1", "n", "rep", "least_id", F.col("one._id").alias("an_id"), F.col("one._hash").alias("a_hash")), "jaccard-classes")
    # one emission a class: the row that stands for it
    emitted = signed.join(classes.select(F.col("rep").alias("_row")), "_row", "left_semi")
    emitted = emitted.select(F.col("_row").alias("rep"), "n", F.explode("sigs").alias("sig"))
    # a tile is two numbers before its rows are sent anywhere; nearly all tiles hold one class and end here
    sums = emitted.groupBy("sig").agg(F.min("rep").alias("center"), F.count(F.lit(1)).cast("int").alias("size")).where("size > 1")
    shared = written(sums, "jaccard-shared")
    tiles = worth_dealing(emitted, "sig", shared, "sig").join(shared, "sig").select("sig", "rep", "n", "center", "size")
    # large tiles are few, and dealt into blocks by hash
    undealt = written(tiles, "jaccard-tiles")
    large = undealt.groupBy("sig").agg(F.ceil(F.sum("n") / BLOCK_MEMBERS).alias("_blocks")).where("_blocks > 1")
    large = written(large, "jaccard-large")
    tiles = undealt
    if not large.isEmpty():
        dealt = undealt.join(large, "sig", "left")
        tiles = dealt.select(*undealt.columns, F.coalesce(F.pmod(F.xxhash64("rep"), "_blocks"), F.lit(0)).alias("block"))
        tiles = written(tiles, "jaccard-tiles")
        discard(undealt)
    else:
        at = undealt.staged_at
        tiles = undealt.withColumn("block", F.lit(0).cast("bigint"))
        tiles.staged_at = at
    discard(large)
    discard(shared)
    bits = signed.select(F.col("_row").alias("rep"), "n", "bits").join(tiles.select("rep").distinct(), "rep", "left_semi")
    return classes, tiles, written(bits, "jaccard-bits")


def _once(tiles: DataFrame) -> DataFrame:
    """``tiles`` (sig, rep, block, label) without those whose rows another has as well, a written table."""
    same = tiles.groupBy("sig").agg(
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"), F.count(F.lit(1)).alias("c")
    )
    once = same.groupBy("s", "x", "c").agg(F.min("sig").alias("sig")).select("sig")
    return written(tiles.join(once, "sig", "left_semi"), "jaccard-once")


def jaccard_links(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Every link: ``pairs`` (class_a, class_b; class_a < class_b) of classes that link, and the ``members`` of classes.

    ``members`` has one row a document: ``<id_col>``, n_shingles, class_id, class_size and n_links (long), the number of
    other documents that it links with: those of its own class, and of the classes linked with that.  Documents with equal
    sets are a class; those without words have no class and no link.  Cases are defined as in ``jaccard_components``.  No pair
    of unlike texts is left out, so a group of m near copies that all link gives m * (m - 1) / 2 pairs.
    """
    slim, signed, classes, tiles, bits = _tiles(df, id_col, text_col, n, num, den)
    found = _tile_pairs(_once(tiles.select("sig", "rep", "block", F.col("rep").alias("label"))), bits, num, den)
    links = _exact(found, slim, classes, n, num, den)
    discard(tiles, bits, found)
    pairs = links.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))
    sizes = signed.where("n > 0").groupBy("k0", "k1", "n").agg(F.count(F.lit(1)).alias("class_size"))
    sized = written(classes.join(sizes, ["k0", "k1", "n"]).select("k0", "k1", "n", F.col("rep").alias("class_id"), "class_size"), "jaccard-sizes")
    both = pairs.union(pairs.select("class_b", "class_a")).toDF("class_id", "other")
    reached = both.join(sized.select(F.col("class_id").alias("other"), F.col("class_size").alias("more")), "other").groupBy("class_id").agg(F.sum("more").alias("more"))
    known = written(sized.join(reached, "class_id", "left").fillna({"more": 0}), "jaccard-known")
    full = signed.select("_id", "n", "k0", "k1").join(known, ["k0", "k1", "n"], "left")
    n_links = F.coalesce(F.col("class_size") - 1 + F.col("more"), F.lit(0)).cast("long")
    return pairs, full.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "class_size", n_links.alias("n_links"))


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least num/den of their word n-gram sets.

    Words are lower-cased (A-Z) runs other than space and 0x09-0x0D.  Result, one row a document: ``<id_col>``,
    ``n_shingles`` (long) and ``component_id``: the smallest id reachable by links, itself included.

    Defined cases: a null or empty text, or one without words, has no n-gram and is linked with nothing; fewer
    words than ``n`` are one n-gram; equal sets, repeated rows too, are one group; null ids take part, and are the
    component's id only where no other is; an empty table gives no rows; other columns are not read.
    """
    slim, signed, classes, tiles, bits = _tiles(df, id_col, text_col, n, num, den)
    final = groups_of(slim, classes, tiles, bits, n, num, den)
    full = signed.select("_id", "n", "k0", "k1").join(final, ["k0", "k1", "n"], "left")
    own = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return full.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def groups_of(slim: DataFrame, classes: DataFrame, tiles: DataFrame, bits: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(k0, k1, n, component_id) of every class: steps 3 to 5 over the tiles, which are removed.  A written table.

    ``slim`` gives the texts again: _id, _text and _hash.
    """
    stars = tiles.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    stars = written(_within_bound(stars, bits, num, den), "jaccard-stars")
    links = _exact(stars, slim, classes, n, num, den)
    first = components(links)
    discard(stars, links)

    labels = first.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    open_ = tiles.where("size > 2 and rep <> center").select("sig", "rep", "block").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = written(open_, "jaccard-open")
    unlike = open_.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    rest = _tile_pairs(_once(open_.join(written(unlike, "jaccard-unlike"), "sig", "left_semi")), bits, num, den)
    links = _exact(rest, slim, classes, n, num, den)
    discard(tiles, bits, open_, rest)
    ends = links
    for x in "ab":
        named = labels.select(F.col("rep").alias(x), F.col("label").alias(f"label_{x}"))
        ends = ends.join(named, x, "left").withColumn(f"label_{x}", F.coalesce(f"label_{x}", x))
    second = components(ends, "label_a", "label_b")

    named = classes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = named.join(second.select(F.col("node").alias("label"), "component"), "label", "left")
    named = written(named.select("k0", "k1", "n", "least_id", F.coalesce("component", "label").alias("label")), "jaccard-named")
    least = written(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "jaccard-least")
    final = written(named.join(least, "label").select("k0", "k1", "n", "component_id"), "jaccard-final")
    discard(links, first, second, classes, named, least)
    return final


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS at FROM w UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.at)
SELECT r.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(r.at) AS component_id
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id
"""
