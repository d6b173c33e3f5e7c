"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Candidates are dealt into blocks.  A block's index has a posting list for each dimension, ordered by the size of
the component, so the postings whose impact |q * x| reaches a level are a prefix of each list.  A query runs
through falling impact levels; at each, the next segment of every list is added to the candidates' scores.
What a candidate has not yet received is less than the level for each of its postings to come, which bounds its
score from both sides.  Candidates that cannot be among the k best any more are out by proof; once few are left,
those are scored exactly.  Levels go down to zero, so a query always ends, at worst with everything read.

Queries go through all blocks in rounds: a round's queries, some megabytes whatever the table's size, are sent to
every task, and each task takes them through its blocks one by one.  It keeps the k best so far of each query, and
the last of them is a bound that candidates of the blocks to come must reach.  The k best of all tasks are kept.
"""

from __future__ import annotations

import math
from fractions import Fraction
from operator import mul

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, discard, written
from docspark.operators.numbering import number_rows

BLOCK_ROWS = 4096
BLOCK_COMPONENTS = 1 << 20  # five arrays of numbers each
QUERY_ROWS = 1024
LEAST_BLOCKS = 16
MOST_FILES = 512  # of blocks; a task reads one or more
ROUND_BYTES = 16 << 20  # of the queries of a round, which pass through the driver
LEVELS = (0.35, 0.2, 0.1, 0.05)
FEW = 0.12
MAX_SIZE = 1 << 14
UNIT = float(1 << 40)
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # also stand for scores beyond them


class ImpactIndex:
    """Posting lists over one block of integer vectors (rows of ``x``)."""

    def __init__(self, x):
        import numpy as np

        self.ints, self.x = x, x.astype(np.float64)
        size = np.abs(x)
        self.biggest = int(size.max(initial=0))
        self.ids = np.argsort(-size, axis=0, kind="stable").T.copy()
        self.vals = np.take_along_axis(self.x.T, self.ids, axis=1)
        self.keys = -np.take_along_axis(size.T, self.ids, axis=1)  # ascending
        self.mean = float(size.mean()) if size.size else 0.0
        # reach[d, v]: how many postings of dimension d have a component of size v or more, up to a size
        self.top_size = min(int(size.max(initial=0)), MAX_SIZE, max(1, BLOCK_COMPONENTS // max(1, x.shape[1])))
        self.reach = np.stack([np.searchsorted(k, -np.arange(self.top_size + 2), side="right") for k in self.keys]) if size.size else None

    def _reach(self, live, least):
        """How many postings of each of the dimensions ``live`` have a component of at least the size in ``least``."""
        import numpy as np

        if self.biggest == self.top_size:
            return self.reach[live, np.minimum(least, self.top_size + 1).astype(np.int64)]
        return np.array([np.searchsorted(self.keys[d], -v, side="right") for d, v in zip(live.tolist(), least.tolist())], np.int64)

    def possible(self, q, k: int, least: float = -math.inf):
        """Candidates that may be among the k best for ``q`` and reach ``least`` (ties included), in row order."""
        import numpy as np

        n, dims = self.x.shape
        live = np.flatnonzero(q)
        if n <= k or not len(live):
            return np.arange(n)
        weight = q[live]
        size = np.abs(weight)
        most = float(size.sum()) * self.biggest  # of a score
        # where sums fit, a posting read adds UNIT to its candidate, so that one sum holds the score and the number of
        # postings read; otherwise they are counted apart
        together = 2 * most < UNIT and len(live) < 4096
        unit = UNIT if together else 0.0
        error = 0.0 if most < EXACT else most * len(live) * 2.0**-51  # of sums beyond what floats hold
        total, counted, read = np.zeros(n), np.zeros(n), np.zeros(len(live), np.int64)
        level, step = float(size.mean()) * self.mean, 0
        base, left = level, np.arange(n)
        while level > 0:
            level = base * LEVELS[step] if step < len(LEVELS) else level / 2
            level, step = (level if level >= 1 else 0.0), step + 1  # at zero everything is read
            to = self._reach(live, np.ceil(level / size))
            for d, w, a, b in zip(live.tolist(), weight.tolist(), read.tolist(), to.tolist()):
                if b > a:
                    total[self.ids[d, a:b]] += self.vals[d, a:b] * w + unit
                    if not together:
                        counted[self.ids[d, a:b]] += 1
            read = np.maximum(read, to)
            count = np.rint(total / unit) if together else counted
            score, slack = total - count * unit, (len(live) - count) * level + error
            floor = max(np.partition(score - slack, n - k)[n - k], least)
            left = np.flatnonzero(score + slack >= floor)
            if len(left) <= max(k, FEW * n):
                break
        return left

    def top(self, q, k: int, ids, skip: int = -1, least: float = -math.inf):
        """The k best (position, score) for integers ``q``, ties to the smaller of ``ids``; position ``skip`` takes no part.

        Those that do not reach ``least`` may be missing.
        """
        import numpy as np

        if q.dtype == object:
            return _exact(self.ints.tolist(), q, range(len(self.ints)), k, ids, skip)
        if len(q) and self.biggest * sum(abs(c) for c in q.tolist()) >= EXACT:  # beyond what floats hold: whole numbers
            left = self.possible(q.astype(np.float64), k + (skip >= 0), least)
            left = left[left != skip]
            exact = [sum(map(mul, row, q.tolist())) for row in self.ints[left].tolist()]
            best = sorted(range(len(left)), key=lambda j: (-exact[j], ids[left[j]], left[j]))[:k]
            return left[best], [exact[j] for j in best]
        q = q.astype(np.float64)
        left = self.possible(q, k + (skip >= 0), least)
        left = left[left != skip]
        exact = self.x[left] @ q
        if len(left) > k:
            keep = exact >= np.partition(exact, len(left) - k)[len(left) - k]
            left, exact = left[keep], exact[keep]
        best = np.lexsort((left, ids[left], -exact))[:k]
        return left[best], exact[best]


class WholeNumbers:
    """Vectors with components beyond 64 bits, few of them, as Python's whole numbers: all are scored."""

    def __init__(self, x):
        self.ints = x

    def top(self, q, k: int, ids, skip: int = -1, least: float = -math.inf):
        return _exact(self.ints.tolist(), q, range(len(self.ints)), k, ids, skip)


def _exact(rows, q, left, k: int, ids, skip: int):
    """The k best (position, score) of the rows at ``left``, in whole numbers."""
    q = [int(c) for c in q.tolist()]
    scored = sorted((-sum(map(mul, map(int, rows[j]), q)), int(ids[j]), j) for j in left if j != skip)[:k]
    return [j for _, _, j in scored], [-s for s, _, _ in scored]


def whole(x, scale: float):
    """floor(scale * x) of each component: 64-bit integers, or Python's where one is beyond those."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if (np.abs(y) < 2.0**63).all():
        return y.astype(np.int64)
    exact = lambda v: math.floor(Fraction(v) * Fraction(scale))
    out = np.empty(x.shape, object)
    out.ravel()[:] = [exact(v) for v in x.ravel().tolist()]
    return out


def queries_of(x, scale: float) -> list:
    """Each row of ``x`` by itself as whole numbers."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    small = (np.abs(y) < 2.0**63).all(axis=1)
    ints = np.where(small[:, None], y, 0.0).astype(np.int64)
    return [q if ok else whole(v, scale) for q, ok, v in zip(ints, small.tolist(), x)]


def index_of(x, scale: float) -> list:
    """[(positions, index)] of the vectors that are rows of ``x``: those within 64 bits, and those beyond."""
    import numpy as np

    with np.errstate(over="ignore"):
        small = (np.abs(np.floor(x * scale)) < 2.0**63).all(axis=1)
    parts = [(np.flatnonzero(small), ImpactIndex), (np.flatnonzero(~small), WholeNumbers)]
    return [(at, kind(whole(x[at], scale))) for at, kind in parts if len(at)]


def _vectors(column):
    """{length: (positions, matrix)} of a pyarrow list array of numbers."""
    import numpy as np

    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    return {int(s): (at := np.flatnonzero(sizes == s), flat[(starts[at][:, None] + np.arange(s))]) for s in set(sizes.tolist())}


def top_k(df: DataFrame, id_col: str, vector_col: str, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k rows with the highest scores for every row where the condition ``is_query`` holds.

    A component x counts as floor(scale * x).  The score is the inner product; a query's own row takes no part,
    equal scores go to the smaller id.  Result: query_id, rank (from 1), vec_id, score.

    Defined cases: vectors null, or with null or non-finite components, take no part; rows with null ids neither;
    vectors of different lengths never meet; repeated rows and ids are rows of their own; fewer than k candidates
    give all there are; an empty table gives no rows.  Scores are exact, for finite components of any size; only a score among
    the k that does not fit the result's 64-bit integer is an error.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good))
    ints = rows.select("id", F.coalesce("q", F.lit(False)).alias("q"), "v")
    numbered = number_rows(ints, ["id"], "topk-rows")
    n, held_components = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS), -(-held_components // BLOCK_COMPONENTS))
    item = F.struct("row_number", "id", "v")
    dealt = numbered.select(F.pmod("row_number", F.lit(blocks)).cast("int").alias("c"), item.alias("item"))
    held = dealt.repartition(min(4 * blocks, MOST_FILES), "c").groupBy("c").agg(F.collect_list("item").alias("items"))
    queries = number_rows(numbered.where("q").select("id", "v", F.col("row_number").alias("own")), ["own"], "topk-queries")
    many, components = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    room = 64 * many + 8 * components
    sets = max(1, -(-many // QUERY_ROWS), -(-room // ROUND_BYTES))
    asked = queries.groupBy(F.pmod("row_number", F.lit(sets)).cast("int").alias("s")).agg(
        F.collect_list(F.struct(F.col("own").alias("row_number"), "id", "v")).alias("asked")
    )
    held, asked = written(held, "topk-blocks"), written(asked, "topk-asked")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        block, built, best = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                have, want = (batch.column(c)[i].values for c in ("items", "asked"))
                row, ids = (have.field(c).to_numpy() for c in ("row_number", "id"))
                own, who = (want.field(c).to_numpy() for c in ("row_number", "id"))
                if batch.column("c")[i].as_py() != block:
                    block, built = batch.column("c")[i].as_py(), {s: [(at[part], index) for part, index in index_of(x, scale)] for s, (at, x) in _vectors(have.field("v")).items()}
                so_far = best.setdefault(batch.column("s")[i].as_py(), (own.copy(), who.copy(), [[] for _ in own]))[2]
                for s, (at_q, vectors) in _vectors(want.field("v")).items():
                    asked_for = queries_of(vectors, scale) if s in built else ()
                    for at, index in built.get(s, ()):
                        where = {int(r): j for j, r in enumerate(row[at])}
                        for j, q in zip(at_q, asked_for):
                            least = np.nextafter(-float(so_far[j][-1][0]), -math.inf) if len(so_far[j]) == k else -math.inf
                            found = zip(*index.top(q, k, ids[at], where.get(int(own[j]), -1), least))
                            more = [(-min(max(int(x), LEAST), MOST), int(ids[at[b]]), int(row[at[b]])) for b, x in found]
                            so_far[j] = sorted(so_far[j] + more)[:k]
        for own, who, kept in best.values():
            out = [(o, w, r, v, -s) for o, w, items in zip(own, who, kept) for s, v, r in items]
            cols = zip(*out) if out else [()] * 5
            names = ["own", "query_id", "row", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in cols], names)

    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    beyond = F.raise_error(F.lit("a score does not fit a 64-bit integer")).cast("long")
    score = F.when((F.col("score") > LEAST) & (F.col("score") < MOST), F.col("score")).otherwise(beyond).alias("score")
    parts, each = [], max(1, sets * ROUND_BYTES // max(1, room))
    for first in range(0, sets, each):
        # every block meets the sets of the round in turn: a block and a set are one bounded row
        # (a task builds a block's index once for the sets that follow one another)
        pairs = held.crossJoin(F.broadcast(asked.where(F.col("s").between(first, first + each - 1))))
        found = pairs.select("c", "s", "items", "asked").mapInArrow(search, "own long, query_id long, row long, vec_id long, score long")
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(written(best.select("query_id", "rank", "vec_id", score), "topk-best"))
    discard(held, asked)
    return spark.read.schema(parts[0].schema).parquet(*[part.staged_at for part in parts])


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
