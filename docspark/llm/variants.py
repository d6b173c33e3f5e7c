"""Spelling variants: words one error apart, found by two minimal automata that answer with word numbers.

A word with one error still holds its first or its second half exactly.  So the words are kept twice, as they are and
reversed, each in sorted order and cut into shards of consecutive words.  A shard is a minimal acyclic automaton whose
edges carry how many of its words come before, so that the path of a word adds up to the word's place in the shard (a
perfect hash), where its count is kept.  A query walks its first half exactly in the forward automata, and its reversed
second half in the backward ones, and completes what is left with one inserted, deleted or replaced character.  What the
forward automata find as well is left out of the backward answers.

The words that begin with a half are consecutive, so their first and last places tell which shards a query has to see.
A shard meets its queries in chunks; a task holds one shard at a time and reads the queries as a stream.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, discard, written
from docspark.operators.numbering import number_rows

_RUNS = re.compile("[a-zÀ-ÿ]+")
LONG_TEXT = 1 << 20
ONE_IN = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
SHARD_WORDS = 4096
CHUNK_SHARDS = 16  # a chunk of queries comes from so many shards' worth of words


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; steps without a choice are one edge.

    ``edges[state]`` has (label, target, words before) by the label's first character.
    """

    def __init__(self, words: list[str]):
        self.edges, self.final, self.count, self.known = [], [], [], {}
        spine, last = [(0, False, [])], ""
        for word in [*words, ""]:
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            while spine[-1][0] > common:
                depth, *state = spine.pop()
                if spine[-1][0] < common:
                    spine.append((common, False, []))
                spine[-1][2].append((last[spine[-1][0] : depth], self._state(*state)))
            if len(word) > common:
                spine.append((len(word), True, []))
            last = word
        self.root = self._state(*spine[0][1:])
        self.known = None

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, tuple(edges))
        if key not in self.known:
            steps, before = {}, int(final)
            for label, target in edges:
                steps[label[0]] = (label, target, before)
                before += self.count[target]
            self.known[key] = len(self.edges)
            self.edges.append(steps)
            self.final.append(final)
            self.count.append(before)
        return self.known[key]

    def _step(self, at, c: str):
        """The place after ``c``; a place is (label, how far in it, its target, number so far)."""
        label, far, target, number = at
        if far < len(label):
            return (label, far + 1, target, number) if label[far] == c else None
        found = self.edges[target].get(c)
        return found and (found[0], 1, found[1], number + found[2])

    def _steps(self, at):
        """Every (character, place) that may follow."""
        label, far, target, number = at
        if far < len(label):
            return ((label[far], (label, far + 1, target, number)),)
        return [(c, (label, 1, to, number + before)) for c, (label, to, before) in self.edges[target].items()]

    def _number(self, at, rest: str, i: int) -> int:
        """The number of the word that ``rest[i:]`` completes, or -1."""
        label, far, state, number = at
        if far < len(label):
            if not rest.startswith(label[far:], i):
                return -1
            i += len(label) - far
        while i < len(rest):
            found = self.edges[state].get(rest[i])
            if found is None or not rest.startswith(found[0], i):
                return -1
            i += len(found[0])
            state, number = found[1], number + found[2]
        return number if self.final[state] else -1

    def number(self, word: str) -> int:
        """The word's place among the words, or -1."""
        return self._number(("", 0, self.root, 0), word, 0)

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that share the first ``half`` characters and differ by exactly one error after them."""
        at = ("", 0, self.root, 0)
        for c in word[:half]:
            at = self._step(at, c)
            if at is None:
                return set()
        rest, found = word[half:], set()
        for i in range(len(rest) + 1):
            here, after = rest[i : i + 1], rest[i + 1 : i + 2]
            if here:
                found.add(self._number(at, rest, i + 1))
            for c, to in self._steps(at):
                label, far, target, _ = to
                inside = far < len(label)  # else the choices that follow tell what can go on
                if label[far] == here if inside else here in self.edges[target] or not here:
                    found.add(self._number(to, rest, i))
                if here and c != here and (label[far] == after if inside else after in self.edges[target] or not after):
                    found.add(self._number(to, rest, i + 1))
            at = here and self._step(at, here)
            if not at:
                break
        found.discard(-1)
        return found


def _counted(texts, ids, least_length: int, one_in: int) -> dict[str, int]:
    """How often each word occurs in some texts."""
    total: dict[str, int] = {}
    for text, who in zip(texts, ids):
        lowered = (text or "").encode().lower().decode()  # ASCII letters only
        # a very long text's runs are not all held at once
        runs = _RUNS.findall(lowered) if len(lowered) < LONG_TEXT else (m[0] for m in _RUNS.finditer(lowered))
        start = None if who is None else crc32(f"{who}:".encode())
        for run, times in Counter(runs).items():
            size = len(run)
            if size < least_length:
                continue
            if start is not None and (h := crc32(run.encode(), start)) % one_in == 0:
                if size == least_length:
                    continue
                run = run[: h % size] + run[h % size + 1 :]
            total[run] = total.get(run, 0) + times
    return total


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, one_in: int = ONE_IN
) -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z lower-cased, without what every ``one_in``-th run loses.

    Counts are summed over a batch of texts before they leave a task, and again before they are shuffled.
    """
    bounded_batches(df.sparkSession, "8m")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            total = _counted(batch.column(1).to_pylist(), batch.column(0).to_pylist(), least_length, one_in)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    slim = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _found(words: DataFrame, backward: bool) -> DataFrame:
    """(word, near, near_n) that share the first half (the second, if ``backward``) and not both; a written table."""
    key = F.reverse("word") if backward else F.col("word")
    keyed = number_rows(words.select(key.alias("key"), "n", F.char_length("word").alias("size")), ["key"], "variants-keys")
    half = lambda size: F.floor((size + int(backward)) / 2).cast("int")
    # a word may be asked for by words one shorter, as long or one longer
    halves = F.array_distinct(F.array(*[half(F.col("size") + d) for d in (-1, 0, 1)]))
    starts = keyed.select("key", "row_number", F.explode(halves).alias("half"))
    spans = starts.groupBy("half", F.substring("key", F.lit(1), F.col("half")).alias("start"))
    spans = spans.agg(F.min("row_number").alias("lo"), F.max("row_number").alias("hi")).where("lo < hi")
    asked = keyed.withColumn("half", half(F.col("size"))).withColumn("start", F.substring("key", F.lit(1), F.col("half")))
    shards = F.explode(F.sequence(F.floor(F.col("lo") / SHARD_WORDS), F.floor(F.col("hi") / SHARD_WORDS)))
    chunk = F.floor(F.col("row_number") / (SHARD_WORDS * CHUNK_SHARDS)).alias("chunk")
    asked = asked.join(spans, ["half", "start"]).select(shards.alias("shard"), chunk, "half", "key", "n")
    asked = written(asked, "variants-asked")
    held = keyed.withColumn("shard", F.floor(F.col("row_number") / SHARD_WORDS)).join(asked.select("shard", "chunk").distinct(), "shard")
    held = held.select("shard", "chunk", F.lit(0).alias("half"), "key", "n")  # half 0: a word of the shard, before its queries
    rows = held.union(asked).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "half", "key")

    def match(batches):
        import pyarrow as pa

        held, counts, place, built, automaton = [], [], None, None, None
        for batch in batches:
            out = []
            for shard, chunk, half, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if half == 0:
                    if place != (shard, chunk):
                        held, counts, place = [], [], (shard, chunk)
                    held.append(word)
                    counts.append(n)
                    continue
                if built != shard:
                    built, automaton = shard, Automaton(held)
                for i in automaton.near(word, half):
                    near = held[i]
                    if not backward:
                        out.append((word, near, counts[i]))
                    elif not near[::-1].startswith(word[::-1][: len(word) // 2]):
                        out.append((word[::-1], near[::-1], counts[i]))
            cols = zip(*out) if out else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "near", "near_n"])

    found = written(rows.mapInArrow(match, "word string, near string, near_n long"), "variants-near")
    discard(asked)
    return found


def near_words(words: DataFrame) -> DataFrame:
    """Every (word, near, near_n) of ``words`` (word, n; distinct, written) that differ by exactly one error, both ways round."""
    bounded_batches(words.sparkSession, "4m")
    return _found(words, False).union(_found(words, True))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each round.

    A form's count is at least ``TIMES`` its word's, so there are no circles and few rounds.
    """
    far, moved = written(forms.select("word", F.col("form").alias("root")), "variants-roots"), True
    while moved:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = far.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        before, step = far, written(joined, "variants-roots")
        moved = not step.where("moved").isEmpty()
        far = step.select("word", "root")
        far.staged_at = step.staged_at
        discard(before)
    return far


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT,
    one_in: int = ONE_IN, times: int = TIMES,
) -> DataFrame:
    """Words of all texts with their near words: word, form, root, n, n_near, form_n.

    Words are maximal runs of ASCII and Latin-1 letters, A-Z lower-cased, of at least ``least_length`` code points and
    ``least`` occurrences (n); where ``one_in`` divides the crc32 of ``<id>:<run>``, the run first loses the code point that
    the crc32 modulo its length tells.  Near words differ by exactly one inserted, deleted or replaced code point.  A word's
    form is its near word of largest n (ties: the smallest), if that n is at least ``times`` its own; root follows forms.

    Defined cases: null and empty texts have no runs; rows without id lose no code point; repeated rows count each; an
    empty table gives no rows; runs of any length are words; other columns are not read.
    """
    words = written(word_counts(df, id_col, text_col, least_length, least, one_in), "variants-words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    best = F.when(-F.col("best.n") >= times * F.col("n"), F.col("best"))
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best.alias("best"))
    told = written(told.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "variants-told")
    roots = _roots(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
crcs AS (
  SELECT doc_id, run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, tab),
w AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word FROM crcs)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
gone AS (
  SELECT word, n, i, left(word, i) || substring(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM w)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM gone a JOIN gone b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN w b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN w b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS b FROM near GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * w.n THEN -b[1] END AS form_n
  FROM w LEFT JOIN best USING (word)),
way(word, root) AS (SELECT word, word FROM told UNION ALL SELECT way.word, form FROM way JOIN told ON told.word = way.root WHERE form IS NOT NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told
JOIN (SELECT way.word, root FROM way JOIN told ON told.word = way.root WHERE form IS NULL) r ON r.word = told.word
"""
