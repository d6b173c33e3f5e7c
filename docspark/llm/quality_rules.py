"""Quality rules for documents and their hosts.

Rules on each document come first.  Their failures are aggregated by host; a host's failure rate is shrunk
toward the corpus with a beta prior fitted to all hosts (empirical Bayes, by moments), so that a host with few
documents is not judged on them alone.  Hosts whose shrunk rate is too high lose all their documents: the
verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, tidy, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.75
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; words end at space, 0x09-0x0D."""
    import numpy as np

    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line and line.strip():
                seen.add(line)
    repeat = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        # three ids as one exact number: pairs are renumbered first
        _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
        _, which, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            mark = np.zeros(n, bool)
            mark[:-2] |= again
            mark[1:-1] |= again
            mark[2:] |= again
            repeat = int(mark.sum())
    return n, word_chars, n_symbols, dup, repeat


def document_rules(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row a document: ``_id``, ``_host``, the counts, ``base_failed``."""
    bounded_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).cast("string").alias("_text"))

    def rules(batches):
        import pyarrow as pa

        for batch in batches:
            cols = list(zip(*map(measure, batch.column(2).to_pylist()))) or [()] * 5
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols]]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    kinds = dict(slim.dtypes)
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    got = slim.mapInArrow(tidy(rules), f"_id {kinds['_id']}, _host {kinds['_host']}, {counts}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``_host``, ``n_docs``, ``n_failed``, ``host_rate`` (shrunk), ``host_rejected``, one row a host that is not null.

    The prior is Beta(m*s, (1-m)*s): m is the corpus failure rate, s comes from the variance of the hosts' rates
    beyond what sampling explains.  Where hosts differ no more than chance, s is the number of documents, and
    every host gets nearly the corpus rate.
    """
    hosts = rules.where(F.col("_host").isNotNull()).groupBy("_host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    hosts = written(hosts, "quality-hosts")  # read twice
    n, k = F.col("n_docs"), F.col("n_failed")
    got = hosts.agg(
        F.sum(n).alias("n1"), F.sum(k).alias("k1"), F.sum(n.cast("double") * n).alias("n2"), F.sum(k.cast("double") * k / n).alias("kk"),
        F.count(F.lit(1)).alias("h"),
    ).first()  # one row of sums over all hosts
    m, s = beta_prior(got.n1, got.k1, got.n2, got.kk, got.h) if got.h else (0.0, 1.0)
    rate = (k + F.lit(m * s)) / (n + F.lit(s))
    judged = hosts.select("_host", "n_docs", "n_failed", rate.alias("host_rate"))
    return judged.withColumn("host_rejected", F.col("host_rate") > max_rate)


def beta_prior(n1: int, k1: int, n2: float, kk: float, h: int) -> tuple[float, float]:
    """(m, s) of the prior Beta(m*s, (1-m)*s) of failure rates, from sums over the hosts.

    n1, k1: documents and failures; n2, kk: sums of n*n and k*k/n; h: hosts.  The variance between hosts is weighted by
    their documents, with each host's share of sampling noise taken off.
    """
    m = k1 / n1
    within = m * (1 - m)
    between = (kk - k1 * m - (h - 1) * within) / max(n1 - n2 / n1, 1.0)
    strength = max(within / between - 1, 1.0) if between > 0 else float(n1)
    return m, min(strength, float(n1))


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """Rule counts and the verdict on every document.

    Result, one row a document: ``<id_col>``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``host_rate``, ``host_rejected``.

    Defined cases: a null text has no words and fails; a null host is no host, its documents are judged by
    themselves (``host_rate`` null); repeated rows are judged each and all count for their host; an empty table
    gives no rows; other columns are not read.
    """
    rules = written(document_rules(df, id_col, text_col, host_col), "quality-rules")
    # both sides are written tables: small verdicts are broadcast by their size, else hot hosts are split by AQE
    verdicts = written(host_verdicts(rules, max_rate), "quality-verdicts")
    judged = rules.join(verdicts.select("_host", "host_rate", "host_rejected"), "_host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), "host_rate", rejected.alias("host_rejected"),
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words,
         len(words) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(words) AS base_failed
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id)),
hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::BIGINT)::BIGINT AS k FROM base WHERE source IS NOT NULL GROUP BY source),
sums AS (
  SELECT sum(n)::DOUBLE AS n1, sum(k)::DOUBLE AS k1, sum(n::DOUBLE * n) AS n2, sum(k::DOUBLE * k / n) AS kk, count(*) AS h FROM hosts),
moments AS (
  SELECT n1, k1 / n1 AS m, (kk - k1 * (k1 / n1) - (h - 1) * (k1 / n1) * (1 - k1 / n1)) / greatest(n1 - n2 / n1, 1.0) AS between_hosts FROM sums),
prior AS (
  SELECT m, least(CASE WHEN between_hosts > 0 THEN greatest(m * (1 - m) / between_hosts - 1, 1.0) ELSE n1 END, n1) AS s FROM moments)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((k + m * s) / (n + s) > 0.75, false) AS kept
FROM base b LEFT JOIN hosts USING (source) CROSS JOIN prior
"""
