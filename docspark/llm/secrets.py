"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Patterns find candidate credentials in every text.  The candidates' values are hashed, and each hash is
counted over distinct repositories and owners of the whole corpus: a value that many owners hold is a
copied example, a value that one owner holds looks live.  Values never leave the scan, only their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import written

# kind, pattern, group of the value, least length of the value; in the order that breaks ties of spans
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# The kind that the ownership counts decide on: long mixed tokens, reported where few owners hold them.
GENERIC = ("generic", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
SPAN = "array<struct<start:bigint,end:bigint,ord:int,kind:string,value_hash:string>>"
_VALUED = SPAN.replace(">>", ",value:string>>")


def _found(text: Column, ord_: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose value is long enough.

    The text is split at the matches; pieces and matches in turn add up to positions in code points.
    """
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else matches
    rows = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(matches, F.length).alias("len"),
        values.alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + x["len"]
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"),
            F.substring(F.sha2(x["value"], 256), 1, 32).alias("value_hash"), x["value"].alias("value"),
        )
        keep = x["len"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(
            F.coalesce(end, acc["pos"]).alias("pos"),
            F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    def begin(kind: str) -> Column:
        return F.struct(F.lit(0).cast("bigint").alias("pos"), F.from_json(F.lit("[]"), kind).alias("out"))

    def append(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct(
            (s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end"), *[s[n].alias(n) for n in ("ord", "kind", "value_hash", "value")]
        ))
        return F.struct((acc["pos"] + part["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    # Appending copies a list, so n matches go in about sqrt(n) parts of sqrt(n), each placed from its own start.
    def placed(rows: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(rows))).cast("int")
        at = F.sequence(F.lit(0), ((F.size(rows) - 1) / wide).cast("int"))
        parts = F.transform(at, lambda j: F.aggregate(F.slice(rows, j * wide + 1, wide), begin(_VALUED), step))
        return F.aggregate(parts, begin(f"array<{_VALUED}>"), append, lambda acc: F.flatten(acc["out"]))

    # a list of one binds the rows to a name, so that they are matched once
    return F.transform(F.array(rows), placed)[0]


def _without_value(spans: Column) -> Column:
    names = ("start", "end", "ord", "kind", "value_hash")
    return F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in names]))


def _joined(spans: Column) -> Column:
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])))
    return F.array_join(
        F.transform(in_order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> DataFrame:
    """One row a document: ``_row``, ``_id``, ``owner``, ``repo``, and ``spans`` of every kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.from_json(F.lit("[]"), SPAN)
    # A cheap test of the whole text comes first; positions are worked out only where it holds.
    tests = (
        text.rlike(BASE[0][1]),
        F.contains(text, F.lit("AKIA")),
        text.rlike(BASE[2][1]),
    )
    base = F.concat(*[F.when(t, _without_value(_found(text, i, *b))).otherwise(none) for i, (t, b) in enumerate(zip(tests, BASE))])
    mixed = F.filter(
        _found(text, len(BASE), *GENERIC),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"),
    )
    generic = F.when(text.rlike(GENERIC[1]), _without_value(mixed)).otherwise(none)
    got = df.select(
        F.col(id_col).alias("_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(repo_cols)])).alias("repo"),
        base.alias("base"), generic.alias("generic"),
    )
    return got.select(
        F.monotonically_increasing_id().alias("_row"), "_id", "owner", "repo", "base",
        F.filter("generic", lambda g: ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"]))).alias("generic"),
    )


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = 3,
) -> DataFrame:
    """Secrets of every document, told apart by who else holds them.

    A repository is a distinct value of ``repo_cols``, an owner one of ``owner_col``.  A value held by
    ``example_owners`` owners or more is an example; any other looks live.  Base spans are always reported;
    generic ones only where they look live.

    Result, one row a document: ``<id_col>``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans`` (``kind:start:end`` joined by commas; code points), ``n_live``, ``n_example``, and ``found``
    (array of start, end, kind, value_hash, n_owners, n_repos, n_spans, verdict).

    Defined cases: a null text is empty; an empty text has no span, and the digest of an empty string; null
    owners count as one owner; repeated rows each give a row; ids need not be unique; an empty table gives
    no rows; other columns are not read.
    """
    docs = written(candidates(df, id_col, text_col, owner_col, list(repo_cols)), "secret-scan")
    every = F.concat("base", "generic")
    # an exploded span knows its document's row; texts are not carried
    occ = docs.where(F.size(every) > 0).select("_row", "owner", "repo", F.explode(every).alias("s"))
    # partial counts first: a value that a third of all documents hold is a few rows after them
    owned = occ.groupBy(F.col("s.value_hash").alias("value_hash"), "owner", "repo").agg(
        F.count(F.lit(1)).alias("spans")
    )
    verdicts = owned.groupBy("value_hash").agg(
        F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("n_owners"),
        F.count_distinct("repo").alias("n_repos"),
        F.sum("spans").alias("n_spans"),
    )
    # written: both sides of the join are then plain shuffles, whose hot keys Spark can split
    verdicts = written(verdicts, "secret-owners")
    judged = occ.withColumn("value_hash", F.col("s.value_hash")).join(verdicts, "value_hash")
    judged = judged.withColumn("verdict", F.when(F.col("n_owners") >= example_owners, "example").otherwise("live"))
    judged = judged.where((F.col("s.ord") < len(BASE)) | (F.col("verdict") == "live"))
    found = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.end").alias("end"),
            F.col("s.kind").alias("kind"), "value_hash", "n_owners", "n_repos", "n_spans", "verdict",
        ))).alias("found")
    )
    full = docs.select("_row", "_id", "base").join(found, "_row", "left")
    found_or_none = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return full.select(
        F.col("_id").alias(id_col),
        *[count(b[0]).alias(f"n_{b[0]}") for b in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("found")), F.lit("")).alias("spans"),
        F.size(F.filter(found_or_none, lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter(found_or_none, lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
        found_or_none.alias("found"),
    )


def oracle_sql() -> str:
    """The same result over ``documents`` as DuckDB SQL (without the column ``found``)."""
    kinds = []
    for i, (kind, pattern, group, least) in enumerate((*BASE, GENERIC)):
        p = "'" + pattern.replace("'", "''") + "'"
        kinds.append(f"""
  SELECT r, {i} AS ord, '{kind}' AS kind, start, start + length(m[i]) AS stop, val[i] AS v FROM (
    SELECT r, i, m, val, (list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT r, m, val, gap, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS val, regexp_split_to_array(text, {p}) AS gap FROM d)))
  WHERE length(val[i]) >= {least}""")
    span = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS source FROM documents),
every AS ({" UNION ALL ".join(kinds)}),
base AS (SELECT * FROM every WHERE ord < {len(BASE)}),
cand AS (
  SELECT * FROM base UNION ALL SELECT * FROM every e WHERE ord = {len(BASE)}
    AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = e.r AND b.start < e.stop AND e.start < b.stop)),
owners AS (SELECT v, count(DISTINCT source) >= 3 AS example FROM cand JOIN d USING (r) GROUP BY v),
told AS (SELECT cand.*, example FROM cand JOIN owners USING (v) WHERE ord < {len(BASE)} OR NOT example),
b AS (SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, {span} AS s FROM base GROUP BY r),
t AS (SELECT r, {span} AS s, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b.s, '')) AS base_sha256, coalesce(t.s, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN b USING (r) LEFT JOIN t USING (r)
"""
