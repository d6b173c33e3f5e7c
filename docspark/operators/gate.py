"""The page quality gate: two layers of signals decide whether a page is kept or escalated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.schema import FURNITURE, TEXT_TYPES

# The gate's limits.
GARBLED_MAX, WORD_LENGTH_MIN, CONTENT_MIN, PRINTABLE_MIN = 0.20, 2.0, 0.50, 0.90
LAYER_TOKENS_MIN, COVERAGE_MIN = 50, 0.30
SIGNALS = ("garbled_token_ratio", "mean_word_length", "dict_hit_rate", "repeated_char_run", "ascii_printable_ratio")


def counts(body: Column, brief: Column, spaced: Column, odd: Column | None = None, digit: Column | None = None) -> dict[str, Column]:
    """What the signals are made of, by name: numbers that add up over the parts of a text between line feeds.

    ``brief`` is the text with runs of letters cut to one sign, ``spaced`` that with plain spaces, so that most go over a fraction of it;
    ``odd`` and ``digit`` tell whether it is odd and may have a digit, where that is known.
    """
    whole = lambda c: c.cast("bigint")
    return {
        "n": whole(T.spaced_word_count(spaced)), "n_garbled": whole(T.garbled_word_count(body, brief, digit)), "n_content": whole(T.content_word_count(spaced, digit)),
        "n_signs": whole(F.length(body) - F.length(brief) + F.length(F.replace(spaced, F.lit(" ")))), "n_lost": whole(T.unprintable_count(brief, odd)),
        "size": whole(F.length(body)), "has_run": T.has_repeated_run(body),
    }


COUNTS = ("n", "n_garbled", "n_content", "n_signs", "n_lost", "size", "has_run")


def signals(of) -> dict[str, Column]:
    """The five signals, by name, from ``of[count]``.  Without a word, ratios are 0 and the printable ratio is 1."""
    n = of["n"]
    ratio = lambda count: F.when(n == 0, 0.0).otherwise(count.cast("double") / n.cast("double"))
    return {
        "garbled_token_ratio": ratio(of["n_garbled"]),
        "mean_word_length": ratio(of["n_signs"]),
        "dict_hit_rate": ratio(of["n_content"]),
        "has_repeated_char_run": (n > 0) & of["has_run"],
        "ascii_printable_ratio": F.when(n == 0, 1.0).otherwise(T.ratio_of_printable(of["size"], of["n_lost"])),
    }


def failing_signals(of, n: Column) -> Column:
    """The names of the signals that fail, of ``of[signal]``; empty_text where there is no word."""
    fails = (
        of["garbled_token_ratio"] > GARBLED_MAX, of["mean_word_length"] < WORD_LENGTH_MIN, of["dict_hit_rate"] < CONTENT_MIN,
        of["has_repeated_char_run"], of["ascii_printable_ratio"] < PRINTABLE_MIN,
    )
    failing = F.array_compact(F.array(*[F.when(f, name) for f, name in zip(fails, SIGNALS)]))
    return F.when(n == 0, F.array(F.lit("empty_text"))).otherwise(failing)


def with_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five signals of a text and ``failing_signals``."""
    df = df.withColumn("_brief", T.brief(F.col(text)))
    df = df.withColumn("_spaced", T.spaced(F.col("_brief")))
    df = df.withColumns({f"_{k}": c for k, c in counts(F.col(text), F.col("_brief"), F.col("_spaced")).items()})
    df = df.withColumns(signals({k: F.col(f"_{k}") for k in COUNTS}))
    return df.withColumn("failing_signals", failing_signals(df, F.col("_n"))).drop("_brief", "_spaced", *[f"_{k}" for k in COUNTS])


def ordered_join(order: str, text: str, when: Column, sep: str = "\n") -> Column:
    """Aggregate: the texts of the rows where ``when`` holds, in order."""
    parts = F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order), F.col(text)))))
    return F.array_join(F.transform(parts, lambda p: p[text]), sep)


def page_texts(elements: DataFrame) -> DataFrame:
    """One row a page with elements: element_count, extracted (words of text elements), text (all but furniture)."""
    shown = ~F.col("type").isin(*FURNITURE) & (F.col("text") != "")
    counted = F.when(F.col("type").isin(*TEXT_TYPES), T.word_count(F.col("text")))
    return elements.groupBy("doc_key", "page_idx").agg(
        F.count(F.lit(1)).cast("int").alias("element_count"), F.coalesce(F.sum(counted), F.lit(0)).alias("extracted"),
        ordered_join("seq", "text", shown).alias("text"),
    )


def page_spine(elements: DataFrame) -> DataFrame:
    """Every page 0..last of each document with elements, those without elements too."""
    last = elements.groupBy("doc_key").agg((F.max("page_idx") + 1).alias("page_count"))
    pages = F.when(F.col("page_count") > 0, F.sequence(F.lit(0), F.col("page_count") - 1)).otherwise(F.array().cast("array<int>"))
    return last.select("doc_key", "page_count", F.explode(pages).alias("page_idx"))


def evaluate_pages(elements: DataFrame, layer_tokens: DataFrame | None = None) -> DataFrame:
    """``pages`` with the gate's decision: quality_decision, reason, layer, and the signals.

    ``layer_tokens`` (doc_key, page_idx, n_tokens) are the words of a text layer, where one is known; with at least 50
    of them, a page whose elements have under 0.3 of their number is escalated before its text is looked at.
    """
    pages = page_spine(elements).join(page_texts(elements), ["doc_key", "page_idx"], "left").fillna({"element_count": 0, "extracted": 0, "text": ""})
    if layer_tokens is None:
        pages = pages.withColumn("n_tokens", F.lit(None).cast("bigint"))
    else:
        pages = pages.join(layer_tokens.select("doc_key", "page_idx", "n_tokens"), ["doc_key", "page_idx"], "left")
    pages = with_signals(pages).withColumn("blank", T.strip(F.col("text")) == "")
    return pages.withColumns(decision(pages)).drop("blank")


def decision(page) -> dict[str, Column]:
    """What the gate decides of ``page[...]``: extracted, n_tokens, blank, failing_signals and the signals."""
    known = F.coalesce(page["n_tokens"] >= LAYER_TOKENS_MIN, F.lit(False))
    coverage = F.when(known, page["extracted"].cast("double") / page["n_tokens"].cast("double"))
    thin = F.coalesce(coverage < COVERAGE_MIN, F.lit(False))
    poor = ~thin & ~page["blank"] & (F.size(page["failing_signals"]) > 0)
    return {
        "coverage": coverage,
        "quality_decision": F.when(thin | poor, "promote_to_vlm").otherwise("keep"),
        "layer": F.when(thin, 1).when(poor, 2).cast("int"),
        "reason": F.when(poor, F.concat(F.lit("heuristic_failed: "), F.array_join(page["failing_signals"], ", "))),
        "vlm_used": thin | poor,
    }


def escalation_message(page) -> Column:
    """What is said of an escalated page: the coverage with two decimals, or the signals that fail."""
    thin = F.concat(F.lit("coverage="), T.two_decimals(page["coverage"]), F.lit("<0.3"))
    why = F.when(page["layer"] == 1, thin).otherwise(page["reason"])
    return F.concat(F.lit("Page "), page["page_idx"].cast("string"), F.lit(" escalated to VLM: "), why)


def escalations(pages: DataFrame) -> DataFrame:
    """``warnings`` of the pages that the gate escalates."""
    up = pages.where("quality_decision = 'promote_to_vlm'")
    return up.select("doc_key", "page_idx", F.lit("quality_gate_escalation").alias("code"), escalation_message(up).alias("message"))
