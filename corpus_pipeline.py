"""A corpus pipeline: five stages, each a filter or an arrangement by an operator of ``docspark.llm``.

A stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of ``documents``; the last returns the
packed pieces.  ``run`` writes every stage's result into the shared folder before the next one reads it.

Documents are told apart by ``doc_id``.  Rows that repeat an id, rows without one included, are kept or dropped together
by the rules and the join: they stay if any of them does.  The classifier judges each row by its own text.  A null text is empty: the rules reject it.  Empty tables stay empty;
other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, written
from docspark.llm.jaccard import jaccard_components, worth_dealing
from docspark.llm.packing import pack_documents
from docspark.llm.quality_model import quality_scores
from docspark.llm.quality_rules import quality_rules
from docspark.llm.queries import tokenizer_path
from docspark.llm.secrets import scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in ``ids``."""
    kept = ids.select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return _only(docs, quality_rules(docs).where("kept"))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, calls poor go."""
    return quality_scores(docs, table(spark, sf_dir, "labels"), keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, that with the smallest id stays."""
    return _only(docs, jaccard_components(docs, n=5, num=80, den=100).where("doc_id <=> component_id"))


def mask_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked in the texts; examples that many owners hold stay as they are.

    Findings come back by id and text, so that rows that share an id are masked each by its own.
    Texts that surely hold none are not shuffled: a bitmap of the keys that do goes to every task.
    """
    live = F.filter("found", lambda s: s["verdict"] == "live")
    text_of = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    keyed = docs.select(*COLUMNS, F.sha2(text_of, 256).alias("_key"))
    found = scan_secrets(keyed, "_key").select("_key", live.alias("_live")).where(F.size("_live") > 0).dropDuplicates(["_key"])
    found = written(found, "pipeline-live")  # read twice
    full = worth_dealing(keyed, "_key", found, "_key").join(found, "_key", "left")
    rest = worth_dealing(keyed, "_key", found, "_key", False).select(*COLUMNS)
    # gaps between the spans, in order; spans that overlap are taken up by the earlier one
    pieces = F.aggregate(
        F.array_sort(F.transform("_live", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        ).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<secret:"), s["kind"], F.lit(">")).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    text = F.when(F.col("_live").isNull(), F.col("text")).otherwise(pieces)
    masked = full.withColumn("text", text).withColumn("n_chars", F.when(F.col("_live").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)
    return masked.unionByName(rest)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences for training: every kept document's pieces and their places."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", mask_live_secrets),
    ("best-fit packing", pack),
]

# The classifier and the tokenizer have no SQL form; the pipeline is tested stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
