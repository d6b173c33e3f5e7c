"""The operators' registered queries: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark.llm import jaccard, lexical, quality_rules, secrets, topk, variants
from docspark.llm.common import shared_dir, table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark, sf_dir):
    from docspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("host_rate", "host_rejected")


def op4_license_scan(spark, sf_dir):
    from docspark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op5_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op6_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op7_token_id_files(spark, sf_dir):
    from docspark.llm.idfiles import read_ids, write_ids

    path = f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read_ids(spark, path)


def op8_sharding(spark, sf_dir):
    from docspark.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    from docspark.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_piece_segmentation(spark, sf_dir):
    from docspark.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_document_fingerprints(spark, sf_dir):
    from docspark.llm.minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_best_fit_packing, op2_ngram_jaccard, op3_quality_rules, op4_license_scan, op5_secret_scan, op6_exact_top_k, op7_token_id_files, op8_sharding,
    op9_quality_classifier, op10_piece_segmentation, op11_spelling_variants, op12_lexical_search,
    op13_document_fingerprints,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": jaccard.ORACLE_SQL, "op3_quality_rules": quality_rules.ORACLE_SQL, "op5_secret_scan": secrets.oracle_sql(),
    "op6_exact_top_k": topk.ORACLE_SQL, "op11_spelling_variants": variants.ORACLE_SQL, "op12_lexical_search": lexical.ORACLE_SQL,
}
