"""The training-data queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, jaccard_join, language_id, mixing, quality_rules, secret_scans, source_audit, token_counts, topk_search, toxicity, url_filters, vector_codes
from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_digest(secret_scans.find_secrets(table(spark, sf_dir, "documents")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark text found in a document."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(toxicity.held_out(), F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk_search.usable(F.col("embedding"))).select("vec_id", topk_search.quantized(F.col("embedding")).alias("x"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.one_row_each(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.fixed_rules(spark))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.learn(language_id.learning_rows(docs))
    return language_id.identify(docs, trees).withColumn("held_out", F.coalesce(language_id.held_out(), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(quality_rules.measure_repetition(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scans, op2_html_extraction, op3_decontamination, op4_jaccard_join, op5_toxicity, op6_token_counts, op7_topk_search, op8_mixing, op9_url_filters, op10_language_id, op11_source_audit, op12_quality_rules, op13_vector_codes)
}
