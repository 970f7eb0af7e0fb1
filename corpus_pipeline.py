"""A corpus pipeline: known languages, one document of each near-duplicate class, no benchmark texts, no secrets, mixed to target weights.

Each stage takes (spark, docs, sf_dir); its result is a Parquet table, read again as the next one's docs. Stages that
pass texts through Python write it themselves, in small Arrow batches: whole files in one batch cost executors memory
outside the heap. In all of them an empty table gives no rows, very long texts count whole, null ids are rows like others, and columns beside those of
documents stay as they are (but for rate and copies, which the last stage sets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import decontamination, jaccard_join, language_id, mixing, secret_scans
from veriloom.llm.common import table, written

#: Near-duplicates of a corpus: words in a shingle, and hundredths of common shingles from which on documents link.
COPY_WORDS, COPY_THRESHOLD = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language scores too low; languages are learned from the documents' own labels. Null and empty texts go; repeated rows stay or go together."""
    return written(language_id.keep_known(docs, language_id.learn(language_id.learning_rows(docs))), "stage-language_id")


def first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate class. Null and empty texts and null ids stay; of repeated rows one stays."""
    return jaccard_join.keep_first(docs, words=COPY_WORDS, threshold=COPY_THRESHOLD)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark text. Null and empty texts stay; repeated rows stay or go together."""
    return written(decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark")), "stage-decontamination")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by their kind; n_chars follows. All rows stay, null and clean texts as they are."""
    return written(secret_scans.redact_secrets(docs, length_col="n_chars"), "stage-secret_scans")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their rate and number of copies. A null source is a source of its own; repeated rows get equal copies."""
    return mixing.with_copies(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", first_of_class),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
]

#: SQL can't express the learned languages, the alignments or the rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = known_language(spark, table(spark, sf_dir, "documents"), sf_dir)
    docs = written(first_of_class(spark, docs, sf_dir), "stage-jaccard_join")
    docs = without_secrets(spark, without_benchmark(spark, docs, sf_dir), sf_dir)
    return mixed(spark, docs, sf_dir)
