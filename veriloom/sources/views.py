"""Logical tables of a media catalogue over the Parquet fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifest JSON, one file or line a record, under a fixed schema: no inference pass."""
    return spark.read.schema(schema).option("multiLine", "false").json(path)


def manifest_files(spark: SparkSession, path: str, fields: str, key: str = r"/media/([^/]+)/manifest[.]json") -> DataFrame:
    """original_hash, manifest (a struct of these DDL fields), broken: a row for each manifest file under the path.

    The hash is taken from the file's own path by the pattern; files without one are left out. A file that isn't a JSON
    object is broken: its manifest is null, and no other file suffers; an empty file counts as missing. Of several files
    for a hash the first by path counts.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    at = F.col("_metadata.file_path")
    rows = files.select(F.url_decode(F.regexp_replace(F.regexp_extract(at, key, 1), "[+]", "%2B")).alias("original_hash"), at.alias("at"), F.col("value")).where("original_hash <> ''")
    return manifest_texts(rows.groupBy("original_hash").agg(F.min_by("value", "at").alias("value")), fields)


def manifest_texts(rows: DataFrame, fields: str) -> DataFrame:
    """original_hash, manifest (a struct of these DDL fields), broken: manifests out of their texts. rows: original_hash, value; one row a hash. A text that isn't a JSON object is broken and its manifest null."""
    parsed = F.from_json("value", f"{fields}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    good = F.trim(F.col("value"), F.lit(" \n\r\t")).startswith("{") & F.col("m").isNotNull() & F.col("m._broken").isNull()
    return rows.withColumn("m", parsed).select("original_hash", F.when(good, F.col("m").dropFields("_broken")).alias("manifest"), (~F.coalesce(good, F.lit(False))).alias("broken"))


def with_manifests(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with manifest and broken; both are null where no file has the record's hash."""
    return records.join(files, "original_hash", "left")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media records; the flag is null where there is no label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS media_id",
        "sha2(text, 256) AS original_hash",
        "CASE lang WHEN 'en' THEN 'jpg' WHEN 'fr' THEN 'png' WHEN 'de' THEN 'mp4' WHEN 'es' THEN 'webp' END AS file_extension",
        "CASE WHEN n_chars % 10 = 0 THEN 0L ELSE n_chars * 1000000 END AS price_lamports",
        "CASE WHEN n_chars % 7 <> 0 THEN concat('doc ', doc_id) END AS title",
        "source AS owner_wallet",
        "quality = 1 AND toxic = 0 AS is_public",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS media_id", "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the vector that is searched for."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS media_id", "p_name AS title", "CAST(round(p_retailprice * 100) AS BIGINT) * 10000000 AS price_lamports", "CAST(p_partkey % 10 AS STRING) AS owner_wallet")


def asset_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("media_id")).agg(F.min("l_suppkey").cast("string").alias("chain_owner"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return lines.join(orders, "l_orderkey").selectExpr(
        "l_partkey AS media_id", "o_custkey AS buyer", "l_suppkey AS seller", "CAST(round(l_extendedprice * 100) AS BIGINT) AS amount", "o_orderdate AS created_at",
        "concat(l_orderkey, '-', l_linenumber) AS signature", "l_orderkey", "l_linenumber",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof records: id, tagged hash, uploader, and the body's hash and target; age is the order of upload."""
    return table(spark, sf_dir, "documents").selectExpr("concat('tx', lpad(CAST(doc_id AS STRING), 8, '0')) AS tx_id", "sha2(text, 256) AS original_hash", "source AS uploader", "doc_id AS target_asset_id", "doc_id AS age")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS asset_id", "concat('https://gw/tx', lpad(CAST(CASE WHEN label = 0 THEN vec_id + 1 ELSE vec_id END AS STRING), 8, '0')) AS json_uri", "label = 9 AS burnt", "CAST(label AS STRING) AS owner"
    )


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node, parent) and the start nodes: each user's events linked backwards, and the last of each."""
    return (
        spark.sql("SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM {e}", e=table(spark, sf_dir, "events")),
        table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("start")).select("start"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id", "ts", "event_id", "CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'view' THEN 'active' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'delayed' END AS state",
        "CAST(get_json_object(props, '$.k') AS INT) AS progress",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("event_id AS token", "ts + INTERVAL 24 HOURS AS expires_at", "CAST(get_json_object(props, '$.k') AS INT) % 12 AS download_count")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS manifest_id", "turn AS pos", "role AS label", "text AS data")
