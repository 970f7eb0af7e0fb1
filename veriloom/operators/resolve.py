"""Resolution of proof records: candidates, existence, two-way links, duplicates and the verdict, for all hashes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.operators.places import with_places


def tagged(index: DataFrame, name: str, value: str, most: int = 100) -> DataFrame:
    """Records with this tag, the oldest so many: tags is an array of (name, value)."""
    has = F.exists("tags", lambda t: (t["name"] == name) & (t["value"] == value))
    return index.where(has).orderBy("timestamp", "tx_id").limit(most)


def tag_postings(index: DataFrame) -> DataFrame:
    """name, value, timestamp, tx_id: a row for each tag of each record (tags: an array of (name, value)); a tag that a record has twice counts once."""
    return index.select("timestamp", "tx_id", F.explode(F.array_distinct("tags")).alias("tag")).select("tag.name", "tag.value", "timestamp", "tx_id")


def write_postings(postings: DataFrame, path: str, buckets: int = 256) -> None:
    """The postings by hash bucket of their tag, each bucket in order, so that a lookup reads a bucket and skips most of its row groups.

    A tag's postings may be many, so a bucket is dealt over several files by record before it is sorted.
    """
    bucket = F.pmod(F.xxhash64("name", "value"), F.lit(buckets)).cast("int")
    rows = postings.withColumn("bucket", bucket).repartition(F.col("bucket"), F.pmod(F.xxhash64("tx_id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "name", "value", "timestamp", "tx_id").write.partitionBy("bucket").mode("overwrite").parquet(path)


def look_up(spark: SparkSession, path: str, name: str, value: str, most: int = 100, buckets: int = 256) -> DataFrame:
    """The oldest so many records of one tag, out of written postings."""
    tag = spark.range(1).select(F.pmod(F.xxhash64(F.lit(name), F.lit(value)), F.lit(buckets))).head()[0]
    rows = spark.read.parquet(path).where((F.col("bucket") == tag) & (F.col("name") == name) & (F.col("value") == value))
    return rows.orderBy("timestamp", "tx_id").limit(most).select("timestamp", "tx_id")


def first_tagged(postings: DataFrame, most: int = 100) -> DataFrame:
    """name, value, place, timestamp, tx_id: the oldest so many records of every tag. A task sends on so many of a tag at most."""
    place = F.row_number().over(Window.partitionBy("name", "value").orderBy("timestamp", "tx_id"))
    return postings.withColumn("place", place).where(F.col("place") <= most).select("name", "value", "place", "timestamp", "tx_id")


def candidates(index: DataFrame, headers: DataFrame, bodies: DataFrame, trusted: Column | None = None) -> DataFrame:
    """Records whose uploader is trusted and whose body names the hash that they are tagged with.

    index: tx_id, original_hash, age; headers: tx_id, uploader; bodies: tx_id, body_hash, target_asset_id. Records
    without a header or body are left out. trusted: a condition on uploader, all if None.
    """
    rows = index.join(headers if trusted is None else headers.where(trusted), "tx_id").join(bodies, "tx_id")
    return rows.where("body_hash = original_hash").select("original_hash", "tx_id", "target_asset_id", "uploader", "age")


def in_order(found: DataFrame, spread: bool = False) -> DataFrame:
    """Candidates with their place among those of their hash, the oldest first.

    A hash with very many records is one window group of narrow rows that Spark sorts and spills; ask `resolve` where
    only the oldest matters, and set spread where a hash may hold a large share of all records: it is then cut into
    ranges of even size, at the price of more passes.
    """
    if spread:
        return with_places(found, "original_hash", ("age", "tx_id")).withColumn("place", (F.col("place") + 1).cast("int"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("original_hash").orderBy("age", "tx_id")))


def has_existing(found: DataFrame, assets: DataFrame) -> DataFrame:
    """original_hash, rejected: whether a candidate's asset exists; burnt ones do."""
    known = assets.select(F.col("asset_id").alias("target_asset_id"), F.lit(True).alias("known"))
    return found.join(known, "target_asset_id", "left").groupBy("original_hash").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("rejected"))


def duplicates(records: DataFrame) -> DataFrame:
    """For each hash how many records have it and the oldest one's asset."""
    return records.groupBy("original_hash").agg(F.count("*").alias("copies"), F.min_by("asset_id", F.struct("age", "asset_id")).alias("oldest_asset"))


def resolve(found: DataFrame, assets: DataFrame, records: DataFrame, documented: bool = False) -> DataFrame:
    """The record that stands for each hash, its links and its verdict.

    The oldest candidate whose asset exists stands; its back-link is tested after that. With documented=True candidates
    must link back to stand. A burnt asset has no owner but keeps its last one. The back-link is containment of the
    record's id in the asset's uri. A hash with several catalogue records isn't valid, even if the oldest of them stands.

    Columns: original_hash, tx_id, asset_id, owner, last_owner, burnt, cross_link, copies, no_duplicates, is_oldest, is_valid.
    """
    pairs = found.join(assets.withColumnRenamed("asset_id", "target_asset_id"), "target_asset_id").withColumn("cross_link", F.coalesce(F.contains("json_uri", "tx_id"), F.lit(False)))
    if documented:
        pairs = pairs.where("cross_link")
    # An aggregate with partial results, no sort: a hash with very many records costs a row for each task.
    best = pairs.groupBy("original_hash").agg(F.min_by(F.struct("tx_id", F.col("target_asset_id").alias("asset_id"), "owner", "burnt", "cross_link"), F.struct("age", "tx_id")).alias("best")).select("original_hash", "best.*")
    out = best.join(duplicates(records), "original_hash", "left")
    one = F.coalesce(F.col("copies") == 1, F.lit(False))
    return out.select(
        "original_hash",
        "tx_id",
        "asset_id",
        F.when(F.col("burnt"), "").otherwise(F.col("owner")).alias("owner"),
        F.col("owner").alias("last_owner"),
        "burnt",
        "cross_link",
        F.coalesce("copies", F.lit(0)).alias("copies"),
        one.alias("no_duplicates"),
        F.coalesce(F.col("oldest_asset") == F.col("asset_id"), F.lit(False)).alias("is_oldest"),
        (F.col("cross_link") & one).alias("is_valid"),
    )


STEPS = ["db", "cnft", "arweave", "crosslink", "duplicate"]


def steps(resolved: DataFrame) -> DataFrame:
    """original_hash and steps: (id, status) of the five displayed checks; an oldest duplicate passes its step."""
    said = lambda ok: F.when(ok, "success").otherwise("error")
    states = [F.lit("success"), F.lit("success"), F.lit("success"), said(F.col("cross_link")), said(F.col("no_duplicates") | (F.col("copies") > 1) & F.col("is_oldest"))]
    return resolved.select("original_hash", F.array(*[F.struct(F.lit(k).alias("id"), s.alias("status")) for k, s in zip(STEPS, states, strict=True)]).alias("steps"))
