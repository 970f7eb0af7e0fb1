"""Keyed changes as whole-table rewrites: each returns the table as it is afterwards, to be written to a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in this order: an aggregate with partial results."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def insert_or_get(target: DataFrame, source: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, key and id of all): a key that the target has keeps its id; a new one has the first row's id of the batch."""
    fresh = first_per_key(source.join(target.select(key), key, "left_anti"), [key], order)
    ids = target.select(key, "id").join(source.select(key).distinct(), key, "left_semi").union(fresh.select(key, "id"))
    return fresh, ids


def upsert(target: DataFrame, source: DataFrame, key: str, optional: list[str], now: Column, order: list[str]) -> DataFrame:
    """The target with the source merged on the key.

    source has one row a key in the end: the last in this order. Its columns overwrite the target's, but a null in an
    optional one leaves the target's value; created_at stays, updated_at becomes now; new keys get both. Columns that
    only the target has stay. A full outer equi-join; both sides have one row a key.
    """
    last = source.groupBy(key).agg(F.max_by(F.struct(*[c for c in source.columns if c != key]), F.struct(*order)).alias("s"))
    fields = {c for c in source.columns if c != key}
    both = target.select(key, F.struct(*[c for c in target.columns if c != key]).alias("t")).join(last, key, "full")
    hit = F.col("s").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        old = F.col(f"t.{c}")
        if c == "created_at":
            return F.coalesce(old, now).alias(c)
        if c == "updated_at":
            return F.when(hit, now).otherwise(old).alias(c)
        if c not in fields:
            return old.alias(c)
        new = F.col(f"s.{c}")
        return F.when(hit, F.coalesce(new, old) if c in optional else new).otherwise(old).alias(c)

    return both.select(*[value(c) for c in target.columns])


def sync_owner(target: DataFrame, owners: DataFrame, owner_col: str = "owner_wallet") -> DataFrame:
    """The chain's owner over the table's, with stale: whether it changed (a null owner is stale). Media without a chain owner stay."""
    rows = target.join(owners, "media_id", "left")
    new = F.coalesce("chain_owner", owner_col)
    return rows.select(*[new.alias(c) if c == owner_col else F.col(c) for c in target.columns], (~F.col(owner_col).eqNullSafe(new)).alias("stale"))


def guarded_update(target: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """target with `column` set where a change matches id and owner; changes: media_id, owner_wallet, new, one row each."""
    rows = target.join(changes.select("media_id", "owner_wallet", F.col("new"), F.lit(True).alias("hit")), ["media_id", "owner_wallet"], "left")
    return rows.select(*[F.when(F.col("hit"), F.col("new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in target.columns])


def partial_update(target: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """target with the supplied columns changed. changes: media_id, one row each, a column and has_<column> each; null is a value."""
    new = changes.select("media_id", *[F.col(c).alias(f"n_{c}") for c in columns], *[f"has_{c}" for c in columns])
    rows = target.join(new, "media_id", "left")
    return rows.select(*[F.when(F.col(f"has_{c}"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def count_grants(target: DataFrame, grants: DataFrame, key: str = "token") -> DataFrame:
    """download_count and the number of grants added to it."""
    n = grants.groupBy(key).agg(F.count("*").cast("int").alias("more"))
    return target.join(n, key, "left").withColumn("download_count", F.col("download_count") + F.coalesce("more", F.lit(0))).drop("more")


def new_purchases(valid: DataFrame, now: Column, token: Column) -> DataFrame:
    """Purchase rows of valid requests; clock and token are given, so reruns agree."""
    return valid.withColumns({"download_token": token, "download_expires_at": now + F.expr("INTERVAL 24 HOURS"), "download_count": F.lit(0), "created_at": now})


def proof_documents(records: DataFrame) -> DataFrame:
    """Proof records as JSON. records: original_hash, target_asset_id, root_signer, claim_generator, source_type, created_at, image."""
    traits = ["original_hash", "root_signer", "claim_generator", "source_type", "created_at"]
    attributes = F.array(*[F.struct(F.lit(t).alias("trait_type"), F.col(t).cast("string").alias("value")) for t in traits])
    body = F.struct(F.concat(F.lit("Proof #"), F.left("original_hash", F.lit(8))).alias("name"), F.col("image"), F.col("target_asset_id"), attributes.alias("attributes"))
    return records.select("original_hash", F.to_json(body).alias("body"))


def write_json(rows: DataFrame, path: str, partition: str = "original_hash") -> None:
    """Documents as JSON files, a folder for each value of partition; rows of one value come together first. A value's folder is written anew, so a rerun leaves one copy; other folders stay."""
    rows.repartition(partition).write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
