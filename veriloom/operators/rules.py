"""Rule chains: the first rule that fails gives a row its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions.scalars import missing

#: Most lamports that a transfer to oneself may cost, and downloads for a token.
MOST_FEE, MOST_DOWNLOADS = 10_000_000, 10


def first_failure(*rules: tuple[str, Column], passed: str = "ok") -> Column:
    """The name of the first rule whose condition holds (null: it doesn't), else passed."""
    out = None
    for name, fails in rules:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise(passed)


def upload_gate(uploads: DataFrame) -> DataFrame:
    """uploads with reason. Columns used: has_store, signature_valid (null counts as valid), has_manifest, is_ai, root_trusted, content_hash, is_duplicate."""
    return uploads.withColumn(
        "reason",
        first_failure(
            ("no_store", ~F.coalesce("has_store", F.lit(False))),
            ("invalid_signature", ~F.coalesce("signature_valid", F.lit(True))),
            ("no_manifest", ~F.coalesce("has_manifest", F.lit(False))),
            ("ai_generated", F.col("is_ai")),
            ("untrusted_issuer", ~F.coalesce("root_trusted", F.lit(False))),
            ("no_hash", missing("content_hash")),
            ("duplicate", F.col("is_duplicate")),
        ),
    )


def last_index(keys: Column, key: Column) -> Column:
    """Place from 0 of the last equal element; null if none."""
    at = F.array_position(F.reverse(keys), key)
    return F.when(at > 0, F.size(keys) - at)


def validate_purchases(requests: DataFrame, media: DataFrame, chain: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests with reason, the first rule that a purchase breaks.

    requests: request_id, media_id, buyer, signature; media: media_id, owner_wallet, price_lamports; chain: signature,
    err, keys, pre, post (arrays in step); recorded: signature. A price that is null is neither free nor paid: a
    signature that isn't free_ passes without a look at the chain. Left joins on the keys; signatures of recorded
    purchases are made distinct first, so none multiplies rows.
    """
    seen = recorded.select("signature").where("signature is not null").distinct().withColumn("seen", F.lit(True))
    known = media.select("media_id", "owner_wallet", "price_lamports", F.lit(True).alias("has_media"))
    rows = requests.join(known, "media_id", "left").join(chain.withColumn("has_tx", F.lit(True)), "signature", "left").join(seen, "signature", "left")
    free, free_tx, paid = F.col("price_lamports") == 0, F.startswith("signature", F.lit("free_")), F.col("price_lamports") > 0
    at_buyer, at_seller = last_index(F.col("keys"), F.col("buyer")), last_index(F.col("keys"), F.col("owner_wallet"))
    delta = lambda at: F.get("post", at) - F.get("pre", at)
    self_ = F.lower("buyer") == F.lower("owner_wallet")
    reason = first_failure(
        ("missing_fields", missing(F.col("media_id").cast("string")) | missing("buyer") | missing("signature")),
        ("media_not_found", F.col("has_media").isNull()),
        ("free_needs_free_signature", free & ~free_tx),
        ("paid_with_free_signature", ~F.coalesce(free, F.lit(False)) & free_tx),
        ("tx_not_found", paid & F.col("has_tx").isNull()),
        ("tx_failed", paid & F.coalesce("err", F.lit(False))),
        ("wrong_signer", paid & ~F.get("keys", F.lit(0)).eqNullSafe(F.col("buyer"))),
        ("account_missing", paid & (at_buyer.isNull() | at_seller.isNull())),
        ("fee_too_high", paid & self_ & (F.abs(delta(at_buyer)) > MOST_FEE)),
        ("short_payment", paid & ~F.coalesce(self_, F.lit(False)) & (delta(at_seller) < F.col("price_lamports"))),
        ("already_recorded", F.col("seen")),
    )
    return rows.select(*requests.columns, reason.alias("reason"))


def download_grants(tokens: DataFrame, media: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """tokens with reason and download_count as it is afterwards. tokens: token, expires_at, download_count; a token at its very expiry is good."""
    now = F.current_timestamp() if now is None else now
    rows = tokens if media is None else tokens.join(media, "media_id")
    reason = first_failure(("expired", now > F.col("expires_at")), ("limit", F.col("download_count") >= MOST_DOWNLOADS), passed="granted")
    return rows.withColumn("reason", reason).withColumn("download_count", F.col("download_count") + (F.col("reason") == "granted").cast("int"))


def download_requests(requests: DataFrame, tokens: DataFrame, most: int = MOST_DOWNLOADS) -> tuple[DataFrame, DataFrame]:
    """(requests with reason and download_count as each leaves it, tokens with download_count after all of them).

    requests: request_id, token, at; tokens: token, expires_at, download_count. A token's requests come in the order of
    (at, request_id): one for a token that isn't there is not_found, one after its expiry expired, one that finds `most`
    downloads limit, and the others are granted, each a download. Requests without a time come first and never expire.
    A null count counts as 0; a null expiry never comes.

    A request that is granted is among its token's first `most` that haven't expired, so every task sends on that many of
    a token at most, and the last one granted decides for the rest: a token with very many requests isn't one task.
    """
    known = tokens.select("token", "expires_at", F.coalesce("download_count", F.lit(0)).alias("before"))
    rows = requests.select("request_id", "token", "at").join(known, "token")
    nth = F.row_number().over(Window.partitionBy("token").orderBy("at", "request_id"))
    first = rows.where(~F.coalesce(F.col("at") > F.col("expires_at"), F.lit(False))).withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") + F.col("before") <= most)
    last = first.groupBy("token").agg(F.max(F.struct(F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**63))).alias("us"), "request_id")).alias("last"), F.max("nth").alias("granted"))
    side = known.join(last, "token", "left").select("token", "expires_at", "before", "last", F.coalesce("granted", F.lit(0)).alias("granted"))
    own = F.struct(F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**63))).alias("us"), F.col("request_id"))
    all_ = requests.join(side.withColumn("known", F.lit(True)), "token", "left")
    reason = first_failure(("not_found", F.col("known").isNull()), ("expired", F.col("at") > F.col("expires_at")), ("limit", F.coalesce(own > F.col("last"), F.lit(True))), passed="granted")
    place = first.select("request_id", "token", "nth")
    judged = all_.withColumn("reason", reason).join(place, ["request_id", "token"], "left")
    count = F.when(F.col("known"), (F.col("before") + F.coalesce("nth", "granted")).cast("int"))
    after = tokens.join(last.select("token", "granted"), "token", "left").withColumn("download_count", (F.coalesce("download_count", F.lit(0)) + F.coalesce("granted", F.lit(0))).cast("int"))
    return judged.select(*requests.columns, "reason", count.alias("download_count")), after.select(*tokens.columns)


def purchase_status(latest: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (media_id, buyer) with purchased and the latest token, whether or not it has expired."""
    return asked.join(latest.select("media_id", "buyer", "token"), ["media_id", "buyer"], "left").withColumn("purchased", F.col("token").isNotNull())
