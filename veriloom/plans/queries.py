"""The reference queries over the fixtures: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import nested as N
from veriloom.functions import scalars as S
from veriloom.operators import catalog, jobs, manifests, merge, resolve, rules, vector
from veriloom.sources import views
from veriloom.sources.views import table

NOW = "TIMESTAMP_NTZ'2024-01-15 00:00:00'"
BUYER, OWNER = 10, "1"


def _trusted() -> Column:
    return F.col("uploader") != "src0"


def _text(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.search_similar(views.vectors(spark, d), views.media(spark, d), views.query_vector(spark, d))


def vector_percent(spark: SparkSession, d: str) -> DataFrame:
    found = vector.similarities(views.vectors(spark, d), views.media(spark, d), views.query_vector(spark, d))
    return found.select("media_id", S.percent("similarity").alias("percent"))


def vector_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    incoming = views.media(spark, d).select("media_id", "original_hash", F.lit("text").alias("model_name"))
    return vector.insert_if_absent(views.vectors(spark, d), incoming).select("media_id", "original_hash", "model_name")


def owner_page(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.owned(views.listing(spark, d), views.asset_owner(spark, d), OWNER)
    return catalog.page_of(rows, [F.col("price_lamports").desc(), F.col("media_id")], 1, 20).select("media_id", "title", "price_lamports", "owner_wallet")


def buyer_page(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.bought(catalog.buyer_rows(views.purchases(spark, d), str(BUYER)), views.listing(spark, d))
    order = [F.col("created_at").desc_nulls_first(), *[F.col(c) for c in ("media_id", "l_orderkey", "l_linenumber", "seller", "amount")]]
    return catalog.page_of(rows, order, 1, 20).select("media_id", F.col("media.title").alias("title"), "amount", "seller", "signature", _text("created_at").alias("created_at"))


def page_envelope(spark: SparkSession, d: str) -> DataFrame:
    got = catalog.envelope(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey")], 3, 20)
    return got.select("total", "page", "limit", "total_pages", F.array_join(F.col("items.o_orderkey").cast("array<string>"), ",").alias("items"))


def latest_purchase(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_per_key(views.purchases(spark, d), ["media_id", "buyer"], ["created_at", "l_orderkey", "l_linenumber", "seller", "amount"], ["signature", "amount", "seller"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    return views.transactions(spark, d).select("original_hash", F.col("target_asset_id").alias("asset_id"), "age")


def oldest_per_hash(spark: SparkSession, d: str) -> DataFrame:
    return resolve.duplicates(_records(spark, d)).select("original_hash", "copies", F.col("oldest_asset").alias("oldest_id"), (F.col("copies") > 1).alias("is_duplicated"))


def _candidates(spark: SparkSession, d: str, trusted: Column | None) -> DataFrame:
    tx = views.transactions(spark, d)
    return resolve.candidates(tx.select("original_hash", "tx_id", "age"), tx.select("tx_id", "uploader"), tx.select("tx_id", F.col("original_hash").alias("body_hash"), "target_asset_id"), trusted)


def candidates_verified(spark: SparkSession, d: str) -> DataFrame:
    return resolve.in_order(_candidates(spark, d, _trusted())).select("original_hash", "tx_id", "target_asset_id", "uploader", "place")


def duplicate_check(spark: SparkSession, d: str) -> DataFrame:
    return resolve.has_existing(_candidates(spark, d, _trusted()), views.assets(spark, d))


def _resolved(spark: SparkSession, d: str, documented: bool = False) -> DataFrame:
    return resolve.resolve(_candidates(spark, d, _trusted()), views.assets(spark, d), _records(spark, d), documented)


def proof_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


def proof_resolution_documented(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, documented=True)


def verification_steps(spark: SparkSession, d: str) -> DataFrame:
    got = resolve.steps(_resolved(spark, d))
    status = lambda step: N.first_where("steps", lambda s: s["id"] == step)["status"].alias(f"step_{step}")
    return got.select("original_hash", *map(status, resolve.STEPS))


def access_rule(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "orders").selectExpr("o_orderkey AS media_id", "concat('src', o_custkey % 20) AS viewer")
    bought = views.purchases(spark, d).selectExpr("media_id", "concat('src', buyer % 20) AS viewer")
    return catalog.access(requests, views.media(spark, d), bought)


def root_walk(spark: SparkSession, d: str) -> DataFrame:
    return manifests.root_walk(*views.chain(spark, d))


def action_timeline(spark: SparkSession, d: str) -> DataFrame:
    actions = views.assertions(spark, d).select("manifest_id", "pos", F.concat(F.lit("c2pa.chat_"), "label").alias("action"))
    return manifests.timeline(actions)


def first_attribute(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pair = lambda k, v: F.struct(F.lit(k).alias("trait_type"), v.alias("value"))
    attributes = F.array(pair("original_hash", F.sha2("text", 256)), pair("root_signer", F.col("source")), pair("source_type", F.col("lang")), pair("root_signer", F.lit("later")))
    return docs.select("doc_id", attributes.alias("attributes")).select("doc_id", *[N.attribute("attributes", k).alias(k) for k in ("original_hash", "root_signer", "source_type", "absent")])


def assertion_group(spark: SparkSession, d: str) -> DataFrame:
    got = manifests.group_assertions(views.assertions(spark, d))
    return got.select("manifest_id", "label", F.array_join("values", "|").alias("values"), F.size("values").alias("n"), "multi")


def source_type_label(spark: SparkSession, d: str) -> DataFrame:
    key = S.choose(F.col("event_type"), {"view": "digitalCapture", "click": "compositeWithTrainedAlgorithmicMedia", "purchase": "trainedAlgorithmicMedia", "signup": ""}, F.lit("newKey"))
    uri = F.when(F.col("event_type") != "error", F.concat(F.lit(S.SOURCE_TYPE_BASE), key))
    rows = table(spark, d, "events").select("event_id", uri.alias("uri"))
    return rows.select("event_id", S.source_type("uri").alias("source_type"), S.source_type_label("uri").alias("label"), S.is_hardware("uri").alias("is_hardware"))


def hash_spec_match(spark: SparkSession, d: str) -> DataFrame:
    """Issuers by source; one document in three has a hash, one an empty hash, one none."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((F.col("doc_id") + k * 7) % 256).cast("int"))
    none = F.lit(None).cast("array<int>")
    held = F.when(F.col("n_chars") % 3 == 0, raw).when(F.col("n_chars") % 3 == 1, F.array().cast("array<int>"))
    one = lambda label, h: F.struct(F.lit(label).alias("label"), h.alias("hash"), none.alias("val"), none.alias("data"))
    issuer = F.when(F.col("source") == "src1", "Google LLC").when(F.col("source") == "src2", "Pixel, Google LLC, US").when(F.col("source") == "src3", "Sony")
    rows = table(spark, d, "documents").select("doc_id", issuer.alias("issuer"), F.concat(F.lit("urn:uuid:u"), "doc_id").alias("instance_id"), F.array(one("c2pa.actions", raw), one("c2pa.hash.data", held)).alias("assertions"))
    specs = spark.sql("SELECT * FROM VALUES ('google-pixel', 0, 'Google LLC', false), ('any', 1, '^S[a-z]+$', true) AS t(spec_id, place, matcher, is_regex)")
    return manifests.match_spec(rows, specs).select("doc_id", "spec_id", N.content_hash("issuer", "assertions", "instance_id").alias("content_hash"))


def byte_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.binary_hex(F.encode("text", "UTF-8")).alias("hex"))


def price_display(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("p_size") % 5 == 0, 0).otherwise(S.price_parse(F.col("p_retailprice").cast("string")))
    return table(spark, d, "part").select("p_partkey", price.cast("long").alias("lamports")).select("p_partkey", "lamports", S.price_display("lamports").alias("display"))


def address_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.select("doc_id", S.truncated("h", 4, 4).alias("short"), S.truncated("h", 8, 6).alias("medium"), S.truncated("h", 6, 6).alias("even"))


def mime_extension(spark: SparkSession, d: str) -> DataFrame:
    mime = S.choose(F.col("lang"), {"en": "image/jpeg", "fr": "image/heic", "de": "video/quicktime", "es": "application/json"}, F.lit("text/plain"))
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), mime.alias("mime"))
    out = rows.select("doc_id", "h", *[S.extension_of("mime", t).alias(k) for k, t in (("store", S.STORE_EXTENSIONS), ("upload", S.UPLOAD_EXTENSIONS), ("page", S.PAGE_EXTENSIONS))])
    key = S.object_key("h", "original", "store")
    return out.select("doc_id", "store", "upload", "page", key.alias("original_key"), S.object_key("h", "manifest").alias("manifest_key"), S.path_extension(key).alias("from_path"))


def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    taken = _records(spark, d).groupBy("original_hash").agg(F.min("asset_id").alias("first_id"))
    rows = rows.withColumn("original_hash", F.sha2("text", 256)).join(taken, "original_hash", "left")
    asked = rows.selectExpr(
        "doc_id", "n_chars % 11 <> 0 AS has_store", "CASE WHEN toxic IS NOT NULL THEN toxic = 0 END AS signature_valid", "n_chars % 13 <> 0 AS has_manifest", "quality = 0 AS is_ai",
        "source <> 'src0' AS root_trusted", "CASE WHEN n_chars % 17 = 0 THEN '' ELSE original_hash END AS content_hash", "doc_id <> first_id AS is_duplicate",
    )
    return rules.upload_gate(asked).select("doc_id", "reason")


def purchase_validation(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS buyer", "CAST(o_orderkey % 10 AS STRING) AS seller", "CAST(round(o_totalprice * 100) AS BIGINT) AS total", "o_orderstatus = 'F' AS err")
    price = "CASE WHEN o_orderkey % 19 = 0 THEN 0L WHEN o_orderkey % 23 <> 0 THEN total END"
    signature = "CASE WHEN o_orderkey % 19 = 0 AND o_orderkey % 2 = 0 OR o_orderkey % 29 = 0 THEN concat('free_', o_orderkey) WHEN o_orderkey % 31 <> 0 THEN concat('sig', o_orderkey) ELSE '' END"
    requests = orders.selectExpr("o_orderkey AS request_id", "CASE WHEN o_orderkey % 37 = 0 THEN -o_orderkey ELSE o_orderkey END AS media_id", "buyer", f"{signature} AS signature")
    media = orders.selectExpr("o_orderkey AS media_id", "seller AS owner_wallet", f"{price} AS price_lamports")
    chain = orders.where("o_orderkey % 41 <> 0").selectExpr(
        "concat('sig', o_orderkey) AS signature", "err", "CASE WHEN o_orderkey % 43 = 0 THEN array(seller, buyer) WHEN o_orderkey % 47 = 0 THEN array(buyer) ELSE array(buyer, seller, seller) END AS keys",
        "array(total + 5000, 7L, 0L) AS pre", "array(0L, 7L, CASE WHEN o_orderkey % 7 = 0 THEN total - 1 ELSE total END) AS post",
    )
    recorded = orders.where("o_orderkey % 53 = 0").selectExpr("concat('sig', o_orderkey) AS signature")
    return rules.validate_purchases(requests, media, chain, recorded).select("request_id", "reason")


def download_grant(spark: SparkSession, d: str) -> DataFrame:
    return rules.download_grants(views.tokens(spark, d), now=F.expr(NOW)).select("token", "reason", "download_count")


def upsert_media(spark: SparkSession, d: str) -> DataFrame:
    """Every second record is there; every third one comes in, some without a title."""
    m = merge.first_per_key(views.media(spark, d), ["original_hash"], ["media_id"])
    old, new = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.expr(NOW)
    fields = ["original_hash", "media_id", "title", "price_lamports", "owner_wallet", "is_public"]
    target = m.where("media_id % 2 = 0").select(*fields, old.alias("created_at"), old.alias("updated_at"))
    source = m.where("media_id % 3 = 0").select("original_hash", "media_id", "title", (F.col("price_lamports") + 1).alias("price_lamports"), F.lit("new").alias("owner_wallet"), F.lit(True).alias("is_public"))
    got = merge.upsert(target, source, "original_hash", ["title"], new, ["media_id"])
    return got.select(*fields, _text("created_at").alias("created_at"), _text("updated_at").alias("updated_at"))


def owner_sync(spark: SparkSession, d: str) -> DataFrame:
    return merge.sync_owner(views.listing(spark, d), views.asset_owner(spark, d)).select("media_id", "owner_wallet", "stale")


def partial_update(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "part").where("p_partkey % 4 <> 0").selectExpr(
        "p_partkey AS media_id", "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) END AS title", "p_partkey % 2 = 0 AS has_title", "p_partkey * 1000 AS price_lamports", "p_partkey % 5 = 0 AS has_price_lamports"
    )
    return merge.partial_update(views.listing(spark, d), changes, ["title", "price_lamports"])


def job_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.state_counts(jobs.latest(views.jobs(spark, d)))


def job_retention(spark: SparkSession, d: str) -> DataFrame:
    got = jobs.retained(jobs.latest(views.jobs(spark, d)), F.expr(NOW), jobs.RETENTION["worker"])
    return got.select("job_id", "state", "kept")


def leaf_index(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "events").selectExpr("event_id", "ts", "user_id % 8 AS tree")
    minted = spark.sql("SELECT id AS tree, id * 100 AS num_minted FROM range(7)")
    return jobs.leaf_indexes(queue, minted).select("event_id", "tree", "leaf_index")


def mint_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events ask for documents' hashes, several of them more than once."""
    docs = table(spark, d, "documents").selectExpr("doc_id", "sha2(text, 256) AS original_hash")
    n = docs.agg(F.count("*").alias("n"))
    asked = table(spark, d, "events").crossJoin(F.broadcast(n)).selectExpr("event_id", "ts", "user_id % 8 AS tree", "event_id * 7 % n AS doc_id")  # n has one row
    queue = asked.join(docs, "doc_id").select("event_id", "ts", "tree", "original_hash")
    existing = docs.where("doc_id % 5 = 0").select("original_hash")
    minted = spark.sql("SELECT id AS tree, id * 100 AS num_minted FROM range(7)")
    return jobs.replay(queue, existing, minted).select("event_id", "reason", "success", "progress", "leaf_index")


def json_progress(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(views.jobs(spark, d)).select("job_id", "state", "progress")


def flatten_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = views.assertions(spark, d).groupBy("manifest_id").agg(F.min_by("data", "pos").alias("title"), F.max_by("label", "pos").alias("format"), F.count("*").cast("string").alias("vendor"))
    held = F.array(F.struct(F.lit("c2pa.actions").alias("label"), F.create_map(F.lit("a"), F.col("vendor")).alias("data")), F.struct(F.lit("c2pa.hash.data").alias("label"), F.create_map(F.lit("alg"), F.lit("sha256"), F.lit("pad"), F.lit("")).alias("data")))
    return manifests.flatten(rows.withColumn("assertions", held), ["title", "format", "vendor"])


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_percent, vector_insert_if_absent, owner_page, buyer_page, page_envelope, latest_purchase, oldest_per_hash, candidates_verified, duplicate_check,
        proof_resolution, proof_resolution_documented, verification_steps, access_rule, root_walk, action_timeline, first_attribute, assertion_group, source_type_label,
        hash_spec_match, byte_hex, price_display, address_truncate, mime_extension, upload_gate, purchase_validation, download_grant, upsert_media, owner_sync, partial_update,
        job_state_counts, job_retention, leaf_index, mint_replay, json_progress, flatten_metadata,
    )
}
