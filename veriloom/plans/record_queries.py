"""More queries over the fixtures: keyed changes, walks and display rules of single records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import nested as N
from veriloom.functions import scalars as S
from veriloom.operators import catalog, jobs, manifests, merge, resolve, rules
from veriloom.sources import views
from veriloom.sources.views import table

NOW = "TIMESTAMP_NTZ'2024-01-15 00:00:00'"
# Descriptions of two assertion labels.
DESCRIPTIONS = {"c2pa.chat_user": "User turn", "c2pa.chat_assistant": "Assistant turn"}


def insert_or_get(spark: SparkSession, d: str) -> DataFrame:
    """Every second record is there; all come in."""
    m = views.media(spark, d).select("original_hash", F.col("media_id").alias("id"))
    target = merge.first_per_key(m.where("id % 2 = 0"), ["original_hash"], ["id"])
    return merge.insert_or_get(target, m, "original_hash", ["id"])[1]


def guarded_update(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS media_id", "CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 10 ELSE 99 END AS STRING) AS owner_wallet", "upper(p_name) AS new")
    return merge.guarded_update(views.listing(spark, d), changes, "title")


def count_grants(spark: SparkSession, d: str) -> DataFrame:
    """Views are grants of the tokens of the purchases with the same last digits."""
    tokens = views.tokens(spark, d).select("token", "download_count")
    grants = table(spark, d, "events").where("event_type = 'view'").selectExpr("event_id % 997 AS token")
    return merge.count_grants(tokens, grants)


def new_purchases(spark: SparkSession, d: str) -> DataFrame:
    valid = table(spark, d, "orders").selectExpr("o_orderkey AS media_id", "CAST(o_custkey AS STRING) AS buyer")
    got = merge.new_purchases(valid, F.expr(NOW), S.seeded_token("seed", "media_id", "buyer"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return got.select("media_id", "buyer", "download_token", text("download_expires_at"), "download_count", text("created_at"))


def purchase_status(spark: SparkSession, d: str) -> DataFrame:
    bought = views.purchases(spark, d).select("media_id", "buyer", "created_at", "l_orderkey", "l_linenumber", F.col("signature").alias("token"))
    latest = catalog.latest_per_key(bought, ["media_id", "buyer"], ["created_at", "l_orderkey", "l_linenumber"], ["token"])
    asked = table(spark, d, "orders").selectExpr("o_orderkey AS media_id", "o_custkey AS buyer").distinct()
    return rules.purchase_status(latest, asked)


def manifest_visible(spark: SparkSession, d: str) -> DataFrame:
    """Each order's customer asks for the document with its number; some have no record."""
    asked = table(spark, d, "orders").selectExpr("o_orderkey AS media_id", "concat('src', o_custkey % 20) AS viewer")
    rows = asked.join(views.media(spark, d).select("media_id", "is_public", "owner_wallet"), "media_id", "left")
    return rows.select("media_id", "viewer", catalog.manifest_visible(F.col("is_public"), F.col("owner_wallet"), F.col("viewer")).alias("visible"))


def candidates_any_uploader(spark: SparkSession, d: str) -> DataFrame:
    tx = views.transactions(spark, d)
    bodies = tx.selectExpr("tx_id", "CASE WHEN age % 4 = 0 THEN 'other' ELSE original_hash END AS body_hash", "target_asset_id")
    got = resolve.candidates(tx.select("original_hash", "tx_id", "age"), tx.select("tx_id", "uploader"), bodies)
    return got.select("original_hash", "tx_id", "target_asset_id")


def tagged_records(spark: SparkSession, d: str) -> DataFrame:
    """The oldest hundred records of one uploader."""
    tag = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    index = views.transactions(spark, d).select("tx_id", F.col("age").alias("timestamp"), F.array(tag("App", F.lit("veriloom")), tag("Uploader", F.col("uploader"))).alias("tags"))
    return resolve.tagged(index, "Uploader", "src1").select("tx_id", "timestamp")


def root_thumbnail(spark: SparkSession, d: str) -> DataFrame:
    edges, starts = views.chain(spark, d)
    held = edges.selectExpr("node", "parent", "CASE WHEN node % 3 = 0 THEN concat('i', node) WHEN node % 3 = 1 THEN '' END AS ingredient_thumbnail")
    own = edges.where("node % 5 < 2").selectExpr("node", "concat('t', node) AS thumbnail")
    return manifests.root_thumbnail(held, starts, own)


def proof_documents(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "documents").select(
        F.sha2("text", 256).alias("original_hash"), F.col("doc_id").alias("target_asset_id"), F.col("source").alias("root_signer"), F.lit("gen").alias("claim_generator"), F.col("lang").alias("source_type"), F.lit("2024").alias("created_at"), F.lit(None).cast("string").alias("image")
    )
    got = merge.proof_documents(records)
    field = lambda path: F.get_json_object("body", path)
    return got.select("original_hash", field("$.name").alias("name"), field("$.target_asset_id").cast("long").alias("asset"), field("$.attributes[1].value").alias("signer"), field("$.attributes[3].trait_type").alias("fourth"), field("$.image").alias("image"))


def enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a title are asked for, some of them already queued as users' jobs."""
    requests = table(spark, d, "documents").where("n_chars % 7 <> 0").selectExpr("doc_id AS job_id")
    return jobs.enqueue(jobs.latest(views.jobs(spark, d)).select("job_id", "state", "progress"), requests).select("job_id", "state", "progress", "attempts", "backoff_ms")


def listing_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "part").where("p_size % 3 = 0").selectExpr("p_partkey AS media_id", "concat('media/', p_partkey, '/thumbnail.jpg') AS thumbnail")
    return catalog.with_thumbnails(views.listing(spark, d), objects).select("media_id", "title", "thumbnail")


def search_routes(spark: SparkSession, d: str) -> DataFrame:
    kind = S.choose(F.col("event_type"), {"view": "multipart/form-data; boundary=x", "click": "application/json", "error": "text/plain"})
    return table(spark, d, "events").select("event_id", S.search_route(kind).alias("route"))


def generator_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "CASE p_size % 4 WHEN 0 THEN concat(p_name, ' 8.1') WHEN 1 THEN '' END AS generator", "CASE WHEN p_size % 3 > 0 THEN p_brand END AS name", "CASE WHEN p_size % 5 > 0 THEN concat('v', p_size) ELSE '' END AS version")
    said = S.generator_text("generator", "name", "version")
    return rows.select("p_partkey", said.alias("generator"), S.generator_name(said).alias("clean"))


def ai_actions(spark: SparkSession, d: str) -> DataFrame:
    key = S.choose(F.col("event_type"), {"view": "trainedAlgorithmicMedia", "click": "compositeWithTrainedAlgorithmicMedia", "purchase": "digitalCapture"}, F.lit(""))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.concat(F.lit(S.SOURCE_TYPE_BASE), key)).alias("uri"), F.when(F.col("event_id") % 5 == 0, "Used Generative AI here").alias("said"))
    return rows.select("event_id", S.is_ai_action("uri", "said").alias("ai"), S.is_listed_ai_action("uri", "said").alias("listed"), S.is_composite("uri").alias("composite"))


def display_rules(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, titles, gateways, ids, times and previews of parts."""
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", "p_size * 100 AS width", "p_partkey % 3000 + 1 AS height", "CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS title", "concat(p_brand, '.tar.gz') AS file", "CASE WHEN p_size % 3 = 0 THEN 'https://devnet.x' ELSE 'https://y' END AS url",
        "concat('https://gw/', p_partkey, 'https://gw/') AS uri", "CASE WHEN p_size % 4 > 0 THEN p_partkey * 1500 END AS ms", "CASE WHEN p_size % 5 = 0 THEN 'given' END AS given", "sequence(1, p_size) AS bytes",
    )
    size = S.fitted("width", "height")
    return rows.select(
        "p_partkey", size["width"].alias("width"), size["height"].alias("height"), S.title_or_file("title", "file").alias("title"), S.gateway("url").alias("gateway"), S.without_prefix("uri", "https://gw/").alias("tx"), S.epoch_seconds("ms").alias("seconds"),
        S.created_at("given", S.epoch_seconds("ms")).alias("created_at"), S.binary_preview("bytes").alias("preview"), S.vector_text(F.slice("bytes", 1, 3)).alias("vector"), S.looks_like_json("title").alias("json"), S.progress_percent(F.col("p_partkey") % 100 / 7.0).alias("progress"),
    )


def page_buttons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_size AS pages", "CAST(p_partkey % p_size + 1 AS INT) AS page")
    return rows.select("p_partkey", F.array_join(S.page_window("page", "pages").cast("array<string>"), ",").alias("buttons"))


def validation_status(spark: SparkSession, d: str) -> DataFrame:
    """Codes from the size; every seventh part has none."""
    code = lambda c, e: F.struct(c.alias("code"), e.alias("explanation"))
    codes = F.array(
        code(F.lit("claim.ok"), F.lit("fine")),
        code(F.when(F.col("p_size") % 2 == 0, "failure.sig").otherwise("sig.ok"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.lit("bad sig"))),
        code(F.when(F.col("p_size") % 5 == 0, "failure.hash"), F.lit(None).cast("string")),
    )
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, codes).alias("codes"))
    labels = F.array(F.lit("c2pa.soft-binding"), F.lit("c2pa.actions"), F.concat(F.lit("c2pa.soft-binding__"), "p_partkey"))
    return rows.select("p_partkey", N.is_valid("codes").alias("valid"), F.array_join(N.errors("codes"), "|").alias("errors"), N.count_prefix(labels, "c2pa.soft-binding").alias("bindings"))


def ingredient_list(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, f: F.struct(t.alias("title"), f.alias("format"), F.lit("x").alias("relationship"))
    items = F.array(one(F.col("p_name"), F.lit("image/jpeg")), one(F.lit(""), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))))
    flat = N.empty_as_null(N.ingredients_flat(items), ["title", "format"])
    return table(spark, d, "part").select("p_partkey", flat.alias("flat")).selectExpr("p_partkey", "flat[0].title AS title_0", "flat[1].title AS title_1", "flat[0].format AS format_0", "flat[1].format AS format_1", "size(flat) AS n")


def first_action_type(spark: SparkSession, d: str) -> DataFrame:
    act = lambda t: F.struct(F.lit("c2pa.edited").alias("action"), t.alias("digitalSourceType"))
    held = lambda label, *types: F.struct(F.lit(label).alias("label"), F.array(*map(act, types)).alias("actions"))
    none = F.lit(None).cast("string")
    rows = table(spark, d, "part").select("p_partkey", F.array(held("c2pa.hash.data", F.lit("no")), held("c2pa.actions.v2", none, F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")), F.col("p_brand")), held("c2pa.actions", F.lit("later"))).alias("a"))
    return rows.select("p_partkey", N.first_action_type("a").alias("source_type"))


def assertion_labels(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("c2pa.chat_"), "role", F.when(F.col("turn") > 0, F.concat(F.lit("__"), "turn")).otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", S.assertion_label(key, DESCRIPTIONS).alias("label"))


def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Retry delays and what a polling client sees, for jobs whose age and attempt follow from their id."""
    rows = jobs.latest(views.jobs(spark, d))
    attempt, seconds = (F.col("job_id") % 4 + 1).cast("int"), (F.col("job_id") % 200).cast("int")
    return rows.select("job_id", jobs.retry_delays(attempt).alias("delay_ms"), jobs.poll_outcome(F.col("state"), F.col("job_id") % 3 == 0, seconds).alias("outcome"))


RECORD_QUERIES = {
    f.__name__: f
    for f in (
        insert_or_get, guarded_update, count_grants, new_purchases, purchase_status, manifest_visible, candidates_any_uploader, tagged_records, root_thumbnail, proof_documents, enqueue, listing_thumbnails,
        search_routes, generator_names, ai_actions, display_rules, page_buttons, validation_status, ingredient_list, first_action_type, assertion_labels, job_outcomes,
    )
}
