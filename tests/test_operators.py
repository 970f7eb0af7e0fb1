import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriloom.operators import catalog, jobs, manifests, merge, resolve, rules, vector
from veriloom.sources import views
from veriloom.streaming import jobs as stream

from .oracle import DATA


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_search_prefix_and_hidden(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0])], "media_id long, embedding array<float>")
    m = spark.createDataFrame([(1, True), (2, True), (3, None), (4, True), (5, True)], "media_id long, is_public boolean").selectExpr("*", *[f"'' AS {c}" for c in vector.LISTED])
    two = [tuple(r)[:2] for r in vector.search_similar(v, m, [1.0, 0.0], 2).collect()]
    three = [tuple(r)[:2] for r in vector.search_similar(v, m, [1.0, 0.0], 3).collect()]
    assert three == [(1, 1.0), (2, 1.0), (1, 0.0)] and two == three[:2]


def test_pages_concatenate(spark):
    rows = views.listing(spark, f"{DATA}/sf0.001")
    order = [F.col("price_lamports").desc(), F.col("media_id")]
    pages = [r["media_id"] for p in range(1, 12) for r in catalog.page_of(rows, order, p, 20).collect()]
    assert pages == [r["media_id"] for r in rows.orderBy(*order).collect()]
    for page, limit in ((0, 20), (1, 101), ("abc", 20)):
        with pytest.raises(ValueError):
            catalog.page_of(rows, order, page, limit)
    empty = catalog.envelope(rows.where("false"), order).head()
    assert (empty["items"], empty["total"], empty["total_pages"]) == ([], 0, 0)


def test_exactly_one(spark):
    assert catalog.exactly_one(spark.range(1))["id"] == 0
    assert catalog.exactly_one(spark.range(0), optional=True) is None
    for n in (0, 2):
        with pytest.raises(ValueError):
            catalog.exactly_one(spark.range(n))


def resolved(spark, assets, documented=False, records=None):
    found = spark.createDataFrame([("h", "old", 1, "u", 1), ("h", "new", 2, "u", 2)], "original_hash string, tx_id string, target_asset_id long, uploader string, age long")
    a = spark.createDataFrame(assets, "asset_id long, json_uri string, burnt boolean, owner string")
    r = spark.createDataFrame(records or [("h", 1, 1)], "original_hash string, asset_id long, age long")
    return resolve.resolve(found, a, r, documented)


def test_oldest_that_exists_stands_before_its_link(spark):
    both = [(1, "https://gw/none", False, "w"), (2, "https://gw/newer", False, "w")]
    assert got(resolved(spark, both), "tx_id", "cross_link", "is_valid") == [("old", False, False)]
    assert got(resolved(spark, both, documented=True), "tx_id", "is_valid") == [("new", True)]


def test_substring_link_burnt_and_duplicates(spark):
    one = [(1, "https://gw/olden", True, "w")]
    assert got(resolved(spark, one), "cross_link", "owner", "last_owner", "is_valid") == [(True, "", "w", True)]
    twice = resolved(spark, one, records=[("h", 1, 1), ("h", 9, 2)])
    assert got(twice, "copies", "is_oldest", "is_valid") == [(2, True, False)]
    assert resolve.steps(twice).head()["steps"][-1]["status"] == "success"


def test_tagged(spark):
    df = spark.sql("SELECT 'b' AS tx_id, 2L AS timestamp, array(named_struct('name', 'h', 'value', 'x')) AS tags UNION ALL SELECT 'a', 1L, array(named_struct('name', 'h', 'value', 'y'))")
    assert got(resolve.tagged(df, "h", "x"), "tx_id") == [("b",)]


def test_walk_guard(spark):
    rows = [(c * 100 + k, c * 100 + k + 1 if k < c else None) for c in (0, 1, 10, 11, 12) for k in range(c + 1)]
    edges = spark.createDataFrame(rows, "node long, parent long")
    starts = spark.createDataFrame([(c * 100,) for c in (0, 1, 10, 11, 12)], "start long")
    assert got(manifests.root_walk(edges, starts), "start", "root", "depth") == [(0, 0, 0), (100, 101, 1), (1000, 1010, 10), (1100, 1111, 11), (1200, 1211, 11)]


def test_walk_plans(spark):
    """Both walks: every length of way, two parents, a cycle, and any number of hops; strides take fewer joins."""
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 20), (200, 30)]
    edges = spark.createDataFrame(chain, "node long, parent long")
    starts = spark.createDataFrame([(k,) for k in (*range(41), 100, 200, 300)], "start long")
    up = {}
    for a, b in chain:
        up.setdefault(a, []).append(b)

    def plain(node, left):
        return [(root, depth + 1) for p in up[node] for root, depth in plain(p, left - 1)] if left and node in up else [(node, 0)]

    for most in (0, 1, 3, 4, 5, 8, 11):
        for doubling in (False, True) if most in (3, 11) else (True,):
            assert got(manifests.root_walk(edges, starts, most, doubling), "start", "root", "depth") == sorted((r[0], *x) for r in starts.collect() for x in plain(r[0], most))
    own = spark.createDataFrame([(k, f"t{k}" if k % 7 == 0 else "") for k in range(0, 45)], "node long, thumbnail string")
    held = edges.where("node < 100").selectExpr("*", "CASE WHEN node % 5 = 0 THEN concat('i', node) END AS ingredient_thumbnail")
    shown = {k: f"i{k}" if k % 5 == 0 and k < 40 else f"t{k}" if k % 7 == 0 else None for k in range(45)}
    want = [(s, next((shown[k] for k in range(min(s + 10, 40) if s <= 40 else s, s - 1, -1) if shown.get(k)), "none")) for s in range(41)]
    for doubling in (False, True):
        assert got(manifests.root_thumbnail(held, starts.where("start < 50"), own, doubling=doubling).fillna("none"), "start", "thumbnail") == want
    walk = manifests.root_walk(edges, starts, doubling=True)
    walk.collect()
    stages = walk._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum(stages.count(f"{kind}Join ") for kind in ("SortMerge", "BroadcastHash", "ShuffledHash")) < manifests.GUARD


def test_thumbnail_unwinds(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (2, None, None), (3, 4, None), (4, None, None)], "node long, parent long, ingredient_thumbnail string")
    own = spark.createDataFrame([(1, "y"), (2, ""), (3, "three"), (4, "root")], "node long, thumbnail string")
    starts = spark.createDataFrame([(1,), (3,)], "start long")
    assert got(manifests.root_thumbnail(edges, starts, own), "start", "thumbnail") == [(1, "x"), (3, "root")]


MEDIA = "media_id long, owner_wallet string, price_lamports long"


def test_purchase_reasons(spark):
    media = spark.createDataFrame([(1, "s", 100), (2, "s", 0), (3, "s", None), (4, "B", 100)], MEDIA)
    chain = [
        ("ok", False, ["b", "s"], [200, 0], [100, 100]), ("bad", True, ["b", "s"], [0, 0], [0, 0]), ("other", False, ["s", "b"], [0, 0], [0, 0]), ("alone", False, ["b"], [0], [0]),
        ("short", False, ["b", "s"], [0, 0], [0, 99]), ("last", False, ["b", "s", "s"], [0, 0, 0], [0, 0, 100]), ("fee", False, ["b", "B"], [10_000_001, 0], [0, 0]), ("fee2", False, ["b", "B"], [10_000_000, 0], [0, 0]), ("used", False, ["b", "s"], [0, 0], [0, 100]),
    ]
    tx = spark.createDataFrame(chain, "signature string, err boolean, keys array<string>, pre array<long>, post array<long>")
    want = {
        (1, "ok"): "ok", (1, "bad"): "tx_failed", (1, "other"): "wrong_signer", (1, "alone"): "account_missing", (1, "short"): "short_payment", (1, "last"): "ok", (1, "none"): "tx_not_found", (1, "free_x"): "paid_with_free_signature",
        (2, "ok"): "free_needs_free_signature", (2, "free_x"): "ok", (3, "whatever"): "ok", (3, "free_x"): "paid_with_free_signature", (4, "fee"): "fee_too_high", (4, "fee2"): "ok", (1, "used"): "already_recorded", (9, "ok"): "media_not_found", (1, ""): "missing_fields", (None, "ok"): "missing_fields",
    }
    asked = spark.createDataFrame([(k, m, "b", s) for k, (m, s) in enumerate(want)], "request_id long, media_id long, buyer string, signature string")
    out = rules.validate_purchases(asked, media, tx, spark.createDataFrame([("used",), ("used",)], "signature string"))
    assert {(r["media_id"], r["signature"]): r["reason"] for r in out.collect()} == want


def test_upload_reasons(spark):
    kind = "has_store boolean, signature_valid boolean, has_manifest boolean, is_ai boolean, root_trusted boolean, content_hash string, is_duplicate boolean"
    good = [True, None, True, False, True, "h", False]
    rows = [good] + [[*good[:k], bad, *good[k + 1 :]] for k, bad in enumerate([False, False, False, True, False, "", True])]
    out = rules.upload_gate(spark.createDataFrame(rows, kind))
    assert [r["reason"] for r in out.collect()] == ["ok", "no_store", "invalid_signature", "no_manifest", "ai_generated", "untrusted_issuer", "no_hash", "duplicate"]


def test_download_boundaries(spark):
    now = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", now, 9), ("b", now, 10), ("c", now - dt.timedelta(seconds=1), 0)], "token string, expires_at timestamp, download_count int")
    assert got(rules.download_grants(df, now=F.lit(now)), "token", "reason", "download_count") == [("a", "granted", 10), ("b", "limit", 10), ("c", "expired", 0)]


def test_download_requests_of_a_hot_token(spark):
    """The tenth download stops the rest; a count at the limit, an unknown token, an expiry between requests, ties and null times."""
    now = dt.datetime(2024, 1, 1)
    tokens = spark.createDataFrame([("hot", None, 3), ("full", None, 12), ("soon", now + dt.timedelta(seconds=5), None), ("idle", None, 1)], "token string, expires_at timestamp, download_count int")
    asked = [(k, "hot", now + dt.timedelta(seconds=k // 4)) for k in range(500)] + [(1000 + k, "soon", now + dt.timedelta(seconds=k)) for k in range(9)] + [(2000, "full", now), (2001, "none", now), (2002, None, now), (2003, "hot", None)]
    judged, after = rules.download_requests(spark.createDataFrame(asked, "request_id long, token string, at timestamp").repartition(5), tokens)
    rows = {r["request_id"]: (r["reason"], r["download_count"]) for r in judged.collect()}
    assert len(rows) == len(asked) and rows[2003] == ("granted", 4) and [rows[k] for k in range(6)] == [("granted", 5 + k) for k in range(6)] and {rows[k] for k in range(6, 500)} == {("limit", 10)}
    assert [rows[1000 + k] for k in range(9)] == [("granted", k + 1) for k in range(6)] + [("expired", 6)] * 3
    assert rows[2000] == ("limit", 12) and rows[2001] == rows[2002] == ("not_found", None)
    assert got(after, "token", "download_count") == [("full", 12), ("hot", 10), ("idle", 1), ("soon", 6)]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_upsert_is_idempotent_and_keeps_optional(spark):
    t = spark.createDataFrame([("a", "old", 1, 1, 1), ("b", "b", 1, 1, 1)], "k string, title string, price long, created_at long, updated_at long")
    s = spark.createDataFrame([("a", None, 2, 1), ("a", None, 3, 2), ("c", "new", 4, 1)], "k string, title string, price long, n long")
    once = merge.upsert(t, s, "k", ["title"], F.lit(9).cast("long"), ["n"])
    assert got(once, *t.columns) == [("a", "old", 3, 1, 9), ("b", "b", 1, 1, 1), ("c", "new", 4, 9, 9)]
    assert got(merge.upsert(once, s, "k", ["title"], F.lit(9).cast("long"), ["n"]), *t.columns) == got(once, *t.columns)


def test_insert_update_and_counters(spark):
    t = spark.createDataFrame([("a", 1)], "k string, id long")
    s = spark.createDataFrame([("a", 7), ("b", 9), ("b", 8)], "k string, id long")
    fresh, ids = merge.insert_or_get(t, s, "k", ["id"])
    assert got(fresh, "k", "id") == [("b", 8)] and got(ids, "k", "id") == [("a", 1), ("b", 8)]
    m = spark.createDataFrame([(1, "w", True, "t"), (2, "v", True, "t"), (3, None, True, "t")], "media_id long, owner_wallet string, is_public boolean, title string")
    c = spark.createDataFrame([(1, "w", False), (2, "w", False)], "media_id long, owner_wallet string, new boolean")
    assert got(merge.guarded_update(m, c, "is_public"), "media_id", "is_public") == [(1, False), (2, True), (3, True)]
    p = spark.createDataFrame([(1, None, True), (2, "x", False)], "media_id long, title string, has_title boolean")
    assert got(merge.partial_update(m, p, ["title"]).fillna("null"), "media_id", "title") == [(1, "null"), (2, "t"), (3, "t")]
    owners = spark.createDataFrame([(3, "z"), (1, "w")], "media_id long, chain_owner string")
    assert got(merge.sync_owner(m, owners), "media_id", "owner_wallet", "stale") == [(1, "w", False), (2, "v", False), (3, "z", True)]
    tk = spark.createDataFrame([("a", 1), ("b", 1)], "token string, download_count int")
    assert got(merge.count_grants(tk, tk.where("token = 'a'").union(tk.where("token = 'a'"))), "token", "download_count") == [("a", 3), ("b", 1)]


def test_proof_documents_and_json(spark, tmp_path):
    r = spark.sql("SELECT 'abcdefghij' AS original_hash, 'x' AS target_asset_id, 's' AS root_signer, 'g' AS claim_generator, 't' AS source_type, 'now' AS created_at, CAST(NULL AS STRING) AS image")
    body = merge.proof_documents(r).head()["body"]
    assert body.startswith('{"name":"Proof #abcdefgh","target_asset_id":"x","attributes":[{"trait_type":"original_hash","value":"abcdefghij"}')
    merge.write_json(merge.proof_documents(r), str(tmp_path / "out"))
    assert views.manifests(spark, str(tmp_path / "out"), "body string, original_hash string").count() == 1


def test_retention_retry_and_polling(spark):
    now = dt.datetime(2024, 1, 2)
    j = spark.createDataFrame([(1, now, "completed"), (2, now, "completed"), (3, now - dt.timedelta(days=2), "completed"), (4, now - dt.timedelta(days=2), "waiting")], "job_id long, ts timestamp, state string")
    assert got(jobs.retained(j, F.lit(now), {"completed": (3600, 1)}), "job_id", "kept") == [(1, False), (2, True), (3, False), (4, True)]
    d = spark.range(1, 4).select(jobs.retry_delays(F.col("id")))
    assert [r[0] for r in d.collect()] == [2000, 4000, None]
    o = spark.createDataFrame([("completed", True, 1), ("completed", False, 1), ("active", None, 119), ("active", None, 120)], "s string, ok boolean, t int")
    assert [r[0] for r in o.select(jobs.poll_outcome(F.col("s"), F.col("ok"), F.col("t"))).collect()] == ["success", "failure", "pending", "timeout"]


def test_leaf_places_over_days(spark):
    """A busy tree over several days, times that tie, null times first, and a null tree."""
    day = dt.datetime(2024, 1, 1)
    rows = [(t if t < 2 else None, None if k % 11 == 0 else day + dt.timedelta(hours=k * 7 % 90 // 3), 100 * t + k) for t, n in ((0, 60), (1, 2), (2, 9)) for k in range(n)]
    jobs_in = spark.createDataFrame(rows, "tree long, ts timestamp, event_id long")
    want = []
    for tree, first in ((0, 500), (1, 0), (None, 0)):
        ordered = sorted((r for r in rows if r[0] == tree), key=lambda r: (r[1] is not None, r[1] or day, r[2]))
        want += [(r[2], first + k) for k, r in enumerate(ordered)]
    minted = spark.createDataFrame([(0, 500)], "tree long, num_minted long")
    assert got(jobs.leaf_indexes(jobs_in, minted), "event_id", "leaf_index") == sorted(want)


def test_places_in_hot_groups(spark, monkeypatch):
    """Groups that hold most rows, times that tie, null orders and groups, numbers and texts, and cuts that are few."""
    from pyspark.sql import Window

    from veriloom.operators import places

    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('g', id % 40) WHEN id % 7 > 0 THEN 'ties' END AS g", "CASE WHEN id % 3 = 2 THEN id DIV 2000 WHEN id % 50 > 0 THEN id * 37 % 1000 END AS o",
        "CASE WHEN id % 90 > 0 THEN concat('k', id * 7 % 3001) END AS e", "CAST(id * 7 % 3001 AS DOUBLE) - 1000.5 AS x", "'kept' AS range", "7 AS n", "8 AS own",
    )
    for cuts, order in ((256, ("o", "x")), (8, ("o", "x")), (8, ("x", "o")), (16, ("e", "x"))):
        monkeypatch.setattr(places, "CUTS", cuts)
        got_ = places.with_places(df.repartition(3), "g", order)
        assert got_.columns == [*df.columns, "place"]
        wrong = got_.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).where("place <> want")
        assert got_.count() == 3000 and wrong.count() == 0 and got_.where("range = 'kept' AND n = 7 AND own = 8").count() == 3000
    assert places.with_places(df.where("false"), "g", ("o", "e")).count() == 0


def test_mixed_assertions(spark):
    rows = [(1, "a", 0, '[1, {"x": 2}]'), (1, "a", 1, "b"), (1, "a", 2, "[3]"), (1, "b", 0, "[4, 5]"), (1, "c", 0, "x"), (1, "c", 1, "[6]"), (2, "a", 0, None), (2, "a", 1, "[7"), (2, "d", 0, "[broken"), (2, "d", 1, "y")]
    df = spark.createDataFrame(rows, "manifest_id int, label string, pos int, data string")
    out = {(r[0], r[1]): (r[2], r[3]) for r in manifests.group_assertions(df, mixed=True).collect()}
    assert out == {(1, "a"): (["1", '{"x":2}', "b", "[3]"], True), (1, "b"): (["[4, 5]"], False), (1, "c"): (["x", "[6]"], True), (2, "a"): ([None, "[7"], True), (2, "d"): (["[broken", "y"], True)}


def test_walk_kinds_and_nulls(spark):
    """Parents and starts of another number type than nodes, a null start, and many starts that have arrived."""
    edges = spark.createDataFrame([(1, 2), (2, None)], "node long, parent int")
    starts = spark.createDataFrame([(1,), (2,), (None,)] + [(k,) for k in range(10, 40)], "start int")
    rows = manifests.root_walk(edges, starts).collect()
    assert {(r["start"], r["root"], r["depth"]) for r in rows} == {(1, 2, 1), (2, 2, 0), (None, None, 0)} | {(k, k, 0) for k in range(10, 40)} and len(rows) == 33
    own = spark.createDataFrame([(2, "two"), (11, "eleven")], "node int, thumbnail string")
    shown = manifests.root_thumbnail(edges.withColumn("ingredient_thumbnail", F.lit("")), starts, own).where("thumbnail is not null")
    assert got(shown, "start", "thumbnail") == [(1, "two"), (2, "two"), (11, "eleven")]


def test_stream_equals_batch(spark, tmp_path):
    events = views.jobs(spark, f"{DATA}/sf0.001")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "job_id long, ts timestamp_ntz, event_id long, state string, progress int"
    stream.follow_states(stream.read_events(spark, str(tmp_path / "in"), schema), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination(120)
    newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "table").iterdir())
    want = got(jobs.latest(events), "job_id", "state", "event_id")
    assert got(spark.read.parquet(str(tmp_path / f"table/batch={newest}")), "job_id", "state", "event_id") == want
    q = stream.latest_states(stream.read_events(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got(spark.table("states").select("job_id", "last.*"), "job_id", "state", "event_id") == want
