"""Matchers, postings, manifests by path, single rows and SQL objects on literal rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veriloom.operators import catalog, manifests, merge, resolve
from veriloom.operators.keyed import KeyedTable
from veriloom.plans import sql_objects
from veriloom.plans.flow_oracles import FLOW_ORACLES
from veriloom.plans.flow_queries import FLOW_QUERIES
from veriloom.sources import store, views

from .oracle import DATA, rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_many_matchers_equal_plain_ones(spark, monkeypatch):
    """Literals of every length, regexes with and without a run that they need, nulls and equal places of names."""
    rng = random.Random(2)
    words = ["Google LLC", "Sony", "So", "S", "", "LLC", "Leica", "Nikon Corp", "o", "ü"]
    regexes = ["^S[a-z]+$", "Sonyx?", "Go+gle.*LLC", "Leica$", "(?i)nikon", "a|b", "Nik*on", "L.C", "^$", "x*"]
    specs = [(f"s{k}", k, rng.choice(words) + rng.choice(["", "", str(k % 7)]), rng.choice([False, None])) for k in range(60)] + [(f"r{k}", 100 + k, r, True) for k, r in enumerate(regexes)]
    rng.shuffle(specs)
    names = [None, "", "Sony", "Sonyx", "Pixel, Google LLC, US", "Nikon Corp 3", "NIKON", "Nion", "S3", "ü", "zzz", "Leica", "Leica 5", "b"] * 2
    table = spark.createDataFrame(specs, "spec_id string, place int, matcher string, is_regex boolean")
    rows = spark.createDataFrame(list(enumerate(names)), "k int, issuer string")
    want = [(k, min(((p, s) for s, p, m, r in specs if (re.search(m, n) if r else m in n)), default=(0, None))[1] if n is not None else None) for k, n in enumerate(names)]
    for few in (1000, 5):
        monkeypatch.setattr(manifests, "FEW_SPECS", few)
        assert [tuple(r) for r in manifests.match_spec(rows, table).select("k", "spec_id").orderBy("k").collect()] == want


def test_matchers_by_the_hundred_thousand(spark):
    specs = spark.range(100_000).selectExpr("concat('s', id) AS spec_id", "id AS place", "CASE WHEN id % 10 = 0 THEN concat('^maker ', id, '( |$)?.*') ELSE concat('maker ', id, ' inc') END AS matcher", "id % 10 = 0 AS is_regex")
    specs = specs.withColumn("matcher", F.regexp_replace("matcher", r"\( \|\$\)\?", " "))
    rows = spark.range(0, 100_000, 997).selectExpr("id", "concat('by maker ', id, ' inc') AS issuer")
    got = manifests.match_spec(rows, specs)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert got.where("spec_id = concat('s', id)").count() == rows.where("id % 10 <> 0").count()


def test_equal_matchers_are_keyed_once(spark):
    """Copies of a matcher count as its first spec; runs are taken of distinct matchers, and no task sorts the runs to find the rarest."""
    specs = spark.range(30_000).selectExpr("concat('s', id) AS spec_id", "(id * 7919) % 30000 AS place", "IF(id % 10 = 0, concat('^by maker ', id % 30, '.*ltd$'), concat('maker ', id % 300, ' inc')) AS matcher", "IF(id % 10 = 0, true, IF(id % 2 = 0, false, null)) AS is_regex")
    rows = spark.range(400).selectExpr("id", "concat('by maker ', id, IF(id % 2 = 0, ' inc', ' ltd')) AS issuer")
    got = manifests.match_spec(rows, specs)
    first = {}
    for r in sorted(specs.collect(), key=lambda r: r["place"]):
        first.setdefault((r["matcher"], bool(r["is_regex"])), (r["place"], r["spec_id"]))
    want = {r["id"]: min((p for (m, regex), p in first.items() if (re.search(m, r["issuer"]) if regex else m in r["issuer"])), default=(0, None))[1] for r in rows.collect()}
    assert {r["id"]: r["spec_id"] for r in got.collect()} == want and None in want.values() and len(set(want.values())) > 100
    lines = plan(got).split("== Initial Plan ==")[-1].splitlines()
    at = [k for k, line in enumerate(lines) if "explode(" in line and "matcher" in line]
    assert at and all(any("Aggregate" in below and "min_by(spec_id" in below for below in lines[k + 1 : k + 9]) for k in at)
    rarest = [line for line in lines if "min_by(gram" in line]
    assert rarest and all("HashAggregate" in line for line in rarest)


def test_postings(spark, tmp_path):
    tag = "array<struct<name:string,value:string>>"
    rows = [(f"t{k:03}", k // 2, [("App", "x"), ("App", "x"), ("Hash", str(k % 3)), (None, None)][: 2 + k % 3]) for k in range(60)] + [("none", 0, None), ("empty", 0, [])]
    index = spark.createDataFrame(rows, f"tx_id string, timestamp long, tags {tag}")
    postings = resolve.tag_postings(index)
    first = resolve.first_tagged(postings, 5)
    assert [r["tx_id"] for r in first.where("name = 'App'").orderBy("place").collect()] == [f"t{k:03}" for k in range(5)] and first.where("name IS NULL").count() == 5
    assert "WindowGroupLimit" in plan(first)
    resolve.write_postings(postings, str(tmp_path / "p"), buckets=8)
    got = resolve.look_up(spark, str(tmp_path / "p"), "Hash", "1", 4, buckets=8)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in resolve.tagged(index, "Hash", "1", 4).select("timestamp", "tx_id").collect()]
    assert resolve.look_up(spark, str(tmp_path / "p"), "Hash", "9", buckets=8).count() == 0
    assert "PartitionFilters: [isnotnull(bucket" in plan(got)


def test_manifests_by_path(spark, tmp_path):
    """Missing, broken, wrong and doubled files, and folders that aren't manifests."""
    texts = {"a/manifest.json": '{"title": "A",\n "n": 1}', "b/manifest.json": '{"title": "B"', "c/manifest.json": "", "d/manifest.json": '[{"title": "D"}]', "e/manifest.json": '{"title": ["E"], "n": 1}', "f/other.json": "{}", "g/manifest.json": '{"other": 1}', "h i/manifest.json": ' {"title": "H"}'}
    for name, text in texts.items():
        (tmp_path / "media" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "media" / name).write_text(text)
    files = views.manifest_files(spark, str(tmp_path), "title STRING, n INT")
    records = spark.createDataFrame([(h,) for h in [*"abcdefg", "h i", "missing", None]], "original_hash string")
    got = {r["original_hash"]: (r["manifest"] and tuple(r["manifest"]), r["broken"]) for r in views.with_manifests(records, files).collect()}
    assert got["a"] == (("A", 1), False) and got["g"] == ((None, None), False) and got["h i"] == (("H", None), False)
    assert got["b"] == got["d"] == (None, True) and got["c"] == got["f"] == got["missing"] == got[None] == (None, None)
    assert got["e"] == (('["E"]', 1), False)


def test_documents_are_written_once(spark, tmp_path):
    docs = spark.createDataFrame([("h1", "one"), ("h2", "two")], "original_hash string, body string")
    for _ in range(2):
        merge.write_json(docs, str(tmp_path / "d"))
    merge.write_json(docs.where("original_hash = 'h2'").withColumn("body", F.lit("new")), str(tmp_path / "d"))
    files = views.manifest_files(spark, str(tmp_path / "d"), "body STRING", r"/original_hash=([^/]+)/")
    assert sorted((r["original_hash"], r["manifest"]["body"]) for r in files.collect()) == [("h1", "one"), ("h2", "new")]


def test_document_store_has_as_many_files_as_buckets(spark, tmp_path, monkeypatch):
    """Hundreds of documents, some records without one and some with equal texts, and a table without records."""
    monkeypatch.setattr(store, "new_path", lambda spark, label: f"{tmp_path}/{label}")
    docs = spark.range(0, 6000, 10).selectExpr("id AS doc_id", "concat('text ', id % 5000) AS text")
    docs.write.parquet(str(tmp_path / "in/documents.parquet"))
    got = FLOW_QUERIES["document_store"](spark, str(tmp_path / "in")).toPandas()
    files = [f for f in (tmp_path / "documents").rglob("part-*") if f.suffix in (".json", ".parquet")]
    assert 0 < len(files) <= 64
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/in/documents.parquet/*.parquet'")
    want = con.sql(FLOW_ORACLES["document_store"]).df()
    assert len(got) == 500 and got["name"].notna().sum() == 333 and rows(got) == rows(want)
    monkeypatch.setattr(store, "new_path", lambda spark, label: f"{tmp_path}/none/{label}")
    docs.where("doc_id < 0").write.parquet(str(tmp_path / "no/documents.parquet"))
    assert FLOW_QUERIES["document_store"](spark, str(tmp_path / "no")).count() == 0


def test_documents_in_buckets(spark, tmp_path):
    """A document written again is there once, others stay, and broken ones hurt no other."""
    kind = "original_hash string, body string"
    held = KeyedTable.create(spark.createDataFrame([("h1", '{"name": "one"}'), ("h2", '{"name": "two"}'), ("h3", '{"name"'), ("h4", '[{"name": "four"}]')], kind), str(tmp_path / "d"), "original_hash", buckets=2)
    for _ in range(2):
        held.upsert(spark.createDataFrame([("h2", '{"name": "new"}'), ("h5", "{}")], kind), ["body"], F.current_timestamp())
    got = views.manifest_texts(held.read().select("original_hash", F.col("body").alias("value")), "name STRING")
    want = [("h1", ("one",), False), ("h2", ("new",), False), ("h3", None, True), ("h4", None, True), ("h5", (None,), False)]
    assert sorted((r["original_hash"], r["manifest"] and tuple(r["manifest"]), r["broken"]) for r in got.collect()) == want


def test_one_row_as_a_plan(spark):
    assert catalog.one_row(spark.range(1)).head()["id"] == 0 and catalog.one_row(spark.range(0), optional=True).count() == 0
    for df, optional in ((spark.range(0), False), (spark.range(2), False), (spark.range(2), True)):
        with pytest.raises(Exception, match="one row expected"):
            catalog.one_row(df, optional).collect()


def test_page_requests(spark):
    said = [(None, None, True), ("1", "100", True), ("", "", True), ("0", "1", False), ("1", "101", False), ("abc", "1", False), ("2x", "10.0", True), ("-1", "5", False), ("1", "0", False), ("9" * 18, "1", True)]
    df = spark.createDataFrame(said, "page string, n string, want boolean")
    assert [r[0] for r in df.select(catalog.page_request(F.col("page"), F.col("n"))).collect()] == [w for *_, w in said]


def test_sql_objects(spark):
    sf = f"{DATA}/sf0.001"
    sql_objects.define(spark, sf)
    assert spark.sql("SELECT * FROM purchases").count() == 0  # no wallet, no rows
    spark.sql("SET VAR claim_wallet = '10'")
    assert spark.sql("SELECT * FROM purchases").count() == views.purchases(spark, sf).where("buyer = 10").count() > 0
    vector = spark.sql("SELECT embedding FROM feature_vectors WHERE media_id = 0").head()[0]
    found = spark.sql(f"SELECT * FROM search_similar(array({', '.join(f'{x!r}D' for x in vector)}), k => 3)")
    assert [r["media_id"] for r in found.collect()] == [r["media_id"] for r in spark.sql("SELECT f.media_id FROM (SELECT CAST(embedding AS ARRAY<DOUBLE>) AS q FROM feature_vectors WHERE media_id = 0), LATERAL search_similar(q, 3) f").collect()]
    assert "TakeOrderedAndProject(limit=3" in plan(found)


def test_shared_folder(spark):
    assert store.shared_folder(spark) and store.new_path(spark, "x") != store.new_path(spark, "x")
