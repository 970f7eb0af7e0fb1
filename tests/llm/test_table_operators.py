"""Joins, search, mixing and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from veriloom.llm import jaccard_join, mixing, topk_search
from veriloom.llm.queries import QUERIES

SF = f"{DATA}/sf0.001"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()


def classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_brute_force(spark):
    """Families of near copies whose members link or just don't."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  Two"), (5, "one")]
    for family in range(8):
        base = rng.choices(vocabulary, k=rng.choice([12, 40, 90, 150, 300]))
        for _ in range(35):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    want = classes(docs)
    assert got == want and len({c for _, c in want.values()}) > 30


def test_join_of_odd_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (7, "a b c d", None), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hashes string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (7, 1), (8, 8)], key=str)
    assert jaccard_join.near_duplicates(df.where("false")).count() == 0
    assert sorted((r["doc_id"] for r in jaccard_join.keep_first(df).collect()), key=str) == [1, 8, None]


@pytest.mark.parametrize("spread", [3, 200])
def test_topk_brute_force(spark, spread, monkeypatch):
    """Small trees, many ties."""
    monkeypatch.setattr(topk_search, "TREE", 64)
    monkeypatch.setattr(topk_search, "PAGE", 8)
    monkeypatch.setattr(topk_search, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.integers(-spread, spread, (600, 6))
    x[300:340] = x[299]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist()), (None, [1] * 6), (999, None), (998, [1, 2])], "vec_id long, x array<long>")
    got = {}
    for r in topk_search.top_k(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 600, 20):
        s = x @ x[q]
        best = sorted((k for k in range(600) if k != q), key=lambda k: (-s[k], k))[:5]
        assert sorted(got[q]) == [(n + 1, k, s[k]) for n, k in enumerate(best)]
    assert topk_search.top_k(df.where("false"), df).count() == 0 and topk_search.top_k(df, df.where("false")).count() == 0
    assert topk_search.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_unusable_vectors(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(1.5f, -0.001f)), (2, array(CAST('NaN' AS FLOAT))), (3, array(CAST(NULL AS FLOAT))), (4, CAST(NULL AS ARRAY<FLOAT>)), (5, array(CAST('inf' AS FLOAT))) AS t(vec_id, embedding)")
    got = df.where(topk_search.usable(F.col("embedding"))).select("vec_id", topk_search.quantized(F.col("embedding")).alias("x")).collect()
    assert [(r["vec_id"], r["x"]) for r in got] == [(1, [384, -1])]


def targets(sizes):
    """Shares by weight with caps, reshared until none is above."""
    keys = sorted(sizes)
    weight = {k: (5, 2, 1)[n % 3] for n, k in enumerate(keys)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest, free = total - sum(capped.values()), [k for k in keys if k not in capped]
        new = {k: 3 * sizes[k] for k in free if weight[k] * rest / sum(weight[f] for f in free) > 3 * sizes[k]}
        if not new:
            return capped | {k: weight[k] * rest / sum(weight[f] for f in free) for k in free}
        capped |= new


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(900)] + [(2000, None, "a"), (2001, "one two", "tiny"), (None, "x y", "b"), (7, "w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash"))
    out = mixing.one_row_each(mixing.mix(df)).cache()
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        key = "1" if s is None else "0" + s
        sizes[key] = sizes.get(key, 0) + len((t or "").split())
    want = targets(sizes)
    for key in sizes:
        own = [r for r in got if r["key"] == key]
        assert all(abs(r["target"] - want[key]) < 1e-6 * want[key] + 1e-9 and r["source_size"] == sizes[key] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[key]) <= max(300, 0.01 * want[key])
    assert sorted(map(str, mixing.one_row_each(mixing.mix(df.repartition(7))).collect())) == sorted(map(str, got))
    assert mixing.mix(df.where("false")).count() == 0


def test_pipeline_stages(spark):
    import __spark_entry__ as e

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(pipeline.STAGES) - 1 or out.schema.names == docs.schema.names
        assert 0 < out.count() <= n and out.select("doc_id").distinct().count() == out.count()
        n, docs = out.count(), out
    whole = e.queries()["pipeline"](spark, SF)
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_all_operators_are_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
