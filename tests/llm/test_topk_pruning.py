"""On tight clusters most trees are skipped before the shuffle and most products within trees, with equal results."""

import numpy as np

from veriloom.llm import topk_search


def test_clusters(spark, monkeypatch):
    for name, value in (("TREE", 128), ("PAGE", 16), ("PIVOTS", 400), ("SAMPLE", 1200), ("BLOCK", 40)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(8)
    centers = rng.integers(-300, 300, (20, 8))
    x = np.concatenate([c + rng.integers(-4, 5, (150, 8)) for c in centers])
    x = x[rng.permutation(len(x))]
    seen = []
    old = topk_search.tree_pairs

    def counted(queries, trees):
        seen.append((old(queries, trees).count(), queries.count() * trees.count()))
        return old(queries, trees)

    monkeypatch.setattr(topk_search, "tree_pairs", counted)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, x array<long>")
    got = {}
    for r in topk_search.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, len(x), 50):
        s = x @ x[q]
        best = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-s[k], k))[:5]
        assert sorted(got[q]) == [(n + 1, k, s[k]) for n, k in enumerate(best)]
    assert seen[0][0] < 0.3 * seen[0][1]
