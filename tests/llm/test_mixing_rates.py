"""Rates against a dual that is solved here by bisection, and copies in documents with clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veriloom.llm import mixing
from veriloom.llm.common import scratch


def words(sizes, lam, mean):
    return sum(s * n * min(3.0, math.exp(min(50, lam * (max(s, 1) / mean) ** mixing.TILT))) for s, n in sizes.items())


def test_rates(spark):
    rng = random.Random(3)
    sizes = {f"0s{k}": {rng.randint(0, 3000): rng.randint(1, 400) for _ in range(60)} for k in range(5)} | {"1": {7: 1}}
    total = {k: sum(s * n for s, n in own.items()) for k, own in sizes.items()}
    share = {"0s0": 2.9999, "0s1": 0.01, "0s2": 1.0, "0s3": 3.0, "0s4": 1.7, "1": 0.5}
    histogram = spark.createDataFrame([(k, s, n) for k, own in sizes.items() for s, n in own.items()], "key string, size long, n long")
    targets = spark.createDataFrame([(k, total[k], share[k] * total[k]) for k in sizes], "key string, source_size long, target double")
    with scratch(spark) as table:
        got = {(r["key"], r["size"]): r["rate"] for r in mixing.tilted_rates(histogram, targets, 3, table).collect()}
    for key, own in sizes.items():
        mean = total[key] / sum(n for s, n in own.items() if s)
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(own, mid, mean) < share[key] * total[key] else (low, mid)
        for s in own:
            want = 3.0 if share[key] == 3.0 else min(3.0, math.exp(min(50, low * (max(s, 1) / mean) ** mixing.TILT)))
            assert got[key, s] == pytest.approx(want, rel=1e-3)
        assert sum(s * n * got[key, s] for s, n in own.items()) == pytest.approx(share[key] * total[key], rel=1e-6)


def test_with_copies_of_odd_rows(spark):
    rows = [(1, "a b c", "x", "k"), (1, "a b c", "x", "k"), (None, "d e", None, "k"), (2, None, "x", None), (3, "", "y", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string").withColumn("copies", F.lit("k")).withColumn("mix_key", F.lit("k")).withColumn("own_size", F.lit(1))
    got = mixing.with_copies(df).collect()
    assert [r["copies"] for r in got if r["doc_id"] == 1] == [1, 1] and all(0 < r["copies"] <= 3 and r["mix_key"] == "k" for r in got)
    assert mixing.with_copies(df.where("false")).count() == 0
