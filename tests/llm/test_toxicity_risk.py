"""The risk and its slopes against sums in Python, and scoring on executors that don't have the package."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from veriloom.llm.toxicity import Risk, train


def plain(rows, positive, prior, params):
    s = [1 / (1 + np.exp(-(sum(params[k] for k in r) + params[-1]))) for r in rows]
    p, u = [x for x, y in zip(s, positive, strict=True) if y], [x for x, y in zip(s, positive, strict=True) if not y]
    return prior * sum(1 - x for x in p) / len(p), sum(u) / len(u) - prior * sum(p) / len(p)


@pytest.mark.parametrize("seed", range(3))
def test_risk_and_slopes(seed):
    rng = random.Random(seed)
    rows = [np.array(sorted(rng.sample(range(6), rng.randint(0, 5))), np.int64) for _ in range(30)]
    positive = np.array([k % 4 == 0 for k in range(30)])
    params = np.array([rng.uniform(-2, 2) for _ in range(7)])
    risk = Risk(rows, positive, 6, 0.2)
    up, down, up_slope, down_slope = risk.at(params)
    assert np.allclose((up, down), plain(rows, positive, 0.2, params))
    for k in range(7):
        near = params + 1e-6 * (np.arange(7) == k)
        assert np.allclose((np.array(plain(rows, positive, 0.2, near)) - (up, down)) / 1e-6, (up_slope[k], down_slope[k]), atol=1e-5)


def test_a_telling_feature_is_enough():
    """One feature that positives alone have, one that all have, and none."""
    rows = [np.array([0, 1]) if k % 10 == 0 else np.array([1] * (k % 2)) for k in range(400)] + [np.array([0])] * 40
    positive = np.array([False] * 400 + [True] * 40)
    w, b = train(rows, positive, 2, 0.1)
    assert w[0] + b > 0 and w[0] + w[1] + b > 0 and b < 0 and w[1] + b < 0
    assert train(rows, np.ones(440, bool), 2, 0.1)[1] == -30 and train([], np.zeros(0, bool), 2, 0.1)[1] == -30


def test_executors_without_the_package(tmp_path):
    """Functions travel by value: workers run from a folder, and a path, without the package."""
    code = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.executorEnv.PYTHONPATH", "/nowhere").getOrCreate()
from veriloom.llm import quality_rules, toxicity
docs = s.createDataFrame([(k, "bad words" if k % 5 == 0 else "good words " + str(k)) for k in range(60)], "doc_id long, text string")
labels = s.createDataFrame([(k, int(k % 5 == 0)) for k in range(40)], "doc_id long, toxic int")
model = toxicity.learn(docs, labels)
got = toxicity.score(docs, model).collect()
assert {{r["doc_id"] for r in got if r["predicted"]}} == {{k for k in range(60) if k % 5 == 0}}, got
assert quality_rules.measure_repetition(docs).count() == 60
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "fine" in out.stdout, out.stderr[-2000:]
