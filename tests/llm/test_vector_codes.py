"""Vector codes against whole numbers in Python, on odd rows, hot values, large components and few vectors."""

import hashlib
import math
import random

import pytest

from veriloom.llm import vector_codes

KIND = "vec_id long, embedding array<double>, label int, code string"


def plain(rows, parts, entries, rounds):
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    width = -(-max(len(v) for _, v, _ in good) // parts)
    good = [(i, v, v + [0] * (parts * width - len(v)), label) for i, v, label in good]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((away(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in first]
            for _, _, v, _ in good:
                own[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(held) for c in zip(*held, strict=True)] if held else old for held, old in zip(own, books[p], strict=True)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, [near(v, p) for p in range(parts)], label) for i, _, v, label in good]
    out = [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), label) for i, n, label in out]
    return sorted((str(i), c, min(e, vector_codes.MOST), min(sum(x[2] for x in out if x[3] == label), vector_codes.MOST), digest) for i, c, e, label in out)


def got(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def rows_of(rng, n, length):
    some = [[rng.choice([0.0, 0.5, -0.25, 1 / 256, rng.uniform(-1, 1)]) for _ in range(length)] for _ in range(n)]
    same = [0.125] * length
    rows = [(k, v if k % 3 else same, rng.choice([1, 2, None]), "x") for k, v in enumerate(some)]
    return [*rows, rows[1], (None, some[0], 1, None), (3, same, 1, None), (900, None, 1, None), (901, [*same[:-1], None], 1, None), (902, [*same[:-1], float("nan")], 1, None), (903, [*same[:-1], float("-inf")], 2, None)]


@pytest.mark.parametrize(("length", "parts", "entries"), [(32, 16, 8), (12, 3, 256), (10, 4, 5)])
def test_equals_plain_lloyd(spark, length, parts, entries):
    rows = rows_of(random.Random(length), 90, length)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    assert got(vector_codes.compress(df, parts, entries)) == plain(rows, parts, entries, 2)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("veriloom.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector_codes, "HOT", 2)
    rows = rows_of(random.Random(9), 60, 32)
    assert got(vector_codes.compress(spark.createDataFrame(rows, KIND).repartition(3))) == plain(rows, 16, 64, 2)


@pytest.mark.parametrize("scale", [1e4, 1e6, 1e10, 1e15])
def test_large_components(spark, scale):
    rng = random.Random(7)
    rows = [(k, [rng.uniform(-1, 1) * scale for _ in range(8)], k % 2, "x") for k in range(30)]
    assert got(vector_codes.compress(spark.createDataFrame(rows, KIND), 4, 6)) == plain(rows, 4, 6, 2)


def test_short_empty_and_few(spark):
    rows = [(1, [0.5], 1, "x"), (2, [], None, "x"), (3, [0.25, -0.25, 1.0], None, "x")]
    df = spark.createDataFrame(rows, KIND)
    assert got(vector_codes.compress(df, 2, 64)) == plain(rows, 2, 64, 2)
    assert got(vector_codes.compress(df.where("false"))) == [] == got(vector_codes.compress(df.withColumn("embedding", df.embedding.cast("array<double>")).where("vec_id < 0")))
