"""Keyed tables: changes rewrite the buckets of their keys alone, and set updated_at by one path."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from veriloom.operators.keyed import KeyedTable

KIND = "k long, title string, n int, owner string, created_at timestamp, updated_at timestamp"
T = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4, 5, 6)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = [(k, f"t{k}", None if k == 3 else k, "w" if k % 2 else None, T[0], T[0]) for k in range(40)]
    return KeyedTable.create(spark.createDataFrame([*rows, (None, "no key", 1, "w", T[0], T[0])], KIND), str(tmp_path / "table"), "k", buckets=16)


def row(table, k):
    r = table.read().where(F.col("k") == k).collect()
    assert len(r) <= 1
    return tuple(r[0])[1:] if r else None


def test_only_touched_buckets_change(spark, table):
    before = files(table.path)
    assert table.read().count() == 40 and len(before) == len({os.path.dirname(f) for f in before})
    source = spark.createDataFrame([(5, None, 50, 1), (5, None, 51, 2), (1000, "new", 1, 1), (None, "x", 1, 1)], "k int, title string, n int, place int")
    table.upsert(source, ["place"], F.lit(T[1]), optional=("title",))
    after = files(table.path)
    assert row(table, 5) == ("t5", 51, "w", T[0], T[1]) and row(table, 1000) == ("new", 1, None, T[1], T[1]) and row(table, 6) == ("t6", 6, None, T[0], T[0])
    kept = {f for f in before if after.get(f) == before[f]}
    changed = {os.path.dirname(f) for f in set(after) - kept}
    assert len(changed) == 2 and {os.path.dirname(f) for f in set(before) - kept} <= changed and table.read().count() == 41
    table.upsert(source, ["place"], F.lit(T[1]), optional=("title",))
    assert table.read().count() == 41 and row(table, 5) == ("t5", 51, "w", T[0], T[1])
    table.upsert(source.where("false"), ["place"], F.lit(T[2]))
    assert {f: s for f, s in files(table.path).items() if f in kept} == {f: before[f] for f in kept}


def test_updates_share_one_path(spark, table):
    """A guard that fails, a null that is a value, counters, inserts that are there, and a hit that changes nothing."""
    changes = spark.createDataFrame([(1, "w", "public"), (2, "w", "public"), (77, "w", "public")], "k long, owner string, new string")
    table.update(changes, {"title": "s.new"}, F.lit(T[1]), where="t.owner = s.owner")
    assert row(table, 1) == ("public", 1, "w", T[0], T[1]) and row(table, 2) == ("t2", 2, None, T[0], T[0]) and row(table, 77) is None
    parts = spark.createDataFrame([(1, None, True), (2, "no", False)], "k long, title string, has_title boolean")
    table.update(parts, {"title": "if(s.has_title, s.title, t.title)"}, F.lit(T[2]))
    assert row(table, 1) == (None, 1, "w", T[0], T[2]) and row(table, 2) == ("t2", 2, None, T[0], T[2])
    table.count(spark.createDataFrame([(3,), (3,), (4,), (78,)], "k long"), "n", F.lit(T[3]))
    assert row(table, 3)[1] == 2 and row(table, 4)[1] == 5 and row(table, 78) is None and row(table, 4)[4] == T[3]
    table.insert_if_absent(spark.createDataFrame([(4, "later", 9), (79, "b", 2), (79, "a", 1)], "k long, title string, n int"), ["n"], F.lit(T[4]))
    assert row(table, 4) == ("t4", 5, None, T[0], T[3]) and row(table, 79) == ("a", 1, None, T[4], T[4])
    assert table.read().count() == 41
