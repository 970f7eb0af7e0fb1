"""Spark's rows against DuckDB's: the same columns and the same values, in any order."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def connection(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(f"{DATA}/{sf}"):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return int(x) if isinstance(x, float) and x == int(x) else x


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


def same(spark_df, sql: str, sf: str) -> None:
    got, want = spark_df.toPandas(), connection(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
