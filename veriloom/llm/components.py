"""Connected components of links, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Each node u points neighbours (all larger ones, or all smaller ones and itself) to its least neighbour.

    The least neighbour is a partial aggregate and the join can be split where a node has very many links.
    """
    near = links.select(F.col("b").alias("u"), F.col("a").alias("v")) if small else _both(links)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    else:
        out = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where("a < b").distinct()


def components(links: DataFrame, table) -> DataFrame:
    """node, root: the least node that links (a < b, not null) reach, for every linked node but the roots themselves.

    table writes a table under a label. Each round's links are written; rounds grow with the logarithm of the longest
    path. Repeated links count once; without links there are no rows.
    """
    links, before = table(links.select("a", "b").distinct(), "links"), None
    while True:
        links = table(_star(_star(links, small=False), small=True), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before or not now[0]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
