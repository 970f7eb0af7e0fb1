"""Places within groups, where a group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group with more than this share of all rows is dealt out, so there are fewer such groups than this. It is cut at so many quantiles.
SHARE, CUTS = 1024, 256


def _number(rows: DataFrame, column: str) -> Column:
    """A long that rises with the column's order: a number's, a time's, or a text's first seven bytes."""
    kind, c = rows.schema[column].dataType.typeName(), F.col(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.floor(c.cast("double")).cast("long") if kind in ("double", "float", "decimal") else c.cast("long")


def _cuts_below(cuts: Column, x: Column, equal: bool) -> Column:
    """How many of the CUTS - 1 ascending cuts lie below x (or at it), by halving."""
    halves = F.array(*[F.lit(CUTS >> k) for k in range(1, CUTS.bit_length())])
    return F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get(cuts, n + half - 1) <= x if equal else F.get(cuts, n + half - 1) < x, n + half).otherwise(n))


def with_places(rows: DataFrame, group: str, order: tuple[str, str], name: str = "place") -> DataFrame:
    """rows with each one's place from 0 within its group, in this order (nulls first); null groups are one group.

    A group with more than 1 / SHARE of the rows is cut into ranges at quantiles of the first order column; rows that tie
    at a cut are cut again by the second. Ranges are ordered side by side, and each adds the number of rows in its
    group's earlier ranges. The others are one range. Quantiles may be rough: they decide how even ranges are, not places.
    """
    first, second = (_number(rows, c) for c in order)
    base = rows.select(F.struct(*rows.columns).alias("row"), F.struct(F.col(group).alias("g")).alias("own"), first.alias("a"), second.alias("b"))
    sizes = base.groupBy("own").agg(F.count("*").alias("n"))
    hot = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total")))).where(F.col("n") * SHARE > F.col("total"))  # total is one row
    hot = hot.where(F.col("n") > CUTS).select(F.col("own").alias("hot"))
    cuts = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    in_hot = base.join(F.broadcast(hot), F.col("own") == F.col("hot"))  # fewer than SHARE rows
    stats = in_hot.groupBy("hot").agg(F.percentile_approx("a", cuts, F.lit(10_000)).alias("cuts_a"), F.percentile_approx("b", cuts, F.lit(10_000)).alias("cuts_b"))
    below, upto = _cuts_below(F.col("cuts_a"), F.col("a"), False), _cuts_below(F.col("cuts_a"), F.col("a"), True)
    at = (below + upto) * (CUTS + 1) + F.when(below < upto, F.coalesce(_cuts_below(F.col("cuts_b"), F.col("b"), True) + 1, F.lit(0))).otherwise(0)
    range_ = F.when(F.col("hot").isNull(), F.lit(0)).when(F.col("a").isNull(), F.lit(-1)).otherwise(at).cast("long")
    dealt = base.join(F.broadcast(stats), F.col("own") == F.col("hot"), "left").select("row", "own", range_.alias("range"))  # fewer than SHARE rows
    earlier = F.sum("n").over(Window.partitionBy("own").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counted = dealt.groupBy("own", "range").agg(F.count("*").alias("n")).withColumn("before", earlier)
    before = counted.where("before > 0").select(F.col("own").alias("own_group"), F.col("range").alias("own_range"), "before")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("own", "range").orderBy(*[F.col("row")[c] for c in order])) - 1)
    out = ranked.join(before, (F.col("own") == F.col("own_group")) & (F.col("range") == F.col("own_range")), "left")
    return out.select("row.*", (F.col("k") + F.coalesce("before", F.lit(0))).cast("long").alias(name))
