"""Mixing sources to target weights by entropy balancing: tilted document rates from the dual, rounded into copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few, fresh, scratch, written

#: Weights of the sources in code-point order, repeating; null last.
WEIGHTS = (5, 2, 1)
#: No source's target and no document's copies exceed so many times its size.
MOST = 3
#: The tilt grows with a document's size to this power.
TILT = 0.25
#: Newton steps at most, and the share of a source's words by which its target may be missed.
STEPS, CLOSE = 60, 1e-7
#: Documents of one source and size are dealt their extra copies in buckets of about so many.
BUCKET = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Not null, and sorted as the sources by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size, target. Targets share all sizes by weight; one above its cap is set to it and the rest reshared, until none is above.

    With sources by cap over weight the capped ones come first, so running sums over the sources (one row each) settle all at once.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    # Both windows run over one row for each source.
    rank = F.row_number().over(Window.orderBy("key")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    per = per.withColumn("shares", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    per = per.withColumn("capped", F.col("cap").cast("double") * F.col("shares") <= F.col("weight").cast("double") * F.col("left"))
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))
    shares = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / shares)
    return per.select("key", "source_size", target.alias("target"))


def tilted_rates(histogram: DataFrame, targets: DataFrame, most: float, table, tilt: float = TILT) -> DataFrame:
    """histogram (key, size, n) with source_size, target and rate = min(most, exp(lam * z)), z = (size / mean) ** tilt, so that each source takes its target's words.

    These rates minimise their entropy against one copy of each document, with a document's cost in words over z, under
    0 <= rate <= most and the token constraint. The dual has one multiplier a source; each Newton step is an aggregate
    over the histogram for all sources at once, and between steps there is one row a source, written by table. A
    bracket halves where a step would leave it.
    """
    own = histogram.where("size > 0").groupBy("key").agg(F.sum("n").cast("double").alias("docs"), F.min("size").alias("least"))
    state = targets.join(own, "key").withColumn("mean", F.col("source_size") / F.col("docs")).where("target > 0")
    z_least = F.pow(F.col("least") / F.col("mean"), tilt)
    # At low no document's rate exceeds target / size of the source, at high all have the most.
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) / z_least - 1e-9
    state = state.select("key", "source_size", "target", "mean", F.lit(0.0).alias("lam"), low.alias("low"), (F.log(F.lit(most)) / z_least + 1e-9).alias("high"))
    state, kept = table(state, "state"), ["key", "source_size", "target", "mean"]
    z = F.pow(F.greatest("size", F.lit(1)) / F.col("mean"), tilt)
    rate = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
    words = F.col("size") * F.col("n").cast("double")
    total = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")  # noqa: E731  exact, so the order of the rows doesn't matter
    for _ in range(STEPS):
        step = histogram.join(few(state, 64), "key").groupBy(*kept, "lam", "low", "high").agg(total(words * F.least(rate, F.lit(float(most)))).alias("got"), total(F.when(rate < most, words * z * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap < 0, F.col("high")).otherwise(F.col("lam"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        done = F.abs(gap) <= CLOSE * F.col("source_size")
        lam = F.when(done, F.col("lam")).when((low < newton) & (newton < high), newton).otherwise((low + high) / 2)
        state = table(step.select(*kept, lam.alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")), "state")
        if state.where("not done").isEmpty():
            break
        state = state.drop("done")
    solved = histogram.join(targets, "key").join(few(state.select("key", "mean", "lam"), 32), "key", "left")
    full = F.col("target") >= most * F.col("source_size")
    return solved.select("key", "size", "n", "source_size", "target", F.when(full, float(most)).otherwise(F.coalesce(F.least(rate, F.lit(float(most))), F.lit(0.0))).alias("rate"))


def rounded(rates: DataFrame) -> DataFrame:
    """rates with base, the copies that all documents of a size get, and extra, how many of them get one more.

    Running sums from the largest size down are rounded, so a source's words miss the rates' by a document at most. The
    window holds the histogram of a source's sizes, which doesn't grow with the documents.
    """
    upto = F.sum(F.col("n") * F.col("part")).over(Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0))
    parts = rates.withColumn("base", F.floor(F.col("rate") + 1e-12)).withColumn("part", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).withColumn("upto", upto)
    extra = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("n") * F.col("part") + 0.5)
    return parts.withColumn("extra", F.greatest(F.least(extra, F.col("n")), F.lit(0))).drop("part", "upto")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    The dual is solved for all sources at once over the histograms of their sizes, which don't grow with the documents.
    Which documents of a size get a further copy is settled by the hash of the id, in buckets of bounded size, so a
    source or size with a third of all rows is no single task. Reruns agree.

    Columns: doc_id, key (source_key), size (words; null text: 0), source_size, target, rate, copies, taken (size *
    copies), rows (how many input rows had this id, source and size; they get equal copies). A null source is a source
    of its own; equal ids of one source and size have one row; an empty table gives no rows; a very long text is only
    counted; other columns are ignored. The result is a written table, intermediate ones are deleted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col).cast("string")).alias("key"), word_count(F.col(text_col).cast("string")).alias("size"))
    with scratch(docs.sparkSession) as table:
        units = table(rows.groupBy("doc_id", "key", "size").agg(F.count("*").alias("rows")), "mix-sizes")
        histogram = table(units.groupBy("key", "size").agg(F.sum("rows").alias("n")), "mix-histogram")
        targets = table(source_targets(histogram.select("key", (F.col("size") * F.col("n")).alias("size")), weights, most), "mix-targets")
        plan = table(rounded(tilted_rates(histogram, targets, most, table)), "mix-plan")
        dealt = units.join(plan, ["key", "size"]).withColumn("hash", F.xxhash64("doc_id", F.lit("mix"))).withColumn("bucket", F.pmod("hash", F.ceil(F.col("n") / BUCKET)))
        buckets = dealt.groupBy("key", "size", "bucket").agg(F.sum("rows").alias("here"), F.first("n").alias("n"), F.first("extra").alias("extra"))
        upto = F.sum("here").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        share = lambda x: F.floor((F.col("extra").cast("double") * x) / F.col("n") + 0.5)
        buckets = buckets.select("key", "size", "bucket", (share(upto) - share(upto - F.col("here"))).alias("more"))
        order = Window.partitionBy("key", "size", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        out = dealt.join(buckets, ["key", "size", "bucket"]).withColumn("copies", F.col("base") + (F.sum("rows").over(order) <= F.col("more")).cast("long"))
        return written(out.select("doc_id", "key", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "rows"), "mix")


def one_row_each(mixed: DataFrame) -> DataFrame:
    """A row for each input row again."""
    return mixed.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))


def with_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source and any other columns) that the mix takes, with their rate and copies.

    Columns named rate or copies are replaced. Null texts count as empty; null ids and
    sources count like any other; repeated rows get equal copies; an empty table gives no rows; a very long text is one
    document. Ids, sources and sizes are joined, by broadcast if few.
    """
    docs = docs.drop("rate", "copies")
    names = [fresh(docs, k) for k in ("mix_id", "mix_key", "mix_size", "own_key", "own_size")]
    m_id, m_key, m_size, own_key, own_size = names
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias(m_id), F.col("key").alias(m_key), F.col("size").alias(m_size), "rate", "copies")
    keyed = docs.withColumn(own_key, source_key(F.col("source"))).withColumn(own_size, word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(m_id)) & (F.col(own_key) == F.col(m_key)) & (F.col(own_size) == F.col(m_size))
    return keyed.join(few(taken, 80), same).select(*docs.columns, "rate", "copies")
