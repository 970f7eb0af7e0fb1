"""A serial job pipeline as set operations: states, retention, ordinals, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators.places import with_places

STATES = ["waiting", "active", "completed", "failed", "delayed"]
# Age in seconds and number kept of finished jobs, by who sets them.
RETENTION = {"producer": {"completed": (3600, 100), "failed": (86400, None)}, "worker": {"completed": (86400, 1000), "failed": (604800, None)}}
#: Progress after each step of a replayed job.
PROGRESS = {"duplicate": 5, "predict": 15, "proof": 35, "mint": 65, "merge": 85, "done": 100}
ATTEMPTS, BACKOFF_MS = 3, 2000


def latest(events: DataFrame) -> DataFrame:
    """job_id, ts, event_id, state, progress of each job's last event."""
    keep = ["ts", "event_id", "state", "progress"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*keep), F.struct("ts", "event_id")).alias("e")).select("job_id", "e.*")


def state_counts(jobs: DataFrame) -> DataFrame:
    """state, n: a row for each state, also those without jobs."""
    states = jobs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STATES))).alias("state"))
    return states.join(jobs.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """queue (job_id, state, progress) with a waiting job for each request (job_id) that it doesn't have yet; attempts and backoff_ms are null for the others."""
    new = requests.select("job_id").distinct().join(queue.select("job_id"), "job_id", "left_anti")
    new = new.select("job_id", F.lit("waiting").alias("state"), F.lit(0).alias("progress"), F.lit(ATTEMPTS).alias("attempts"), F.lit(BACKOFF_MS).alias("backoff_ms"))
    none = F.lit(None).cast("int")
    return queue.select("job_id", "state", "progress", none.alias("attempts"), none.alias("backoff_ms")).union(new)


def retained(jobs: DataFrame, now: Column, policy: dict[str, tuple[int, int | None]]) -> DataFrame:
    """jobs with kept: finished jobs go when they are too old or beyond the newest so many of their state; others stay.

    The newest so many are found by a top-k of keys, so a state with very many jobs isn't sorted in one task.
    """
    out, kept = jobs, F.lit(True)
    for state, (age, most) in policy.items():
        ok = F.col("ts") >= now - F.expr(f"INTERVAL {age} SECONDS")
        if most is not None:
            newest = jobs.where(F.col("state") == state).orderBy(F.col("ts").desc(), F.col("job_id").desc()).limit(most).select("job_id", F.lit(True).alias(f"new_{state}"))
            out = out.join(F.broadcast(newest), "job_id", "left")  # at most `most` rows
            ok = ok & F.col(f"new_{state}").isNotNull()
        kept = F.when(F.col("state") == state, ok).otherwise(kept)
    return out.select(*jobs.columns, kept.alias("kept"))


def retry_delays(attempt: Column) -> Column:
    """Milliseconds before this attempt's retry, doubling; null when no attempt is left."""
    return F.when(attempt < ATTEMPTS, BACKOFF_MS * F.pow(F.lit(2), attempt - 1)).cast("long")


def poll_outcome(state: Column, success: Column, seconds: Column, most: int = 120) -> Column:
    """What a client that polls each second sees: completed without success is a failure."""
    return F.when((state == "completed") & success, "success").when(state.isin("completed", "failed"), "failure").when(seconds >= most, "timeout").otherwise("pending")


def leaf_indexes(jobs: DataFrame, minted: DataFrame, spread: bool = False) -> DataFrame:
    """jobs with leaf_index: the tree's counter plus the job's place in its tree's queue by (ts, event_id).

    jobs: tree, ts (a time or date), event_id; minted: tree, num_minted. A place is the number of the tree's jobs on
    earlier days plus the place within the day, so a busy tree is ordered a day at a time, side by side; over a whole
    tree only its days are ordered. The windows see keys only.
    """
    keys = jobs.select("tree", "ts", "event_id", F.to_date("ts").alias("day"))
    rank = F.row_number().over(Window.partitionBy("tree", "day").orderBy("ts", "event_id")) - 1
    earlier = F.sum("n").over(Window.partitionBy("tree").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = keys.groupBy("tree", "day").agg(F.count("*").alias("n")).select(F.col("tree").alias("d_tree"), F.col("day").alias("d_day"), F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = keys.withColumn("rank", rank).join(days, F.col("tree").eqNullSafe(F.col("d_tree")) & F.col("day").eqNullSafe(F.col("d_day")))
    return jobs.join(ranked.select("event_id", (F.col("rank") + F.col("before")).alias("place")), "event_id").join(minted, "tree", "left").select(*jobs.columns, (F.coalesce("num_minted", F.lit(0)) + F.col("place")).cast("long").alias("leaf_index"))


def replay(jobs: DataFrame, existing: DataFrame, minted: DataFrame) -> DataFrame:
    """The serial pipeline over a table of jobs: the first job of a new hash mints, others end without success.

    jobs: event_id, ts, tree, original_hash; existing: original_hash of records whose asset exists. A job whose hash
    exists, or that an earlier job took, ends at the duplicate check: state completed, success false, since the
    processor catches its errors. Columns: those of jobs, success, progress, leaf_index, reason.
    """
    first = jobs.groupBy("original_hash").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("original_hash", F.col("f.event_id").alias("first_id"))
    taken = existing.select("original_hash").distinct().withColumn("taken", F.lit(True))
    rows = jobs.join(first, "original_hash", "left").join(taken, "original_hash", "left")
    reason = F.when(F.col("taken"), "exists").when(~F.col("first_id").eqNullSafe(F.col("event_id")), "earlier_job").otherwise("minted")
    rows = rows.withColumn("reason", reason).select(*jobs.columns, "reason")
    mints = leaf_indexes(rows.where("reason = 'minted'"), minted).select("event_id", "leaf_index")
    ok = F.col("reason") == "minted"
    return rows.join(mints, "event_id", "left").select(*jobs.columns, "reason", ok.alias("success"), F.when(ok, PROGRESS["done"]).otherwise(PROGRESS["duplicate"]).alias("progress"), "leaf_index")
