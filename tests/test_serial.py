"""The serial queue in batch and as a stream, over any split of the events into files and a batch that fails midway."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import jobs, serial
from veriloom.streaming import serial as stream

EVENTS = "queue long, at timestamp, event_id long, job_id long, kind string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def said(rows):
    return sorted((r["queue"], r["seq"], (r["at"].replace(tzinfo=r["at"].tzinfo or dt.UTC) - T0).total_seconds(), r["job_id"], r["what"], r["stalls"]) for r in rows)


def plain(events, now):
    """One second after another."""
    out = []
    for queue in {e[0] for e in events}:
        line, active, seq = [], None, 0

        def say(t, job, what, stalls):
            nonlocal seq
            seq += 1
            out.append((queue, seq, float(t), job, what, stalls))  # noqa: B023

        def start(t):
            nonlocal active
            if active is None and line:  # noqa: B023
                job, stalls = line.pop(0)  # noqa: B023
                active = [job, t + 30, stalls]
                say(t, job, "active", stalls)  # noqa: B023

        for t in range(now + 1):
            if t % 30 == 0 and active and active[1] <= t:
                job, _, stalls = active
                active = None
                if stalls == 0:
                    line.insert(0, (job, 1))
                say(t, job, "stalled" if stalls == 0 else "failed", stalls + 1)
                start(t)
            for _, s, _, job, kind in sorted((e for e in events if e[0] == queue and e[1] == t), key=lambda e: e[2]):
                assert s == t
                if kind == "add" and (active is None or active[0] != job) and job not in [j for j, _ in line]:
                    line.append((job, 0))
                elif active and active[0] == job and kind == "beat":
                    active[1] = t + 30
                elif active and active[0] == job and kind in ("completed", "failed"):
                    active, stalls = None, active[2]
                    say(t, job, kind, stalls)
                start(t)
    return sorted(out)


def events_of(seed, n, span):
    rng = random.Random(seed)
    return [(rng.randint(0, 2), rng.randint(1, span), k, rng.randint(0, 5), rng.choice(["add", "add", "beat", "completed", "failed", None])) for k in range(n)]


def frame(spark, events):
    return spark.createDataFrame([(q, at(t), e, j, k) for q, t, e, j, k in events], EVENTS)


def test_locks_and_stalls(spark):
    """A beat keeps the lock; a lost one costs a stall; the second ends the job; a late end is ignored."""
    events = [(1, 1, 0, 7, "add"), (1, 2, 1, 8, "add"), (1, 25, 2, 7, "beat"), (1, 62, 3, 7, "completed"), (1, 200, 4, 8, "completed"), (1, 201, 5, 9, "add")]
    want = [
        (1, 1, 1.0, 7, "active", 0), (1, 2, 60.0, 7, "stalled", 1), (1, 3, 60.0, 7, "active", 1), (1, 4, 62.0, 7, "completed", 1), (1, 5, 62.0, 8, "active", 0), (1, 6, 120.0, 8, "stalled", 1), (1, 7, 120.0, 8, "active", 1),
        (1, 8, 150.0, 8, "failed", 2), (1, 9, 201.0, 9, "active", 0), (1, 10, 240.0, 9, "stalled", 1), (1, 11, 240.0, 9, "active", 1),
    ]
    assert said(serial.consume(frame(spark, events), at(250)).collect()) == want == plain(events, 250)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_seconds(spark, seed):
    events = events_of(seed, 150, 900)
    assert said(serial.consume(frame(spark, events).repartition(3), at(1000)).collect()) == plain(events, 1000)
    assert serial.consume(frame(spark, events).where("false"), at(1000)).count() == 0
    late = frame(spark, events).withColumn("at", F.when(F.col("event_id") < 5, F.lit(None)).otherwise(F.col("at")))
    assert said(serial.consume(late, at(1000)).collect()) == plain(events[5:], 1000)


def run_twice(frame_of, path, out, checkpoint):
    """Runs over the files of path; the third batch fails after it was written, and a second run goes on from there."""
    failed = []

    def sink(batch, k):
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")
        if k == 2 and not failed:
            failed.append(k)
            raise RuntimeError("killed")

    for _ in range(2):
        q = frame_of().writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        try:
            q.awaitTermination(300)
        except Exception as e:
            assert "killed" in str(e)
    assert failed


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, stream.STATE_STORE)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_queue_as_a_stream(spark, tmp_path, state_store):
    events, rng = events_of(5, 120, 600), random.Random(1)
    files = [[e for e in events if e[1] // 150 == k] for k in range(5)]
    for k, part in enumerate(files):  # in order but for the delay
        part += [e for e in events if e[1] // 150 == k + 1 and rng.random() < 0.3]
        files[min(k + 1, 4)] = [e for e in files[min(k + 1, 4)] if e not in part]
        frame(spark, part if k < 4 else [*part, (99, 2000 + 400, 10**6, 0, "beat")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_twice(lambda: stream.follow_queue(source(), "400 seconds"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = said(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == said(serial.consume(frame(spark, events), at(2000)).collect()) == plain(events, 2000)


@pytest.mark.parametrize("seed", [0, 1])
def test_mints_as_a_stream(spark, tmp_path, state_store, seed):
    """Any split of the jobs into files gives the batch's rows."""
    rng = random.Random(seed)
    rows = [(k, at(rng.randint(1, 300)), rng.choice([0, 1, 2]), rng.choice(["a", "b", "c", "d", "e", "f", "g", None])) for k in range(60)]
    kind = "event_id long, ts timestamp, tree long, original_hash string"
    existing = spark.createDataFrame([("a",), ("a",)], "original_hash string")
    minted = spark.createDataFrame([(0, 100), (1, 7)], "tree long, num_minted long")
    rng.shuffle(rows)
    cuts = [0, *sorted(rng.sample(range(1, 60), 3)), 60]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, at(5000), 9, "end")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_twice(lambda: stream.follow_mints(source(), existing, minted, "1000 seconds"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    cols = ["event_id", "tree", "original_hash", "reason", "success", "progress", "leaf_index"]
    want = jobs.replay(spark.createDataFrame(rows, kind), existing, minted)
    text = lambda df: sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert text(spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0")) == text(want)
