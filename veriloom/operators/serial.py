"""A serial consumer: a queue's jobs one at a time, each under a lock that its worker renews, stalled jobs tried once more."""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Milliseconds that a lock lasts and between two checks for stalled jobs; stalls that a job survives.
LOCK_MS, CHECK_MS, MOST_STALLS = 30_000, 30_000, 1
#: What an event says of a job: it is asked for, its worker is alive, it ended well or not.
ADD, BEAT, COMPLETED, FAILED = "add", "beat", "completed", "failed"
ACTIVE, STALLED = "active", "stalled"
MICROS = dt.timedelta(microseconds=1)


class Line:
    """Waiting jobs with the stalls of each, in memory; stalled jobs come back to the front."""

    def __init__(self):
        self.jobs: deque = deque()
        self.held: set = set()

    def __contains__(self, job) -> bool:
        return job in self.held

    def append(self, job, stalls: int) -> None:
        self.jobs.append((job, stalls))
        self.held.add(job)

    def appendleft(self, job, stalls: int) -> None:
        self.jobs.appendleft((job, stalls))
        self.held.add(job)

    def popleft(self):
        job = self.jobs.popleft() if self.jobs else None
        if job:
            self.held.discard(job[0])
        return job


class Consumer:
    """One queue. Events must come in order; each call yields what happens: (seq, time, job, what, stalls), times in microseconds.

    Checks are due at whole multiples of check_ms; one that finds the active job's lock run out takes the job off: back to
    the front of the line, or failed once it has stalled more than most_stalls times. A check comes before an event of
    its time. A job that waits or is active isn't added again; what is said of a job that isn't active is ignored, as its
    worker has lost the lock.
    """

    def __init__(self, line, active: tuple | None = None, seq: int = 0, lock_ms: int = LOCK_MS, check_ms: int = CHECK_MS, most_stalls: int = MOST_STALLS):
        self.line, self.active, self.seq = line, active, seq
        self.lock, self.check, self.most = lock_ms * 1000, check_ms * 1000, most_stalls

    def due(self) -> int | None:
        """The first check at which the active job is found stalled."""
        return None if self.active is None else -(-self.active[1] // self.check) * self.check

    def _said(self, at: int, job, what: str, stalls: int) -> tuple:
        self.seq += 1
        return self.seq, at, job, what, stalls

    def _next(self, at: int) -> Iterator[tuple]:
        if self.active is None and (job := self.line.popleft()):
            self.active = (job[0], at + self.lock, job[1])
            yield self._said(at, job[0], ACTIVE, job[1])

    def until(self, at: int) -> Iterator[tuple]:
        """The checks up to this time."""
        while (check := self.due()) is not None and check <= at:
            job, _, stalls = self.active
            self.active = None
            if stalls < self.most:
                self.line.appendleft(job, stalls + 1)
            yield self._said(check, job, STALLED if stalls < self.most else FAILED, stalls + 1)
            yield from self._next(check)

    def event(self, at: int, job, kind: str) -> Iterator[tuple]:
        yield from self.until(at)
        own = self.active is not None and self.active[0] == job
        if kind == ADD and not own and job not in self.line:
            self.line.append(job, 0)
        elif own and kind == BEAT:
            self.active = (job, at + self.lock, self.active[2])
        elif own and kind in (COMPLETED, FAILED):
            stalls, self.active = self.active[2], None
            yield self._said(at, job, kind, stalls)
        yield from self._next(at)


def consume(events: DataFrame, now: dt.datetime, lock_ms: int = LOCK_MS, check_ms: int = CHECK_MS, most_stalls: int = MOST_STALLS) -> DataFrame:
    """queue, seq, at, job_id, what (active, stalled, completed, failed), stalls: all that happens up to now (a naive time is UTC).

    events: queue, at (a time), event_id, job_id, kind; taken in the order of (at, event_id). Events without a time are left
    out. What a queue does follows from its order, so a queue is one task; its rows stream by, sorted through disk if
    need be, and only its waiting jobs are held. `veriloom.streaming.serial` does the same to a stream.
    """
    until = (now if now.tzinfo else now.replace(tzinfo=dt.UTC)).astimezone(dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    until = until // MICROS
    src = events.where("at IS NOT NULL").select("queue", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "event_id", "job_id", "kind").where(F.col("us") <= until)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, consumer, schema = None, None, None
        for batch in batches:
            fields = {f.name: f.type for f in batch.schema}
            schema = pa.schema([("queue", fields["queue"]), ("seq", pa.int64()), ("us", pa.int64()), ("job_id", fields["job_id"]), ("what", pa.string()), ("stalls", pa.int32())])
            out = []
            for own, us, _, job, kind in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if consumer is None or own != queue:
                    out += [] if consumer is None else [(queue, *x) for x in consumer.until(until)]
                    queue, consumer = own, Consumer(Line(), None, 0, lock_ms, check_ms, most_stalls)
                out += [(own, *x) for x in consumer.event(us, job, kind)]
            yield _rows(out, schema)
        if consumer is not None:
            yield _rows([(queue, *x) for x in consumer.until(until)], schema)

    ordered = src.repartition("queue").sortWithinPartitions("queue", "us", "event_id")
    got = ordered.mapInArrow(run, f"queue {kinds['queue']}, seq long, us long, job_id {kinds['job_id']}, what string, stalls int")
    return got.select("queue", "seq", F.timestamp_micros("us").alias("at"), "job_id", "what", "stalls")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
