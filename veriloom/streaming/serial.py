"""The serial queue as streams with keyed state: a consumer for each queue, and minting with its duplicate check and leaf counters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from veriloom.operators import jobs
from veriloom.operators.serial import CHECK_MS, LOCK_MS, MOST_STALLS, Consumer

#: Keyed state of these operators needs this store: set it on the session as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them, then hands them on by (us, event_id).

    So results don't depend on how rows are dealt to files or batches, as long as none comes later than the watermark's
    delay. The rows of that delay are held, no more. One timer a key, for what comes next.
    """

    columns: tuple[str, ...]
    kinds: str

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.kinds)
        self.alarm = handle.getValueState("alarm", "ms long")
        self.own(handle)

    def own(self, handle) -> None:
        """Makes the key's other state."""

    def steps(self, key: tuple, rows: list[tuple], until: int) -> Iterator[Row]:
        """What comes of the rows, in order, and of the time up to `until`."""
        raise NotImplementedError

    def due(self) -> int | None:
        """When, in microseconds, something happens without a row."""
        return None

    def _wake(self, us: int | None) -> None:
        if us is None:
            return
        ms, before = -(-us // 1000), self.alarm.get()[0] if self.alarm.exists() else None
        if before is None or ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.buffer.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        held = sorted((tuple(r) for r in self.buffer.get()), key=lambda r: r[:2])
        ripe = [r for r in held if r[0] <= until]
        out, rest = list(self.steps(key, ripe, until)), held[len(ripe) :]
        if rest:
            self.buffer.put(rest)
            self._wake(rest[0][0])
        else:
            self.buffer.clear()
        self._wake(self.due())
        return iter(out)

    def close(self) -> None:
        pass


class _Line:
    """Waiting jobs in keyed state: places that grow to the back and fall to the front, and which jobs have one."""

    def __init__(self, places, members, front: int, back: int):
        self.places, self.members, self.front, self.back = places, members, front, back

    def __contains__(self, job) -> bool:
        return self.members.containsKey((job,))

    def _put(self, place: int, job, stalls: int) -> None:
        self.places.updateValue((place,), (job, stalls))
        self.members.updateValue((job,), (place,))

    def append(self, job, stalls: int) -> None:
        self._put(self.back, job, stalls)
        self.back += 1

    def appendleft(self, job, stalls: int) -> None:
        self.front -= 1
        self._put(self.front, job, stalls)

    def popleft(self):
        if self.front == self.back:
            return None
        job = tuple(self.places.getValue((self.front,)))
        self.places.removeKey((self.front,))
        self.members.removeKey((job[0],))
        self.front += 1
        return job


class SerialConsumer(InOrder):
    """`operators.serial.Consumer` with its line, active job and lock as state, and a timer for the check that finds it stalled."""

    columns, kinds = ("us", "event_id", "job_id", "kind"), "us long, event_id long, job_id long, kind string"

    def __init__(self, lock_ms: int, check_ms: int, most_stalls: int):
        self.rules = (lock_ms, check_ms, most_stalls)

    def own(self, handle) -> None:
        self.places = handle.getMapState("places", "place long", "job long, stalls int")
        self.members = handle.getMapState("members", "job long", "place long")
        self.active = handle.getValueState("active", "job long, until long, stalls int, seq long, front long, back long")

    def _consumer(self) -> Consumer:
        job, until, stalls, seq, front, back = self.active.get() if self.active.exists() else (None, None, None, 0, 0, 0)
        return Consumer(_Line(self.places, self.members, front, back), None if until is None else (job, until, stalls), seq, *self.rules)

    def steps(self, key, rows, until) -> Iterator[Row]:
        c, out = self._consumer(), []
        for us, _, job, kind in rows:
            out += c.event(us, job, kind)
        out += c.until(until)
        self.active.update((*(c.active or (None, None, None)), c.seq, c.line.front, c.line.back))
        for seq, us, job, what, stalls in out:
            yield Row(queue=key[0], seq=seq, us=us, job_id=job, what=what, stalls=stalls)

    def due(self) -> int | None:
        return self._consumer().due()


def _timed(events: DataFrame, at: str, delay: str) -> DataFrame:
    """Rows with a time, under a watermark, with us: that time in microseconds."""
    return events.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withColumn("us", F.unix_micros(at)).withWatermark(at, delay)


def follow_queue(events: DataFrame, delay: str = "1 minute", lock_ms: int = LOCK_MS, check_ms: int = CHECK_MS, most_stalls: int = MOST_STALLS) -> DataFrame:
    """`operators.serial.consume` over a stream (queue and job_id are longs): its rows up to the watermark.

    A queue's line is in keyed state, a job at a time, so it may be long. Rows later than the delay are dropped by Spark.
    """
    rows = _timed(events, "at", delay).select("queue", "at", "us", "event_id", "job_id", "kind")
    got = rows.groupBy("queue").transformWithState(SerialConsumer(lock_ms, check_ms, most_stalls), "queue long, seq long, us long, job_id long, what string, stalls int", "append", "eventTime")
    return got.select("queue", "seq", F.timestamp_micros("us").alias("at"), "job_id", "what", "stalls")


class FirstOfHash(InOrder):
    """Whether a job's hash is free: not among those that exist, and asked for by no earlier job."""

    columns, kinds = ("us", "event_id", "tree", "taken", "num_minted"), "us long, event_id long, tree long, taken boolean, num_minted long"

    def own(self, handle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def steps(self, key, rows, until) -> Iterator[Row]:
        seen = self.seen.exists() or key[0] is None
        for us, event_id, tree, taken, num_minted in rows:
            reason = "exists" if taken else "earlier_job" if seen else "minted"
            seen = True
            yield Row(ts=dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=us), us=us, event_id=event_id, tree=tree, original_hash=key[0], reason=reason, num_minted=num_minted)
        if rows:
            self.seen.update((True,))


class NextLeaf(InOrder):
    """A tree's counter: minted jobs get the next leaf, others pass."""

    columns, kinds = ("us", "event_id", "original_hash", "reason", "num_minted"), "us long, event_id long, original_hash string, reason string, num_minted long"

    def own(self, handle) -> None:
        self.next = handle.getValueState("next", "leaf long")

    def steps(self, key, rows, until) -> Iterator[Row]:
        leaf = self.next.get()[0] if self.next.exists() else None
        for us, event_id, original_hash, reason, num_minted in rows:
            ok = reason == "minted"
            if ok:
                leaf = (num_minted or 0) if leaf is None else leaf
            yield Row(event_id=event_id, us=us, tree=key[0], original_hash=original_hash, reason=reason, success=ok, progress=jobs.PROGRESS["done" if ok else "duplicate"], leaf_index=leaf if ok else None)
            leaf = leaf + 1 if ok else leaf
        if leaf is not None:
            self.next.update((leaf,))


def follow_mints(queue: DataFrame, existing: DataFrame, minted: DataFrame, delay: str = "1 minute") -> DataFrame:
    """`operators.jobs.replay` over a stream of jobs (event_id, ts, tree, original_hash): its rows up to the watermark.

    Two keyed states after one another: by hash, whether it is taken, then by tree, the next leaf. existing and minted are
    tables, read anew in each batch; a tree's counter is taken over at its first mint and kept as state from then on. The state grows with
    the distinct hashes, a flag each.
    """
    taken = existing.select("original_hash").distinct().withColumn("taken", F.lit(True))
    rows = _timed(queue, "ts", delay).join(taken, "original_hash", "left").join(minted.select("tree", "num_minted"), "tree", "left")
    rows = rows.select("original_hash", "ts", "us", "event_id", "tree", "taken", "num_minted")
    first = rows.groupBy("original_hash").transformWithState(FirstOfHash(), "ts timestamp, us long, event_id long, tree long, original_hash string, reason string, num_minted long", "append", "eventTime", eventTimeColumnName="ts")
    got = first.groupBy("tree").transformWithState(NextLeaf(), "event_id long, us long, tree long, original_hash string, reason string, success boolean, progress int, leaf_index long", "append", "eventTime")
    return got.select("event_id", F.timestamp_micros("us").alias("ts"), "tree", "original_hash", "reason", "success", "progress", "leaf_index")
