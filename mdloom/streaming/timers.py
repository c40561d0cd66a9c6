"""Keyed streams whose state ends: bursts of edits saved by a timer, and jobs that are forgotten when they are done.

Both need the RocksDB state store; start them within with_state_store(spark).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: The stages after which a job has nothing more to tell.
ENDS = ("complete", "error")


@contextmanager
def with_state_store(spark: SparkSession):
    """Streams that start within use RocksDB for their state; the session's own choice is put back."""
    old = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, old)


class Debounce(StatefulProcessor):
    """Per key the open bursts of edits, and one timer at the first end among them; an edit within the gap joins a burst (or two), which
    puts off its end. So a batch or a timer costs a key a fixed number of calls to its state, however many bursts it has."""

    def __init__(self, gap: int) -> None:
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getListState("bursts", "started long, last long, content string")

    def timer_of(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bursts = [(b[0], b[1], b[2]) for b in self.bursts.get()] if self.bursts.exists() else []
        bursts += [(r.at, r.at, r.content) for r in rows]
        merged: list[tuple] = []
        for started, last, content in sorted(bursts, key=lambda b: (b[0], b[1], b[2] is not None, b[2] or "")):
            if merged and started <= merged[-1][1] + self.gap:
                before = merged[-1]
                later = max((before[1], before[2] is not None, before[2] or ""), (last, content is not None, content or ""))
                merged[-1] = (before[0], later[0], later[2] if later[1] else None)
            else:
                merged.append((started, last, content))
        self.keep(merged)
        first, there = min(self.timer_of(b[1]) for b in merged), [*self.handle.listTimers()]
        for t in there:
            if t != first:
                self.handle.deleteTimer(t)
        if first not in there:
            self.handle.registerTimer(first)
        return iter(())

    def keep(self, bursts: list[tuple]) -> None:
        if bursts:
            self.bursts.put(bursts)
        else:
            self.bursts.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        bursts = [(b[0], b[1], b[2]) for b in self.bursts.get()] if self.bursts.exists() else []
        is_over = lambda b: (t := self.timer_of(b[1])) <= now or t < watermark
        open_ = [b for b in bursts if not is_over(b)]
        self.keep(open_)
        if open_:
            self.handle.registerTimer(min(self.timer_of(b[1]) for b in open_))
        for started, last, content in filter(is_over, bursts):
            yield Row(key=key[0], started=_EPOCH + timedelta(microseconds=started), saved=_EPOCH + timedelta(microseconds=last + self.gap), content=content)

    def close(self) -> None:
        pass


def debounced_by_timer(edits: DataFrame, gap: timedelta = timedelta(seconds=1), late: str = "1 hour") -> DataFrame:
    """The same as debounced_latest in append mode, by a timer for each key: when the watermark passes a burst's end, its last content
    comes out and the burst is forgotten; a key without open bursts has no state. An edit just one gap after the last joins it.
    edits: key, ts, content (text); edits later than the watermark are dropped."""
    micros = int(gap / timedelta(microseconds=1))
    timed = edits.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"), F.col("content").cast("string").alias("content"))
    kind = dict(edits.dtypes)["key"]
    return timed.groupBy("key").transformWithState(Debounce(micros), f"key {kind}, started timestamp, saved timestamp, content string", "append", "EventTime")


class Progress(StatefulProcessor):
    """Per job its latest stage, until it ends or the watermark is a time to live past its last news."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, stage string")

    def timer_of(self, at: int) -> int:
        return -(-at // 1000) + self.ttl_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        told = self.latest.get() if self.latest.exists() else None
        best = max([(r.at, r.stage) for r in rows] + ([(told[0], told[1])] if told is not None else []))
        if told is not None:
            self.handle.deleteTimer(self.timer_of(told[0]))
        if best[1] in ENDS:
            self.latest.clear()
        else:
            self.latest.update(best)
            self.handle.registerTimer(self.timer_of(best[0]))
        yield Row(job=key[0], stage=best[1], ts=_EPOCH + timedelta(microseconds=best[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_until_done(stages: DataFrame, ttl: timedelta = timedelta(days=1), late: str = "1 hour") -> DataFrame:
    """The latest stage of each job that a batch has news of; stages: job, ts (timestamp), stage. A job that is complete, or ended by an error,
    is told once more and then forgotten, as is one whose last news is a time to live behind the watermark: state holds the jobs
    under way. News of a job that was forgotten starts it anew, so older news must not come after its end; news later than the
    watermark is dropped."""
    kind = dict(stages.dtypes)["job"]
    known = stages.where("ts is not null and stage is not null").withWatermark("ts", late).select("job", "ts", F.unix_micros("ts").alias("at"), "stage")
    return known.groupBy("job").transformWithState(Progress(int(ttl / timedelta(milliseconds=1))), f"job {kind}, stage string, ts timestamp", "update", "EventTime")
