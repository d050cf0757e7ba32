"""Status of every batch from a stream of status records: keyed state with timers.

1. Records are first counted by built-in aggregates per (window, batch, status): first and last time. Counts are partial
   before their shuffle, so a batch with a third of all records reaches the state as a few rows a window.
2. ``transformWithState`` keeps one small row per batch. Event-time timers report a batch as stuck an hour after it
   began and end it as expired after a day; a last timer forgets ended batches after ``keep``.

A record counts once its window has closed, so the result doesn't depend on how records are cut into micro-batches:

* a batch begins with its first record; the earliest final status (completed, failed) within a day ends it, ties by
  name; records after that, or more than a day after it began, change nothing until it is forgotten;
* without a final status it is stuck after an hour and expired after a day (the last window of that time has closed);
* else its status is that of its latest record, ties by name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from riskweave.schema import FINAL_BATCH_STATES

HOUR_MS = 3600 * 1000
DAY_MS = 24 * HOUR_MS
WINDOW_MS = 10 * 60 * 1000
KEEP_MS = 30 * DAY_MS

CHANGES = "batch_id string, status string, at_ms bigint"
# a type and not its text: text would be parsed again, by a round trip, with every update
_STATE = StructType().add("status", StringType()).add("at_ms", LongType()).add("created_ms", LongType()).add("ended", BooleanType())


def status_windows(log: DataFrame, ts: str = "ts", delay: str = "1 hour", window_ms: int = WINDOW_MS) -> DataFrame:
    """batch_id, status, first_ms, last_ms, n per window; ``log``: batch_id, status and a time. Batch or stream."""
    records = log.select(F.col("batch_id").cast("string").alias("batch_id"), "status", F.col(ts).cast("timestamp").alias("ts"))
    timed = records.withWatermark("ts", delay) if log.isStreaming else records
    return (
        timed.filter("status is not null")
        .groupBy(F.window("ts", f"{window_ms} milliseconds").alias("w"), "batch_id", "status")
        .agg(F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"), F.count(F.lit(1)).alias("n"))
    )


class BatchStates(StatefulProcessor):
    """One row of state per batch; see the module text for the rules.

    Each call of the state costs a round trip between two processes, so a batch makes few: a batch that ends with its first
    windows sets no timers to delete, and what is due by then is said at once instead of by timers.
    """

    def __init__(self, window_ms: int = WINDOW_MS, keep_ms: int = KEEP_MS):
        self.window_ms, self.keep_ms = window_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", _STATE)

    def _stuck_at(self, created: int) -> int:
        return created + HOUR_MS + self.window_ms  # by then every window with a record of that hour has closed

    def _expired_at(self, created: int) -> int:
        return created + DAY_MS + self.window_ms

    def _end(self, status: str, at: int, created: int) -> Row:
        self.state.update((status, at, created, True))
        self.handle.registerTimer(created + self.keep_ms)
        return self._change(status, at)

    def _change(self, status: str, at: int) -> Row:
        return Row(batch_id=self.key, status=status, at_ms=at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.key = key[0]
        seen = [(r["first_ms"], r["last_ms"], r["status"]) for r in rows]  # a few rows a window
        known = self.state.get()
        status, at, created, ended = known or (None, -1, min(seen)[0], False)
        if ended:
            return
        seen = [x for x in seen if x[0] <= created + DAY_MS]
        final = [(first, s) for first, _, s in seen if s in FINAL_BATCH_STATES]
        if final:
            first, s = min(final)
            if known:
                self.handle.deleteTimer(self._stuck_at(created))
                self.handle.deleteTimer(self._expired_at(created))
            yield self._end(s, first, created)
            return
        latest = max([(at, status), *((last, s) for _, last, s in seen)] if status is not None else [(last, s) for _, last, s in seen])
        if latest != (at, status):
            yield self._change(latest[1], latest[0])
        if not known:
            now = timerValues.getCurrentWatermarkInMs()
            if self._stuck_at(created) <= now:
                yield self._change("stuck", created + HOUR_MS)
            else:
                self.handle.registerTimer(self._stuck_at(created))
            if self._expired_at(created) <= now:
                yield self._end("expired", created + DAY_MS, created)
                return
            self.handle.registerTimer(self._expired_at(created))
        self.state.update((latest[1], latest[0], created, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.key = key[0]
        state = self.state.get()
        if not state:
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        _, _, created, ended = state
        if ended:
            if due == created + self.keep_ms:
                self.state.clear()
        elif due == self._stuck_at(created):
            yield self._change("stuck", created + HOUR_MS)
        elif due == self._expired_at(created):
            yield self._end("expired", created + DAY_MS, created)

    def close(self) -> None:
        pass


def stream_batch_state(
    log: DataFrame, ts: str = "ts", delay: str = "1 hour", window_ms: int = WINDOW_MS, keep_ms: int = KEEP_MS
) -> DataFrame:
    """Changes of each batch's status (batch_id, status, at_ms), append mode. Start it with ``jobs.run_available`` or under
    ``jobs.keyed_state``: its state needs the RocksDB store."""
    windows = status_windows(log, ts, delay, window_ms).select("batch_id", "status", "first_ms", "last_ms")
    return windows.groupBy("batch_id").transformWithState(BatchStates(window_ms, keep_ms), CHANGES, "Append", "EventTime")


def current_states(changes: DataFrame) -> DataFrame:
    """batch_id, status, at_ms as of now from the written changes: an end before stuck before the latest status."""
    rank = F.when(F.col("status").isin(*FINAL_BATCH_STATES, "expired"), 2).when(F.col("status") == "stuck", 1).otherwise(0)
    latest = F.max_by(F.struct("status", "at_ms"), F.struct(rank, "at_ms", "status"))
    return changes.groupBy("batch_id").agg(latest.alias("s")).select("batch_id", "s.status", "s.at_ms")
