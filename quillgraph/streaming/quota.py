"""Per-key quota in windows that open at a key's first event.

State per key is four numbers, and goes once the window has ended. The same processor serves a stream and a static table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Events allowed per window and window length of the two services.
QUOTA, WINDOW_MS, ENGINE_QUOTA = 60, 60_000, 120

OUTPUT = "key string, event_id long, ts timestamp, allowed boolean, n_in_window int, kind string"


def admit_sorted(times: np.ndarray, count: int, reset_at: int, window_us: int, limit: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Verdicts for one key's ascending times (microseconds), one step per window.

    An event after ``reset_at`` opens a window with count 1; within it events are allowed up to
    the limit and denied ones are not counted. Returns allowed, counts, and the state to carry.
    """
    allowed = np.zeros(len(times), dtype=bool)
    counts = np.zeros(len(times), dtype=np.int32)
    at = 0
    while at < len(times):
        if reset_at < 0 or times[at] > reset_at:
            count, reset_at, first = 1, int(times[at]) + window_us, at
            allowed[at], counts[at] = True, 1
            at = first + 1
        end = int(np.searchsorted(times, reset_at, side="right"))
        if end > at:
            place = count + np.arange(1, end - at + 1)
            allowed[at:end] = place <= limit
            counts[at:end] = np.minimum(place, limit)
            count = int(min(limit, count + end - at))
        at = max(end, at)
    return allowed, counts, count, reset_at


def expiry_ms(reset_at: int) -> int:
    """First millisecond of the clock at which a window that ends at reset_at (microseconds) is over."""
    return reset_at // 1000 + 1


class QuotaProcessor(StatefulProcessor):
    """Clock is None for a stream, whose timers follow the watermark; else the largest time of the table in microseconds."""

    def __init__(self, window_us: int, limit: int, clock: int | None):
        self.window_us, self.limit, self.clock = window_us, limit, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "count int, reset_at long, last_ts long, last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """One frame for each frame of rows: a frame costs far more than what a key usually holds."""
        # A static table hands a key over once. A key without a slot is new or its window is over; what is older than the clock then
        # has no window to count in.
        slot = self.slot.get() if self.clock is None else None
        clock_us = -(1 << 62) if self.clock is not None else timerValues.getCurrentWatermarkInMs() * 1000
        count, reset_at, last_ts, last_id = slot or (0, -1, clock_us, -1)
        known_end, moved = int(reset_at), False
        if self.clock is None:
            # Order within a micro-batch; the source's trigger options bound it.
            parts = list(rows)
            rows = iter(parts if len(parts) == 1 else [pd.concat(parts)])
        for part in rows:
            times, ids = part["ts"].to_numpy(dtype="datetime64[us]").astype("int64"), part["event_id"].to_numpy()
            order = np.lexsort((ids, times))
            times, ids = times[order], ids[order]
            late = (times < last_ts) | ((times == last_ts) & (ids < last_id))
            late_rows, (times, ids) = (times[late], ids[late]), (times[~late], ids[~late])
            allowed, counts, ends, held = np.zeros(0, bool), np.zeros(0, np.int32), [], []
            if len(times):
                before, moved = (int(count), int(reset_at)), True
                allowed, counts, count, reset_at = admit_sorted(times, *before, self.window_us, self.limit)
                ends, held = self._closed(times, counts, *before)
                last_ts, last_id = int(times[-1]), int(ids[-1])
            if len(part):
                yield self._frame(key, late_rows, (times, ids), allowed, counts, ends, held)
        if reset_at < 0:
            return
        if self.clock is not None:
            if expiry_ms(int(reset_at)) <= self.clock // 1000:
                yield self._ended(key, [int(reset_at)], [int(count)])
        elif moved:
            self.slot.update((int(count), int(reset_at), int(last_ts), int(last_id)))
            if reset_at != known_end:
                self.handle.registerTimer(expiry_ms(int(reset_at)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Reports and forgets a key whose window is over. A timer of an earlier window finds a later end and does nothing."""
        slot = self.slot.get()
        if slot:
            count, reset_at, _, _ = slot
            if expiry_ms(int(reset_at)) <= expiredTimerInfo.getExpiryTimeInMs():
                self.slot.clear()
                yield self._ended(key, [int(reset_at)], [int(count)])

    def _closed(self, times: np.ndarray, counts: np.ndarray, count: int, reset_at: int) -> tuple[list[int], list[int]]:
        """Windows that an event of these rows came after: their ends and how many they held."""
        ends, held, at = [], [], 0
        while at < len(times):
            if reset_at < 0 or times[at] > reset_at:
                if reset_at >= 0:
                    ends.append(reset_at)
                    held.append(count if at == 0 else int(counts[at - 1]))
                reset_at = int(times[at]) + self.window_us
            at = max(int(np.searchsorted(times, reset_at, side="right")), at + 1)
        return ends, held

    def _ended(self, key, ends: list[int], held: list[int]) -> pd.DataFrame:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return self._frame(key, none, none, np.zeros(0, bool), np.zeros(0, np.int32), ends, held)

    def _frame(self, key, late, decided, allowed: np.ndarray, counts: np.ndarray, ends: list[int], held: list[int]) -> pd.DataFrame:
        """Rows of OUTPUT: late ones and decided ones (times, ids), and the ends of windows with what they held."""
        n_late, n_decided, n_ended = len(late[0]), len(decided[0]), len(ends)
        kinds = np.repeat(np.array(["late", "verdict", "closed"], dtype=object), (n_late, n_decided, n_ended))
        joined = lambda a, b, c, kind: np.concatenate((a, b, c)).astype(kind)
        ids = np.concatenate((late[1], decided[1], np.zeros(n_ended, np.int64)))
        no_id = pd.isna(ids) | (kinds == "closed")
        times = joined(late[0], decided[0], np.array(ends, np.int64), np.int64)
        return pd.DataFrame({
            "key": str(key[0]), "event_id": pd.arrays.IntegerArray(np.where(no_id, 0, ids).astype(np.int64), no_id),
            "ts": times.view("datetime64[us]").astype("datetime64[ns]"),
            "allowed": pd.arrays.BooleanArray(joined(np.zeros(n_late, bool), allowed, np.zeros(n_ended, bool), bool), kinds != "verdict"),
            "n_in_window": pd.arrays.IntegerArray(joined(np.zeros(n_late), counts, np.array(held, np.int32), np.int32), kinds == "late"),
            "kind": kinds})

    def close(self) -> None:
        pass


def anchored_quota(events: DataFrame, window_ms: int = WINDOW_MS, limit: int = QUOTA) -> DataFrame:
    """Rows of OUTPUT for events (key, event_id, ts), by kind.

    verdict: an event in the order of its key. late: an event that came after a later one of its key was decided, or after its
    key's window was over and forgotten (streams only); it has no verdict and is not lost. closed: a window whose end lies before
    the largest time of all keys, with its end and what it held.

    The clock is that largest time. A stream tells it to the timers as a watermark without delay on a column that is dropped
    before the state, so no row is filtered as late; a timer reports an idle key's window and clears its state. A static table
    is sorted by key and time first, so a busy key flows through in order and is never held; a stream is held per micro-batch.
    """
    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    clock = None
    if events.isStreaming:
        rows = rows.withColumn("_clock", F.col("ts")).withWatermark("_clock", "0 seconds").select("key", "event_id", "ts")
    else:
        clock = rows.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
        rows = rows.repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=QuotaProcessor(window_ms * 1000, limit, clock),
        outputStructType=OUTPUT, outputMode="Append", timeMode="None" if clock is not None else "EventTime")


def use_state_store(spark) -> None:
    """The keyed state needs the RocksDB store; asking for the active streams starts its coordinator."""
    _ = spark.streams.active
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
