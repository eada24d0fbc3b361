"""Structured Streaming versions of periodic refreshes: a time-limited cache, windows, and snapshot updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_writes(events: DataFrame, keys: list[str], ttl_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """A cache over a stream: for each key its latest write and when that expires, updated per micro-batch.

    State for a key is two numbers; it goes when event time passes the expiry. events has a timestamp ts.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, writes = state.get if state.exists else (0, 0)
        for batch in batches:
            last = max(last, int(batch["ts"].max().value // 1000))
            writes += len(batch)
        state.update((last, writes))
        expires = last // 1000 + ttl_seconds * 1000
        if expires > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expires)
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "last_ts": [pd.Timestamp(last, unit="us")], "expires": [pd.Timestamp(expires, unit="ms")], "writes": [writes]})

    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    grouped = events.withWatermark("ts", watermark).groupBy(*keys)
    return grouped.applyInPandasWithState(update, f"{kinds}, last_ts timestamp, expires timestamp, writes long", "last_us long, writes long", "update", GroupStateTimeout.EventTimeTimeout)


def expiring(events: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """A cache whose entries go by themselves: for each key a row (writes, state `live`) at each write, and one (state `gone`)
    when ttl_seconds of processing time have passed without another.

    The entry is a value with a time to live, so the store itself forgets it; a timer of the key tells when, without a new
    event of the key. events has a timestamp ts. Needs the RocksDB state store.
    """
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    class Entry(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.writes = handle.getValueState("writes", "writes long", ttl_seconds * 1000 + 60_000)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # what the timer has not yet told counts on
            writes = (self.writes.get()[0] if self.writes.exists() else 0) + sum(map(len, rows))
            self.writes.update((writes,))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + ttl_seconds * 1000)
            yield self._row(key, writes, "live")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            writes = self.writes.get()[0] if self.writes.exists() else 0
            self.writes.clear()
            yield self._row(key, writes, "gone")

        def _row(self, key, writes: int, state: str) -> pd.DataFrame:
            return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "writes": [writes], "state": [state]})

        def close(self) -> None:
            pass

    return events.groupBy(*keys).transformWithStateInPandas(Entry(), f"{kinds}, writes long, state string", "update", "processingTime")


def windows(events: DataFrame, length: str, slide: str | None = None, watermark: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts per event-time window (tumbling, or sliding); events later than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", watermark).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Counts per session: events of a key with gaps of less than gap."""
    counted = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def refresh(stream: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str):
    """Run once over what is new and hand it to publish as one table per micro-batch: a scheduled refresh."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: publish(batch)).start()
