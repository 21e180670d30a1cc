"""Timers and audits over unbounded input: state a key, cleared by its own timer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that timers need, for streams started inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Recovery(StatefulProcessor):
    """Waits for a key's closing event from its first event on.

    (key, outcome, at, events): closed at the closing event, or expired at the end of the wait; events counts those up to then. While a key waits, its state
    is the times of its events; after that only that it is settled, and that goes too when the watermark has passed twice the wait, after which
    a key starts anew. State thus grows with the keys of two waits, not with the stream.
    """

    def __init__(self, closing: str, wait_ms: int) -> None:
        self.closing, self.wait_ms = closing, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, settled boolean")
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, settled = self.first.get() if self.first.exists() else (None, False)
        if settled:
            return
        new, close = [], None
        for r in rows:
            new.append(r.at)
            if r.event_type == self.closing:
                close = r.at if close is None else min(close, r.at)
        known = [t[0] for t in self.times.get()] if first is not None else []
        start = min(known + new)
        if start != first:
            if first is not None:
                self.handle.deleteTimer(first + self.wait_ms)
            self.handle.registerTimer(start + self.wait_ms)
        if close is not None and close <= start + self.wait_ms:
            yield Row(key=key[0], outcome="closed", at=close, events=sum(t <= close for t in known + new))
            self._settle(start)
            return
        self.first.update((start, False))
        self.times.appendList([(t,) for t in new])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        start, settled = self.first.get()
        if settled:
            self.first.clear()
            return
        end = start + self.wait_ms
        yield Row(key=key[0], outcome="expired", at=end, events=sum(t[0] <= end for t in self.times.get()))
        self._settle(start)

    def _settle(self, start: int) -> None:
        self.times.clear()
        self.first.update((start, True))
        self.handle.deleteTimer(start + self.wait_ms)
        self.handle.registerTimer(start + 2 * self.wait_ms)

    def close(self) -> None:
        """Nothing is held outside the state store."""


def recoveries(events: DataFrame, key: str, closing: str, wait_ms: int, lateness: str) -> DataFrame:
    """(key, outcome, at, events) of a stream with ts and event_type."""
    rows = events.withWatermark("ts", lateness).select(F.col(key).alias("key"), "ts", F.unix_millis("ts").alias("at"), "event_type")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(Recovery(closing, wait_ms), f"key {kind}, outcome string, at long, events long", "append", "eventTime")


def schedule_audit(ticks: DataFrame, schedules: DataFrame, key: str) -> DataFrame:
    """Each tick of a stream against the static schedules (key, start_min, interval_min, enabled): due, waiting, off or unscheduled, with the slot it falls in."""
    minute = (F.unix_seconds("ts") / 60).cast("long")
    into = F.pmod(minute, F.lit(1440)) - F.col("start_min")
    slot = F.when(into >= 0, F.floor(into / F.col("interval_min")))
    decision = F.when(F.col("interval_min").isNull(), "unscheduled").when(~F.col("enabled"), "off").when(into < 0, "waiting").otherwise("due")
    return ticks.join(schedules, key, "left").select(*ticks.columns, decision.alias("decision"), F.when(decision == "due", slot).cast("long").alias("slot"))
