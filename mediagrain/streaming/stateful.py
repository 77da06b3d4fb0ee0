"""Folds over a key's events in the order of their time, on a stream: the session machine and the cache's hits and misses.

Events are held back until the watermark has passed them, so their order doesn't depend on how they come in, and
are folded into a small state. A timer frees the state `keep` (or, for the cache, `days`) after the last event that
counts. Late events are dropped by the engine. Both need Spark's RocksDB state store (`with_state_store`).
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mediagrain.streaming.events import LATE, timed

DAY_MS = 86_400_000


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to keep the state of streams in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class InOrder(StatefulProcessor):
    """Holds the events of a key (at: microseconds, id, what) back until the watermark has passed them, then folds them in order.

    A fold has `state` (a schema), `out` (the columns of what it emits), `step(state, event)`, which gives the new state and perhaps a
    row, `after(key, state)`, which gives the rows after a run of events, and `ends(state)`: the time (ms) at which the state is freed.
    """

    state, out = "", []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, what string")
        self.now = handle.getValueState("now", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        at = events["at"].astype("int64")
        self.held.appendList(list(zip(at.tolist(), events["id"].astype("int64").tolist(), events["what"].tolist(), strict=True)))
        self.handle.registerTimer(int(at.max()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get()) if self.held.exists() else []
        due = sorted(x for x in held if x[0] // 1000 < mark)
        state, rows = self.now.get() if self.now.exists() else None, []
        if not due:
            if not held and state is not None and self.ends(state) <= mark:
                self.now.clear()
            return
        for event in due:
            state, row = self.step(state, event)
            rows += [] if row is None else [row]
        rest = [x for x in held if x[0] // 1000 >= mark]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
            self.handle.registerTimer(int(self.ends(state)))
        rows += self.after(state)
        if rows:
            yield pd.DataFrame([(key[0], *row) for row in rows], columns=self.out)

    def after(self, state) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class SessionFold(InOrder):
    state = "status string, first long, last long, restarts long, pauses long"
    out = ["session", "status", "restarts", "pauses", "seconds", "over"]

    def __init__(self, keep_days: int):
        self.keep = keep_days * DAY_MS

    def step(self, state, event):
        at, _, status = event
        before, first, last, restarts, pauses = state or (None, at, at, 0, 0)
        restarts += before == "failed" and status in ("in_progress", "created")
        pauses += status == "paused" and before != "paused"
        return (status, first, max(last, at), restarts, pauses), None

    def after(self, state):
        status, first, last, restarts, pauses = state
        return [(status, restarts, pauses, last // 10**6 - first // 10**6, status in ("completed", "failed"))]

    def ends(self, state):
        return state[2] // 1000 + self.keep


class CacheFold(InOrder):
    """Emits every read, with whether a write at most `days` old stood behind it; the state is the time of the last write."""

    state = "written long"
    out = ["key", "ts", "hit"]

    def __init__(self, days: int):
        self.days = days * DAY_MS

    def step(self, state, event):
        at, _, kind = event
        if kind == "write":
            return (at,), None
        hit = state is not None and at - state[0] < self.days * 1000
        return state, (pd.Timestamp(at, unit="us"), hit)

    def ends(self, state):
        return state[0] // 1000 + self.days


def _events(df: DataFrame, key: str, id_: str, what: str, late: str) -> DataFrame:
    return timed(df, late).select(F.col(key), "ts", F.unix_micros("ts").alias("at"), F.col(id_).cast("long").alias("id"), F.col(what).alias("what"))


def session_machine_stream(events: DataFrame, keep_days: int = 30, late: str = LATE) -> DataFrame:
    """`events.session_machine` on a stream (update mode): a session's row after each run of its events that the watermark has passed."""
    kind = events.schema["session"].dataType.simpleString()
    out = f"session {kind}, status string, restarts long, pauses long, seconds long, over boolean"
    return _events(events, "session", "id", "status", late).groupBy("session").transformWithStateInPandas(SessionFold(keep_days), out, "Update", "eventTime")


def cache_reads(requests: DataFrame, days: int = 7, late: str = LATE) -> DataFrame:
    """(key, ts, hit): every read of a stream of requests (key, ts, event_id, kind), in append mode."""
    return _events(requests, "key", "event_id", "kind", late).groupBy("key").transformWithStateInPandas(CacheFold(days), "key string, ts timestamp, hit boolean", "Append", "eventTime", eventTimeColumnName="ts")


def cache_hits_stream(requests: DataFrame, days: int = 7, late: str = LATE) -> DataFrame:
    """`events.cache_hits` on a stream: a day's row when the watermark has passed the day (append mode)."""
    reads = cache_reads(requests, days, late).groupBy(F.window("ts", "1 day").alias("w"))
    out = reads.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))
    return out.select(F.to_date("w.start").alias("day"), "hits", "misses", "hit_rate")
