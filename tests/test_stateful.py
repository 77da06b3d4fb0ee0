"""Ordered folds on a stream: equal to their batch twins whatever the order of arrival; state is freed; a restart goes on."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediagrain.sources.catalog import load
from mediagrain.streaming import events as S
from mediagrain.streaming import stateful as T

SF = "/root/testdata/sf0.001"
END = 4_102_444_800  # an event of 2100 moves the watermark past all others


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    T.with_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def batches(spark, path):
    return spark.read.parquet(path)


def shuffled(df, path, parts=3):
    """Files whose order of arrival has nothing to do with the order of time, so that the watermark must wait for all (`late`)."""
    for i in range(parts):
        df.filter(F.pmod(F.hash("ts"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)


def last_rows(spark, path, key):
    rows = {}
    for r in batches(spark, path).orderBy("batch").collect():
        rows[r[key]] = r
    return rows


def test_sessions_out_of_order_and_after_a_restart(spark, tmp_path):
    events = load(spark, SF).sessions.select("session", "id", "status", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    path, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: S.write_stream(T.session_machine_stream(stream(spark, path, events.schema), late="400 days"), out, mark, "update")
    shuffled(events.filter("id % 2 = 0"), path)
    run()
    shuffled(events.filter("id % 2 = 1"), path)  # a new query from the old checkpoint
    end = spark.createDataFrame([(-1, -1, "created", END)], "session long, id long, status string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    end.select(events.columns).coalesce(1).write.mode("append").parquet(path)
    run()
    got = last_rows(spark, out, "session")
    want = {r.session: r for r in S.session_machine(events).collect()}
    assert {k: tuple(got[k][c] for c in T.SessionFold.out) for k in got if k != -1} == {k: tuple(r[c] for c in T.SessionFold.out) for k, r in want.items()}


def test_hits_and_misses_of_late_events(spark, tmp_path):
    k = load(spark, SF)
    requests = k.cache.select("key", F.col("created_at").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_id") % 4 == 0, "write").otherwise("read").alias("kind"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    shuffled(requests, path)
    for i in (0, 1):  # the second moves the watermark of what the first fold gives
        end = spark.createDataFrame([("end", END + i * 10**9, i, "read")], "key string, ts long, event_id long, kind string").withColumn("ts", F.timestamp_seconds("ts"))
        end.coalesce(1).write.mode("append").parquet(path)
    S.write_stream(T.cache_hits_stream(stream(spark, path, requests.schema), late="400 days"), out, str(tmp_path / "cp"))
    got = {r.day: (r.hits, r.misses, r.hit_rate) for r in batches(spark, out).collect() if r.day.year < 2100}
    want = {r.day: (r.hits, r.misses, r.hit_rate) for r in S.cache_hits(requests).collect()}
    assert got == want and len(want) > 5 and any(h for h, _, _ in want.values())


class Value:
    def __init__(self):
        self.x = None

    exists = lambda self: self.x is not None
    get = lambda self: self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None

    put = update

    def appendList(self, xs):
        self.x = [*(self.x or []), *xs]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, Value())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_order_timers_and_freed_state():
    fold, handle = T.SessionFold(1), Handle()
    fold.init(handle)
    s = 1_000_000
    fold.handleInputRows((7,), iter([pd.DataFrame({"at": [30 * s, 10 * s], "id": [3, 1], "what": ["in_progress", "paused"]}), pd.DataFrame({"at": [20 * s, 90 * s], "id": [2, 9], "what": ["failed", "completed"]})]), Mark(0))
    assert handle.timers == [90_001]
    (rows,) = fold.handleExpiredTimer((7,), Mark(31_000), None)
    assert rows.values.tolist() == [[7, "in_progress", 1, 1, 20, False]]
    assert len(handle.states["held"].x) == 1 and handle.timers[-1] == 30_000 + T.DAY_MS
    (rows,) = fold.handleExpiredTimer((7,), Mark(90_001), None)
    assert rows.values.tolist() == [[7, "completed", 1, 1, 80, True]] and handle.states["held"].x is None
    assert list(fold.handleExpiredTimer((7,), Mark(handle.timers[-2]), None)) == [] and handle.states["now"].x is not None  # an old timer
    assert list(fold.handleExpiredTimer((7,), Mark(handle.timers[-1]), None)) == [] and handle.states["now"].x is None


def test_a_write_lasts_its_days():
    fold, handle = T.CacheFold(1), Handle()
    fold.init(handle)
    day = 86_400 * 10**6
    events = [(0, 1, "read"), (1, 2, "write"), (day, 3, "read"), (day + 1, 4, "read"), (day + 2, 5, "write"), (day + 2, 6, "read")]
    fold.handleInputRows(("k",), iter([pd.DataFrame(events[::-1], columns=["at", "id", "what"])]), Mark(0))
    (rows,) = fold.handleExpiredTimer(("k",), Mark(2 * T.DAY_MS), None)
    assert rows["hit"].tolist() == [False, True, False, True]
