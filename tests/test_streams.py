"""A stream gives what its batch twin gives; late and out-of-order events; state of the ordered fold."""

import pytest
from pyspark.sql import functions as F

from mediagrain.sources.catalog import load
from mediagrain.streaming import events as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def run(df, spark, tmp_path, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.sql("SELECT * FROM out")


def log(df):
    return df.select("event_id", (F.col("user_id") % 4).alias("api"), (F.col("event_type") != "error").alias("ok"), "ts", "value")


def test_rate_windows(spark, folder, tmp_path):
    got = run(S.rate_windows(log(S.events_stream(spark, folder)), "1 hour", None, 2), spark, tmp_path)
    want = S.rate_windows(load(spark, SF).api_log, "1 hour", None, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_adaptive_limits_are_folded_in_order(spark, folder, tmp_path):
    stream = log(S.events_stream(spark, folder, 10))
    got = run(S.adaptive_limits_stream(stream), spark, tmp_path, "update")
    last = {(r.api, r.day): r.lim for r in got.collect()}
    want = {(r.api, r.day): r.lim for r in S.adaptive_limits(load(spark, SF).api_log).collect()}
    assert last == want


def test_duplicates_within_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:10:00"), (3, "b", "2024-01-01 00:05:00")], "id long, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(path)
    got = run(S.first_arrivals(S.events_stream(spark, path), ["k"]), spark, tmp_path, "append")
    assert sorted(r.k for r in got.collect()) == ["a", "b"]


def test_session_gap(spark):
    """An event at exactly the gap still belongs to the session, one a second later doesn't."""
    times = ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 00:10:01", "2024-01-01 00:20:00"]
    df = spark.createDataFrame([(1, t) for t in times], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in S.activity_sessions(df, "k").collect()) == [1, 1, 2]
