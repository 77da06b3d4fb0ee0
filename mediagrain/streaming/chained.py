"""Stateful steps one after the other: windows over windows, the day before from state, and a kept table of snapshots."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mediagrain.operators.components import removed, written
from mediagrain.streaming.events import LATE, daily_means, timed


def overall_progress_windows(events: DataFrame, least: int, length: str = "1 day", late: str = LATE) -> DataFrame:
    """Per session and window over its steps (session, status, found, ts): done, total, percentage and seconds left at the pace so far.

    Steps are counted in a first window; the second one goes over the first's rows by their window's time. On a
    stream both append, when the watermark has passed the window.
    """
    w = F.window("ts", length)
    steps = timed(events, late).groupBy(w.alias("w"), "session", "status").agg(F.count_if(F.col("found") > least).alias("done"), F.count("*").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    over = steps.withColumn("at", F.window_time("w")).groupBy(F.window("at", length).alias("v"), "session")
    out = over.agg(F.sum("done").alias("done"), F.sum("total").alias("total"), F.count("*").alias("steps"), (F.unix_timestamp(F.max("last")) - F.unix_timestamp(F.min("first"))).alias("elapsed"))
    left = F.try_divide(F.col("elapsed") * (F.col("total") - F.col("done")), F.col("done"))
    return out.select("session", F.col("v.start").alias("started"), "steps", "done", "total", F.round(F.try_divide(100.0 * F.col("done"), F.col("total")), 4).alias("pct"), F.round(left, 4).alias("eta_seconds"))


class DayBefore(StatefulProcessor):
    """The mean of the last day; rows come when their day is over, so in order from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day")
        before = self.mean.get()[0] if self.mean.exists() else None
        trends = []
        for mean in days["mean"]:
            trends.append("stable" if before is None or mean == before else "improving" if mean > before else "declining")
            before = float(mean)
        self.mean.update((before,))
        yield days.assign(trend=trends)[["day", "mean", "n", "trend"]]

    def close(self) -> None:
        pass


def daily_trend_stream(events: DataFrame, value: str) -> DataFrame:
    """`events.daily_trend` on a stream (append mode): a day's row when it is over; the one key has a row a day."""
    days = daily_means(events, value).withColumn("all", F.lit(0))
    return days.groupBy("all").transformWithStateInPandas(DayBefore(), "day date, mean double, n long, trend string", "Append", "None")


class SnapshotTable:
    """A Parquet table of the last `keep` snapshots (key, started, n) of each key, fed by the batches of a stream.

    Keys are dealt out to `buckets` folders. A batch rewrites only the folders of its own keys (dynamic partition
    overwrite): the newest value of each (key, started) wins, then the last `keep` stay. So a batch that is run
    anew, or twice, changes nothing.
    """

    def __init__(self, path: str, key: str, buckets: int = 16, keep: int = 100):
        self.path, self.key, self.buckets, self.keep = path, key, buckets, keep

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)

    def save(self, batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, self.key
        new = batch.select(key, "started", "n", F.lit(number).cast("long").alias("batch"), F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket"))
        new = written(new, "snapshots")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            old = self._old(spark, new.schema).filter(F.col("bucket").isin(touched))
            newest = old.unionByName(new).groupBy(key, "started", "bucket").agg(F.max_by(F.struct("n", "batch"), "batch").alias("x")).select(key, "started", "x.*", "bucket")
            rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("started")))
            kept = written(newest.withColumn("rank", rank).filter(F.col("rank") <= self.keep).drop("rank"), "snapshots")  # not read while it is written
            kept.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(self.path)
            removed(spark, kept.inputFiles()[0].rsplit("/", 1)[0])
        removed(spark, new.inputFiles()[0].rsplit("/", 1)[0])

    def _old(self, spark, schema) -> DataFrame:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(self.path) if there else spark.createDataFrame([], schema)

    def run(self, snapshots: DataFrame, checkpoint: str, mode: str = "update") -> None:
        """Feeds a stream of snapshots over what there is now."""
        snapshots.writeStream.outputMode(mode).foreachBatch(self.save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
