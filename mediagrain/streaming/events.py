"""Request rates, activity sessions, session states, cache views, progress, alerts and log summaries.

The functions take a streaming or a static DataFrame of events with a timestamp `ts` and return an
aggregated one, to be written in update or append mode. State is bounded by the watermark `late`: what is
grouped by key alone on a table is, on a stream, also grouped by a period `keep`, after which it is freed.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediagrain.operators.ranking import recent_trend

LATE = "1 hour"


def events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream over a growing folder of Parquet event files."""
    schema = spark.read.parquet(folder).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def timed(df: DataFrame, late: str = LATE) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if df.isStreaming else df


def rate_windows(requests: DataFrame, length: str = "1 minute", slide: str | None = None, limit: int = 30) -> DataFrame:
    """Requests of each api in each window, and whether they exceed the limit."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = timed(requests).groupBy(w.alias("w"), "api").agg(F.count("*").alias("n"))
    return out.select("api", F.col("w.start").alias("started"), "n", (F.col("n") > limit).alias("exceeded"))


def activity_sessions(events: DataFrame, key: str, gap: str = "5 minutes") -> DataFrame:
    """Sessions of a key that end after `gap` without events."""
    out = timed(events).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


KEEP = "30 days"


def by_period(df: DataFrame, keep: str, *keys: str):
    """The rows grouped by key; on a stream by key and period, so that a key's state ends with its period."""
    return df.groupBy(*keys, F.window("ts", keep).alias("period")) if df.isStreaming else df.groupBy(*keys)


def latest_states(events: DataFrame, key: str, keep: str = KEEP) -> DataFrame:
    """Latest status, first and last time and number of failures of each key (update mode)."""
    return by_period(timed(events), keep, key).agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("status") == "failed").alias("failures"))


def session_machine(events: DataFrame) -> DataFrame:
    """Per session: latest status, restarts (going on after a failure), pauses, seconds from the first to the last event, and whether it is over."""
    w = Window.partitionBy("session").orderBy("ts", "id")
    df = events.withColumn("before", F.lag("status").over(w))
    restart = (F.col("before") == "failed") & F.col("status").isin("in_progress", "created")
    out = df.groupBy("session").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.count_if(restart).alias("restarts"), F.count_if((F.col("status") == "paused") & ~F.col("before").eqNullSafe(F.lit("paused"))).alias("pauses"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return out.withColumn("over", F.col("status").isin("completed", "failed"))


def cache_hits(requests: DataFrame, days: int = 7) -> DataFrame:
    """Reads of each day that found a write of their key at most `days` old, and those that didn't. requests: key, ts, event_id, kind (read or write)."""
    w = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("kind") == "write", F.col("ts"))).over(w)
    df = requests.withColumn("hit", F.coalesce(last > F.col("ts") - F.make_interval(days=F.lit(days)), F.lit(False))).filter("kind = 'read'")
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def overall_progress(steps: DataFrame) -> DataFrame:
    """Per session over its steps (session, step, done, total, first, last): percentage done and the seconds left at the pace so far."""
    out = steps.groupBy("session").agg(F.sum("done").alias("done"), F.sum("total").alias("total"), (F.unix_timestamp(F.max("last")) - F.unix_timestamp(F.min("first"))).alias("elapsed"))
    left = F.try_divide(F.col("elapsed") * (F.col("total") - F.col("done")), F.col("done"))
    return out.select("session", "done", "total", F.round(F.try_divide(100.0 * F.col("done"), F.col("total")), 4).alias("pct"), F.round(left, 4).alias("eta_seconds"))


def snapshots(metrics: DataFrame, key: str, keep: int = 100, k: int = 10) -> DataFrame:
    """Per key the last `keep` snapshots (key, started, n): their number and mean, and the trend of the last k against the k before."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("started")))
    kept = metrics.withColumn("_rn", rank).filter(F.col("_rn") <= keep)
    size = kept.groupBy(key).agg(F.count("*").alias("kept"), F.round(F.avg("n"), 6).alias("mean"))
    return size.join(recent_trend(kept.drop("_rn"), key, ["started"], "n", k), key)


def daily_trend(events: DataFrame, value: str) -> DataFrame:
    """Daily means with the change from the day before (one row a day: the window over all days is small)."""
    days = daily_means(events, value)
    before = F.lag("mean").over(Window.orderBy("day"))
    return days.withColumn("trend", F.when(before.isNull() | (F.col("mean") == before), "stable").when(F.col("mean") > before, "improving").otherwise("declining"))


def size_alerts(entries: DataFrame, most: int) -> DataFrame:
    """Days on which the written data exceed a size."""
    out = timed(entries).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("writes"))
    return out.filter(F.col("bytes") > most).select(F.to_date("w.start").alias("day"), "bytes", "writes")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is now and writes it as Parquet: each batch a folder, once, so that a batch that is run anew replaces its own."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cache_view(entries: DataFrame, keep: str = KEEP) -> DataFrame:
    """Last write of each key and when it expires."""
    return by_period(timed(entries.withColumn("ts", F.col("created_at"))), keep, "key").agg(F.max_by("data", F.struct("ts", "event_id")).alias("data"), F.max("ts").alias("written"), F.max("expires_at").alias("expires_at"), F.count("*").alias("writes"))


def progress(events: DataFrame, keep: str = KEEP) -> DataFrame:
    """Latest completed number of each step of a session."""
    return by_period(timed(events), keep, "session", "status").agg(F.max_by("found", F.struct("ts", "id")).alias("latest"), F.max("found").alias("best"))


def first_arrivals(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose key hasn't come within the watermark (a stream) or at all (a table)."""
    df = timed(records)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def daily_means(events: DataFrame, value: str) -> DataFrame:
    out = timed(events).groupBy(F.window("ts", "1 day").alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), F.round("mean", 6).alias("mean"), "n")


def alerts(events: DataFrame, least_failures: int = 3) -> DataFrame:
    """Hours of a session with several failures."""
    out = timed(events.filter("status = 'failed'")).groupBy(F.window("ts", "1 hour").alias("w"), "session").agg(F.count("*").alias("failures"))
    return out.filter(F.col("failures") >= least_failures).select("session", F.col("w.start").alias("started"), "failures")


def log_summary(events: DataFrame) -> DataFrame:
    """Per api and day: entries, errors and slow operations."""
    out = timed(events).groupBy(F.window("ts", "1 day").alias("w"), "api").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(F.col("value") > 50).alias("slow"))
    return out.select("api", F.to_date("w.start").alias("day"), "n", "errors", "slow")


def adapted(multiplier: float, ok: bool) -> float:
    """A failure takes a fifth off (not below 0.1), a success adds a fiftieth (not above 1)."""
    return min(1.0, multiplier * 1.02) if ok else max(0.1, multiplier * 0.8)


def adaptive_limits(requests: DataFrame, base: int = 60) -> DataFrame:
    """The limit of each api after all its requests of a day in order: max(1, int(base * multiplier)).

    Each request scales and clamps the multiplier, and so does a run of requests: the runs of a minute are folded
    first, then those of a day, so that no row holds more than a minute's requests or a day's minutes.
    """
    step = lambda s, x: F.when(
        x["ok"], F.struct((s["by"] * 1.02).alias("by"), F.least(F.lit(1.0), s["lo"] * 1.02).alias("lo"), F.least(F.lit(1.0), s["hi"] * 1.02).alias("hi"))
    ).otherwise(F.struct((s["by"] * 0.8).alias("by"), F.greatest(F.lit(0.1), s["lo"] * 0.8).alias("lo"), F.greatest(F.lit(0.1), s["hi"] * 0.8).alias("hi")))
    unit = F.struct(F.lit(1.0).alias("by"), F.lit(0.0).alias("lo"), F.lit(1e300).alias("hi"))
    runs = requests.groupBy("api", F.date_trunc("minute", "ts").alias("minute")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "ok"))).alias("xs"))
    runs = runs.select("api", F.to_date("minute").alias("day"), "minute", F.aggregate("xs", unit, step).alias("run"))
    rows = runs.groupBy("api", "day").agg(F.array_sort(F.collect_list(F.struct("minute", "run"))).alias("xs"))
    m = F.aggregate("xs", F.lit(1.0), lambda m, x: F.least(x["run"]["hi"], F.greatest(x["run"]["lo"], m * x["run"]["by"])))
    return rows.select("api", "day", F.greatest(F.lit(1), (base * m).cast("int")).alias("lim"))


def adaptive_limits_stream(requests: DataFrame, base: int = 60) -> DataFrame:
    """The same fold on a stream, with one number of state for each (api, day); idle keys time out after the watermark."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        m = state.get[0] if state.exists else 1.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ok in rows["ok"]:
            m = adapted(m, bool(ok))
        state.update((m,))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 86_400_000)
        yield pd.DataFrame({"api": [key[0]], "day": [key[1]], "lim": [max(1, int(base * m))]})

    df = timed(requests).withColumn("day", F.to_date("ts"))
    return df.groupBy("api", "day").applyInPandasWithState(fold, "api long, day date, lim int", "m double", "update", GroupStateTimeout.EventTimeTimeout)
