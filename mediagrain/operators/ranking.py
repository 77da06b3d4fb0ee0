"""Set operations, ordered de-duplication, top-k, modal values, running statistics and series."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagrain.operators.components import shared_folder


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def add_absent(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    return df.unionByName(more.join(df.select(key), key, "left_anti"))


def set_overlap(a: Column, b: Column) -> Column:
    """(shared, all) sizes of two arrays as sets."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("together"))


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_in_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def modal(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group (ties: the smallest), with its count."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("x")).select(*group, F.col(f"x.{value}").alias(value), (-F.col("x.m")).alias("n"))


def share_of_total(df: DataFrame, group: str) -> DataFrame:
    """Count and percentage of all rows of each value; the total is a one-row aggregate."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(group, "n", F.round(100.0 * F.col("n") / F.col("_all"), 4).alias("pct"))


def running_mean(df: DataFrame, group: str, order: list[str], value: str, places: int = 6) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.round(F.avg(value).over(w), places))


def last_k(df: DataFrame, group: list[str], order: list, value: str, k: int, name: str = "latest") -> DataFrame:
    """The first k values of each group in the given order, as an array; no task holds more than k rows of a group at once."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    top = df.withColumn("_rn", rank).filter(F.col("_rn") <= k)
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", value))), lambda x: x[value]).alias(name))


def global_rank(df: DataFrame, *order) -> DataFrame:
    """Adds rank, 1 to n over the whole table: ranges of the order are numbered by themselves, then shifted by the rows before them."""
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def exponential_mean(df: DataFrame, group: str, order: list[str], value: str, chunk: str = "hour") -> DataFrame:
    """The fold m = (m + x) / 2 from the first value on.

    A run of values maps m to scale * m + offset, and so do runs of runs: the values of a `chunk` (a unit of the first
    order column, a time) are folded first, so that no row holds a whole group.
    """
    step = lambda s, x: F.struct((s["scale"] / 2).alias("scale"), ((s["offset"] + x[value]) / 2).alias("offset"))
    unit = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    parts = df.groupBy(group, F.date_trunc(chunk, order[0]).alias("_at")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias(value)))).alias("xs"))
    parts = parts.select(group, "_at", F.col("xs")[0][value].alias("_first"), F.aggregate("xs", unit, step).alias("_run"))
    runs = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", "_first", "_run"))).alias("xs"))
    return runs.select(group, F.aggregate("xs", F.col("xs")[0]["_first"], lambda m, x: m * x["_run"]["scale"] + x["_run"]["offset"]).alias("ema"))


def recent_trend(df: DataFrame, group: str, order: list[str], value: str, k: int = 10) -> DataFrame:
    """Mean of the last k values against that of the k before them."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in order)))
    top = df.withColumn("_rn", rank).filter(F.col("_rn") <= 2 * k)
    out = top.groupBy(group).agg(F.avg(F.when(F.col("_rn") <= k, F.col(value))).alias("recent"), F.avg(F.when(F.col("_rn") > k, F.col(value))).alias("previous"))
    trend = F.when(F.col("recent") > F.col("previous"), "up").when(F.col("recent") < F.col("previous"), "down").otherwise("flat")
    return out.select(group, F.round("recent", 6).alias("recent"), F.round("previous", 6).alias("previous"), trend.alias("trend"))


def first_last(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """First and last value of each group and whether it rose, fell or stayed."""
    at = F.struct(*order)
    out = df.groupBy(group).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    return out.withColumn("trend", F.when(F.col("last_value") > F.col("first_value"), "improving").when(F.col("last_value") < F.col("first_value"), "declining").otherwise("stable"))


def islands(df: DataFrame, group: str, order: list[str], at: str, value: str, deviations: float = 0.5, least_seconds: float = 0.5) -> DataFrame:
    """Runs of consecutive rows whose value is above the group's mean and so many standard deviations: start, end, rows and seconds of those longer than `least_seconds`.

    A run ends where the next row that isn't above it stands (the last one at its last row).
    """
    bounds = df.groupBy(group).agg((F.avg(value) + deviations * F.stddev_pop(value)).alias("_bound"))
    w = Window.partitionBy(group).orderBy(*order)
    df = df.join(bounds, group).withColumn("_on", F.col(value) > F.col("_bound")).withColumn("_next", F.lead(at).over(w))
    df = df.withColumn("_new", (F.col("_on") != F.coalesce(F.lag("_on").over(w), ~F.col("_on"))).cast("int"))
    df = df.withColumn("_island", F.sum("_new").over(w)).filter("_on")
    out = df.groupBy(group, "_island").agg(F.min(at).alias("started"), F.max(F.coalesce("_next", at)).alias("ended"), F.count("*").alias("n"))
    out = out.withColumn("seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))
    return out.filter(F.col("seconds") > least_seconds).drop("_island")


def intervals(df: DataFrame, group: str, order: list[str], at: str) -> DataFrame:
    """Mean and deviation of the gaps between events, regularity 1 - std / mean, events per hour and a style label."""
    at_us = F.unix_micros(F.col(at).cast("timestamp"))
    gap = (at_us - F.lag(at_us).over(Window.partitionBy(group).orderBy(*order))) / 1e6
    out = df.withColumn("_gap", gap).groupBy(group).agg(F.avg("_gap").alias("mean_gap"), F.stddev_pop("_gap").alias("std_gap"), F.count("*").alias("n"), ((F.max(at_us) - F.min(at_us)) / 1e6).alias("span"))
    regular = 1 - F.col("std_gap") / F.nullif(F.col("mean_gap"), F.lit(0.0))
    density = 3600 * F.col("n") / F.nullif(F.col("span"), F.lit(0.0))
    style = F.when(F.col("std_gap") < 0.1 * F.col("mean_gap"), "regular").when(F.col("std_gap") > 0.3 * F.col("mean_gap"), "irregular").otherwise("moderate")
    return out.select(group, "n", F.round("mean_gap", 4).alias("mean_gap"), F.round("std_gap", 4).alias("std_gap"), F.round(regular, 6).alias("regularity"), F.round(density, 6).alias("per_hour"), style.alias("style"))


def daily(df: DataFrame, at: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(at).alias("day")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
