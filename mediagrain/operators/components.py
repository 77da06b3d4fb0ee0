"""Shared folders, joins that spread hot keys, and connected components for the operators that need several jobs."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator made itself."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """`df` as a Parquet table in `folder` or the shared one: cuts the lineage and survives lost executors."""
    path = f"{folder or shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, by_key: DataFrame, keys: list[str], most: int = 4096, floor: int = 1000) -> DataFrame:
    """`rows` joined with `by_key`, which has one row for a key and in `n` at least the number of its rows.

    No task gets all rows of a hot key: keys of more than `floor` rows, and of more than one in `most` of all rows,
    are sent to every task (so at most `most` of them); the others are joined by shuffle. Both tables are read more
    than once, so they should be written ones.
    """
    total, top = by_key.agg(F.sum("n"), F.max("n")).first()
    limit = max(floor, (total or 0) // most)
    if (top or 0) <= limit:
        return rows.join(by_key, keys)
    hot = F.broadcast(by_key.filter(F.col("n") > limit))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(by_key.filter(F.col("n") <= limit), keys)
    return rows.join(hot, keys).unionByName(cold)


def sent(rows: DataFrame, megabytes: int = 32) -> DataFrame:
    """A written table for a join with the texts: sent to all tasks if its columns (numbers and short strings) take at most `megabytes`, else shuffled."""
    width = sum(8 if f.dataType.typeName() != "string" else 48 for f in rows.schema)
    return F.broadcast(rows) if rows.count() * width <= megabytes << 20 else rows


def components(edges: DataFrame, rounds: int = 40, spread: int = 1_000_000) -> DataFrame:
    """(id, label) for every id of the edges (a, b): label is the smallest id of its component.

    Alternating large-star and small-star steps until a round changes nothing, that is, until all edges point to
    their smallest id (stars that come in take one round); every round is checkpointed. Only a count and a sum
    reach the driver. A step is a window over an id's edges or, from `spread` edges on, a pre-aggregated minimum
    and a join that spreads the rows of hubs (a large component's smallest id) over the tasks.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(e)
    n = before[0]

    def with_least(rows: DataFrame) -> DataFrame:
        if n < spread:  # a few MB at most, so a hub's rows may meet in one task
            return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return spread_join(rows, least.checkpoint(), ["a"])

    for _ in range(rounds):
        few = max(8, n // 100_000 + 1)  # tasks for the edges there are, not for those of a large table
        both = e.coalesce(few).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        large = with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        if n >= spread:
            large = large.distinct().checkpoint()
        small = with_least(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = small.coalesce(few).checkpoint()
        now = state(e)
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label").unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
