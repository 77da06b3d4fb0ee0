"""Ordered leader groups: rows are taken in an order, and a row that is like a kept row before it joins the first such row.

Likeness isn't transitive, so these are no components: in a ~ b ~ c with a unlike c, both a and c are kept.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagrain.operators.components import removed, shared_folder, written


def leader_groups(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, leader) of every id of `edges` (a, b: like rows) that isn't kept; the ids' own order is the order of the rows (a struct sorts by its fields).

    The kept ids are the lexicographically first independent set. In each round the ids without an undecided
    earlier neighbour are kept and their later neighbours drop out: two joins on the edges that are left, so
    the rounds are as many as the longest chain of ever later like rows needs (half of its length). An id's
    leader is its earliest kept neighbour. Repeated edges and loops don't matter; edges with a null are left out.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    ordered = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    every = written(ordered.distinct(), "edges")
    left, gone = every, None
    for _ in range(rounds):
        if left.isEmpty():
            break
        waiting = left.select(F.col("b").alias("a")).distinct()
        kept = left.select("a").distinct().join(waiting, "a", "left_anti")
        dropped = written(left.join(kept, "a").select("b").distinct(), "dropped")
        gone = dropped if gone is None else gone.unionByName(dropped)
        out = dropped.select(F.col("b").alias("a"))
        before, left = left, written(left.join(dropped, "b", "left_anti").join(out, "a", "left_anti"), "left")
        if before is not every:
            removed(spark, _folder(before))
    else:
        raise RuntimeError(f"leader groups did not settle in {rounds} rounds")
    if gone is None:
        return every.select(F.col("b").alias("id"), F.col("a").alias("leader")).filter("false")
    follows = every.join(gone, "b").join(gone.select(F.col("b").alias("a")), "a", "left_anti")
    return follows.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))


def _folder(table: DataFrame) -> str:
    return table.inputFiles()[0].rsplit("/", 1)[0]
