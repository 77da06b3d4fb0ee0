"""Bounded training samples and folds shared by the trained operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % n


def first_by_hash(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most n rows, the same for any partitioning: those whose ids have the smallest hashes."""
    return rows.orderBy(F.xxhash64(column), column).limit(n)


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded table of ids (columns doc_id, ...); `ids` is sent to all tasks, the texts stay where they are."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
