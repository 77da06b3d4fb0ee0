"""The longest-common-block ratio of two texts, for pairs that a bound inside Spark doesn't rule out."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in the longest common block, and recursively in those left and right of it, by both lengths; null for a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def shared_characters(a: Column, b: Column) -> Column:
    """Characters that both texts hold, with repetition."""
    own = lambda text, c: F.length(text) - F.length(F.replace(text, c))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(own(a, c), own(b, c))))


def block_bound(a: Column, b: Column) -> Column:
    """No block ratio is above this: blocks hold only characters of both texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2 * shared_characters(a, b) / both)


def block_pairs(pairs: DataFrame, a: str, b: str, least: float, score: str = "score") -> DataFrame:
    """The pairs whose block ratio is `least` or more, with the ratio; pairs below the bound never reach Python. Pairs with a null go."""
    near = pairs.filter(block_bound(F.col(a), F.col(b)) >= least - 1e-12)
    return near.withColumn(score, block_ratio(F.col(a), F.col(b))).filter(F.col(score) >= least)
