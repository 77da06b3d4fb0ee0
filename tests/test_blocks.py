"""The longest-block ratio against a plain recursion, and its bound."""

import random

from pyspark.sql import functions as F

from mediagrain.functions import blocks as B
from mediagrain.plans import textual


def plain(a, b):
    """Matched characters: the longest common block (first in a, then in b), and what stands left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return k + plain(a[:i], b[:j]) + plain(a[i + k :], b[j + k :]) if k else 0


def ratio(a, b):
    return 2 * plain(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_ratio_and_bound(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("abxcd", "abcd"), ("été", "ete"), (None, "a"), ("a", None)]
    for _ in range(150):
        a = "".join(rng.choice("abc d") for _ in range(rng.randrange(14)))
        b = "".join(c for c in a if rng.random() < 0.8) + rng.choice(["", "x", "ab"])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", B.block_ratio(F.col("a"), F.col("b")).alias("r"), B.block_bound(F.col("a"), F.col("b")).alias("bound")).collect():
        if r.a is None or r.b is None:
            assert r.r is None or r.r != r.r
        else:
            assert abs(r.r - ratio(r.a, r.b)) < 1e-9 and r.bound >= r.r - 1e-9, r
    got = {(r.a, r.b) for r in B.block_pairs(df, "a", "b", 0.8).collect()}
    assert got == {(a, b) for a, b in pairs if a is not None and b is not None and ratio(a, b) >= 0.8 - 1e-12}


def test_pairs_below_the_bound_never_reach_python(spark):
    df = spark.createDataFrame([("abc", "xyz"), ("abcd", "abce")], "a string, b string")
    plan = B.block_pairs(df, "a", "b", 0.7)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("ArrowEvalPython")
    assert "Filter" in plan[at:], "the bound is judged below the Python step"
    assert [r.b for r in B.block_pairs(df, "a", "b", 0.7).collect()] == ["abce"]


def test_query(spark):
    got = textual.Q["sim1b_block_ratio"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 20
    for r in got[:200]:
        assert abs(r.score - ratio(r.title1, r.title2)) < 1e-5 and r.score >= 0.7
