"""Operators that look at whole texts, whole tables and all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediagrain import plans
from mediagrain.operators import lookup, ranking
from mediagrain.operators.components import components, spread_join
from mediagrain.operators.documents import repetition_of_all
from mediagrain.operators.linkage import candidate_pairs, near_pairs
from tests.test_oracle import SF


def test_every_key_is_in_order(spark):
    for name, key in ("q05_tracks_by_artist", "artist_id"), ("q06_albums_by_artist", "artist_id"), ("q07_credits_by_track", "track_id"):
        keys = [r[key] for r in plans.queries()[name](spark, SF).collect()]
        assert keys == sorted(keys) and len(set(keys)) > 100, name


@pytest.mark.parametrize("ratio", [0.9, 0.85, 0.7])
def test_near_pairs_miss_none(spark, ratio):
    rng = random.Random(5)
    names = ["", "a", "b", "ab"]
    for _ in range(25):
        name = "".join(rng.choice("abc ") for _ in range(rng.randrange(6, 60)))
        for edits in range(6):
            x = list(name)
            for _ in range(edits):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
            names.append("".join(x))
    rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    near = lambda d: d.filter(1 - F.levenshtein("name1", "name2") / F.greatest(F.length("name1"), F.length("name2"), F.lit(1)) >= ratio).select("id1", "id2").collect()
    got, want = near(near_pairs(df, [], "id", "name", ratio, common=20)), near(candidate_pairs(df.withColumn("k", F.lit(1)), ["k"], "id", "name"))
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_all_frames_meet(spark):
    far = spark.createDataFrame([(1, i, [1.0, 0.0] if i in (0, 59) else [math.cos(1.6 + i), math.sin(1.6 + i) * 9]) for i in range(60)], "g int, k int, v array<double>")
    v = [np.array(r.v) / np.linalg.norm(r.v) for r in far.collect()]
    want = sum(a @ b > 0.8 for i, a in enumerate(v) for b in v[i + 1 :])
    for block in (7, 512):
        got = repetition_of_all(far, "g", "k", "v", block=block).first()
        assert (got.alike, got.pairs) == (want, 60 * 59 // 2)


def test_pairs_of_far_and_close_directions_take_no_product(spark):
    """Four narrow bundles, a loose one, frames without a direction and a null group; counts stay exact."""
    rng = np.random.default_rng(2)
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(g, i, (axes[i % 4] + rng.normal(size=16) * (0.02 if g == 1 else 0.3)).tolist()) for g in (1, None) for i in range(160)]
    rows += [(1, 900, [0.0] * 16), (1, 901, None), (2, 902, [1.0] * 16), (2, 903, [2.0] * 16), (3, 904, [1.0] * 16)]
    got = {r.g: r for r in repetition_of_all(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v", block=20).collect()}
    for g in (1, None, 2):
        v = [np.array(v) / np.linalg.norm(v) for h, _, v in rows if h == g and v and any(v)]
        n = sum(h == g for h, _, _ in rows)
        assert (got[g].alike, got[g].pairs) == (sum(a @ b > 0.8 for i, a in enumerate(v) for b in v[i + 1 :]), n * (n - 1) // 2), g
    assert got[1].skipped > 0.9 * got[1].pairs and 3 not in got


def test_oldest_rows_go(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "at int, key int").repartition(5)
    for share in (0.0, 0.004, 0.5, 0.77, 1.0):
        left = sorted((r.at, r.key) for r in lookup.evict_oldest(df, share, "at", "key").collect())
        assert left == sorted((i % 7, i) for i in range(100))[int(100 * share) :]


def test_invalidation_by_kind_of_pattern(spark):
    entries = spark.createDataFrame([(k,) for k in ("a:1", "a:12", "b:1", "b:22", "c_1", "cx1", "z:9", "q", "in the middle of", "mid", "x7y", "x77y")], "key string")
    events = spark.createDataFrame([("x", 1), ("x", 12), ("y", 2), ("w", 9), ("v", 0), ("u", 7)], "event string, id long")
    rules = spark.createDataFrame([("x", "a:{id}"), ("y", "b:{id}*"), ("w", "*:{id}"), ("v", "c_?"), ("u", "*middle*"), ("u", "?{id}?")], "event string, pattern string")
    assert sorted(r.key for r in lookup.invalidate(entries, events, rules).collect()) == ["b:1", "cx1", "mid", "q", "x77y"]
    assert lookup.invalidate(entries, events.limit(0), rules).count() == 12


def test_exponential_mean_over_chunks(spark):
    rng = random.Random(3)
    given = [(k, 1_700_000_000 + rng.randrange(90_000), i, rng.random()) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(given, "k string, t long, id int, x double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.k: r.ema for r in ranking.exponential_mean(df, "k", ["ts", "id"], "x").collect()}
    for k in "ab":
        xs = [x for c, t, i, x in sorted(given) if c == k]
        m = xs[0]
        for x in xs[1:]:
            m = (m + x) / 2
        assert abs(got[k] - m) < 1e-12


def test_hubs_and_hot_keys_are_spread(spark):
    edges = [(100, i) for i in range(101, 160)] + [(3, 100), (7, 8), (8, 9), (9, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.label for r in components(df, spread=1).collect()} == {**dict.fromkeys([3, *range(100, 160)], 3), 7: 7, 8: 7, 9: 7}
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("gone", 2)], "k string, i int")
    by = spark.createDataFrame([("hot", 50, "H"), ("cold", 1, "C")], "k string, n long, v string")
    got = spread_join(rows, by, ["k"], most=4, floor=5)
    assert sorted((r.k, r.v) for r in got.collect()) == [("cold", "C")] + [("hot", "H")] * 50
