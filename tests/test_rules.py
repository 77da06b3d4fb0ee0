"""Boundaries of rules and ladders, text examples, round trips of the writers, and layering."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mediagrain.functions import text as T
from mediagrain.operators import linkage, quality
from mediagrain.operators.components import components
from mediagrain.sources import exports

ROOT = Path(__file__).parent.parent


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    "given,want",
    [("  Nekfeu  ", "nekfeu"), ("Étœile & @Æ", "etoeile and atae"), ("", ""), ("!?", ""), ("L'été-là", "l'ete-la")],
)
def test_normalize_text(spark, given, want):
    assert one(spark, T.normalize_text, given) == want


def test_featured(spark):
    x = one(spark, T.extract_featured, "Song (feat. Artist1 & Artist2) [Remix]")
    assert x.title == "Song  [Remix]" and x.artists == ["Artist1", "Artist2"]
    assert one(spark, T.extract_featured, "Song ft. X, Yo").artists == ["Yo"]
    assert one(spark, T.extract_featured, "Song").artists == []


@pytest.mark.parametrize("score,label", [(90, "excellent"), (89.9, "good"), (80, "good"), (79.9, "average"), (70, "average"), (50, "poor"), (49.9, "very_poor")])
def test_ladder(spark, score, label):
    assert spark.range(1).select(quality.ladder(F.lit(score), quality.VALIDATION_STEPS, "very_poor").alias("x")).first().x == label


@pytest.mark.parametrize("seconds,issues", [(14, ["short_duration"]), (15, []), (600, []), (601, ["long_duration"]), (None, ["missing_duration"])])
def test_duration_rule(spark, seconds, issues):
    df = spark.createDataFrame([(1, "T", 1, 1, seconds, 100.0, 1, True, True, 3)], "id int, title string, artist_id int, album_id int, duration_seconds int, bpm double, track_number int, has_lyrics boolean, has_producer boolean, n_credits int")
    got = [x.name for x in quality.apply_rules(df, quality.track_rules()).first().issues if "duration" in x.name]
    assert got == issues


def test_release_types(spark):
    for n, title, want in [(1, "X", "single"), (3, "X", "ep"), (8, "X", "ep"), (9, "X", "album"), (9, "The Mixtape", "mixtape"), (9, "X Live", "live"), (9, "Best of X", "compilation")]:
        assert spark.range(1).select(linkage.release_type(F.lit(n), F.lit(title)).alias("x")).first().x == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "xml"])
def test_write_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "é & <b>"), (3, None)], "id long, name string")
    exports.write_table(df, str(tmp_path / fmt), fmt, max_rows=2)
    reader = spark.read.schema("id long, name string")
    back = reader.option("header", True).csv(str(tmp_path / fmt)) if fmt == "csv" else reader.option("rowTag", "row").xml(str(tmp_path / fmt)) if fmt == "xml" else reader.format(fmt).load(str(tmp_path / fmt))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_nothing_but_the_entry_and_the_pipeline_uses_the_corpus_operators():
    for p in ROOT.glob("mediagrain/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"mediagrain\.llm|corpus_pipeline", p.read_text()), p
