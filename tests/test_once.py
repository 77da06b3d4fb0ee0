"""Texts are compared and parsed once a value, not once a row or a pair of rows."""

from pyspark.sql import functions as F

from mediagrain.operators import credits, documents
from mediagrain.operators import linkage as L
from mediagrain.plans import linkage, payloads, shaping, textual
from mediagrain.sources import catalog
from mediagrain.sources.catalog import load

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_results_are_not_normalised_by_track(spark):
    k = load(spark, SF)
    text = plan(linkage.confident(k))
    assert "translate(lower(title" not in text and "title2" not in text
    assert linkage.confident(k).count() == k.tracks.count()


def test_points_give_the_confidence_of_results(spark):
    rows = [(t, u, a) for t in (None, "", "!?", "Ring a", "ring A b") for u in (None, "", "ring a") for a in (None, "Ann")]
    df = spark.createDataFrame(rows, "t string, u string, a string").withColumn("bpm", F.lit(90.0))
    more = [F.col("a").isNotNull()]
    both = df.select(L.result_confidence(F.col("bpm"), F.col("t"), F.col("u"), F.col("a"), F.col("a"), more).alias("x"), L.confidence_of(F.col("bpm"), L.word_points(F.col("t"), F.col("u")), L.word_points(F.col("a"), F.col("a")), more).alias("y"), "t", "u", "a")
    for r in both.collect():
        one, two = (set((x or "").lower().split()) - {"!?"} for x in (r.t, r.u))
        near = len(one & two) / len(one | two) if one and two else 0
        assert r.x == r.y and abs(r.x - (0.5 + 0.2 * near + (0.22 if r.a else 0))) < 1e-6, r


def test_the_bound_of_blocks_is_judged_once_a_pair_of_titles(spark):
    assert "Join" not in plan(textual.block_pairs(load(spark, SF)))


def test_release_metadata_makes_tracks_once(spark):
    assert plan(shaping.release_metadata(load(spark, SF))).count("Relation [l_orderkey") == 1


def test_tracks_take_more_tasks_as_line_items_grow(spark, monkeypatch):
    want = sorted(map(repr, load(spark, SF).tracks.collect()))
    monkeypatch.setattr(catalog, "LINES", 100)
    few = load(spark, SF)
    assert few.tasks == -(-few.lineitem.count() // 100)
    assert plan(few.tracks).count(f", {few.tasks}") >= 2 and sorted(map(repr, few.tracks.collect())) == want


def test_payloads_are_parsed_once_for_their_tracks(spark):
    k = load(spark, SF)
    assert plan(documents.release_tracks(payloads.releases(k), "doc")).count("from_json(") == 1
    docs = ['{"id":1,"tracklist":[{"title":"a","duration":"1:05"},null]}', '{"id":2,"tracklist":[]}', '{"id":3}', "broken", None]
    got = documents.release_tracks(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()
    assert sorted((r.id, r.title or "", r.seconds, r.credits) for r in got if r.title) == [(1, "a", 65, "")] and len(got) == 2


def test_the_label_of_a_role_is_made_lower_case_once(spark):
    df = spark.createDataFrame([(" Mixed BY ",), ("Saxophone",), ("Some thing",), ("",), (None,)], "r string").select(credits.normal_role(F.col("r")).alias("x"))
    assert plan(df).count("lower(") == 1
    assert [r.x for r in df.collect()][:3] == ["Mixing Engineer", "Instrumentalist", "Some Thing"]
