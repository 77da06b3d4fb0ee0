"""Ordered leader groups and the queries on them, against plain folds."""

import random

import pytest

from mediagrain.operators import enrich, linkage
from mediagrain.operators.leaders import leader_groups


def fold(edges):
    """The leader of each id that is like a kept id before it."""
    like = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            like.setdefault(a, set()).add(b)
            like.setdefault(b, set()).add(a)
    kept, leader = [], {}
    for x in sorted(like):
        first = next((k for k in kept if k in like[x]), None)
        if first is None:
            kept.append(x)
        else:
            leader[x] = first
    return leader


def run(spark, edges, **options):
    return {r.id: r.leader for r in leader_groups(spark.createDataFrame(edges, "a long, b long"), **options).collect()}


def test_a_chain_is_no_component(spark):
    assert run(spark, [(1, 2), (2, 3), (3, 4), (4, 5)]) == {2: 1, 4: 3}
    assert run(spark, [(3, 2), (2, 1), (3, 1)]) == {2: 1, 3: 1}


def test_the_earliest_kept_neighbour_leads_even_if_it_is_decided_late(spark):
    # 9 drops by 8 in the first round; 5 is kept only in the third, but comes before 8
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 9), (8, 9)]
    assert run(spark, edges) == fold(edges) == {2: 1, 4: 3, 9: 5}


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([8, 30, 80])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n, 3 * n]))]
    assert run(spark, edges) == fold(edges)


def test_odd_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (None, 2), (2, None), (1, 2), (2, 1), (1, 2)]) == {2: 1}


def test_rounds_are_bounded(spark):
    chain = [(i, i + 1) for i in range(11)]
    assert run(spark, chain, rounds=7) == fold(chain)
    with pytest.raises(RuntimeError, match="settle"):
        run(spark, chain, rounds=2)


def test_source_priority_keeps_what_is_unlike_kept_rows(spark):
    base = "the long and winding song"  # an edit each: neighbours are alike to 0.95, the ends are not to 0.85
    titles = [base, "xhe long and winding song", "xxe long and winding song", "xxx long and winding song", "xxxxlong and winding song", "xxxxxxng and winding song"]
    rows = [(i, 1, t, 0 if i == 5 else 1) for i, t in enumerate(titles)] + [(9, 1, base.upper(), 2), (10, 2, base, 2), (11, 1, None, 0), (12, 1, None, 0)]
    got = {r.id: r.kept for r in linkage.source_priority(spark.createDataFrame(rows, "id long, artist_id long, title string, rank int")).collect()}

    def edits(a, b):
        return sum(x != y for x, y in zip(a, b, strict=True))

    kept, want = [], {}
    for i, _, t, _ in sorted(rows[:6], key=lambda r: (r[3], r[0])):
        first = next((k for k in kept if 1 - edits(t, titles[k]) / 25 >= 0.85), None)
        want[i] = i if first is None else first
        kept += [i] if first is None else []
    assert {i: got[i] for i in range(6)} == want and len(set(want.values())) > 1
    assert got[9] == want[0] and got[10] == 10


def test_the_longest_name_of_a_group_is_canonical(spark):
    names = ["Jean Dupont", "Jean Duponts", "Jean Dupontss", "Other Name", None]
    got = {r.name: r.canonical for r in linkage.merged_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    # the third is like the second, which isn't kept, and not like the first
    assert got["Jean Dupont"] == got["Jean Duponts"] == "Jean Duponts"
    assert got["Jean Dupontss"] == "Jean Dupontss" and got["Other Name"] == "Other Name"


@pytest.mark.parametrize(
    "tracks,title,want",
    [(1, "Best of", "single"), (2, "X", "single"), (12, "Song feat. Y", "single"), (3, "Live", "ep"), (8, "Mixtape", "ep"), (9, "X EP", "ep"), (9, "Mix Tape", "mixtape"), (9, "Tape Live", "mixtape"), (9, "Live Tour", "live"), (9, "Greatest Hits", "compilation"), (9, "Liver", "album")],
)
def test_release_types(spark, tracks, title, want):
    df = spark.createDataFrame([(tracks, title)], "n int, t string")
    assert df.select(linkage.release_type(df.n, df.t).alias("x")).first().x == want


def test_a_producer_is_inferred_from_seven_tenths(spark):
    tracks = spark.createDataFrame([(10 * a + i, a) for a in (1, 2) for i in range(10)], "id long, album_id long")
    credits = spark.createDataFrame([(10 * a + i, "P", "producer") for a, n in ((1, 7), (2, 6)) for i in range(n)], "track_id long, person_name string, credit_type string")
    got = enrich.infer_producer(tracks, credits).collect()
    assert sorted((r.id, r.producer, r.confidence) for r in got) == [(17, "P", 0.7), (18, "P", 0.7), (19, "P", 0.7)]


def test_title_variants(spark):
    titles = ["Song", "Song (Remix)", "Song [Live]", "My Song - Remix", "Song 2", "So", "S", "", None, "Other remaster", "Other (Remaster 2011)", "Song"]
    rows = [(i, 1, t) for i, t in enumerate(titles)] + [(90, 2, "Song - live")]
    got = {(r.id1, r.id2): r.rule for r in linkage.title_variants(spark.createDataFrame(rows, "id long, artist_id long, title string")).collect()}
    # "Song (Remix)" and "Song [Live]" have the base "Song"; "My Song - Remix" holds "Song" and leaves "My  - Remix"
    assert got == {(0, 1): "base", (0, 2): "base", (1, 2): "base", (0, 3): "contained", (1, 5): "contained", (2, 5): "contained", (3, 5): "contained", (1, 6): "contained", (2, 6): "contained", (3, 6): "contained"}


def test_names_that_hold_others(spark):
    names = ["a", "ab", "abc", "xabcx", "abcabc", "zz", "", None, "b"]
    df = spark.createDataFrame([(1, n) for n in names] + [(2, "abc")], "k int, name string")
    got = {(r.short, r.long) for r in linkage.contained_pairs(df, ["k"], "name").collect() if r.k == 1}
    real = [n for n in names if n]
    assert got == {(a, b) for a in real for b in real if a != b and a in b}


def test_marks_and_dropped_credits(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, name string")
    merges = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, label long")
    assert sorted(((r.id, r.name) for r in linkage.marked_duplicates(rows, merges, "name").collect())) == [(1, "A"), (2, "B [DUPLICATE]"), (3, None)]
    credits = spark.createDataFrame([(1, "Jean Dupont", "producer", 5), (1, "Jean Duponts", "producer", 6), (1, "Jean Dupont", "mixing", 7), (2, "Jean Duponts", "producer", 8), (2, None, "producer", 9)], "track_id long, person_name string, credit_type string, n int")
    assert sorted(r.n for r in linkage.dropped_credits(credits).collect()) == [5, 7, 8, 9]
