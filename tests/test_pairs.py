"""Names compared once, by group and by pieces, against plain comparisons; groups and merges without all pairs."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from mediagrain.operators import linkage
from mediagrain.plans import textual


class Parts:
    def __init__(self, spark):
        self.spark = spark
        self.part = spark.createDataFrame([(1, "Small Ring", "B", 3), (2, "small  ring!", "B", 3), (3, "Other", "C", 3)], "p_partkey long, p_name string, p_brand string, p_size int")


def test_similarities_normalise_rows_before_they_meet(spark):
    """A pair costs no regular expression."""
    df = textual.sim(lambda s, t, *w: textual.T.ratio_of(s, t))(Parts(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "regexp_replace" not in above and "regexp_replace" in below
    assert [tuple(r) for r in df.collect()] == [(1, 2, 1.0)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_by_group_and_by_pieces(spark):
    """short names by what is left without a character, long ones by q-grams, small groups whole; all find the same pairs."""
    rng = random.Random(5)
    names = {"", "a", "customer", *(f"customer{rng.randrange(3000):09d}" for _ in range(120)), *("".join(rng.choices("ab", k=rng.randrange(8, 26))) for _ in range(60))}
    names |= {n[1:] for n in list(names)[:40]} | {n + "x" for n in list(names)[:40]}
    df = spark.createDataFrame([(k, n) for k in (1, 2) for n in sorted(names)], "k int, name string")
    want = {(a, b) for a in names for b in names if a < b and 1 - edits(a, b) / max(len(a), len(b)) >= 0.9}
    pieces = [(r.k, r.name1, r.name2) for r in linkage.near_names(df, ["k"], 0.9, whole=0).collect()]
    whole = [(r.k, r.name1, r.name2) for r in linkage.near_names(df, ["k"], 0.9, whole=1000).collect()]
    assert sorted(pieces) == sorted(whole) == sorted((k, a, b) for k in (1, 2) for a, b in want) and len(want) > 50


def test_group_labels_are_components(spark):
    """pairs and cliques are settled at once, chains by rounds."""
    pairs = [(1, "a", "b"), (2, "a", "b"), (2, "b", "c"), (2, "c", "d"), (2, "d", "e"), (3, "x", "y"), (3, "x", "z"), (3, "y", "z")]
    got = sorted((r.k, r.name, r.label) for r in linkage.group_labels(spark.createDataFrame(pairs, "k int, name1 string, name2 string"), ["k"]).collect())
    assert got == [(1, "a", "a"), (1, "b", "a"), *((2, c, "a") for c in "abcde"), *((3, c, "x") for c in "xyz")]


def test_merges_need_no_pairs_of_copies(spark):
    """The components of the pairs."""
    rows = [(i, f"Customer#{i % 40:09d}" if i % 9 else None, i % 5 if i % 11 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, ext int")
    want = {(r.id, r.label) for r in linkage.merge_components(linkage.artist_duplicates(df, "ext")).collect()}
    assert {(r.id, r.label) for r in linkage.artist_merges(df, "ext").collect()} == want


def test_title_variants_of_large_and_small_artists(spark):
    """titles compared in place give what their pieces give."""
    titles = ["Song", "Song (Remix)", "Song [Live]", "My Song - Remix", "Song 2", "So", "S", "", "Other remaster", "Other (Remaster 2011)"]
    df = spark.createDataFrame([(10 * a + i, a, t) for a in (1, 2) for i, t in enumerate(titles)], "id long, artist_id long, title string")
    assert sorted(map(tuple, linkage.title_variants(df, whole=0).collect())) == sorted(map(tuple, linkage.title_variants(df).collect()))


def test_search_terms_of_normalised_texts(spark):
    """texts normalised once give the terms of raw ones, without a regular expression a term."""
    T = textual.T
    df = spark.createDataFrame([("Ünder  World!", "Big Song, a"), (None, "x"), ("a", "")], "a string, t string")
    got = df.select(T.normalize_text(df.a).alias("a"), T.normalize_text(df.t).alias("t")).select(T.search_terms_of(textual.C("a"), textual.C("t")).alias("x"))
    assert got.collect() == df.select(T.search_terms(df.a, df.t).alias("x")).collect()
    assert "regexp" not in str(T.search_terms_of(df.a, df.t))


def test_names_are_scored_once_a_pair_of_names(spark):
    """50 parts of one name are one name to score, in blocks of any size; names may be null."""
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def judged(s, t, sw, tw):
        scored.add(1)
        return None if s is None or t is None else float(len(s) * 100 + len(t))

    names = ["a", "bbb", "cc", None, "dddd"]
    rows = [(i, names[i * 7 % 5], "B", i % 2) for i in range(100)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")
    got = textual.sim(judged, most=2)(SimpleNamespace(spark=spark, part=part)).collect()
    size = lambda x, y: None if x is None or y is None else float(len(x) * 100 + len(y))
    want = {(x[0], y[0], size(x[1], y[1])) for x in rows for y in rows if x[3] == y[3] and x[0] < y[0]}
    assert len(got) == len(want) and {(r.a, r.b, r.out) for r in got} == want
    assert scored.value <= 2 * 2 * 25  # not one for each of 2 450 pairs


def test_a_group_of_one_name_is_the_work_of_many_tasks(spark):
    """parts of one name meet in blocks of ids; before, blocks were of names and one task made all their pairs."""
    rows = [(i, "Old Ring" if i % 9 else None, "B", 1) for i in range(80)] + [(None, "Old Ring", "B", 1), (81, "Old Ring", None, 1), (82, "Old Ring", "B", None)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")
    got = textual.sim(textual.jaccard, most=4, copies=3)(SimpleNamespace(spark=spark, part=part)).select("*", F.spark_partition_id().alias("task")).collect()
    want = {(a, b, 1.0 if a % 9 and b % 9 else None) for a in range(80) for b in range(a + 1, 80)}
    assert len(got) == len(want) and {(r.a, r.b, r.out) for r in got} == want
    assert len({r.task for r in got}) > 1


def test_names_are_scored_only_against_later_parts(spark):
    """of two names only the order that the ids have is scored; before, both were. Relevance depends on the order."""
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def judged(s, t, sw, tw):
        scored.add(1)
        return 1.0 if s == t else 0.8 if s in t else 0.7 if t in s else len({*sw} & {*tw}) / len(sw)

    names = [" ".join(("old ring", "red bolt", "a b c d", "z")[: i % 4 + 1][i % 3 :] + (f"x{i % 10}",)) for i in range(20)]
    part = spark.createDataFrame([(i, n, "B", 1) for i, n in enumerate(names)], "p_partkey long, p_name string, p_brand string, p_size int")
    got, plain = (textual.sim(f, most=7)(SimpleNamespace(spark=spark, part=part)).collect() for f in (textual.T.relevance_of, judged))
    assert len(got) == 190 and {*got} == {*plain} and len({r.out for r in got}) > 3
    assert scored.value <= 190


def test_stars_of_names_keep_components(spark):
    """Names that differ at one place are linked to the least of them, which takes fewer rows and keeps the groups."""
    names = [f"customer{i:09d}" for i in range(300)] + ["customer00000001", "another name", "anothers name", "x" * 30, "x" * 29 + "y", "customer000000001ab", "customer000000001abc"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    whole = linkage.near_names(df, [], 0.9).collect()
    stars = linkage.near_names(df, [], 0.9, stars=True).collect()
    ratio = lambda a, b: 1 - edits(a, b) / max(len(a), len(b))
    assert {(r.name1, r.name2) for r in whole} == {(a, b) for a in names for b in names if a < b and ratio(a, b) >= 0.9 - 1e-6}
    assert len(whole) == len(set(whole)) and {*stars} <= {*whole} and 2 * len(stars) < len(whole)

    def groups(pairs):
        label = {n: n for n in names}
        for _ in names:
            for r in pairs:
                label[r.name1] = label[r.name2] = min(label[r.name1], label[r.name2])
        return label

    assert groups(stars) == groups(whole)


def test_artist_pairs_need_no_broadcast(spark):
    """what grows with the artists is merged; before, exploded names and the artists were taken for small and sent to the driver."""
    rows = [(i, f"Customer#{i // 2:09d}", i % 7 if i % 11 == 0 else None) for i in range(300)]
    found = linkage.artist_duplicates(spark.createDataFrame(rows, "id long, name string, ext int"), "ext")
    lines = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    free = [x for x in lines if "strategy=merge" not in x]
    assert len(lines) - len(free) >= 5 and all("strategy=broadcast" in x and "LeftOuter" in x for x in free)


def test_artists_of_one_name_meet_in_blocks(spark):
    """pairs of artists that share a name, an external id or neither, in blocks of any size and in many tasks."""
    names = ["Old Ringer Band", "Old Ringer Bend", "Other", None, "", "old ringer band!"]
    rows = [(i, names[0] if i < 40 else names[i % 6], [None, 1, 2, None, 3][i % 5]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, name string, ext int")
    fold = lambda s: s and "".join(c for c in s.lower() if c.isalnum() or c == " ")
    want = {}
    for i, a, e in rows:
        for j, b, f in rows[i + 1 :]:
            x, y = fold(a), fold(b)
            score = 1.0 if e is not None and e == f else None if x is None or y is None else round(1 - edits(x, y) / max(len(x), len(y), 1), 6)
            if score is not None and score >= 0.9:
                want[i, j] = score
    got = linkage.artist_duplicates(df, "ext").collect()
    assert len(got) == len(want) > 1000 and {(r.id1, r.id2): r.score for r in got} == want
    known = df.select("id", textual.T.normalize_text(df.name).alias("n"), "ext")
    like = spark.createDataFrame([("old ringer band", "old ringer bend", 0.9)], "n1 string, n2 string, score double")
    blocks = linkage.blocked(known, "n", "id", "ext", most=4)
    assert blocks.agg(F.max(F.size("held"))).first()[0] == 4
    pairs = linkage.spread_pairs(blocks, like).select("x.id", F.col("y.id").alias("other"), "score", F.spark_partition_id().alias("task")).collect()
    n = {i: fold(a) for i, a, _ in rows if a is not None}
    both = {(i, j) for i in n for j in n if i < j and n[i] == n[j]} | {(i, j) for i in n for j in n if (n[i], n[j]) == ("old ringer band", "old ringer bend")}
    assert len(pairs) == len(both) and {(r.id, r.other) for r in pairs} == both and len({r.task for r in pairs}) > 1
