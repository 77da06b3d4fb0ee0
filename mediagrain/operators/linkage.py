"""Duplicate detection and record linkage over blocked candidate pairs, merging, and release grouping.

Pairs are never a cross join: candidates share a key that their rule asks for (an artist, an external id), or
one of the rare q-grams that no pair above the rule's ratio can do without (`near_pairs`), are ordered by id, and
are judged by column expressions.
"""

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagrain.functions import text as T
from mediagrain.operators.components import components, sent, written
from mediagrain.operators.leaders import leader_groups


def candidate_pairs(df: DataFrame, key: list[str], id_: str, *columns: str) -> DataFrame:
    """Pairs (id1 < id2) of rows with equal keys, with the columns of both (suffixes 1 and 2)."""
    one = df.select(*key, F.col(id_).alias("id1"), *(F.col(c).alias(f"{c}1") for c in columns))
    two = df.select(*key, F.col(id_).alias("id2"), *(F.col(c).alias(f"{c}2") for c in columns))
    return one.join(two, key).filter("id1 < id2")


def near_pairs(df: DataFrame, key: list[str], id_: str, name: str, ratio: float, common: int = 4096) -> DataFrame:
    """Pairs (id1 < id2, name1, name2) of rows inside `key` (may be empty) whose names' edit-distance ratio is `ratio` (less a millionth) or more; ids are unique.

    Names are compared once (`near_names`); rows of equal or near names are brought together after that.
    """
    named = df.select(*key, F.col(id_).alias("id"), F.col(name).alias("name")).filter(F.col(name).isNotNull())
    of = lambda n: named.select(*key, F.col("name").alias(f"name{n}"), F.col("id").alias(f"id{n}"))
    near = near_names(named.select(*key, "name").distinct(), key, ratio, common).join(of(1), [*key, "name1"]).join(of(2), [*key, "name2"]).filter("id1 <> id2")
    back = F.col("id1") > F.col("id2")
    near = near.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.when(back, F.col("name2")).otherwise(F.col("name1")).alias("name1"), F.when(back, F.col("name1")).otherwise(F.col("name2")).alias("name2"))
    equal = candidate_pairs(named, [*key, "name"], "id").select("id1", "id2", F.col("name").alias("name1"), F.col("name").alias("name2"))
    return near.unionByName(equal)


def large_keys(rows: DataFrame, key: list[str], most: int) -> DataFrame | None:
    """The keys of more than `most` rows, as a written table; None if there are none."""
    large = written(rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*key), "large")
    return None if large.isEmpty() else large


def near_names(names: DataFrame, key: list[str], ratio: float, common: int = 4096, whole: int = 256, stars: bool = False) -> DataFrame:
    """(key, name1 < name2): all pairs of distinct names (key, name) inside `key` (may be empty) whose edit-distance ratio is `ratio` (less a millionth) or more.

    Keys of at most `whole` names are compared whole: fewer comparisons than there would be pieces to shuffle. In the others, names that may
    differ by one edit only meet exactly: by what is left of both without the character at one place, or of the longer one by the shorter one itself.
    With `stars`, names that differ at one place are linked to the least of them only, which leaves the components as they are. Longer names meet
    by q-grams: k edits change at most q * k of a name's q-grams, so two names within k edits share one of the first q * k + 1 q-grams of each in any common order. The order puts the `common` most
    frequent q-grams last (a bounded table), so a piece that most names share brings nobody together. A name's k is that of the longest name it
    may match. Every meeting is judged before it leaves its task.
    """
    if not 0.7 <= ratio <= 1:
        raise ValueError("ratio must be from 0.7 to 1")
    edits = lambda n: int((1 - ratio + 1e-6) * n + 1e-9)
    one = max(n for n in range(1, 256) if edits(n) <= 1)  # the longest name that one edit at most is allowed
    least = next((n for n in range(1, 256) if edits(n) == 1), 256)
    n1, n2 = F.length("name1"), F.length("name2")
    longer = F.greatest(n1, n2)
    like = (F.col("name1") < F.col("name2")) & (F.least(n1, n2) >= (ratio - 1e-6) * longer) & (F.levenshtein("name1", "name2") <= (1 - ratio + 1e-6) * longer + 1e-9)
    # merged, as what is exploded here grows with the names, but is taken for as small as their file and sent to the driver
    met = lambda rows, on: rows.withColumnRenamed("name", "name1").join(rows.withColumnRenamed("name", "name2").hint("merge"), [*key, *on])

    small = None
    if key:
        large = large_keys(names, key, whole)
        if large is None:
            return met(names, []).filter(like).select(*key, "name1", "name2")
        small = met(names.join(large, key, "left_anti"), []).filter(like).select(*key, "name1", "name2")
        names = names.join(large, key, "left_semi")

    n = F.length("name")
    without = lambda i: F.concat(F.substr("name", F.lit(1), i - 1), F.substr("name", i + 1))
    some = names.filter(n.between(max(1, least - 1), one)).repartition(*key, "name")
    place = some.filter(n >= least).select(*key, "name", F.explode(F.sequence(F.lit(1), n)).alias("place"))
    left = place.select(*key, "name", "place", without(F.col("place")).alias("left"))
    if stars:
        hub = F.min("name").over(Window.partitionBy(*key, "place", "left"))
        changed = left.select(*key, hub.alias("name1"), F.col("name").alias("name2")).filter("name1 < name2")
    else:
        changed = met(left, ["place", "left"]).filter("name1 < name2").select(*key, "name1", "name2")
    shorter = left.select(*key, F.col("name").alias("long"), F.col("left").alias("name")).distinct().join(some.select(*key, "name").hint("merge"), [*key, "name"])
    shorter = shorter.select(*key, F.least("name", "long").alias("name1"), F.greatest("name", "long").alias("name2"))
    short = changed.unionByName(shorter)

    q = 3 if ratio >= 0.85 else 2
    long = names.filter(n >= ceil((ratio - 1e-6) * (one + 1)))
    k = F.floor((1 - ratio + 1e-6) * F.floor(n / (ratio - 1e-6)) + 1e-9).cast("int")
    places = F.when(n >= q, F.sequence(F.lit(1), n - q + 1)).otherwise(F.array(F.lit(1)))
    grams = long.select("name").distinct().withColumn("gram", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("name", i, F.lit(q))))))
    often = grams.groupBy("gram").agg(F.count("*").alias("often")).orderBy(F.desc("often"), "gram").limit(common)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("often").asc_nulls_first(), F.xxhash64("gram"), "gram"))
    first = grams.join(F.broadcast(often), "gram", "left").withColumn("rank", rank).filter(F.col("rank") <= q * k + 1).select("name", "gram")
    pieces = long.join(first.hint("merge"), "name") if key else first
    # one of both is longer than `one`; names that may only be the other one don't meet among themselves
    rest = pieces.filter(n > one).withColumnRenamed("name", "long").join(pieces.hint("merge"), [*key, "gram"]).filter((n <= one) | (F.col("long") < F.col("name")))
    rest = rest.select(*key, F.least("name", "long").alias("name1"), F.greatest("name", "long").alias("name2")).filter(like)
    found = short.unionByName(rest.distinct())
    return found if small is None else small.unionByName(found)


def group_labels(near: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, label) of every name of the pairs (key, name1, name2): the smallest name of its component; components lie inside `key`.

    One shuffle by key settles the keys in which each name's smallest neighbour is that of its neighbours, too; the others go through `components`.
    """
    ends = F.array(F.struct(F.col("name1").alias("name"), F.col("name2").alias("other")), F.struct(F.col("name2").alias("name"), F.col("name1").alias("other")))
    both = near.repartition(*key).select(*key, F.explode(ends).alias("x")).select(*key, "x.*")
    over = lambda *more: Window.partitionBy(*key, *more)
    seen = both.withColumn("label", F.least("name", F.min("other").over(over("name")))).withColumns({"_lo": F.least("name", "other"), "_hi": F.greatest("name", "other")})
    open_ = F.min("label").over(over("_lo", "_hi")) != F.max("label").over(over("_lo", "_hi"))
    judged = written(seen.withColumn("_open", open_).withColumn("_open", F.max("_open").over(over())).drop("_lo", "_hi"), "labels")
    settled = judged.filter("not _open").select(*key, "name", "label").distinct()
    rest = judged.filter("_open and name < other")
    if rest.isEmpty():
        return settled
    labels = components(rest.select(F.struct(*key, "name").alias("a"), F.struct(*key, F.col("other").alias("name")).alias("b")))
    return settled.unionByName(labels.select("id.*", F.col("label")["name"].alias("label")))


def blocked(rows: DataFrame, key: str, *columns: str, most: int = 256) -> DataFrame:
    """(k, nth, held): the rows of each key that isn't null as structs of `columns` (id first), in the order of ids, in arrays of at most `most`."""
    nth = F.floor((F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1) / most)
    kept = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), nth.alias("nth"), F.struct(*columns).alias("x"))
    return kept.groupBy("k", "nth").agg(F.sort_array(F.collect_list("x")).alias("held"))


def spread_pairs(blocks: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(x, y, score): the pairs x before y of one key's rows with score 1.0, and each x of a key with each y of another one, by the pairs of keys (n1, n2, score).

    `blocks` (`blocked`) are read more than once, so they should be written. A pair of blocks is what is shuffled, and neither many rows of a key nor two such
    keys are one task's. As many tasks as the session has, as pairs are many more than blocks. Only keys of several blocks may be sent to all tasks, in a bounded table.
    """
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = blocks.filter("nth = 0 and size(held) > 1").select(F.col("k").alias("k1"), F.col("k").alias("k2"), F.lit(1.0).alias("score"))
    if keys is not None:
        pairs = pairs.unionByName(keys.toDF("k1", "k2", "score"))
    several = written(blocks.groupBy("k").agg(F.max("nth").alias("last")).filter("last > 0"), "several")
    for i in (1, 2):
        pairs = pairs.join(sent(several).toDF(f"k{i}", "last"), f"k{i}", "left").withColumn(f"nth{i}", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("last")
    of = lambda i: blocks.toDF(f"k{i}", f"nth{i}", f"held{i}")
    met = pairs.filter("k1 <> k2 or nth1 <= nth2").join(of(1).hint("merge"), ["k1", "nth1"]).select("k2", "nth2", (F.col("k1") == F.col("k2")).alias("own"), "score", "held1")
    met = met.repartition(tasks, "k2", "nth2").join(of(2).repartition(tasks, "k2", "nth2").hint("merge"), ["k2", "nth2"])
    out = met.select("own", "score", "held2", F.explode("held1").alias("x")).select("own", "score", "x", F.explode("held2").alias("y"))
    return out.filter("not own or x.id < y.id").select("x", "y", "score")


def edit_ratio(a: str, b: str) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def once(rows: DataFrame, column: str, **made: Callable[[Column], Column]) -> DataFrame:
    """The rows with columns made of `column`, worked out once for each of its distinct values; `rows` are read twice."""
    value = F.col("_value")
    values = written(rows.select(F.col(column).alias("_value")).filter("_value is not null").distinct().withColumns({name: f(value) for name, f in made.items()}), "values")
    return rows.join(values, F.col(column) == value, "left").drop("_value")


def base_title(c: Column) -> Column:
    """Normalised title without version and featuring marks."""
    c = F.regexp_replace(c, r"(?i)[(\[]?\b(remix|live|deluxe edition|version|edit|mix)\b[)\]]?", "")
    return T.normalize_text(T.drop_featuring(c))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.95, "certain").when(score >= 0.85, "high").when(score >= 0.70, "medium").when(score >= 0.50, "low").otherwise("none")


def track_duplicates(tracks: DataFrame, threshold: float = 0.9) -> DataFrame:
    """All pairs of an artist's tracks that are exact, remix, featuring or similar."""
    keyed = once(written(tracks.select("artist_id", "id", "title"), "tracks"), "title", n=T.normalize_text, b=base_title, f=T.featured_text)
    keyed = written(keyed.drop("title"), "titles")
    same = candidate_pairs(keyed, ["artist_id", "b"], "id", "n", "f")
    kind = F.when(F.col("n1") == F.col("n2"), "exact").when(F.col("f1") != F.col("f2"), "featuring").otherwise("remix")
    same = same.select("id1", "id2", kind.alias("kind"), F.when(F.col("n1") == F.col("n2"), 1.0).otherwise(0.9).alias("score"))
    equal = candidate_pairs(keyed, ["artist_id", "n"], "id", "b").filter("b1 <> b2").select("id1", "id2", F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    near = near_names(keyed.filter("b is not null").select("artist_id", F.col("b").alias("name")).distinct(), ["artist_id"], threshold)
    near = near.withColumn("score", edit_ratio("name1", "name2")).filter(F.col("score") >= threshold)
    of = lambda i: keyed.select("artist_id", F.col("b").alias(f"name{i}"), F.col("id").alias(f"id{i}"), F.col("n").alias(f"n{i}"))
    near = near.join(of(1), ["artist_id", "name1"]).join(of(2), ["artist_id", "name2"]).filter("n1 <> n2 and id1 <> id2")
    near = near.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.lit("similar").alias("kind"), F.round("score", 6).alias("score"))
    return same.unionByName(equal).unionByName(near).withColumn("confidence", confidence(F.col("score")))


def merge_statistics(pairs: DataFrame) -> DataFrame:
    """A dry run of the merges: pairs to merge by kind (certain, or high but no remix), the rows they touch, and those kept apart."""
    wanted = F.expr("confidence = 'certain' or (confidence = 'high' and kind <> 'remix')")
    return pairs.groupBy("kind").agg(F.count_if(wanted).alias("merged"), F.count_if(~wanted).alias("kept_apart"), F.count_distinct(F.when(wanted, F.col("id2"))).alias("rows_gone"))


def credit_duplicates(credits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Groups of a track's credits of one type whose folded names are equal or alike to the threshold: the least name, names, credits."""
    rows = written(credits.groupBy("track_id", "credit_type", "person_name").agg(F.count("*").alias("n")), "credits")
    folded = written(once(rows, "person_name", name=T.normalize_text).groupBy("track_id", "credit_type", "name").agg(F.sum("n").alias("n")), "names")
    grouped = folded.join(like_credits(folded, threshold), ["track_id", "credit_type", "name"], "left").withColumn("grp", F.coalesce("label", "name"))
    out = grouped.groupBy("track_id", "credit_type", "grp").agg(F.min("name").alias("name"), F.count("*").alias("names"), F.sum("n").alias("n"))
    return out.filter("n > 1").drop("grp")


def like_credits(folded: DataFrame, threshold: float) -> DataFrame:
    """(track_id, credit_type, name, label): the least name of the group, for the distinct names of a track's credits of one type that are like another."""
    key = ["track_id", "credit_type"]
    near = near_names(folded.filter("name is not null").select(*key, "name"), key, threshold).filter(edit_ratio("name1", "name2") >= threshold)
    return group_labels(near, key)


def like_artists(artists: DataFrame, external: str, threshold: float, stars: bool = False) -> tuple[DataFrame, DataFrame]:
    """The artists as (id, n, ext), and pairs of different normalised names that are alike: n1, n2, score."""
    rows = written(artists.select("id", T.normalize_text(F.col("name")).alias("n"), F.col(external).alias("ext")), "artists")
    like = near_names(rows.filter("n is not null").select(F.col("n").alias("name")).distinct(), [], threshold, stars=stars).toDF("n1", "n2")
    return rows, like.withColumn("score", F.round(edit_ratio("n1", "n2"), 6)).filter(F.col("score") >= threshold)


def artist_duplicates(artists: DataFrame, external: str, threshold: float = 0.9) -> DataFrame:
    """All pairs with like names or the same external id, which makes a pair certain; ids are unique."""
    rows, like = like_artists(artists, external, threshold)
    apart = F.coalesce(F.col("x.ext") != F.col("y.ext"), F.lit(True))
    ids = [F.least("x.id", "y.id").alias("id1"), F.greatest("x.id", "y.id").alias("id2"), "score"]
    near = spread_pairs(written(blocked(rows, "n", "id", "ext"), "blocks"), like).filter(apart).select(ids)
    return near.unionByName(spread_pairs(written(blocked(rows, "ext", "id"), "blocks")).select(ids))


def artist_merges(artists: DataFrame, external: str, threshold: float = 0.9) -> DataFrame:
    """(id, label): the components of the pairs of `artist_duplicates`, without making the pairs of artists that share a name or an external id: the least
    artist of a name stands for all, and those of an external id form a star."""
    rows, like = like_artists(artists, external, threshold, stars=True)
    heads = written(rows.filter("n is not null").groupBy("n").agg(F.min("id").alias("head"), F.count("*").alias("holders")), "heads")
    of = lambda i, c: heads.select(F.col("n").alias(f"n{i}"), F.col("head").alias(c))
    near = like.join(of(1, "a"), "n1").join(of(2, "b"), "n2").select("a", "b")
    noded = written(rows.join(heads, "n", "left").select("id", "ext", F.coalesce("head", "id").alias("node"), (F.coalesce("holders", F.lit(1)) > 1).alias("shared")), "nodes")
    known = noded.filter("ext is not null").groupBy("ext", "node").agg(F.count("*").alias("n"))
    hubs = known.groupBy("ext").agg(F.min("node").alias("b"))
    labels = components(near.unionByName(known.join(hubs, "ext").select(F.col("node").alias("a"), "b"))).withColumnRenamed("id", "node")
    return noded.join(labels, "node", "left").filter("label is not null or shared").select("id", F.coalesce("label", "node").alias("label"))


def source_priority(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, kept): rows (id, artist_id, title, rank) by rank, then id; a row whose title is like that of a kept row of the artist gives way to the first such row.

    Rows with one title share the fate of the first of them.
    """
    rows = written(rows.select("artist_id", "title", F.struct("rank", "id").alias("row")), "rows")
    keyed = written(once(rows, "title", t=T.normalize_text).drop("title"), "keyed")
    names = written(keyed.groupBy("artist_id", "t").agg(F.min("row").alias("head")), "heads")
    near = near_names(names.filter("t is not null").select("artist_id", F.col("t").alias("name")), ["artist_id"], threshold).filter(edit_ratio("name1", "name2") >= threshold)
    of = lambda i, c: names.select("artist_id", F.col("t").alias(f"name{i}"), F.col("head").alias(c))
    followers = leader_groups(near.join(of(1, "a"), ["artist_id", "name1"]).join(of(2, "b"), ["artist_id", "name2"]).select("a", "b")).withColumnRenamed("id", "head")
    grouped = keyed.join(names, ["artist_id", "t"]).join(followers, "head", "left")
    return grouped.select("row.id", F.coalesce("leader", "head")["id"].alias("kept"))


def merged_names(names: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(name, canonical): distinct names in their order; a name joins the first group whose first name is like it; the longest, then the first name of a group stands for it."""
    distinct = written(names.select("name").distinct().withColumn("n", T.normalize_text(F.col("name"))), "names")
    near = near_pairs(distinct, [], "name", "n", threshold).filter(edit_ratio("name1", "name2") >= threshold)
    followers = leader_groups(near.select(F.col("id1").alias("a"), F.col("id2").alias("b"))).withColumnRenamed("id", "name")
    grouped = distinct.join(followers, "name", "left").select("name", F.coalesce("leader", "name").alias("grp"))
    canonical = grouped.groupBy("grp").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("canonical"))
    return grouped.join(canonical, "grp").select("name", "canonical")


def merged_releases(groups: DataFrame, tracks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Release groups (artist_id, key, release_id, albums) of an artist, by release_id; a group whose key is like that of an earlier one that stays joins the first such one.

    Gives release, artist_id, groups, albums, tracks and the best key: that of most tracks (artist_id, key), else the shortest with fewest brackets.
    """
    near = near_pairs(groups.withColumn("row", F.struct("release_id", "key")), ["artist_id"], "row", "key", threshold).filter(edit_ratio("name1", "name2") >= threshold)
    followers = leader_groups(near.select(F.col("id1.release_id").alias("a"), F.col("id2.release_id").alias("b"))).withColumnRenamed("id", "release_id")
    named = tracks.groupBy("artist_id", "key").agg(F.count("*").alias("named"))
    brackets = lambda c: F.length("key") - F.length(F.replace("key", F.lit(c)))
    best = F.min_by("key", F.struct(-F.coalesce("named", F.lit(0)), F.length("key"), brackets("("), brackets("["), "key"))
    out = groups.join(followers, "release_id", "left").join(named, ["artist_id", "key"], "left")
    return out.groupBy("artist_id", F.coalesce("leader", "release_id").alias("release")).agg(F.count("*").alias("groups"), F.sum("albums").alias("albums"), F.coalesce(F.sum("named"), F.lit(0)).alias("tracks"), best.alias("best_key"))


def featuring_variants(tracks: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs of an artist's tracks whose titles without guests are alike to the threshold and whose guests differ."""
    x = T.extract_featured(F.col("title"))
    df = tracks.select("artist_id", "id", T.normalize_text(x["title"]).alias("t"), F.array_sort(x["artists"]).alias("f"))
    df = written(df, "titles").withColumn("row", F.struct("id", "f"))
    near = near_pairs(df, ["artist_id"], "row", "t", threshold)
    near = near.filter(1 - F.levenshtein("name1", "name2") / F.greatest(F.length("name1"), F.length("name2"), F.lit(1)) >= threshold)
    return near.filter(F.col("id1.f") != F.col("id2.f")).select("id1.id", "id2.id").toDF("id1", "id2").distinct()


def merge_enrichments(ref: DataFrame, others: DataFrame, key: list[str], least: float = 0.8, most: int = 512) -> DataFrame:
    """(id, sources, mean, lo, hi): each row's confidence with those of its match in every source, by id, else by the likest title above `least`.

    ref has id, title, confidence and the key columns, in which titles are compared; others source, other_id, other_title, other_confidence too.
    All rows are dealt twice, by key and by id, in as many tasks as they need, so that none sorts more than memory holds as tables grow. Keys of at most `most` rows are an array in which titles are matched in place (`matches_in_place`); others meet by joins.
    """
    held = lambda rows, asked, source, id_, title, c: rows.select(*key, F.lit(asked).alias("asked"), F.lower(title).alias("t"), source.cast("string").alias("source"), F.col(id_).alias("id"), c.cast("double").alias("c"))
    met = held(ref, True, F.lit(None), "id", "title", F.lit(None)).unionByName(held(others, False, F.col("source"), "other_id", "other_title", F.col("other_confidence")))
    tasks = max(ref.sparkSession.sparkContext.defaultParallelism, (ref.count() + others.count()) // 2**17 + 1)
    met = met.filter(" and ".join(f"{x} is not null" for x in ("t", *key))).repartition(tasks, *key)
    whole = Window.partitionBy(*key)
    large, nth = F.count("*").over(whole) > most, F.floor((F.row_number().over(whole.orderBy(*key)) - 1) / most)
    dealt = met.select(*key, F.struct("asked", "t", "source", "id", "c").alias("x"), large.alias("large"), nth.alias("nth"))
    arrays = written(dealt.groupBy(*key, "large", "nth").agg(F.collect_list("x").alias("rows")), "arrays")
    best = matches_in_place(arrays.filter("not large"), least)
    if not arrays.filter("large").isEmpty():
        best = best.unionByName(matches_by_joins(arrays.filter("large").select(*key, F.explode("rows").alias("x")).select(*key, "x.*"), key, least))

    # kind 0: the row itself, 1: the match by title, 2: the one by id, which counts if there is one
    every = ref.select("id", F.lit(None).cast("string").alias("source"), F.lit(0).alias("kind"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("before"), F.col("confidence").alias("c"))
    every = every.unionByName(best.filter("id is not null").withColumn("kind", F.lit(1)))
    by_id = others.filter("other_id is not null").select(F.col("other_id").alias("id"), F.col("source").cast("string").alias("source"), F.col("other_confidence").cast("double").alias("c"))
    every = every.unionByName(by_id.withColumns({"kind": F.lit(2), "score": F.col("c"), "before": F.lit(0).cast("long")})).repartition(tasks, "id")
    one = every.groupBy("id", "source", (F.col("kind") == 0).alias("own")).agg(F.count("*").alias("n"), F.count("c").alias("known"), F.sum("c").alias("sum"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("kind", "score", "before", "c"))["c"].alias("c"))
    of = lambda own, c: F.when(F.col("own"), F.col(own)).otherwise(c)
    one = one.select("id", "own", of("n", F.lit(1)).alias("n"), of("known", F.col("c").isNotNull().cast("long")).alias("known"), *(of(x, F.col("c")).alias(x) for x in ("sum", "lo", "hi")))
    out = one.groupBy("id").agg(F.max("own").alias("own"), (F.sum("n") - 1).alias("sources"), F.round(F.try_divide(F.sum("sum"), F.sum("known")), 6).alias("mean_conf"), F.round(F.min("lo"), 6).alias("min_conf"), F.round(F.max("hi"), 6).alias("max_conf"))
    return out.filter("own").drop("own")


def matches_in_place(arrays: DataFrame, least: float) -> DataFrame:
    """(id, source, score, before, c): of arrays `rows` of a key's rows, for each asked id and each source the likest title above `least`, then the least id."""
    asked = arrays.select(F.filter("rows", lambda r: r["asked"]).alias("asked"), F.filter("rows", lambda r: ~r["asked"]).alias("offers"))
    titles = asked.filter("size(asked) > 0 and size(offers) > 0").select("asked", "offers", F.explode(F.array_distinct(F.transform("asked", lambda r: r["t"]))).alias("t"))

    def score(t: Column) -> Column:
        short, long = F.least(F.length("t"), F.length(t)), F.greatest(F.length("t"), F.length(t))
        most = F.floor((1 - least + 1e-6) * long + 1e-9).cast("int")
        edits = F.call_function("levenshtein", F.col("t"), t, most)  # -1 above `most`
        return F.when((short >= (least - 1e-6) * long) & (edits >= 0), 1 - edits / F.greatest(long, F.lit(1))).otherwise(0.0)

    scored = F.transform("offers", lambda o: F.struct(o["source"].alias("source"), score(o["t"]).alias("score"), (-o["id"]).alias("before"), (-o["c"]).alias("less")))
    like = titles.select(F.transform(F.filter("asked", lambda r: r["t"] == F.col("t")), lambda r: r["id"]).alias("ids"), F.filter(scored, lambda s: s["score"] > least).alias("like"))
    best = F.transform(F.array_distinct(F.transform("like", lambda s: s["source"])), lambda x: F.array_max(F.filter("like", lambda s: s["source"].eqNullSafe(x))))
    # outer, as else Spark asks for arrays that aren't empty before, and makes them twice
    best = like.select("ids", F.explode_outer(best).alias("b")).filter("b is not null")
    return best.select(F.explode("ids").alias("id"), "b.source", "b.score", "b.before", (-F.col("b.less")).alias("c"))


def matches_by_joins(rows: DataFrame, key: list[str], least: float) -> DataFrame:
    """`matches_in_place` of keys of any size: titles are compared and matched once, whatever the number of their rows."""
    named = rows.filter("asked").select(*key, "t", "id")
    first = F.max(F.struct((-F.col("id")).alias("before"), (-F.col("c")).alias("less"))).alias("o")
    offered = written(rows.filter("not asked").groupBy(*key, "t", "source").agg(first), "offered")
    asked = written(named.select(*key, "t").distinct(), "asked")
    near = near_names(asked.unionByName(offered.select(*key, "t")).distinct().withColumnRenamed("t", "name"), key, least)
    ends = F.array(F.struct(F.col("name1").alias("t"), F.col("name2").alias("other")), F.struct(F.col("name2").alias("t"), F.col("name1").alias("other")))
    near = near.withColumn("score", edit_ratio("name1", "name2")).filter(F.col("score") > least).select(*key, F.explode(ends).alias("x"), "score").select(*key, "x.t", "x.other", "score")
    near = near.unionByName(asked.select(*key, "t", F.col("t").alias("other"), F.lit(1.0).alias("score")))
    matched = near.join(asked, [*key, "t"], "left_semi").join(offered.withColumnRenamed("t", "other"), [*key, "other"])
    matched = matched.groupBy(*key, "t", "source").agg(F.max(F.struct("score", "o.before", "o.less")).alias("b"))
    return named.join(matched, [*key, "t"]).select("id", "source", "b.score", "b.before", (-F.col("b.less")).alias("c"))


# What marks a title as a variant of another (remix, version, quality, live).
VARIANT_PATTERNS = (
    r"\s*\(.*remix.*\)", r"\s*\[.*remix.*\]", r"\s*-\s*remix", r"\s*remix$", r"\s*rmx$",
    r"\s*\(.*version.*\)", r"\s*\[.*version.*\]", r"\s*\(.*edit.*\)", r"\s*\[.*edit.*\]", r"\s*\(.*mix.*\)", r"\s*\[.*mix.*\]",
    r"\s*\(.*remaster.*\)", r"\s*\[.*remaster.*\]", r"\s*\(.*clean.*\)", r"\s*\[.*clean.*\]", r"\s*\(.*explicit.*\)", r"\s*\[.*explicit.*\]",
    r"\s*\(.*live.*\)", r"\s*\[.*live.*\]", r"\s*-\s*live",
)


def variant_base(title: Column) -> Column:
    """The title without the marks of variants."""
    for pattern in VARIANT_PATTERNS:
        title = F.regexp_replace(title, f"(?i){pattern}", "")
    return F.trim(title)


def contained_pairs(names: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, short, long): distinct pairs of names inside `key` of which one holds the other and both differ; empty names are held by none.

    A name of three letters or more is looked for by its rarest piece of three letters, a shorter one as a whole.
    """
    rows = written(names.select(*key, F.col(name).alias("name")).filter(F.col(name) != "").distinct(), "held")
    pieces = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr("name", i, F.lit(n))))
    of = lambda n: rows.filter(F.length("name") >= n).withColumn("piece", F.explode(pieces(n)))
    often = of(3).groupBy("piece").agg(F.count("*").alias("n"))
    rarest = of(3).join(often, "piece").groupBy(*key, "name").agg(F.min(F.struct("n", "piece")).alias("x")).select(*key, F.col("name").alias("short"), F.col("x.piece").alias("piece"))
    pairs = rarest.join(of(3).withColumnRenamed("name", "long"), [*key, "piece"])
    for n in (1, 2):
        tiny = rows.filter(F.length("name") == n).select(*key, F.col("name").alias("short"), F.col("name").alias("piece"))
        pairs = pairs.unionByName(tiny.join(of(n).withColumnRenamed("name", "long"), [*key, "piece"]))
    return pairs.filter(F.col("long").contains(F.col("short")) & (F.col("long") != F.col("short"))).select(*key, "short", "long").distinct()


def title_variants(tracks: DataFrame, whole: int = 1024) -> DataFrame:
    """(artist_id, id1, id2, rule): pairs of an artist's different titles that are variants of one another, each by its smallest track: titles with one base, or a
    title that holds another and has a mark in what is left (`contained`).

    Titles that are equal are one (`track_duplicates` has them), so a title that many tracks bear is in no more pairs than one that a single track bears.
    The titles of an artist with at most `whole` are compared with one another in place; only those of others are looked for by pieces.
    """
    titles = written(tracks.filter("title is not null").groupBy("artist_id", "title").agg(F.min("id").alias("id")), "titles")
    titles = written(once(titles, "title", base=variant_base), "titles")
    marks = "|".join(f"(?:{p})" for p in VARIANT_PATTERNS)
    marked = lambda long, short: F.trim(F.replace(long, short)).rlike(f"(?i){marks}")
    large = large_keys(titles, ["artist_id"], whole)
    small = titles if large is None else titles.join(large, "artist_id", "left_anti")
    shorter = F.length("title1") < F.length("title2")
    short, long = F.when(shorter, F.col("title1")).otherwise(F.col("title2")), F.when(shorter, F.col("title2")).otherwise(F.col("title1"))
    alike, held = F.col("base1") == F.col("base2"), (short != "") & long.contains(short)
    pairs = candidate_pairs(small, ["artist_id"], "id", "title", "base").filter(alike | (held & marked(long, short)))
    pairs = pairs.select("artist_id", "id1", "id2", F.when(alike, "base").otherwise("contained").alias("rule"))
    if large is None:
        return pairs
    titles = titles.join(large, "artist_id", "left_semi")
    same = candidate_pairs(titles, ["artist_id", "base"], "id").select("artist_id", "id1", "id2", F.lit("base").alias("rule"))
    ids = lambda c, n: titles.select("artist_id", F.col("title").alias(c), F.struct("id", "base").alias(n))
    found = contained_pairs(titles, ["artist_id"], "title").filter(marked(F.col("long"), F.col("short")))
    found = found.join(ids("short", "a"), ["artist_id", "short"]).join(ids("long", "b"), ["artist_id", "long"]).filter("a.base <> b.base")
    found = found.select("artist_id", F.least("a.id", "b.id").alias("id1"), F.greatest("a.id", "b.id").alias("id2"), F.lit("contained").alias("rule"))
    return pairs.unionByName(same).unionByName(found)


DUPLICATE = " [DUPLICATE]"


def marked_duplicates(rows: DataFrame, merges: DataFrame, name: str) -> DataFrame:
    """The rows with the mark behind the names of those that were merged into another (merges: id, label)."""
    gone = merges.filter("id <> label").select(F.col("id").alias("_id"))
    return rows.join(gone, F.col("id") == F.col("_id"), "left").withColumn(name, F.when(F.col("_id").isNotNull(), F.concat(name, F.lit(DUPLICATE))).otherwise(F.col(name))).drop("_id")


def dropped_credits(credits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The credits (columns unchanged) without later ones of a like name in the same track and type: of each group of `credit_duplicates` one credit of the least name stays."""
    keyed = once(written(credits, "credits"), "person_name", _name=T.normalize_text)
    folded = written(keyed.select("track_id", "credit_type", F.col("_name").alias("name")).distinct(), "names")
    labels = like_credits(folded, threshold).withColumnRenamed("name", "_name")
    grouped = keyed.join(labels, ["track_id", "credit_type", "_name"], "left").withColumn("_grp", F.coalesce("label", "_name"))
    first = grouped.groupBy("track_id", "credit_type", "_grp").agg(F.min(F.struct("_name", *credits.columns)).alias("x"))
    return first.select("x.*").select(*credits.columns)


def dedup_credits(credits: DataFrame, key: str) -> DataFrame:
    """One credit for each track, type and name, with their number: the least name stands for all. key: lower (case and outer spaces) or folded (letters and digits only)."""
    name = F.lower(F.trim("person_name")) if key == "lower" else F.replace(T.normalize_text(F.col("person_name")), F.lit(" "))
    return credits.groupBy("track_id", "credit_type", name.alias("_key")).agg(F.min("person_name").alias("person_name"), F.count("*").alias("n")).drop("_key")


def result_confidence(bpm: Column, title: Column, asked_title: Column, artist: Column, asked_artist: Column, more: list[Column]) -> Column:
    """0.4 for a tempo, 0.1 if it is from 60 to 200, 0.2 times the word Jaccard similarity of artist and of title where they are known, 0.02 for each further field that holds; at most 1."""
    return confidence_of(bpm, word_points(title, asked_title), word_points(artist, asked_artist), more)


def word_points(a: Column, b: Column) -> Column:
    """0.2 times the word Jaccard similarity; 0 where either isn't known or the first has no word."""
    return F.coalesce(0.2 * F.when(T.normalize_text(a) != "", T.word_jaccard(a, b)), F.lit(0.0))


def confidence_of(bpm: Column, title_points: Column, artist_points: Column, more: list[Column]) -> Column:
    """`result_confidence` by the word points of title and artist, which large tables should hold once a value, not make once a row."""
    flat = F.when(bpm > 0, 0.4).otherwise(0.0) + F.when(bpm.between(60, 200), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), sum((F.when(c, 0.02).otherwise(0.0) for c in more), flat + artist_points + title_points)), 6)


def album_titles(rows: DataFrame, group: list[str]) -> DataFrame:
    """The title of each group: the most frequent one or, among those alike to it above 0.9, the shortest, then the first."""
    counts = rows.groupBy(*group, "title").agg(F.count("*").alias("n"))
    modal = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), "title")).alias("x")).select(*group, F.col("x.title").alias("modal"))
    like = counts.join(modal, group).filter((F.col("title") == F.col("modal")) | (T.ratio(F.col("title"), F.col("modal")) > 0.9))
    return like.groupBy(*group).agg(F.min_by("title", F.struct(F.length("title"), "title")).alias("title"))


def assign_releases(tracks: DataFrame, groups: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, album, reused): each track's album: the existing one with its group's artist and key, else the group's own; groups need a title, an artist and a track."""
    valid = groups.filter("title is not null and title <> '' and artist_id is not null and tracks > 0")
    known = existing.groupBy("artist_id", "key").agg(F.min("id").alias("known"))
    album = valid.join(known, ["artist_id", "key"], "left").select("artist_id", "key", F.coalesce("known", "release_id").alias("album"), F.col("known").isNotNull().alias("reused"))
    return tracks.join(album, ["artist_id", "key"]).select("id", "album", "reused")


def merge_components(pairs: DataFrame, survivors: str = "label") -> DataFrame:
    """(id, survivor): every id of the pairs with the smallest id of its component."""
    return components(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b"))).withColumnRenamed("label", survivors)


def apply_merges(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Re-points a column from merged ids to their survivors."""
    m = merges.select(F.col("id").alias("_id"), F.col("label").alias("_to"))
    return rows.join(m, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_to", column)).drop("_id", "_to")


# What a title says of a release's type, in the order in which the types are asked for.
RELEASE_PATTERNS = {
    "single": r"\bsingle\b|\bfeat\.?\b|\bft\.?\b|\bwith\b.*\bfeat\b",
    "ep": r"\bep\b|\bmini[\s\-]*album\b|\bextended[\s\-]*play\b|\bplaylist\b",
    "mixtape": r"\bmixtape\b|\bmix[\s\-]*tape\b|\btape\b|\bfree[\s\-]*tape\b",
    "live": r"\blive\b|\bconcert\b|\btour\b|\ben[\s\-]*direct\b",
    "compilation": r"\bcompilation\b|\bbest[\s\-]*of\b|\bgreatest[\s\-]*hits\b|\bcollection\b|\bantology\b|\bselected\b",
}
#: The most tracks of a single and of an EP, whatever the title says.
MOST_TRACKS = {"single": 2, "ep": 8}


def release_type(tracks: Column, title: Column) -> Column:
    """single, ep, mixtape, live or compilation, the first that the track count or the title asks for; else an album."""
    t, out = F.lower(title), F.lit("album")
    for kind, pattern in reversed(RELEASE_PATTERNS.items()):
        out = F.when(t.rlike(pattern) | (tracks <= MOST_TRACKS.get(kind, 0)), kind).otherwise(out)
    return out


def release_key(title: Column) -> Column:
    t = T.normalize_text(F.regexp_replace(F.regexp_replace(title, r"[(\[][^)\]]*[)\]]", ""), r"(?i)\b(deluxe|edition|remaster(ed)?|live)\b", ""))
    return F.when(title.isNull(), "_UNKNOWN_").when(t == "", "_ORPHANS_").otherwise(t)


def group_releases(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """Albums of an artist with one key become a release: title (shortest), year, albums, tracks, length, type."""
    facts = tracks.groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("s"))
    a = albums.join(facts, "id", "left").withColumn("key", release_key(F.col("title")))
    out = a.groupBy("artist_id", "key").agg(F.min_by("title", F.struct(F.length("title"), "title")).alias("title"), F.min("release_date").alias("release_date"), F.count("*").alias("albums"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"), F.sum("s").alias("seconds"), F.min("id").alias("release_id"))
    return out.withColumn("kind", release_type(F.col("tracks"), F.col("title")))


def orphan_bucket(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike("feat"), "collaborations").when(t.rlike("remix"), "remixes").when(t.rlike("freestyle|live"), "freestyles").otherwise("singles")
