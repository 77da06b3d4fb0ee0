"""Exact best matches and searches of many requests at once, without a block and without all pairs.

Every bound here is lossless: what isn't brought together can't reach the rule's score, or can't beat what was found.
Equal rows are one profile (its smallest id stands for all), so a title that many rows bear meets others once.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagrain.functions import text as T
from mediagrain.operators.components import written
from mediagrain.operators.linkage import near_pairs

RATIO_FLOOR = 0.7  # what near_pairs can search for


def _plain(c: str) -> Column:
    return T.normalize_text(F.col(c))


def _ratio(a: str, b: str) -> Column:
    """The edit ratio of normalised names; null, which counts in no mean, where one is null or empty."""
    return F.when((F.col(a) != "") & (F.col(b) != ""), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _near_values(asked: DataFrame, offered: DataFrame, name: str, ratio: float) -> DataFrame:
    """(ask, give): values of column `name` of both tables whose edit ratio may be `ratio` or more."""
    one = asked.select(F.lit(0).alias("side"), F.col(name).alias("v")).distinct()
    two = offered.select(F.lit(1).alias("side"), F.col(name).alias("v")).distinct()
    both = one.unionByName(two).filter("v <> ''").withColumn("row", F.struct("side", "v"))
    met = near_pairs(both, [], "row", "v", ratio).filter("id1.side = 0 and id2.side = 1").select(F.col("id1.v").alias("ask"), F.col("id2.v").alias("give"))
    equal = one.join(two.select("v"), "v").filter("v <> ''").select(F.col("v").alias("ask"), F.col("v").alias("give"))
    return met.unionByName(equal).distinct()


def best_by_edits(refs: DataFrame, others: DataFrame, fields: list[str], least: float = 0.7) -> DataFrame:
    """(id, source, other_id, score): for each reference row and source the row of the highest mean edit ratio over the fields, above `least` (at least 0.7); of equal ones the smallest id.

    refs: id and the fields; others: source, other_id and the fields. A field that is missing or empty in either row
    doesn't count; rows without a common field match nothing. A mean of t or more over n fields needs every one of
    them at 1 - n * (1 - t) or more, and one at t or more. So a first round finds what reaches the t at which the first
    bound is 0.7 by the first field alone; only rows for which some source offers nothing of that score take
    part in the second, in which one field after the other brings together values alike to `least`.
    """
    if least < RATIO_FLOOR:
        raise ValueError(f"least must be {RATIO_FLOOR} or more")
    n = len(fields)
    keyed = written(refs.select("id", *(F.coalesce(_plain(f), F.lit("")).alias(f) for f in fields)), "refs")
    asked = written(keyed.select(*fields).distinct(), "asked")
    offered = written(others.groupBy("source", *(F.coalesce(_plain(f), F.lit("")).alias(f) for f in fields)).agg(F.min("other_id").alias("other_id")), "offered")

    def scored(asked: DataFrame, field: str, ratio: float) -> DataFrame:
        near = _near_values(asked, offered, field, ratio)
        met = asked.select(*(F.col(f).alias(f"{f}_a") for f in fields)).join(near, F.col(f"{field}_a") == F.col("ask")).join(offered, F.col("give") == F.col(field))
        ratios = F.array_compact(F.array(*(_ratio(f"{f}_a", f) for f in fields)))
        score = F.aggregate(ratios, F.lit(0.0), lambda s, x: s + x) / F.size(ratios)
        best = met.withColumn("score", score).groupBy("source", *(f"{f}_a" for f in fields)).agg(F.max(F.struct("score", (-F.col("other_id")).alias("k"))).alias("x"))
        return best.select("source", *(F.col(f"{f}_a").alias(f) for f in fields), (-F.col("x.k")).alias("other_id"), F.col("x.score").alias("score"))

    # the first bound holds where all fields count: for whole rows, in sources of whole rows
    whole = " and ".join(f"{f} <> ''" for f in fields)
    sources = offered.groupBy("source").agg(F.count_if(~F.expr(whole)).alias("partial"))
    first = scored(asked.filter(whole), fields[0], RATIO_FLOOR).join(sources.filter("partial = 0").select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = written(first.filter(F.col("score") >= 1 - (1 - RATIO_FLOOR) / n), "first")
    settled = first.groupBy(*fields).agg(F.count("*").alias("settled")).filter(F.col("settled") == sources.count())
    rest = written(asked.join(settled, fields, "left_anti"), "rest")
    found = first
    if not rest.isEmpty():
        for field in fields:
            found = found.unionByName(scored(rest, field, least))
    best = found.filter(F.col("score") > least).groupBy("source", *fields).agg(F.max(F.struct("score", (-F.col("other_id")).alias("k"))).alias("x"))
    return keyed.join(best, fields).select("id", "source", (-F.col("x.k")).alias("other_id"), F.round("x.score", 6).alias("score"))


def cross_referenced(refs: DataFrame, best: DataFrame) -> DataFrame:
    """(id, sources, confidence): in how many sources a row has a match, and the product of their scores (1 without one)."""
    products = best.groupBy("id").agg(F.count("*").alias("sources"), F.product("score").alias("confidence"))
    return refs.select("id").join(products, "id", "left").select("id", F.coalesce("sources", F.lit(0)).alias("sources"), F.round(F.coalesce("confidence", F.lit(1.0)), 6).alias("confidence"))


def _words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(_plain(c), " "), lambda w: w != ""))


def _overlap(a: str, b: str) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def best_by_words(requests: DataFrame, candidates: DataFrame, title: float = 0.6, artist: float = 0.4, bonus: float = 0.1, least: float = 0.5) -> DataFrame:
    """(id, other_id, score, found): for each request (id, title, artist) the candidate (other_id, title, artist, bpm) of the highest score, if that is `least` or more; of equal ones the smallest id.

    The score weighs the Jaccard similarity of the words of both fields, and a known tempo adds the bonus. A pair that can
    reach `least` (a) shares a word of both fields: these are joined on pairs of words; or (b) has no artist word in common:
    then its titles share one of their first, rarest words up to the length that the needed similarity leaves; or (c)
    has no title word in common: then it is the smallest id of its artist's words, with or without a tempo. Missing
    fields have no words.
    """
    profile = lambda rows, *more: rows.select(*more, F.array_sort(F.coalesce(_words("title"), F.array().cast("array<string>"))).alias("t"), F.array_sort(F.coalesce(_words("artist"), F.array().cast("array<string>"))).alias("a"))
    asks = written(profile(requests, "id"), "asks")
    asked = asks.select("t", "a").distinct()
    offered = profile(candidates, "other_id", F.col("bpm").isNotNull().alias("known")).groupBy("t", "a", "known").agg(F.min("other_id").alias("other_id"))
    offered = written(offered, "offers")
    ends = lambda rows: (rows.select(F.col("t").alias("t1"), F.col("a").alias("a1")), offered.select(F.col("t").alias("t2"), F.col("a").alias("a2"), "known", "other_id"))
    one, two = ends(asked)

    pairs_of_words = lambda t, a: F.explode(F.flatten(F.transform(t, lambda x: F.transform(a, lambda y: F.struct(x, y)))))
    both = one.withColumn("key", pairs_of_words(F.col("t1"), F.col("a1"))).join(two.withColumn("key", pairs_of_words(F.col("t2"), F.col("a2"))), "key").drop("key")

    # (b): the similarity that titles need without a word of the artist; rare words first in both
    needed = (least - bonus) / title
    counts = offered.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rarest = lambda rows, t: rows.select(t).distinct().withColumn("word", F.explode(t)).join(counts, "word", "left").groupBy(t).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ranked"))
    length = F.size("ranked") - F.ceil(needed * F.size("ranked") - 1e-9).cast("int") + 1
    first = lambda rows, t: rows.join(rarest(rows, t), t).withColumn("key", F.explode(F.slice("ranked.word", F.lit(1), length))).drop("ranked")
    titles = first(one, "t1").join(first(two, "t2"), "key").drop("key")

    # (c): the smallest id of each set of artist words
    named = two.groupBy("a2", "known").agg(F.min(F.struct("other_id", "t2")).alias("x")).select("x.t2", "a2", "known", "x.other_id")
    artists = one.withColumn("key", F.explode("a1")).join(named.withColumn("key", F.explode("a2")), "key").drop("key") if artist + bonus >= least else None

    met = both.unionByName(titles) if artists is None else both.unionByName(titles).unionByName(artists)
    score = title * _overlap("t1", "t2") + artist * _overlap("a1", "a2") + F.when(F.col("known"), bonus).otherwise(0.0)
    best = met.withColumn("score", F.round(score, 6)).filter(F.col("score") >= least).groupBy("t1", "a1").agg(F.max(F.struct("score", (-F.col("other_id")).alias("k"))).alias("x"))
    out = asks.join(best, (F.col("t") == F.col("t1")) & (F.col("a") == F.col("a1")), "left")
    return out.select("id", (-F.col("x.k")).alias("other_id"), F.col("x.score").alias("score"), F.col("x").isNotNull().alias("found"))


def search(requests: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    """(request, rank, id, score): the `k` most relevant rows of `catalogue` (id, name) for each request (request, query), by score, then id.

    Relevance (`text.relevance`) is 1 for the query itself, 0.8 for a name that holds it, 0.7 for one that it holds, else the share
    of its words that are found; rows of no relevance are left out. Names that hold a query, or are held by it, are found by
    the rarer text's rarest piece of three letters (all shorter texts by a word or as a whole). Words are taken from the rarest on, a round
    for each: a request that has `k` rows which no name without the words so far can beat takes no further part.
    """
    asks = written(requests.select("request", _plain("query").alias("q")).filter("q <> ''"), "asks")
    rows = catalogue.select("id", _plain("name").alias("name")).filter("name is not null")
    rows = written(rows.withColumn("own", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter(F.col("own") <= k).drop("own"), "rows")
    names = written(rows.select("name").distinct(), "names")
    queries = asks.select("q").distinct()
    words = lambda c: F.array_distinct(F.split(c, " "))

    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))
    often = names.select(F.explode(grams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = lambda texts, c: texts.filter(F.length(c) > 2).withColumn("gram", F.explode(grams(F.col(c)))).join(often, "gram", "left").groupBy(c).agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("x")).select(c, F.col("x.gram").alias("gram"))
    all_grams = lambda texts, c: texts.select(c, F.explode(grams(F.col(c))).alias("gram"))
    # a query of one or two letters, or a name of as many, is looked for in the pieces of the other
    short = lambda texts, c: texts.filter(F.length(c).between(1, 2)).withColumn("gram", F.col(c))
    bits = lambda texts, c: texts.select(c, F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substr(c, i, F.lit(1)), F.substr(c, i, F.lit(2))))))).alias("gram")).filter("gram <> ''")
    full = names.filter("name <> ''").select("name")
    held = rarest(queries, "q").join(all_grams(full, "name"), "gram").select("q", "name")
    held = held.unionByName(rarest(full, "name").join(all_grams(queries, "q"), "gram").select("q", "name"))
    held = held.unionByName(short(queries, "q").join(bits(full, "name"), "gram").select("q", "name")).unionByName(short(full, "name").join(bits(queries, "q"), "gram").select("q", "name"))
    holds = written(held.filter(F.col("name").contains(F.col("q")) | F.col("q").contains(F.col("name"))).distinct(), "holds")

    index = written(names.select("name", F.explode(words(F.col("name"))).alias("word")), "index")
    counts = index.groupBy("word").agg(F.count("*").alias("often"))
    asked = queries.select("q", F.explode(words(F.col("q"))).alias("word")).join(counts, "word")
    place = F.row_number().over(Window.partitionBy("q").orderBy("often", "word"))
    asked = written(asked.withColumn("place", place).withColumn("known", F.count("*").over(Window.partitionBy("q"))), "asked")
    most = asked.agg(F.max("place")).first()[0] or 0

    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = lambda pairs: pairs.join(rows, "name").withColumn("rank", ranked).filter(F.col("rank") <= k)
    found = written(best(holds.withColumn("score", T.relevance(F.col("q"), F.col("name"))).unionByName(_empty_names(queries, names))), "found")
    left = queries
    for at in range(1, most + 1):
        met = left.join(asked.filter(F.col("place") == at), "q").join(index, "word").select("q", "name")
        met = met.withColumn("score", T.relevance(F.col("q"), F.col("name")))
        found = written(best(met.unionByName(found.select("q", "name", "score")).distinct()), "found")
        # a name without the words so far holds, at the most, the known words that are left
        bound = asked.groupBy("q").agg(F.max("known").alias("known")).select("q", (F.greatest(F.col("known") - at, F.lit(0)) / F.size(words(F.col("q")))).alias("bound"))
        kth = found.filter(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        left = written(left.join(bound, "q").join(kth, "q", "left").filter((F.col("bound") > 0) & (F.col("kth").isNull() | (F.col("kth") <= F.col("bound")))).select("q"), "left")
        if left.isEmpty():
            break
    return asks.join(found, "q").select("request", "rank", "id", F.round("score", 6).alias("score"))


def _empty_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """A name that normalises to nothing is held by every query."""
    return queries.withColumn("name", F.lit("")).join(names, "name").select("q", "name", F.lit(0.7).alias("score"))
