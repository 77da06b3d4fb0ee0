"""Reports over scored and gappy rows: enrichment priorities and plans, validation and quality reports. Each is partial aggregates of one pass."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagrain.operators.components import written

# For each field its weight in completeness, the effort to fill it, seconds an item, and where it may come from.
FIELDS = {
    "album": (15.0, "Low", 0.5, ("Database", "Spotify", "Discogs")),
    "release_date": (10.0, "Low", 0.5, ("Database", "Spotify", "Discogs")),
    "duration": (10.0, "Low", 1.0, ("Spotify", "YouTube")),
    "bpm": (10.0, "Medium", 2.0, ("Spotify", "Essentia", "Inference")),
    "key": (5.0, "Medium", 2.0, ("Spotify", "Essentia")),
    "genres": (10.0, "Low", 1.0, ("Database", "Spotify", "LastFM", "Inference")),
    "producer": (20.0, "High", 3.0, ("Genius", "Discogs", "Database")),
    "lyrics": (20.0, "High", 5.0, ("Genius", "Musixmatch")),
}
CRITICAL = ("producer", "album", "duration")
#: How many missing items one call to a source fills.
CALLS = {"Spotify": 1, "Genius": 1, "Discogs": 10}
RANKS = ("High", "Medium", "Low", "Optional")
#: Upper ends of the score ranges.
RANGES = ((50, "0-50"), (70, "50-70"), (85, "70-85"), (95, "85-95"), (None, "95-100"))


def _field_table(spark) -> DataFrame:
    rows = [(f, i, w, effort, s, list(sources), sum(1 for x in sources if CALLS.get(x) == 1), "Discogs" in sources) for i, (f, (w, effort, s, sources)) in enumerate(FIELDS.items())]
    return F.broadcast(spark.createDataFrame(rows, "field string, place int, weight double, effort string, item_seconds double, sources array<string>, single_calls int, batch_calls boolean"))


def enrichment_priorities(rows: DataFrame, group: str) -> DataFrame:
    """For each group and field of FIELDS that is missing anywhere (a column of that name is null or false): count, percentage, priority, rank, effort and sources.

    `completeness` is the share of the fields that less than half of the group's rows miss.
    """
    missing = lambda f: F.count_if(~F.coalesce(F.col(f) if f in ("producer", "lyrics") else F.col(f).isNotNull(), F.lit(False)))
    counts = rows.groupBy(group).agg(F.count("*").alias("total"), *(missing(f).alias(f) for f in FIELDS))
    filled = sum((F.when(F.col(f) < F.col("total") * 0.5, 1).otherwise(0) for f in FIELDS), F.lit(0))
    long = counts.withColumn("completeness", F.round(100 * filled / len(FIELDS), 1)).unpivot([group, "total", "completeness"], list(FIELDS), "field", "missing").filter("missing > 0")
    pct = 100 * F.col("missing") / F.col("total")
    level = F.when(F.col("field").isin(*CRITICAL) & (pct > 20), "High").when(pct > 50, "High").when(pct > 30, "Medium").when(pct > 10, "Low").otherwise("Optional")
    out = long.withColumns({"pct": F.round(pct, 1), "priority": level}).join(_field_table(rows.sparkSession), "field")
    order = [F.array_position(F.array(*map(F.lit, RANKS)), F.col("priority")), F.desc("pct"), F.col("place")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))  # at most a row for each field


def enrichment_plan(priorities: DataFrame, group: str, target: float = 80.0) -> DataFrame:
    """The fields of each group, by rank, until their gains bring its completeness to `target`: rows to fill, gain, hours and calls. Groups that are there already have none."""
    gain = F.col("missing") / F.col("total") * F.col("weight")
    before = F.coalesce(F.sum("gain").over(Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = priorities.withColumn("gain", gain).withColumn("before", before).filter(F.col("completeness") + F.round("before", 9) < target)
    calls = F.col("missing") * F.col("single_calls") + F.when(F.col("batch_calls"), F.floor(F.col("missing") / CALLS["Discogs"])).otherwise(0)
    return out.withColumns({"hours": F.col("item_seconds") * F.col("missing") / 3600, "calls": calls.cast("long")})


def plan_totals(plan: DataFrame, group: str) -> DataFrame:
    """A group's plan in one row: tasks, urgent tasks, hours, calls and the completeness to expect."""
    out = plan.groupBy(group).agg(F.max("completeness").alias("completeness"), F.count("*").alias("tasks"), F.count_if(F.col("priority") == "High").alias("urgent"), F.sum("hours").alias("hours"), F.sum("calls").alias("calls"), F.sum("gain").alias("gain"))
    return out.select(group, "completeness", F.round(F.least(F.lit(100.0), F.col("completeness") + F.col("gain")), 4).alias("expected"), "tasks", "urgent", F.round("hours", 6).alias("hours"), "calls")


def quality_metrics(rows: DataFrame, as_of: Column, fresh_days: int = 30, shortest: int = 30, longest: int = 600) -> DataFrame:
    """One row over tracks with facts (has_producer, n_credits): how many have what, credits a track, freshness and the mean of five shares, in percent."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    has = {"producer": F.col("has_producer"), "duration": F.col("duration_seconds") > 0, "credits": F.col("n_credits") > 0, "album": F.col("album_id").isNotNull()}
    fresh = F.date_diff(as_of, F.col("release_date")) < fresh_days
    out = rows.agg(
        F.count("*").alias("tracks"), *(count(c).alias(f"with_{n}") for n, c in has.items()), count(F.col("bpm") > 0).alias("with_bpm"), count(F.col("has_lyrics")).alias("with_lyrics"),
        count(F.col("duration_seconds").between(shortest, longest)).alias("valid_duration"), F.round(F.avg("n_credits"), 6).alias("mean_credits"), F.round(100 * share(fresh), 6).alias("freshness"),
        F.round(100 * (sum((share(c) for c in has.values()), F.lit(0.0)) + share(fresh)) / 5, 6).alias("overall"),
    )
    return out


def group_quality(rows: DataFrame, group: str, metrics: list[str], low: float = 40, often: float = 0.5, k: int = 3) -> DataFrame:
    """Per group over scored rows (metrics, overall, issues): means (cut to four decimals), the share below `low`, and the `k` issues that more than `often` of the rows have."""
    rows = written(rows.select(group, *metrics, "overall", F.array_distinct(F.transform("issues", lambda x: x["name"])).alias("issues")), "rows")
    mean = lambda m: (F.floor(F.avg(m) * 10_000 + 0.001) / 10_000).alias(m)
    means = rows.groupBy(group).agg(F.count("*").alias("rows"), *(mean(m) for m in [*metrics, "overall"]), F.round(F.avg((F.col("overall") < low).cast("double")), 6).alias("low_share"))
    found = rows.select(group, F.explode("issues").alias("issue")).groupBy(group, "issue").agg(F.count("*").alias("n"))
    frequent = found.join(means.select(group, "rows"), group).filter(F.col("n") > often * F.col("rows"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "issue"))  # a row for each rule
    top = frequent.withColumn("place", place).filter(F.col("place") <= k).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "issue"))), lambda x: x["issue"]), ",").alias("recurring"))
    return means.join(top, group, "left").withColumn("recurring", F.coalesce("recurring", F.lit("")))


def validation_report(checked: DataFrame, key: str, level: Column, advice: dict[str, str], k: int = 3) -> DataFrame:
    """(section, name, n, pct, detail) over checked rows (score, is_valid, issues): totals, levels, score ranges, every rule with `k` examples, the five most frequent and what they advise."""
    marked = checked.select(F.col(key).alias("id"), "score", "is_valid", "issues", level.alias("level"))
    total = F.broadcast(marked.agg(F.count("*").alias("all")))
    span = F.lit(RANGES[-1][1])
    for high, name in reversed(RANGES[:-1]):
        span = F.when(F.col("score") < high, name).otherwise(span)
    part = lambda section, name, one: F.struct(F.lit(section).alias("section"), name.alias("name"), one.alias("one"))
    parts = F.array(part("total", F.lit("valid"), F.col("is_valid").cast("int")), part("level", F.col("level"), F.lit(1)), part("range", span, F.lit(1)))
    counts = marked.select(F.explode(parts).alias("x"), "score").groupBy("x.section", "x.name").agg(F.sum("x.one").cast("long").alias("n"), F.avg("score").alias("mean"))
    counts = counts.select("section", "name", "n", F.when(F.col("section") == "total", F.concat(F.lit("mean "), F.format_number("mean", 2))).otherwise("").alias("detail"))
    found = marked.select("id", F.explode("issues").alias("x")).select("id", F.col("x.name").alias("name"))
    rules = found.groupBy("name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    examples = found.withColumn("place", place).filter(F.col("place") <= k).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("detail"))
    rules = rules.join(examples, "name").select(F.lit("rule").alias("section"), "name", "n", "detail")
    top = rules.orderBy(F.desc("n"), "name").limit(5)
    said = F.element_at(F.create_map(*(F.lit(x) for kv in advice.items() for x in kv)), F.col("name"))
    top = top.select(F.lit("top").alias("section"), "name", "n", F.coalesce(said, F.lit("")).alias("detail"))
    every = counts.unionByName(rules).unionByName(top)
    return every.join(total).select("section", "name", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("pct"), "detail")


def cleaning_report(checked: DataFrame, missing: dict[str, str]) -> DataFrame:
    """(section, name, n, pct) over checked rows (issues): rows with issues, levels by the number of issues (0, 1, 3, more), every issue, and rows that miss a field (a condition each)."""
    n = F.size("issues")
    level = F.when(n == 0, "excellent").when(n <= 1, "good").when(n <= 3, "average").otherwise("poor")
    part = lambda section, name, one: F.struct(F.lit(section).alias("section"), name.alias("name"), one.cast("int").alias("one"))
    fixed = [part("tracks", F.lit("with_issues"), n > 0), part("level", level, F.lit(1)), *(part("missing", F.lit(f), F.coalesce(F.expr(w), F.lit(False))) for f, w in missing.items())]
    own = F.transform("issues", lambda x: F.struct(F.lit("issue").alias("section"), x["name"].alias("name"), F.lit(1).alias("one")))
    counts = checked.select(F.explode(F.concat(F.array(*fixed), own)).alias("x")).groupBy("x.section", "x.name").agg(F.sum("x.one").cast("long").alias("n"))
    return counts.join(F.broadcast(checked.agg(F.count("*").alias("all")))).select("section", "name", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("pct"))
