"""Rule tables for validation and quality scores.

A rule is (name, severity, predicate, points). Predicates are Spark SQL text over the row's columns, so a
rule table is data that users can keep and change. `apply_rules` evaluates a whole table in one
projection: an array of issues, the score and flags; nothing is shuffled.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    severity: str
    when: str
    points: float


def apply_rules(df: DataFrame, rules: list[Rule], bonuses: list[tuple[str, float]] = (), base: float = 100.0, critical: str = "critical") -> DataFrame:
    """Adds issues (array of name and severity), score (0 to 100) and is_valid (no critical issue)."""
    hit = lambda r: F.coalesce(F.expr(r.when), F.lit(False))
    issues = F.array_compact(F.array(*(F.when(hit(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))) for r in rules)))
    score = F.lit(float(base))
    for r in rules:
        score -= F.when(hit(r), float(r.points)).otherwise(0.0)
    for when, points in bonuses:
        score += F.when(F.coalesce(F.expr(when), F.lit(False)), float(points)).otherwise(0.0)
    return df.withColumns({"issues": issues, "score": F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), "is_valid": ~F.coalesce(F.array_contains(F.transform(issues, lambda x: x["severity"]), critical), F.lit(False))})


def ladder(score: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """The label of the first bound that the score reaches."""
    out = F.lit(lowest)
    for bound, label in sorted(steps):
        out = F.when(score >= bound, label).otherwise(out)
    return out


VALIDATION_STEPS = [(90, "excellent"), (80, "good"), (70, "average"), (50, "poor")]
QUALITY_STEPS = [(90, "excellent"), (75, "good"), (60, "average"), (40, "poor")]
# Patterns of suspicious titles, matched at the beginning.
SUSPICIOUS = ("^[^a-zA-Z0-9]+$", "^(test|debug|temp)", "^[<>{}]", "^(javascript|script)")
LIMITS = {"basic": (15, 600), "standard": (15, 600), "strict": (30, 600), "paranoid": (45, 600)}  # fixed values: seconds


def track_rules(level: str = "standard") -> list[Rule]:
    low, high = LIMITS[level]
    return [
        Rule("missing_title", "critical", "title IS NULL OR title = ''", 30),
        Rule("suspicious_title", "warning", f"title RLIKE '{'|'.join(SUSPICIOUS)}'", 10),
        Rule("long_title", "warning", "length(title) > 200", 10),
        Rule("missing_artist", "critical", "artist_id IS NULL", 30),
        Rule("missing_duration", "warning", "duration_seconds IS NULL", 10),
        Rule("short_duration", "warning", f"duration_seconds < {low}", 10),
        Rule("long_duration", "warning", f"duration_seconds > {high}", 10),
        Rule("missing_bpm", "info", "bpm IS NULL", 2),
        Rule("bpm_range", "warning", "bpm < 60 OR bpm > 200", 10),
        Rule("track_number", "warning", "track_number < 1 OR track_number > 100", 5),
        Rule("beats", "info", "duration_seconds / 60.0 * bpm < 50 OR duration_seconds / 60.0 * bpm > 1000", 2),
        Rule("no_producer", "warning", "NOT has_producer", 5),
    ]


TRACK_BONUSES = [("has_lyrics", 5), ("bpm IS NOT NULL AND duration_seconds IS NOT NULL", 5), ("album_id IS NOT NULL", 3), ("has_producer", 3), ("n_credits > 2", 4)]
ARTIST_RULES = [Rule("missing_name", "critical", "name IS NULL OR name = ''", 40), Rule("digits_only", "warning", "name RLIKE '^[0-9]+$'", 15), Rule("no_letter", "warning", "NOT name RLIKE '[a-zA-Z]'", 15), Rule("null_name", "critical", "lower(name) RLIKE '^(unknown|none|null|undefined)'", 40), Rule("in_debt", "info", "balance < 0", 5)]
ARTIST_BONUSES = [("country IS NOT NULL", 5), ("genre = 'MUSIC' OR genre = 'MACHINERY'", 5)]
CREDIT_RULES = [Rule("missing_person", "critical", "person_name IS NULL OR person_name = ''", 35), Rule("short_person", "warning", "length(person_name) < 3", 15), Rule("missing_type", "critical", "credit_type IS NULL", 35), Rule("minor_type", "info", "credit_type = 'mixing'", 5), Rule("odd_part", "warning", "part % 7 = 0", 15)]
PIPELINE_RULES = [Rule("title", "error", "title IS NULL OR title = ''", 1), Rule("artist", "error", "artist_id IS NULL", 1), Rule("duration", "error", "duration_seconds < 10 OR duration_seconds > 1800", 1), Rule("bpm", "error", "bpm < 60 OR bpm > 200", 1)]
INTEGRITY_RULES = [Rule("title", "error", "title IS NULL OR title = ''", 1), Rule("artist", "error", "artist_id IS NULL", 1), Rule("duration", "error", "duration_seconds < 30 OR duration_seconds > 1800", 1), Rule("bpm", "error", "bpm < 40 OR bpm > 300", 1), Rule("credits", "error", "n_credits = 0", 1), Rule("producer", "error", "NOT has_producer", 1)]
DEDUCTIONS = [Rule("lyrics", "minor", "NOT has_lyrics", 20), Rule("duration", "minor", "duration_seconds IS NULL", 15), Rule("bpm", "minor", "bpm IS NULL", 10), Rule("album", "minor", "album_id IS NULL", 10)]
# The constraints of the record schemas: lengths, ranges, the form of a key, and counts and years that must agree.
_LENGTH = lambda c, most: Rule(f"{c}_length", "error", f"length(trim({c})) < 1 OR length({c}) > {most}", 1)
_RANGE = lambda c, low, high: Rule(f"{c}_range", "error", f"{c} < {low} OR {c} > {high}", 1)
SCHEMA_RULES = [
    _LENGTH("title", 300), Rule("track_number", "error", "track_number < 1", 1), _RANGE("duration_seconds", 1, 1800), _RANGE("bpm", 40, 300), _RANGE("release_year", 1900, 2030),
    Rule("key_form", "error", "NOT (lower(musical_key) RLIKE '^ *[a-g][#b]? *(major|minor|maj|min)? *$')", 1), Rule("snippet_length", "error", "length(snippet) > 500", 1),
    Rule("year_of_date", "error", "year(release_date) <> release_year", 1),
]
ALBUM_SCHEMA = [_LENGTH("title", 300), _RANGE("release_year", 1900, 2030), _RANGE("total_tracks", 1, 200), Rule("label_length", "error", "length(label) > 200", 1), Rule("year_of_date", "error", "year(release_date) <> release_year", 1)]
ARTIST_SCHEMA = [_LENGTH("name", 200), Rule("country_length", "error", "length(country) > 100", 1)]
CREDIT_SCHEMA = [_LENGTH("person_name", 200), Rule("role_length", "error", "length(role_detail) > 200", 1), Rule("instrument_length", "error", "length(instrument) > 100", 1)]
SESSION_SCHEMA = [Rule("negative_counts", "error", "total_tracks < 0 OR completed_tracks < 0 OR failed_tracks < 0", 1), Rule("more_than_all", "error", "completed_tracks + failed_tracks > total_tracks", 1)]


def with_credit_facts(tracks: DataFrame, credits: DataFrame) -> DataFrame:
    """Adds n_credits and has_producer."""
    facts = credits.groupBy(F.col("track_id").alias("id")).agg(F.count("*").alias("n_credits"), F.bool_or(F.col("credit_type") == "producer").alias("has_producer"))
    return tracks.join(facts, "id", "left").withColumns({"n_credits": F.coalesce("n_credits", F.lit(0)), "has_producer": F.coalesce("has_producer", F.lit(False))})


def completeness(fields: list[str]) -> Column:
    """Percentage of filled fields; '', 0 and false count as missing."""
    filled = sum((F.when(F.coalesce(F.expr(f"{f} IS NOT NULL AND cast({f} AS string) NOT IN ('', '0', '0.0', 'false')"), F.lit(False)), 1).otherwise(0) for f in fields), F.lit(0))
    return filled * 100.0 / len(fields)


def validity(checks: list[tuple[str, str]]) -> Column:
    """Percentage of valid among present values; 0 if none is present."""
    present = sum((F.when(F.expr(f"{c} IS NOT NULL"), 1).otherwise(0) for c, _ in checks), F.lit(0))
    valid = sum((F.when(F.coalesce(F.expr(p), F.lit(False)), 1).otherwise(0) for _, p in checks), F.lit(0))
    return F.when(present == 0, 0.0).otherwise(valid * 100.0 / F.greatest(present, F.lit(1)))


def freshness(date: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, date)
    return F.when(date.isNull(), 0.0).when(age <= 30, 100.0).when(age <= 60, 50.0).otherwise(25.0)


def consistency(featured: Column, n_credits: Column) -> Column:
    """100 where featured names or credits could be checked, 0 where there is nothing to check."""
    return F.when(featured | (n_credits > 0), 100.0).otherwise(0.0)


def with_uniqueness(tracks: DataFrame, least: float = 0.9) -> DataFrame:
    """Adds uniqueness to tracks, which are read twice: 0 for tracks of an artist with another whose lower-cased title shares more than `least` of the words (Jaccard), else 100.

    Equal word sets are counted. Different ones meet by a prefix of their words: of n words, sets above the bound share
    one of the first n - ceil(least * n) + 1 in any common order; sets of fewer than 1 / (1 - least) words can't differ.
    """
    words = F.array_sort(F.array_distinct(F.split(F.trim(F.lower("title")), r"\s+")))
    keyed = tracks.withColumn("w", words)
    sets = keyed.groupBy("artist_id", "w").agg(F.count("*").alias("n"))
    n = F.size("w")
    long = sets.filter(n > 1 / (1 - least) - 1)
    order = F.transform(F.array_sort(F.transform("w", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s["x"])
    prefixed = long.select("artist_id", "w", F.explode(F.slice(order, 1, n - F.ceil(least * n).cast("int") + 1)).alias("word"))
    met = prefixed.join(prefixed.withColumnRenamed("w", "v"), ["artist_id", "word"]).filter(F.col("w") != F.col("v"))
    near = met.filter(F.size(F.array_intersect("w", "v")) > least * F.size(F.array_union("w", "v"))).select("artist_id", "w").distinct().withColumn("near", F.lit(True))
    judged = sets.join(near, ["artist_id", "w"], "left")
    unique = F.when((F.col("n") > 1) | F.col("near"), 0.0).otherwise(100.0)
    return keyed.join(judged, ["artist_id", "w"]).withColumn("uniqueness", unique).drop("w", "n", "near")


def uniqueness(tracks: DataFrame, least: float = 0.9) -> DataFrame:
    """(id, uniqueness) of tracks."""
    return with_uniqueness(tracks.select("id", "artist_id", "title"), least).select("id", "uniqueness")


#: Weights of the five metrics in the overall score.
METRICS = [("completeness", 0.35), ("validity", 0.20), ("consistency", 0.15), ("freshness", 0.10), ("uniqueness", 0.20)]


def recommendations(issues: Column) -> Column:
    """What to do first, from the issues and the metrics of a row."""
    has = lambda name: F.exists(issues, lambda x: x["name"] == name)
    critical = F.size(F.filter(issues, lambda x: x["severity"] == "critical"))
    return F.array_compact(F.array(F.when(critical > 0, F.concat(F.lit("fix_critical:"), critical.cast("string"))), F.when(F.col("completeness") < 70, "enrich"), F.when(F.col("freshness") < 50, "refresh"), F.when(has("no_producer"), "add_producer"), F.when(F.col("n_credits") == 0, "extract_credits")))


def weighted(parts: list[tuple[str, float]]) -> Column:
    return sum((F.col(c) * w for c, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def clean_numbers(df: DataFrame) -> DataFrame:
    """Tempos from 40 to below 60 are doubled, negative track numbers become null."""
    return df.withColumns({"bpm": F.when((F.col("bpm") >= 40) & (F.col("bpm") < 60), F.col("bpm") * 2).otherwise(F.col("bpm")), "track_number": F.when(F.col("track_number") >= 0, F.col("track_number"))})


def fold_bpm(bpm: Column) -> Column:
    return F.when((bpm < 60) & (bpm * 2 >= 60) & (bpm * 2 <= 200), bpm * 2).when((bpm > 200) & (bpm / 2 >= 60) & (bpm / 2 <= 200), bpm / 2).otherwise(bpm)


def modal_fix(df: DataFrame, group: str, column: str) -> DataFrame:
    """Every row of a group gets the group's most frequent value; `fixed` marks changed rows."""
    counts = df.groupBy(group, column).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), column)).alias("x")).select(group, F.col(f"x.{column}").alias("modal"))
    return df.join(best, group).withColumn("fixed", F.col(column) != F.col("modal")).drop(column).withColumnRenamed("modal", column)


def improvement_plan(scored: DataFrame, k: int = 10, majors: int = 5) -> DataFrame:
    """The k first steps of each row (rank, priority, step, gain): all critical issues, the first major ones, metrics below 50; in the row itself."""
    step = lambda priority, name, gain: F.struct(F.lit(priority).alias("priority"), name.alias("step"), F.round(gain, 4).alias("gain"))
    of = lambda severity: F.filter("issues", lambda x: x["severity"] == severity)
    critical = F.transform(of("critical"), lambda x: step(1, x["name"], F.lit(10.0)))
    major = F.transform(F.slice(of("warning"), 1, majors), lambda x: step(2, x["name"], F.lit(5.0)))
    weak = F.array_compact(F.array(*(F.when(F.col(m) < 50, step(3, F.lit(m), (100 - F.col(m)) / 2)) for m, _ in METRICS)))
    return scored.select("id", F.posexplode(F.slice(F.concat(critical, major, weak), 1, k)).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), "x.*")


def suggestions(metrics: DataFrame) -> DataFrame:
    """(id, category, priority) for each metric below 60 that has a remedy."""
    urgency = {"completeness": "high", "validity": "high", "consistency": "medium", "freshness": "medium"}
    found = F.array_compact(F.array(*(F.when(F.col(m) < 60, F.struct(F.lit(m).alias("category"), F.lit(p).alias("priority"))) for m, p in urgency.items())))
    return metrics.select("id", F.inline(found))


def change_counts(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows differ in each column."""
    b, a = before.select(key, *columns).alias("b"), after.select(key, *columns).alias("a")
    both = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"))
    return both.agg(*(F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(f"{c}_changed") for c in columns))


def technical_issues() -> Column:
    """Of tracks with ids: beats (length by tempo) outside 50 to 1000, a genius_id that is no number, a spotify_id that isn't 22 letters and digits. Missing values raise none."""
    beats = F.col("duration_seconds") / 60.0 * F.col("bpm")
    rules = ((~beats.between(50, 1000), "technical_inconsistency"), (~F.col("genius_id").rlike("^[0-9]+$"), "invalid_genius_id"), (~F.col("spotify_id").rlike("^[a-zA-Z0-9]{22}$"), "invalid_spotify_id"))
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)))
