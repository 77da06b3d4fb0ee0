"""Filling missing fields from related rows, with a log of what was changed and how sure it is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_from(df: DataFrame, other: DataFrame, key: str, column: str, confidence: float) -> DataFrame:
    """Takes `column` from `other` where it is missing; adds <column>_confidence (null if nothing was filled)."""
    o = other.select(F.col(key), F.col(column).alias("_v"))
    filled = F.col(column).isNull() & F.col("_v").isNotNull()
    return df.join(o, key, "left").withColumns({f"{column}_confidence": F.when(filled, confidence), column: F.coalesce(column, "_v")}).drop("_v")


def infer_producer(tracks: DataFrame, credits: DataFrame, least: float = 0.7) -> DataFrame:
    """For tracks without one: the album's most credited producer, if on at least that share of the album's tracks."""
    produced = credits.filter("credit_type = 'producer'").select(F.col("track_id").alias("id"), "person_name").distinct()
    sizes = tracks.groupBy("album_id").agg(F.count("*").alias("size"))
    n = tracks.join(produced, "id").groupBy("album_id", "person_name").agg(F.count("*").alias("n"))
    best = n.groupBy("album_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "person_name")).alias("x"))
    best = best.join(sizes, "album_id").select("album_id", F.col("x.person_name").alias("producer"), F.round(-F.col("x.m") / F.col("size"), 6).alias("confidence"))
    return tracks.join(produced.select("id").distinct(), "id", "left_anti").join(best.filter(F.col("confidence") >= least), "album_id").select("id", "album_id", "producer", "confidence")


def infer_bpm(df: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """The midpoint of the first genre range that fits, where the tempo is missing."""
    guess = F.lit(None).cast("double")
    for genre, low, high in reversed(ranges):
        guess = F.when(F.lower("genre").contains(genre), float((low + high) // 2)).otherwise(guess)
    return df.withColumns({"bpm_inferred": F.col("bpm").isNull() & guess.isNotNull(), "bpm": F.coalesce("bpm", guess)})


def change_log(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each changed value: key, field, old, new."""
    b, a = before.select(key, *(F.col(c).cast("string").alias(f"{c}_b") for c in columns)), after.select(key, *(F.col(c).cast("string").alias(f"{c}_a") for c in columns))
    changes = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_b").alias("old"), F.col(f"{c}_a").alias("new")) for c in columns))
    return b.join(a, key).select(key, F.explode(changes).alias("x")).select(key, "x.*").filter(~F.col("old").eqNullSafe(F.col("new")))


def missing_fields(columns: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))


def write_back(df: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Length in seconds from milliseconds and new metadata entries over old ones."""
    out = df.join(payload, key, "left")
    return out.withColumns({"duration_seconds": F.coalesce("duration_seconds", F.floor(F.col("duration_ms") / 1000).cast("int")), "metadata": F.map_concat(F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("new_metadata", F.create_map().cast("map<string,string>"))), k)), F.coalesce("new_metadata", F.create_map().cast("map<string,string>")))}).drop("duration_ms", "new_metadata")
