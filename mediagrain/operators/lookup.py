"""Lookups, filters, searches and set-based changes of catalogue tables.

All operators take and return DataFrames; instants come in as parameters, never from the clock.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagrain.operators.components import shared_folder
from mediagrain.operators.ranking import global_rank


def get_by_id(df: DataFrame, value, column: str = "id") -> DataFrame:
    return df.filter(F.col(column) == value)


def get_by_name(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Case-insensitive (ASCII) equality."""
    return df.filter(F.lower(column) == name.lower())


def list_rows(df: DataFrame, order: list, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows that meet `where` in order; with a limit, a top-k that is kept per task."""
    df = (df if where is None else df.filter(where)).orderBy(*order)
    return df if limit is None else df.limit(limit)


def search(df: DataFrame, text: str, columns: list[str], limit: int | None = None, order: tuple = ()) -> DataFrame:
    """Case-insensitive substring in any of the columns; `%` and `_` are plain characters."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit |= F.col(c).ilike(pattern)
    return list_rows(df.filter(hit), list(order), limit) if order else df.filter(hit)


def with_any(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows that have a match in `other` (left semi)."""
    return df.join(other.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def without_any(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows that have none (left anti)."""
    return df.join(other.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def attach_credits(tracks: DataFrame, credits: DataFrame) -> DataFrame:
    """Each track with its sorted list of (credit_type, person_name)."""
    nested = credits.groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("credit_type", "person_name"))).alias("credits"))
    return tracks.join(nested, "id", "left").withColumn("credits", F.coalesce("credits", F.array()))


def cascade_delete(artists: DataFrame, albums: DataFrame, tracks: DataFrame, credits: DataFrame, gone: Column) -> dict[str, DataFrame]:
    """The four tables without the artists for whom `gone` holds and all that hangs on them."""
    dead = artists.filter(gone).select(F.col("id").alias("artist_id"))
    dead_tracks = tracks.join(dead, "artist_id", "left_semi").select(F.col("id").alias("track_id"))
    return {"artists": artists.filter(~gone), "albums": albums.join(dead, "artist_id", "left_anti"), "tracks": tracks.join(dead, "artist_id", "left_anti"), "credits": credits.join(dead_tracks, "track_id", "left_anti")}


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of `updates` replace those of `target` with the same key; new keys are added."""
    return target.join(updates.select(key), key, "left_anti").unionByName(updates)


def upsert_fill_missing(existing: DataFrame, new: DataFrame, key: str, priority: str = "priority") -> DataFrame:
    """Full outer: the existing value where there is one, else the new one; the better (smaller) priority is kept."""
    cols = [c for c in existing.columns if c not in (key, priority)]
    e, n = existing.alias("e"), new.alias("n")
    joined = e.join(n, F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"e.{key}", f"n.{key}").alias(key), *(F.coalesce(f"e.{c}", f"n.{c}").alias(c) for c in cols), F.least(f"e.{priority}", f"n.{priority}").alias(priority))


def update_where(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """Sets columns where the predicate is true (null counts as false)."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def latest(df: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """The value of the latest row of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.max(at).alias(at), F.count("*").alias("n"))


def active(df: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires).isNull() | (F.col(expires) > as_of))


def expired(df: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires) <= as_of)


def keys_matching(df: DataFrame, glob: str, column: str = "key") -> DataFrame:
    """`*` and `?` wildcards."""
    return df.filter(F.col(column).like(glob.replace("_", "\\_").replace("*", "%").replace("?", "_")))


def evict_oldest(df: DataFrame, fraction: float, at: str, key: str) -> DataFrame:
    """Without the oldest int(n * fraction) rows by (at, key).

    The keys are dealt into ranges and kept in the shared folder; only a count for each range reaches the driver,
    and the cut is looked up in the one range that holds it.
    """
    shared_folder(df.sparkSession)
    ranged = df.select(at, key).repartitionByRange(at, key).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    left = int(sum(r.n for r in counts) * fraction)
    if not left:
        return df
    for r in counts:
        if left <= r.n:
            break
        left -= r.n
    last = ranged.filter(F.col("_range") == r._range).orderBy(at, key).limit(left).agg(F.max(F.struct(at, key)).alias("last"))
    return df.join(F.broadcast(last), F.struct(F.col(at), F.col(key)) > F.col("last")).drop("last")


def sample_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """n rows, the same each time: those with the smallest hashes of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def since(df: DataFrame, as_of: Column, days: int, at: str) -> DataFrame:
    """Rows of the last `days` days before `as_of`; 0: of its day."""
    cut = F.date_trunc("day", as_of) if days == 0 else as_of - F.make_interval(days=F.lit(days))
    return df.filter((F.col(at) >= cut) & (F.col(at) <= as_of))


def old_final(df: DataFrame, as_of: Column, days: int, at: str = "ts") -> DataFrame:
    return df.filter(F.col("status").isin("completed", "failed") & (F.col(at) < as_of - F.make_interval(days=F.lit(days))))


def open_by_status(df: DataFrame) -> DataFrame:
    """Ids of rows that aren't completed, sorted, by status."""
    return df.filter("status <> 'completed'").groupBy("status").agg(F.array_sort(F.collect_set("session")).alias("sessions"))


def for_extraction(tracks: DataFrame, failed: DataFrame) -> DataFrame:
    """Tracks still to do: not completed, titled, with an artist, and not among the failed ids."""
    todo = tracks.filter("status <> 'completed' and title is not null and title <> '' and artist_id is not null")
    return todo.join(failed.select("id"), "id", "left_anti")


def prioritise(tracks: DataFrame, size: int) -> DataFrame:
    """Additive priority and the number of the batch of `size` rows, over the whole table by descending priority."""
    score = F.when(F.col("duration_seconds").isNull(), 3).otherwise(0) + F.when(F.col("bpm").isNull(), 2).otherwise(0) + F.when(F.col("has_lyrics"), 0).otherwise(1)
    ranked = global_rank(tracks.withColumn("priority", score), F.desc("priority"), "id")
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size) + 1).drop("rank")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def invalidate(entries: DataFrame, events: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries whose key fits no pattern that an event triggers.

    `rules` (event, pattern: `*` and `?` are wildcards, `{id}` stands for the event's id) are few; the patterns that
    events make of them may be many. All meet the keys by an equi-join: patterns without wildcards on the key, others
    on what stands before the first wildcard or, if that is nothing, behind the last one; those with wildcards at
    both ends on the first three letters of a longest piece between. Only patterns without such a piece, of which
    there are few forms, are tried on every key.
    """
    fired = events.join(F.broadcast(rules), "event").select(F.replace("pattern", F.lit("{id}"), F.col("id").cast("string")).alias("pattern")).distinct()
    wild = F.col("pattern").rlike("[*?]")
    out = entries.join(fired.filter(~wild), F.col("key") == F.col("pattern"), "left_anti")
    like = F.replace(F.replace(F.replace("pattern", F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    pieces = F.transform(F.split("pattern", "[*?]"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    loose = fired.filter(wild).select(F.regexp_extract("pattern", "^[^*?]*", 0).alias("stem"), F.regexp_extract("pattern", "[^*?]*$", 0).alias("tail"), F.substring(F.array_max(pieces)["x"], 1, 3).alias("piece"), like.alias("pattern"))
    fits = F.expr("key LIKE pattern")

    def without(out: DataFrame, patterns: DataFrame, column: str, part) -> DataFrame:
        """Without the keys that fit; patterns meet keys by their `column` and, for each of its lengths, the key's `part`."""
        lengths = sorted(r.n for r in patterns.select(F.length(column).alias("n")).distinct().collect())
        if not lengths:
            return out
        keys = out.select("key").distinct().select("key", F.explode(F.array_distinct(F.flatten(F.array(*(part(n) for n in lengths))))).alias(column))
        return out.join(keys.join(patterns.select(column, "pattern"), column).filter(fits).select("key").distinct(), "key", "left_anti")

    out = without(out, loose.filter("stem <> ''"), "stem", lambda n: F.array(F.substring("key", 1, n)))
    out = without(out, loose.filter("stem = '' and tail <> ''"), "tail", lambda n: F.array(F.substring("key", -n, n)))
    inner = loose.filter("stem = '' and tail = ''")
    every = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - n + 1, F.lit(1))), lambda i: F.substr("key", i, F.lit(n)))
    out = without(out, inner.filter("length(piece) = 3"), "piece", every)
    rest = inner.filter("length(piece) < 3")
    if not rest.isEmpty():
        out = out.join(F.broadcast(rest.select("pattern")), fits, "left_anti")
    return out.select(*entries.columns)
