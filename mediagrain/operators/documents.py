"""Lyrics, credit texts, pages, payloads and feature vectors: one row per document in, columns or rows out."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagrain.functions.text import clean_artist_name
from mediagrain.operators.components import written
from mediagrain.operators.credits import normal_role

# Explicit words.
EXPLICIT = ("shit", "fuck", "bitch", "ass", "damn", "hell", "merde", "putain", "connard", "salope", "bordel")


def clean_lyrics(c: Column) -> Column:
    """Without HTML, URLs, mentions and hashtags; spaces squeezed, line breaks kept, blank lines dropped."""
    for pattern, to in ((r"<[^>]+>", ""), (r"https?://\S+", ""), (r"@\w+", ""), (r"#\w+", ""), (r"[ \t]+", " "), (r"\n\s*\n+", "\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}']+"), lambda w: w != "")


def basic_stats(df: DataFrame, text: str) -> DataFrame:
    """Characters, lines, words, different words (lower case, without marks at their ends), richness and mean lengths of lines and words; 0 where there are none."""
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    full = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    mean = lambda xs: F.coalesce(F.round(F.try_divide(F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x)), F.size(xs)), 2), F.lit(0.0))
    unique = F.size(F.array_distinct(F.transform(split, lambda w: F.regexp_replace(F.lower(w), "^[.,!?;:]+|[.,!?;:]+$", ""))))
    out = df.withColumns({"chars": F.length(text), "lines": F.size(F.split(text, "\n", -1)), "full_lines": F.size(full), "words": F.size(split), "unique_words": unique, "mean_line": mean(full), "mean_word": mean(split)})
    return out.withColumns({"richness": F.coalesce(F.round(F.try_divide("unique_words", "words"), 6), F.lit(0.0)), "lines_per_word": F.coalesce(F.round(F.try_divide("full_lines", "words"), 4), F.lit(0.0))})


def sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, pos, line) -> sections by `[Verse 1]`-like markers: a running number of markers, with its kind and lines."""
    marker = F.lower(F.regexp_extract("line", r"^\[(\w+)[^\]]*\]", 1))
    df = lines.withColumn("marker", marker)
    df = df.withColumn("section", F.sum((F.col("marker") != "").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    return df.filter("section > 0").groupBy(key, "section").agg(F.max("marker").alias("kind"), F.count_if(F.col("marker") == "").alias("lines"))


def repeated_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines that occur more than once in their document (a chorus without markers)."""
    return lines.filter(F.trim("line") != "").groupBy(key, F.lower(F.trim("line")).alias("line")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).filter("n > 1")


def explicit_words(text: Column) -> Column:
    """A struct (explicit, severity): the number of explicit words and the level of their share."""

    def judged(s: Column) -> Column:
        share = F.try_divide(s["n"], s["words"])
        return F.struct(s["n"].alias("explicit"), F.when(share > 0.05, "high").when(share > 0.02, "medium").when(s["n"] > 0, "low").otherwise("none").alias("severity"))

    counted = F.transform(F.array(words(text)), lambda w: F.struct(F.size(F.filter(w, lambda x: x.isin(*EXPLICIT))).alias("n"), F.size(w).alias("words")))
    return F.transform(counted, judged)[0]


def explicit(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, explicit_words(F.col(text)).alias("e")).select(key, "e.*")


# Patterns of page fields, the first that hits counts.
FIELD_PATTERNS = {
    "bpm": (r"(?i)(?:BPM|Tempo):\s*(\d+)", r"(?i)(\d+)\s*BPM", r"(?i)Beats Per Minute.*?(\d+)"),
    "key": (r"(?i)(?:Key|Tonalité):\s*([A-G][#b]?\s*(?:major|minor|maj|min)?)", r"(?i)Musical Key.*?([A-G][#b]?\s*(?:major|minor|maj|min)?)"),
    "minutes": (r"(?i)(?:Duration|Length):\s*(\d+):\d+", r"(?i)(\d+):\d+\s*(?:minutes?|mins?)"),
    "seconds": (r"(?i)(?:Duration|Length):\s*\d+:(\d+)", r"(?i)\d+:(\d+)\s*(?:minutes?|mins?)"),
    "year": (r"(?i)(?:year|released?)[:\s]*(\d{4})",),
    "label": (r"(?i)(?:record label|label):\s*([^,\n<]+)",),
    "genre": (r"(?i)(?:genre|style):\s*([^,\n<]+)",),
    "album": (r"(?i)album:\s*([^,\n<]+)",),
}


def first_hit(c: Column, patterns) -> Column:
    """The first group of the first pattern that hits; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns))


def page_details(pages: DataFrame) -> DataFrame:
    """Heading (or title), split in artist and title at ` - `, language, charset, and the fields of music pages: bpm, key, seconds, year, label, genre, album."""
    first = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    found = pages.select("page_id", F.coalesce(first(r"<h1[^>]*>([^<]*)</h1>"), first(r"<title>([^<]*)</title>")).alias("heading"), first(r'<html lang="([^"]*)"').alias("lang"), first(r'charset="([^"]*)"').alias("charset"), *(F.trim(first_hit(F.col("html"), ps)).alias(c) for c, ps in FIELD_PATTERNS.items()))
    parts = F.split("heading", " - ", 2)
    two = F.size(parts) == 2
    length = F.col("minutes").cast("int") * 60 + F.col("seconds").cast("int")
    return found.select("page_id", "heading", F.when(two, F.trim(parts[0])).alias("artist"), F.when(two, F.trim(parts[1])).alias("title"), "lang", "charset", F.col("bpm").cast("int").alias("bpm"), "key", length.alias("duration_seconds"), F.col("year").cast("int").alias("year"), "label", "genre", "album")


def page_text(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<script[^>]*>.*?</script>", " "), r"(?s)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def page_links(pages: DataFrame, only: str | None = None) -> DataFrame:
    """A row for each anchor: page, its url, position, absolute target and text; `only` is a pattern that the target's path must hold."""
    pattern = r'<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"))
    rows = pages.select("page_id", "url", F.posexplode(pairs).alias("pos", "x")).select("page_id", "url", "pos", "x.*")
    site, folder = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1), F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    scheme = F.regexp_extract("url", r"^([a-zA-Z]+:)", 1)
    target = F.when(F.col("href").rlike("^[a-zA-Z]+:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, F.col("href"))).when(F.col("href").startswith("/"), F.concat(site, F.col("href"))).when(F.col("href").rlike("^[?#]|^$"), F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.col("href"))).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), F.col("href")))
    out = rows.select("page_id", "url", "pos", target.alias("target"), F.trim("label").alias("label"))
    return out.filter(F.regexp_extract("target", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).rlike(only)) if only else out


def flatten_payload(df: DataFrame, column: str, schema: str, prefix: str = "") -> DataFrame:
    """JSON text to typed columns; broken JSON gives nulls."""
    return df.withColumn("_p", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_p.*")


RELEASE = "id long, title string, year int, country string, artists array<struct<id:long,name:string>>, labels array<struct<name:string,catno:string>>, formats array<struct<name:string,qty:string,descriptions:array<string>>>, identifiers array<struct<type:string,value:string>>, images array<struct<type:string,uri:string>>, tracklist array<struct<position:string,title:string,duration:string,extraartists:array<struct<name:string,role:string>>>>, extraartists array<struct<name:string,role:string>>"
TRACK = "id long, name string, artists array<struct<id:long,name:string>>, album struct<id:long,name:string,release_date:string,total_tracks:int,images:array<struct<url:string>>>, duration_ms long, explicit boolean, popularity int, track_number int"
SONG = "id long, title string, primary_artist struct<id:long,name:string>, featured_artists array<struct<id:long,name:string>>, producer_artists array<struct<id:long,name:string>>, album struct<id:long,name:string>, stats struct<pageviews:long>, release_date string"


def parsed_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The payload as a struct `p`; broken JSON gives nulls inside."""
    return df.select(F.from_json(column, schema).alias("p"))


def release_payload(df: DataFrame, column: str) -> DataFrame:
    """A row for each release: its own fields, artists, first label and format, the last barcode and matrix number, primary (else first) image, tracks, credits by role."""
    p = lambda x: F.col(f"p.{x}")
    first = lambda x: F.get(p(x), F.lit(0))
    last = lambda kind: F.element_at(F.concat(F.array(F.lit(None).cast("struct<type:string,value:string>")), F.filter(p("identifiers"), lambda i: i["type"] == kind)), -1)["value"]
    cover = F.coalesce(F.get(F.filter(p("images"), lambda i: i["type"] == "primary"), F.lit(0))["uri"], first("images")["uri"])
    credits = F.transform(p("extraartists"), lambda x: F.concat(normal_role(x["role"]), F.lit("="), clean_artist_name(x["name"])))
    parsed = parsed_payload(df, column, RELEASE).select("p", F.transform("p.artists", lambda a: clean_artist_name(a["name"])).alias("names"))
    return parsed.select(
        p("id").alias("id"), p("title").alias("title"), p("year").alias("year"), p("country").alias("country"),
        F.array_join("names", ";").alias("artists"), first("artists")["id"].alias("main_artist_id"), F.get("names", F.lit(0)).alias("main_artist"),
        first("labels")["name"].alias("main_label"), first("labels")["catno"].alias("catalog_number"), first("formats")["name"].alias("main_format"), F.array_join(first("formats")["descriptions"], ";").alias("format_descriptions"),
        last("Barcode").alias("barcode"), last("Matrix / Runout").alias("matrix_number"), cover.alias("cover_art_url"), F.size(p("tracklist")).alias("tracks"), F.array_join(credits, ";").alias("credits"),
    )


def release_tracks(df: DataFrame, column: str) -> DataFrame:
    """A row for each track of a release: position, title, seconds, credits."""
    # one expression holds the parsed payload, and outer as no filter on it is inferred: else it is parsed for each field that is used
    tracks = F.transform(F.array(F.from_json(column, RELEASE)), lambda p: F.transform(p["tracklist"], lambda t: F.struct(p["id"].alias("id"), t.alias("t"), F.lit(True).alias("own"))))
    rows = df.select(F.inline_outer(tracks[0])).filter("own")
    at = F.split("t.duration", ":")
    credits = F.transform("t.extraartists", lambda x: F.concat(normal_role(x["role"]), F.lit("="), clean_artist_name(x["name"])))
    return rows.select("id", F.col("t.position").alias("position"), F.col("t.title").alias("title"), (at[0].cast("int") * 60 + at[1].cast("int")).alias("seconds"), F.coalesce(F.array_join(credits, ";"), F.lit("")).alias("credits"))


def track_payload(df: DataFrame, column: str) -> DataFrame:
    """A row for each track: own fields, main artist, the others, album columns and cover."""
    names = lambda a: F.array_join(F.transform(a, lambda x: x["name"]), ";")
    out = parsed_payload(df, column, TRACK)
    return out.select("p.id", F.col("p.name").alias("title"), F.get("p.artists", F.lit(0))["name"].alias("artist"), names(F.slice("p.artists", F.lit(2), F.greatest(F.size("p.artists"), F.lit(0)))).alias("others"), F.floor(F.col("p.duration_ms") / 1000).alias("seconds"), "p.explicit", "p.popularity", "p.track_number", F.col("p.album.id").alias("album_id"), F.col("p.album.name").alias("album"), F.to_date("p.album.release_date").alias("release_date"), F.col("p.album.total_tracks").alias("total_tracks"), F.get("p.album.images", F.lit(0))["url"].alias("cover_url"))


def song_payload(df: DataFrame, column: str) -> DataFrame:
    """A row for each song: artist, guests, producers, album, page views."""
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["name"]), ";"), F.lit(""))
    return parsed_payload(df, column, SONG).select("p.id", "p.title", F.col("p.primary_artist.name").alias("artist"), names("p.featured_artists").alias("guests"), names("p.producer_artists").alias("producers"), F.col("p.album.id").alias("album_id"), F.col("p.album.name").alias("album"), F.col("p.stats.pageviews").alias("pageviews"), F.to_date("p.release_date").alias("release_date"))


# The key profiles, note names, and the factor on the confidence of minor keys.
PROFILES = {"major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), "minor": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)}
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MINOR = 1.1


def key_profiles() -> list[tuple[str, list[float]]]:
    """The 24 turned profiles by name, each less its mean and of length 1."""
    out = []
    for k, note in enumerate(NOTES):
        for mode, profile in PROFILES.items():
            m = sum(profile) / 12
            size = sum((x - m) ** 2 for x in profile) ** 0.5
            out.append((f"{note}_{mode}", [(profile[(i - k) % 12] - m) / size for i in range(12)]))
    return out


def key_of(vector: Column) -> Column:
    """A struct (key, confidence): the key whose profile correlates best with a 12-bin vector (ties: the first), its correlation, times 1.1 if minor."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    best, size = None, F.sqrt(total(F.transform(vector, lambda x: (x - total(vector) / 12) * (x - total(vector) / 12))))
    for i, (name, profile) in enumerate(key_profiles()):
        r = F.round(F.try_divide(total(F.zip_with(vector, F.array(*(F.lit(p) for p in profile)), lambda x, p: x * p)), size), 6)
        entry = F.struct(r.alias("r"), F.lit(-i).alias("i"), F.lit(name).alias("key"))
        best = entry if best is None else F.greatest(best, entry)
    return F.struct(best["key"].alias("key"), F.round(best["r"] * F.when(best["key"].contains("minor"), MINOR).otherwise(1.0), 6).alias("confidence"))


def per_dimension(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean and deviation of every dimension of a vector in each group."""
    long = df.select(group, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(group, "dim").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std"))


def band_energy(df: DataFrame, key: str, vector: str, bands: list[tuple[str, int, int]]) -> DataFrame:
    """Mean magnitude of the bins of each band: exploded bins against a broadcast band table (a range join)."""
    table = df.sparkSession.createDataFrame(bands, "band string, low int, high int")
    long = df.select(key, F.posexplode(vector).alias("bin", "x"))
    return long.join(F.broadcast(table), (F.col("bin") >= F.col("low")) & (F.col("bin") < F.col("high"))).groupBy(key, "band").agg(F.round(F.avg(F.abs("x")), 5).alias("energy"))


def onset_density(onsets: DataFrame, group: list[str], second: str, most: float = 8.0) -> DataFrame:
    """Onsets of each group, their number a second of its span, and whether that is above `most` (never without a span)."""
    out = onsets.groupBy(*group).agg(F.count("*").alias("n"), (F.max(second) - F.min(second)).alias("_span"))
    density = F.try_divide(F.col("n"), F.nullif(F.col("_span"), F.lit(0.0)))
    return out.select(*group, "n", F.round(density, 6).alias("density"), F.coalesce(density > most, F.lit(False)).alias("dense"))


def repetition_of_all(df: DataFrame, group: str, key: str, vector: str, least: float = 0.8, block: int = 512) -> DataFrame:
    """Share of all frame pairs of a group whose normalised dot product exceeds `least`, with the share of pairs that took no product.

    A group has a pivot (the frames of the smallest hashes) for each `block` of its frames. Frames are dealt to the
    pivot they are nearest to in direction, of which only the widest angle is kept. By the angle of their pivots and
    these radii most pairs of blocks lie wholly above or wholly below `least` and are counted as numbers; the frames
    of the others (all but the decided ones, whatever the data) meet in a task as matrix products, of which only
    counts leave, so no pair is a row. Crowded blocks are cut by hash into parts of about `block`. Frames without a
    direction (null, or all zeros) are alike to nothing.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    frames = df.select(F.struct(F.col(group).alias("v")).alias("g"), F.xxhash64(key).alias("k"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v")).withColumn("size", norm)
    frames = written(frames.select("g", "k", F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).alias("u")), "frames")
    sizes = frames.groupBy("g").agg(F.count("*").alias("all"), F.count("u").alias("n")).withColumn("pivots", F.ceil(F.col("n") / block).cast("int"))
    ranked = frames.filter("u is not null").withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    most = sizes.agg(F.max("pivots")).first()[0] or 0
    pivots = written(ranked.filter(F.col("place") <= most).join(sizes, "g").filter(F.col("place") <= F.col("pivots")).select("g", F.col("place").alias("p"), "u"), "pivots")
    of_group = pivots.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p", "u"))).alias("centres"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_max(F.transform("centres", lambda c: F.struct(dot(c["u"], F.col("u")).alias("cos"), c["p"].alias("p"))))
    dealt = frames.filter("u is not null").join(of_group, "g").withColumn("x", nearest).select("g", "k", "u", F.col("x.p").alias("p"), F.acos(F.least(F.col("x.cos"), F.lit(1.0))).alias("angle"))
    dealt = written(dealt, "dealt")
    blocks = dealt.groupBy("g", "p").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    parts = dealt.join(blocks.select("g", "p", "parts"), ["g", "p"]).withColumn("part", F.pmod("k", F.col("parts")).cast("int"))
    parts = written(parts.select("g", F.struct("p", "part").alias("b"), "u", "angle"), "parts")
    ends = parts.groupBy("g", "b").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).withColumn("p", F.col("b.p")).join(pivots.withColumnRenamed("u", "centre"), ["g", "p"]).drop("p")
    ends = written(ends, "ends")

    two = ends.select("g", *(F.col(c).alias(f"{c}2") for c in ends.columns if c != "g"))
    met = ends.join(two, "g").filter(F.col("b") <= F.col("b2"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("centre"), F.col("centre2")))))
    reach = F.col("radius") + F.col("radius2") + 1e-6
    bound = math.acos(least)
    number = F.when(F.col("b") == F.col("b2"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("n2")).cast("long")
    met = met.select("g", "b", "b2", number.alias("pairs"), F.when(apart - reach > bound + 1e-6, "below").when(apart + reach < bound - 1e-6, "above").alias("side"))
    met = written(met, "met")
    decided = met.filter("side is not null").select("g", F.when(F.col("side") == "above", F.col("pairs")).otherwise(0).cast("long").alias("alike"))

    open_ = met.filter("side is null").select("g", "b", "b2", F.explode(F.array_distinct(F.array("b", "b2"))).alias("own"))
    units = open_.join(parts.select("g", F.col("b").alias("own"), "u"), ["g", "own"]).select("g", "b", "b2", (F.col("own") == F.col("b")).alias("first"), "u")

    def run(table):
        first, u = table.column("first").to_numpy(), np.array(table.column("u").to_pylist(), float)
        one, two = u[first], u[~first]
        alike = int(np.triu(one @ one.T > least, 1).sum()) if table.column("b")[0] == table.column("b2")[0] else int((one @ two.T > least).sum())
        return pa.table({"g": table.column("g")[:1], "alike": pa.array([alike], pa.int64())})

    counted = units.groupBy("g", "b", "b2").applyInArrow(run, units.select("g", F.lit(0).cast("long").alias("alike")).schema)
    alike = counted.unionByName(decided).groupBy("g").agg(F.sum("alike").alias("alike"))
    skipped = met.groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("side").isNotNull(), F.col("pairs"))), F.lit(0)).alias("skipped"))
    out = sizes.select("g", (F.col("all") * (F.col("all") - 1) / 2).cast("long").alias("pairs")).filter("pairs > 0")
    for extra in (alike, skipped):
        out = out.join(extra, "g", "left")
    out = out.select(F.col("g.v").alias(group), F.coalesce("alike", F.lit(0)).cast("long").alias("alike"), "pairs", F.coalesce("skipped", F.lit(0)).alias("skipped"))
    return out.withColumn("density", F.round(F.try_divide("alike", "pairs"), 6))
