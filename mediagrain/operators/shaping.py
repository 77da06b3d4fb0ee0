"""Labelled credit lines, context hits, page metadata, payload projections and feature scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagrain.functions import text as T

# Labels of credit lines and their credit types.
LABELS = {"produit par": "producer", "mix": "mixing_engineer", "paroles": "songwriter", "label": "label"}


def labelled_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """`Label: names` lines -> a row for each name of at most four words."""
    pattern = F.lit(rf"(?im)^({'|'.join(LABELS)})\s*:\s*(.+)$")
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("label"), F.regexp_extract_all(text, pattern, 2).alias("names"))
    rows = df.select(key, F.explode(found).alias("x")).select(key, F.lower("x.label").alias("label"), F.explode(F.split("x.names", r"\s*[,&]\s*")).alias("name"))
    kinds = F.create_map(*(F.lit(v) for kv in LABELS.items() for v in kv))
    return rows.select(key, F.element_at(kinds, F.col("label")).alias("kind"), F.trim("name").alias("name")).filter((F.col("name") != "") & (F.size(F.split("name", r"\s+")) <= 4))


# What announces a credit in the text of a page, by kind.
PAGE_PATTERNS = {
    "production": (r"produced by", r"producer", r"production", r"prod\.?\s*by", r"beat\s*by", r"instrumental\s*by", r"track\s*by"),
    "writing": (r"written by", r"songwriter", r"lyrics\s*by", r"composed\s*by", r"words\s*by"),
    "engineering": (r"mixed\s*by", r"mastered\s*by", r"recorded\s*by", r"engineered\s*by", r"additional\s*engineering", r"vocal\s*engineering"),
    "performance": (r"performed\s*by", r"vocals\s*by", r"featuring", r"guest\s*vocals", r"additional\s*vocals", r"background\s*vocals"),
    "other": (r"executive\s*producer", r"co-producer", r"additional\s*production", r"sample\s*source", r"interpolates", r"contains\s*sample"),
}


def page_credits(df: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, ...]] = PAGE_PATTERNS, before: int = 50, after: int = 100) -> DataFrame:
    """(key, kind, pos, name): the lines around every hit of a pattern (from `before` characters before it to `after` behind it) that have both upper- and lower-case letters and more than two characters.

    Contexts may overlap, so hits are placed by the lengths of the texts between them. `pos` is where the hit begins (from 0).
    """
    total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

    def contexts(kind: str, pattern: str) -> Column:
        hits, between = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 0), F.split(text, f"(?i){pattern}", -1)

        def context(hit: Column, i: Column) -> Column:
            start = total(between, i + 1) + total(hits, i)
            low = F.greatest(start - before, F.lit(0))
            return F.struct(F.lit(kind).alias("kind"), start.alias("pos"), F.substr(text, low + 1, start + F.length(hit) + after - low).alias("context"))

        return F.transform(hits, context)

    found = F.flatten(F.array(*(contexts(kind, p) for kind, ps in patterns.items() for p in ps)))
    rows = df.select(key, F.explode(found).alias("x")).select(key, "x.kind", "x.pos", F.explode(F.split("x.context", "\n")).alias("name"))
    named = rows.withColumn("name", F.trim("name")).filter((F.length("name") > 2) & F.col("name").rlike(r"\p{Lu}") & F.col("name").rlike(r"\p{Ll}"))
    return named.select(key, "kind", "pos", "name")


def infer_role(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("beat") | t.contains("prod"), "producer").when(t.contains("mix"), "mixing_engineer").when(t.contains("feat"), "featuring").otherwise("other")


def by_class(html: Column, fragment: str) -> Column:
    """Text of the first element whose class holds the fragment; null if none."""
    return F.nullif(F.trim(F.regexp_extract(html, f'class="[^"]*{fragment}[^"]*"[^>]*>([^<]*)<', 1)), F.lit(""))


def scrobble_tags(c: Column, least: int, k: int) -> Column:
    """The k heaviest tags of at least a weight; a single tag may come as an object instead of a list."""
    many = F.from_json(c, "struct<tag:array<struct<name:string,count:int>>>")["tag"]
    single = F.array(F.from_json(c, "struct<tag:struct<name:string,count:int>>")["tag"])
    tags = F.filter(F.coalesce(many, single), lambda t: t["count"] >= least)
    return F.slice(F.transform(F.array_sort(F.transform(tags, lambda t: F.struct((-t["count"]).alias("c"), t["name"].alias("name")))), lambda t: t["name"]), 1, k)


def scrobble_image(c: Column) -> Column:
    """The last image (the largest) that has an address; null if none."""
    images = F.from_json(c, "struct<image:array<struct<`#text`:string,size:string>>>")["image"]
    named = F.filter(F.transform(images, lambda x: x["#text"]), lambda x: x != "")
    return F.get(F.reverse(named), F.lit(0))


def similar_artists(c: Column) -> Column:
    """Similar artists as (name, match); a single one may come as an object instead of a list. An empty list if there are none."""
    one = "struct<name:string,match:string>"
    many = F.from_json(c, f"struct<similar:struct<artist:array<{one}>>>")["similar"]["artist"]
    single = F.from_json(c, f"struct<similar:struct<artist:{one}>>")["similar"]["artist"]
    found = F.filter(F.coalesce(many, F.array(single), F.array().cast(f"array<{one}>")), lambda a: a["name"].isNotNull())
    return F.transform(found, lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["match"].try_cast("double"), F.lit(0.0)).alias("match")))


# The audio features of a track, and their types.
AUDIO_FEATURES = {"danceability": "double", "energy": "double", "key": "int", "loudness": "double", "mode": "int", "speechiness": "double", "acousticness": "double", "instrumentalness": "double", "liveness": "double", "valence": "double", "tempo": "double", "time_signature": "int"}


def audio_features(df: DataFrame, key: str, doc: str) -> DataFrame:
    """The audio features of a payload, with a whole tempo, the key's name and the mode's; all null for a broken payload."""
    x = F.from_json(doc, ", ".join(f"{n} {t}" for n, t in AUDIO_FEATURES.items()))
    out = df.select(key, x.alias("x")).select(key, "x.*")
    mode = F.when(F.col("mode") == 1, "Major").when(F.col("mode") == 0, "Minor")
    return out.withColumns({"bpm": F.when(F.col("tempo") != 0, F.bround("tempo")).cast("int"), "key_name": T.key_name(F.col("key")), "mode_name": mode})


def subgenre_scores(tempo: Column, trap_pattern: Column, sub_bass: Column, percussive: Column, harmonic: Column, mid: Column) -> Column:
    """Additive scores of three styles: tempo, a drum pattern, shares of the sub-bass and mid bands, percussive against harmonic energy."""
    add = lambda *rules: F.least(F.lit(1.0), sum((F.when(r, p).otherwise(0.0) for r, p in rules), F.lit(0.0)))
    return F.struct(
        add((tempo.between(130, 150), 0.3), (trap_pattern, 0.4), (sub_bass > 0.15, 0.3)).alias("trap"),
        add((tempo.between(85, 105), 0.4), (percussive > 0.8 * harmonic, 0.3)).alias("boom_bap"),
        add((tempo.between(140, 180), 0.4), (mid > 0.25, 0.3)).alias("drill"),
    )


# The analyses of a track and their fields in its summary.
SUMMARY = {
    "basic": {"duration_seconds": "duration_seconds double", "energy_level": "rms_energy double", "brightness": "spectral_centroid double"},
    "rhythm": {"bpm": "bpm double", "rhythm_regularity": "rhythm_regularity double", "trap_detected": "trap_pattern_detected boolean"},
    "harmonic": {"detected_key": "detected_key string", "key_confidence": "key_confidence double", "harmonic_complexity": "harmonic_complexity double"},
    "energy": {"bass_energy": "bass_energy double", "vocal_energy": "mid_energy double", "dynamic_range": "dynamic_range double"},
    "rap_specific": {"vocal_density": "vocal_density double", "flow_style": "flow_style string"},
}


def summary_features(df: DataFrame, key: str, column: str) -> DataFrame:
    """One flat row of the nested results of the analyses (JSON); what an analysis lacks is null."""
    schema = ", ".join(f"{part} struct<{', '.join(f.replace(' ', ':') for f in fields.values())}>" for part, fields in SUMMARY.items())
    nested = df.select(key, F.from_json(column, schema).alias("x"))
    return nested.select(key, *(F.col(f"x.{part}.{f.split()[0]}").alias(name) for part, fields in SUMMARY.items() for name, f in fields.items()))


def names_in_text(c: Column) -> Column:
    """The names of a list in prose, without parts that hold a word of its own wording."""
    parts = F.transform(F.split(c, r"[,;&\n]| and | et "), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~F.lower(x).rlike("produced|mixed|written|by|credits|show|more"))


def analysis_quality(analyses: dict[str, Column], bpm: Column) -> Column:
    """Over analyses (name: confidence, null where one failed): completeness, confidence, their mean, and issues (incomplete, unsure, odd tempo)."""
    known = F.array_compact(F.array(*analyses.values()))
    complete = F.size(known) / len(analyses)
    sure = F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)), F.lit(0.0))
    issues = F.array_compact(F.array(F.when(complete < 0.8, F.lit("incomplete")), F.when(sure < 0.6, F.lit("unsure")), F.when((bpm < 60) | (bpm > 200), F.lit("odd_tempo"))))
    return F.struct(F.round(complete, 6).alias("completeness"), F.round(sure, 6).alias("confidence"), F.round((complete + sure) / 2, 6).alias("overall"), F.array_join(issues, ",").alias("issues"))


def _cleaned(credits: DataFrame) -> DataFrame:
    return credits.withColumns({"_name": T.clean_artist_name(F.col("person_name")), "_instrument": T.lookup(F.col("instrument"), T.INSTRUMENTS)}).withColumn("_valid", T.valid_artist_name(F.col("_name")))


def cleaned_credits(credits: DataFrame) -> DataFrame:
    """The credits with a valid name, with cleaned names and instruments."""
    out = _cleaned(credits).filter("_valid").withColumns({"person_name": F.col("_name"), "instrument": F.col("_instrument")})
    return out.select(*credits.columns)


def cleaning_counts(credits: DataFrame) -> DataFrame:
    """How many credits there are, are dropped, and of the others get another name or instrument."""
    changed = lambda old, new: F.count_if(F.col("_valid") & ~F.col(old).eqNullSafe(F.col(new)))
    return _cleaned(credits).agg(F.count("*").alias("credits"), F.count_if(~F.col("_valid")).alias("dropped"), changed("person_name", "_name").alias("names_changed"), changed("instrument", "_instrument").alias("instruments_changed"))
