"""Credit texts: splitting, roles and names, categories, confidence, collaborations and merging of like credits.

Everything is column expressions: a text's credits are exploded once, and the merging of like credits folds
the array of one text, whose length the text bounds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagrain.functions import text as T

# Role by label. An equal label counts first, then the first in this order that holds the label or is held by it.
ROLES = {
    "producer": "Producer", "produc": "Producer", "beat maker": "Producer", "beatmaker": "Producer", "executive producer": "Executive Producer", "co-producer": "Co-Producer", "additional producer": "Additional Producer",
    "mixing engineer": "Mixing Engineer", "mix engineer": "Mixing Engineer", "mixed by": "Mixing Engineer", "mixé par": "Mixing Engineer", "mastering engineer": "Mastering Engineer", "mastered by": "Mastering Engineer", "masterisé par": "Mastering Engineer",
    "recording engineer": "Recording Engineer", "recorded by": "Recording Engineer", "enregistré par": "Recording Engineer", "sound engineer": "Sound Engineer",
    "songwriter": "Songwriter", "writer": "Songwriter", "written by": "Songwriter", "écrit par": "Songwriter", "lyricist": "Lyricist", "composer": "Composer", "music by": "Composer", "musique par": "Composer", "arranger": "Arranger", "arranged by": "Arranger", "arrangé par": "Arranger",
    "vocalist": "Vocalist", "vocals": "Vocalist", "lead vocals": "Lead Vocalist", "backing vocals": "Backing Vocalist", "rapper": "Rapper", "rap": "Rapper", "mc": "Rapper", "featuring": "Featured Artist", "feat": "Featured Artist", "ft": "Featured Artist", "avec": "Featured Artist",
    "guitarist": "Guitarist", "guitar": "Guitarist", "electric guitar": "Electric Guitarist", "acoustic guitar": "Acoustic Guitarist", "bassist": "Bassist", "bass": "Bassist", "bass guitar": "Bassist", "drummer": "Drummer", "drums": "Drummer", "percussion": "Percussionist",
    "pianist": "Pianist", "piano": "Pianist", "keyboardist": "Keyboardist", "keyboards": "Keyboardist", "synthesizer": "Synthesizer Player", "synth": "Synthesizer Player",
    "sampled": "Sample Source", "sample": "Sample Source", "interpolation": "Interpolation Source", "director": "Director", "réalisateur": "Director", "photography": "Photographer", "photo": "Photographer",
}
# Words that tell a role without a colon, in order; French forms; words that are no names; instruments.
ROLE_WORDS = (r"\b(produc\w*|beat\w*|instrumental)\b", r"\b(writ\w*|compos\w*|lyric\w*|author\w*)\b", r"\b(vocal\w*|rap\w*|sing\w*|perform\w*)\b", r"\b(mix\w*|master\w*|engineer\w*|record\w*)\b", r"\b(guitar\w*|bass\w*|drum\w*|piano\w*|keyboard\w*|synth\w*)\b", r"\b(feat\w*|featuring)\b")
FRENCH_ROLES = r"(prod\.?\s*par|réalisé\s*par|mixé\s*par|écrit\s*par)"
NO_NAMES = ("unknown", "various", "multiple", "others", "etc", "and", "et", "credits", "production", "all", "rights", "reserved")
INSTRUMENTS = ("guitar", "guitare", "bass", "basse", "drums", "batterie", "piano", "keyboard", "clavier", "synthesizer", "synthé", "synth", "violin", "violon", "saxophone", "sax", "trumpet", "trompette", "flute", "flûte", "harmonica", "accordion", "accordéon", "organ", "orgue")
# The ladders of keywords. A rung is a category, its words, and roles by a more special word, the last for none.
LADDER = (
    ("production", ("produc", "beat", "instrumental"), (("", "Producer"),)),
    ("engineering", ("mix", "master", "engineer", "record"), (("mix", "Mixing Engineer"), ("master", "Mastering Engineer"), ("record", "Recording Engineer"), ("", "Sound Engineer"))),
    ("songwriting", ("writ", "compos", "lyric", "author"), (("lyric", "Lyricist"), ("compos", "Composer"), ("", "Songwriter"))),
    ("vocals", ("vocal", "rap", "sing", "feat"), (("rap", "Rapper"), ("feat", "Featured Artist"), ("", "Vocalist"))),
    ("musician", INSTRUMENTS, (("guitar", "Guitarist"), ("bass", "Bassist"), ("drum", "Drummer"), ("batterie", "Drummer"), ("piano", "Pianist"), ("keyboard", "Keyboardist"), ("clavier", "Keyboardist"), ("synth", "Synthesizer Player"), ("", "Instrumentalist"))),
)
SEPARATOR = r"[;|\n]"


def clean_text(c: Column) -> Column:
    """Without bracketed parts and a leading by or par."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""), r"(?i)^(by|par)\s+", "")


def raw_credits(c: Column, separator: str = SEPARATOR) -> Column:
    """The credits of a cleaned text: parts of three characters or more, squeezed, without punctuation at their ends."""
    parts = F.transform(F.split(c, separator), lambda p: F.regexp_replace(T.squeeze(p), r"^[ .,;:]+|[ .,;:]+$", ""))
    return F.filter(parts, lambda p: F.length(p) > 2)


def role_and_names(raw: Column) -> Column:
    """A struct (role, names) of the two texts: `role: names`, else the first role word or French form and what follows it."""
    colon = F.split(raw, r":\s*", 2)
    pair = lambda role, names: F.struct(role.alias("role"), F.trim(names).alias("names"))
    low, out = F.lower(raw), []
    for pattern in ROLE_WORDS:
        word = F.regexp_extract(low, "(?U)" + pattern, 1)
        at = F.position(word, raw)  # the word in this very spelling
        out.append(F.when((word != "") & (at > 0), pair(word, F.substr(raw, at + F.length(word)))))
    french = lambda k: F.regexp_extract(raw, rf"(?iuU)\b{FRENCH_ROLES}\s+([^,\n]+)", k)
    out.append(F.when(french(1) != "", pair(french(1), french(2))))
    named = pair(F.coalesce(F.nullif(F.trim(colon[0]), F.lit("")), F.lit("Unknown")), colon[1])
    return F.when(F.size(colon) == 2, named).otherwise(F.coalesce(*out, pair(F.lit("Unknown"), raw)))


def is_name(c: Column) -> Column:
    return F.length(c).between(2, 50) & c.rlike(r"^\p{L}[\p{L}\s\-'.]{1,50}$") & ~F.lower(c).isin(*NO_NAMES)


def name_list(c: Column) -> Column:
    """The valid names of a list by comma, ampersand, and, et."""
    return F.filter(F.transform(F.split(c, r"(?i)\s*[,&]\s*|\s+and\s+|\s+et\s+"), lambda n: T.clean_artist_name(F.trim(n))), is_name)


def _holds(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def normal_role(role: Column) -> Column:
    """By equal label, else by partial label in order, else by the ladder of keywords, else the label in title case."""
    # as the element of an array, the label is made lower-case once, not once for each label of the table
    return F.transform(F.array(F.lower(F.trim(role))), _role_of)[0]


def _role_of(low: Column) -> Column:
    """The role of a trimmed lower-case label."""
    exact = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), low)
    table = F.array(*(F.struct(F.lit(p).alias("label"), F.lit(r).alias("role")) for p, r in ROLES.items()))
    partial = F.get(F.filter(table, lambda m: F.contains(low, m["label"]) | F.contains(m["label"], low)), F.lit(0))["role"]
    keyword = F.lit(None).cast("string")
    for _, words, roles in reversed(LADDER):
        own = F.lit(roles[-1][1])
        for word, value in reversed(roles[:-1]):
            own = F.when(low.contains(word), value).otherwise(own)
        keyword = F.when(_holds(low, words), own).otherwise(keyword)
    return F.coalesce(exact, partial, keyword, F.initcap(low))


def role_category(role: Column) -> Column:
    low, out = F.lower(role), F.lit("other")
    for category, words, _ in reversed(LADDER):
        out = F.when(_holds(low, words), category).otherwise(out)
    return out


def confidence(raw: Column, role: Column, names: Column) -> Column:
    """0.5, and for a known label 0.2, valid names 0.2, a colon 0.1; less 0.2 under 5 characters, 0.1 over 100."""
    n = F.length(raw)
    score = 0.5 + F.when(F.lower(role).isin(*ROLES), 0.2).otherwise(0.0) + F.when(F.size(names) > 0, 0.2).otherwise(0.0) + F.when(raw.contains(":"), 0.1).otherwise(0.0) - F.when(n < 5, 0.2).when(n > 100, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def parse(df: DataFrame, key: str, text: str, separator: str = SEPARATOR) -> DataFrame:
    """A row for each credit that has names: key, pos, raw, label, names, role, category, confidence."""
    raw = df.select(key, F.posexplode(raw_credits(clean_text(F.col(text)), separator)).alias("pos", "raw"))
    split = raw.withColumn("x", role_and_names(F.col("raw"))).select(key, "pos", "raw", F.col("x.role").alias("label"), name_list(F.col("x.names")).alias("names")).filter(F.size("names") > 0)
    ready = split.withColumns({"role": normal_role(F.col("label")), "confidence": confidence(F.col("raw"), F.col("label"), F.col("names"))})
    return ready.withColumn("category", role_category(F.col("role")))


def collaborations(credits: DataFrame, key: str) -> DataFrame:
    """Per text: credits with several names, their share, the featured names, and whether there are several producers."""
    role, shared = F.lower("role"), F.size("names") > 1
    out = credits.groupBy(key).agg(
        F.count_if(shared).alias("shared"),
        F.round(F.avg(shared.cast("double")), 6).alias("score"),
        F.sum(F.when(role.contains("producer"), F.size("names")).otherwise(0)).alias("producers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(role.contains("feat"), F.col("names")))))).alias("featured"),
    )
    return out.select(key, "shared", "score", (F.col("producers") > 1).alias("multiple_producers"), "featured")


def merge_similar(credits: DataFrame, key: str, least_role: float = 0.8, least_name: float = 0.85) -> DataFrame:
    """Like credits of a text as one: a credit joins the first one before it with a like role and a shared or like name.

    Gives key, role, names (all, sorted), confidence (the greatest), merged (number). A text's credits are one array.
    """
    own = credits.select(key, F.struct("pos", "role", "names", "confidence").alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("credits"))
    like = lambda a, b: (F.lower(a) == F.lower(b)) | (T.ratio(a, b) > least_name)

    def similar(g: Column, c: Column) -> Column:
        role = (F.lower(g["role"]) == F.lower(c["role"])) | (T.ratio(g["role"], c["role"]) >= least_role)
        return role & F.exists(g["first"], lambda a: F.exists(c["names"], lambda b: like(a, b)))

    def group(role, first, names, score, merged):
        return F.struct(role.alias("role"), first.alias("first"), names.alias("names"), score.alias("confidence"), merged.alias("merged"))

    def step(groups: Column, c: Column) -> Column:
        hit = F.array_position(F.transform(groups, lambda g: similar(g, c)), True)
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == hit, group(g["role"], g["first"], F.array_union(g["names"], c["names"]), F.greatest(g["confidence"], c["confidence"]), g["merged"] + 1)).otherwise(g))
        return F.when(hit > 0, joined).otherwise(F.concat(groups, F.array(group(c["role"], c["names"], F.array_distinct(c["names"]), c["confidence"], F.lit(1)))))

    empty = F.array().cast("array<struct<role:string,first:array<string>,names:array<string>,confidence:double,merged:int>>")
    out = own.select(key, F.posexplode(F.aggregate("credits", empty, step)).alias("grp", "x"))
    return out.select(key, "grp", "x.role", F.array_sort("x.names").alias("names"), "x.confidence", "x.merged")
