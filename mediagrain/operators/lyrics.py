"""Analyses of lyrics: estimated structure, rhymes, themes, guests, language, vocabulary, and all of them in one wide row."""

import re
from collections import Counter
from collections.abc import Callable
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Theme keywords.
THEMES = {
    "money": ("money", "cash", "dollar", "euro", "rich", "wealth", "millionaire", "billionaire", "argent", "fric", "thune", "riche", "fortune", "millionnaire", "milliardaire"),
    "success": ("success", "win", "victory", "champion", "top", "best", "first", "boss", "succès", "réussir", "victoire", "premier", "meilleur", "patron"),
    "struggle": ("struggle", "fight", "battle", "hard", "difficult", "pain", "suffer", "galère", "combat", "bataille", "dur", "difficile", "douleur", "souffrir"),
    "street": ("street", "hood", "ghetto", "block", "corner", "trap", "hustle", "rue", "quartier", "banlieue", "cité", "tess", "tieks"),
    "family": ("family", "mother", "father", "brother", "sister", "mama", "papa", "famille", "mère", "père", "frère", "sœur", "maman"),
    "love": ("love", "girl", "woman", "heart", "baby", "honey", "bae", "amour", "fille", "femme", "cœur", "bébé", "chérie", "meuf"),
    "drugs": ("weed", "smoke", "high", "joint", "blunt", "cannabis", "marijuana", "shit", "beuh", "fumette", "pétard"),
    "violence": ("gun", "shoot", "kill", "murder", "blood", "war", "fight", "flingue", "tirer", "tuer", "meurtre", "sang", "guerre", "bagarre"),
}
# Words that tell French and English.
FRENCH = ("le", "la", "les", "de", "du", "des", "et", "est", "que", "qui", "pour", "dans", "avec", "sur", "par", "mais", "ou", "donc", "ni", "car", "je", "tu", "il", "elle", "nous", "vous", "ils", "elles", "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses", "notre", "votre", "leur", "leurs")
ENGLISH = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about", "like", "that", "this", "these", "those", "i", "you", "he", "she", "we", "they", "my", "your", "his", "her", "our", "their", "me", "him", "us", "them", "am", "is", "are", "was", "were")
# Words that vocabulary leaves out.
STOPS = ("le", "de", "et", "à", "un", "il", "être", "en", "avoir", "que", "pour", "dans", "ce", "son", "une", "sur", "avec", "ne", "se", "pas", "tout", "plus", "par", "grand", "end", "bien", "autre", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between", "among")
SPACES = re.compile("[ \\t\\n\\x0b\\f\\r]+")  # what \\s is in Spark
EDGES, QUOTES = ".,!?;:()[]", ".,!?;:()[]\"'"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once."""
    return F.transform(F.array(value), f)[0]


def runs(values: Column) -> Column:
    """The different values of an array, in their order, as an array of (value, n, first place); null for null. One sort, no shuffle."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["value"] != F.get(s, i - 2)["value"]))
        ends = lambda p, j: F.coalesce(F.get(p, j + 1), F.size(s) + 1)
        run = lambda p: F.transform(p, lambda i, j: F.struct(F.get(s, i - 1)["value"].alias("value"), (ends(p, j) - i).alias("n"), F.get(s, i - 1)["first"].alias("first")))
        return F.when(F.size(s) > 0, bound(starts, run)).when(F.size(s) == 0, F.slice(F.transform(s, lambda x: F.struct(x["value"].alias("value"), F.lit(0).alias("n"), x["first"].alias("first"))), 1, 0))

    return bound(F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("first")))), counted)


def total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + of(x))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def bare(words: Column, edges: str = EDGES) -> Column:
    """The words without punctuation at their ends."""
    return F.transform(words, lambda w: F.btrim(w, F.lit(edges)))


def stripped_lines(text: Column) -> Column:
    """The lines with something on them, without space at their ends."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def line_end(line: Column) -> Column:
    """The word in which a line ends, lower case; empty if it ends otherwise."""
    return F.lower(F.regexp_extract(line, r"([\p{L}\p{N}_]+)$", 1))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): the lines with something on them, without space at their ends."""
    return df.select(key, F.posexplode(stripped_lines(F.col(text))).alias("pos", "line"))


def estimated_structure(lines: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Sections of a text without markers: a line that occurs again begins one; the first is a verse, the others are choruses."""
    whole, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos")
    repeated = F.count("*").over(Window.partitionBy(key, "line")) > 1
    df = lines.withColumns({"repeated": repeated, "n_lines": F.count("*").over(whole)}).filter(F.col("n_lines") >= least)
    df = df.withColumn("section", F.sum((F.col("repeated") & (F.col("pos") > 0)).cast("int")).over(so_far))
    out = df.groupBy(key, "section").agg(F.count("*").alias("lines"), F.min_by("line", "pos").alias("first_line"))
    return out.select(key, "section", F.when(F.col("section") == 0, "verse").otherwise("chorus").alias("kind"), "lines", "first_line", F.lit(0.6).alias("confidence"))


def end_rhymes(lines: DataFrame, key: str) -> DataFrame:
    """Lines that end in a word, the rhyming ones (two or more with the same last three letters), groups, density and complexity."""
    ends = lines.select(key, line_end(F.col("line")).alias("w")).filter("w <> ''").groupBy(key, F.right("w", F.lit(3)).alias("r")).agg(F.count("*").alias("n"))
    out = ends.groupBy(key).agg(F.sum("n").alias("ends"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rhyming"), F.count_if(F.col("n") > 1).alias("groups"))
    return out.withColumns({"density": F.round(F.col("rhyming") / F.col("ends"), 6), "complexity": F.round(F.col("groups") / F.col("ends"), 6)})


def ranked_themes(words: Column) -> Column:
    """The themes of a text's bare words as an array of (i: less the intensity, order, theme, n), the most intense first."""
    every = sorted({w for ws in THEMES.values() for w in ws})

    def ranked(s: Column) -> Column:
        number = lambda ws: F.size(F.filter(s["known"], lambda x: x.isin(*ws)))
        hits = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(name).alias("theme"), number(ws).alias("n")) for i, (name, ws) in enumerate(THEMES.items())))
        return F.array_sort(F.transform(F.filter(hits, lambda h: h["n"] > 0), lambda h: F.struct((-F.round(100 * h["n"] / s["words"], 2)).alias("i"), h["order"].alias("order"), h["theme"].alias("theme"), h["n"].alias("n"))))

    return bound(F.struct(F.filter(words, lambda x: x.isin(*every)).alias("known"), F.size(words).alias("words")), ranked)


def dominant(rank: Column, intensity: Column) -> Column:
    return (rank <= 3) & (intensity > 0.5)


def themes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Themes of each text: hits, intensity (percent of words), rank by intensity, and whether it is dominant (of the first three, over 0.5)."""
    found = df.select(key, F.posexplode(ranked_themes(bare(tokens(F.col(text))))).alias("pos", "x"))
    out = found.select(key, "x.theme", "x.n", (-F.col("x.i")).alias("intensity"), (F.col("pos") + 1).alias("rank"))
    return out.withColumn("dominant", dominant(F.col("rank"), F.col("intensity")))


def guests(c: Column) -> Column:
    """A struct of the names in `[feat X]` markers and of the artists in `[X:]` markers."""
    feat = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\[(feat\.?|featuring|ft\.?)\s*([^\]]+)\]"), 2), lambda x: F.trim(x))
    own = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\[([^\]]+):\]"), 1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains(":"))
    return F.struct(feat.alias("featuring"), own.alias("sections"))


def language(words: Column) -> Column:
    """A struct (language, confidence, french, english) by the share of telling words."""
    told = F.struct(F.filter(words, lambda x: x.isin(*FRENCH, *ENGLISH)).alias("known"), F.size(words).alias("words"))
    share = lambda s, ws: F.coalesce(F.try_divide(F.size(F.filter(s["known"], lambda x: x.isin(*ws))).cast("double"), s["words"]), F.lit(0.0))
    both = F.transform(F.array(told), lambda s: F.struct(share(s, FRENCH).alias("f"), share(s, ENGLISH).alias("e")))

    def judged(s: Column) -> Column:
        f, e = s["f"], s["e"]
        french, english, mixed = (f > e) & (f > 0.05), (e > f) & (e > 0.05), (f > 0.03) & (e > 0.03)
        name = F.when(french, "french").when(english, "english").when(mixed, "mixed").otherwise("unknown")
        sure = F.when(french, F.least(f * 2, F.lit(1.0))).when(english, F.least(e * 2, F.lit(1.0))).when(mixed, 0.7).otherwise(0.0)
        return F.struct(name.alias("language"), F.round(sure, 6).alias("confidence"), F.round(f * 100, 2).alias("french"), F.round(e * 100, 2).alias("english"))

    return F.transform(both, judged)[0]


SPOKEN = StructType([StructField(c, LongType()) for c in ("total", "different", "letters", "long")] + [StructField("rare", ArrayType(StringType())), StructField("top", ArrayType(StringType())), StructField("times", ArrayType(LongType()))])


@F.pandas_udf(SPOKEN)
def spoken_words(lowered: pd.Series) -> pd.DataFrame:
    """Of a lower-case text's words that aren't stop words: their number, the different ones, letters, those of six letters or more, up to 20 rare words
    (once, seven letters or more) by place, and the ten most frequent with their numbers; ties by first place."""
    stops, rows = frozenset(STOPS), []
    for text in lowered:
        n = Counter(w for w in (x.strip(QUOTES) for x in SPACES.split(text or "")) if w and w not in stops)
        rare = islice((w for w, c in n.items() if c == 1 and len(w) >= 7), 20)
        top = sorted(n.items(), key=lambda x: -x[1])[:10]
        rows.append((n.total(), len(n), sum(len(w) * c for w, c in n.items()), sum(c for w, c in n.items() if len(w) >= 6), list(rare), [w for w, _ in top], [c for _, c in top]))
    return pd.DataFrame(rows, columns=["total", "different", "letters", "long", "rare", "top", "times"])


spoken_words = spoken_words.asNondeterministic()  # else a filter on what it gives would have it run twice


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w): `spoken_words` of each text that has any. A row has a whole text, so nothing is shuffled."""
    return df.select(key, spoken_words(F.lower(text)).alias("w")).filter("w.total > 0")


def vocabulary_of(w: Column) -> list[Column]:
    share = lambda c: F.round(F.try_divide(w[c], w["total"]), 6)
    known = lambda c: F.when(w["total"] > 0, w[c]).alias(c)
    return [known("total"), known("different"), share("different").alias("richness"), share("letters").alias("mean_length"), share("long").alias("long_share"), known("rare")]


def vocabulary(counts: DataFrame, key: str) -> DataFrame:
    """Per text: words, different words, richness, mean length, share of words of six letters or more, up to 20 rare words (once, seven letters or more)."""
    return counts.select(key, *vocabulary_of(F.col("w")))


def frequent_words(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k (at most ten) most frequent words, most frequent first, then by first place."""
    if k > 10:
        raise ValueError("k must be at most 10")
    top = counts.select(key, F.posexplode(F.slice(F.arrays_zip("w.top", "w.times"), 1, k)).alias("pos", "x"))
    return top.select(key, F.col("x.top").alias("word"), F.col("x.times").alias("n"), (F.col("pos") + 1).alias("rank"))


def process(df: DataFrame, key: str, text: str, explicit: Column) -> DataFrame:
    """All analyses of a text in one row, worked out in the row itself, so that no text, line or word is shuffled; `df` has one row a key, `explicit` is a struct (explicit, severity)."""
    c = F.col(text)
    split = df.select(key, text, tokens(c).alias("t"), stripped_lines(c).alias("ls"), spoken_words(F.lower(c)).alias("w"))
    ends = F.filter(F.transform("ls", line_end), lambda w: w != "")
    made = split.withColumn("b", bare(F.col("t"))).select(
        key, "w", F.length(text).alias("chars"), guests(c).alias("g"), language(F.col("b")).alias("l"), explicit.alias("e"), ranked_themes(F.col("b")).alias("th"),
        F.size("ls").alias("n_lines"), runs(F.col("ls")).alias("lines"), runs(F.transform(ends, lambda w: F.right(w, F.lit(3)))).alias("rhymes"),
    )
    # a line that occurs again begins a section, but for the first one
    again = total(F.col("lines"), lambda x: F.when(x["n"] > 1, x["n"] - F.when(x["first"] == 0, 1).otherwise(0)).otherwise(0))
    rhymed = lambda of: total(F.col("rhymes"), lambda x: F.when(x["n"] > 1, of(x)).otherwise(0))
    share = lambda n: F.round(F.try_divide(n, total(F.col("rhymes"), lambda x: x["n"])), 6)
    themed, chosen = F.size("th") > 0, F.filter(F.transform("th", lambda h, i: F.when(dominant(i + 1, -h["i"]), h["theme"])), lambda x: x.isNotNull())
    out = made.select(
        key, "chars", F.array_join("g.featuring", ";").alias("featuring"), F.array_join("g.sections", ";").alias("section_artists"), (F.size("g.featuring") + F.size("g.sections") > 0).alias("collaboration"), "l.language", F.col("l.confidence").alias("language_confidence"), "e.*",
        F.when(F.col("n_lines") > 0, F.col("n_lines").cast("long")).alias("lines"), F.when(F.col("n_lines") >= 4, again + 1).alias("sections"), share(rhymed(lambda x: x["n"])).alias("rhyme_density"), share(rhymed(lambda x: F.lit(1))).alias("rhyme_complexity"),
        F.when(themed, F.array_join(chosen, ";")).alias("themes"), F.when(themed, total(F.col("th"), lambda h: h["n"])).alias("theme_words"), *vocabulary_of(F.col("w")), F.get("w.top", F.lit(0)).alias("top_word"),
    )
    return out.withColumn("rare", F.array_join("rare", ";"))


def insights(wide: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, name, value) of many texts: languages, the ten most frequent themes, explicit and collaboration rate, mean richness."""
    row = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    languages = row(wide.groupBy("language").agg(F.count("*").alias("n")), "language", "language", "n")
    top = row(found.groupBy("theme").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "theme").limit(10), "theme", "theme", "n")
    rates = wide.agg(F.round(F.avg((F.col("explicit") > 0).cast("double")), 6).alias("explicit"), F.round(F.avg(F.col("collaboration").cast("double")), 6).alias("collaboration"), F.round(F.avg("richness"), 6).alias("richness"))
    rates = rates.select(F.explode(F.create_map(*(x for c in ("explicit", "collaboration", "richness") for x in (F.lit(c), F.col(c))))).alias("name", "value")).select(F.lit("rate").alias("kind"), "name", "value")
    return languages.unionByName(top).unionByName(rates)
