"""Name, title and date normalisation and text similarity, as column expressions.

Every function takes Columns and returns a Column; nulls give nulls unless stated.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
FOLDED = "aaaaaaeeeeiiiiooooouuuuyync"
# Stop words for language detection.
FRENCH = ("le", "la", "les", "de", "du", "des", "et", "ou", "à", "dans", "pour", "avec", "sur")
ENGLISH = ("the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by")
FRENCH_PATTERNS = ("de", "le", "la", "des", "du", "et", "ou", "dans")
# UTF-8 read as Latin-1, and what was meant.
MOJIBAKE = {"Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã¢": "â", "Ã®": "î", "Ã´": "ô", "Ã»": "û", "Ã¹": "ù", "Ã§": "ç", "Ã±": "ñ", "Ã¼": "ü", "Ã¡": "á", "Ã³": "ó", "Ãº": "ú", "â€™": "'"}
# Instrument aliases.
INSTRUMENTS = {"keys": "keyboard", "synth": "synthesizer", "percussion": "drums", "bass": "bass guitar", "sax": "saxophone"}
# Words that stay lower-case inside names; words that mark a version of a title.
PARTICLES = ("de", "la", "le", "du", "des", "and", "the", "of", "feat", "ft")
VERSION = r"(?i)\b(?:remix|version|edit|mix|instrumental|acapella|radio|clean|explicit)\b"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column, aggressive: bool = False) -> Column:
    """Folded, lower case, letters, digits, spaces and dashes (and apostrophes unless aggressive)."""
    c = F.translate(F.lower(c), ACCENTED, FOLDED)
    for old, new in (("œ", "oe"), ("æ", "ae"), ("&", "and"), ("@", "at")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s\-]" if aggressive else r"[^a-z0-9\s\-']", ""))


def clean_artist_name(c: Column) -> Column:
    out = F.replace(F.replace(F.trim(c), F.lit("&"), F.lit("and")), F.lit("@"), F.lit("at"))
    return F.coalesce(F.nullif(squeeze(F.regexp_replace(out, r'[<>{}|\\^`\[\]"]', "")), F.lit("")), c)


def drop_featuring(c: Column) -> Column:
    """Bracketed forms first, the bare form last."""
    c = F.regexp_replace(c, r"(?i)\((?:feat\.?|featuring|ft\.?|avec|with)\s+[^)]+\)", "")
    c = F.regexp_replace(c, r"(?i)\[(?:feat\.?|featuring|ft\.?|avec|with)\s+[^\]]+\]", "")
    return F.regexp_replace(c, r"(?i)\b(?:feat\.?|featuring|ft\.?|avec|with)\s+.+", "")


def normalize_title(c: Column, remove_featuring: bool = False, remove_version: bool = False) -> Column:
    if remove_featuring:
        c = drop_featuring(c)
    if remove_version:
        c = F.regexp_replace(c, VERSION, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\(\s*\)", ""), r"\[\s*\]", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\.{2,}", "."), "-{2,}", "-")
    return F.trim(c)


def clean_album_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\(?\d{4}\)?$", ""))


def remove_special_chars(c: Column, keep: str = r" \-'&.") -> Column:
    return squeeze(F.regexp_replace(c, f"[^a-zA-Z0-9{keep}]", ""))


def parse_artist_list(c: Column) -> Column:
    """Names between commas, &, and, et, feat, ft, featuring; one-letter names are dropped."""
    parts = F.split(F.regexp_replace(c, r"(?i)\s*(?:,|&|\band\b|\bet\b|\bfeaturing\b|\bfeat\b\.?|\bft\b\.?)\s*", "\x01"), "\x01")
    return F.filter(F.transform(parts, clean_artist_name), lambda x: F.length(x) > 1)


def featured_text(c: Column) -> Column:
    """What follows the featuring word, in brackets or bare; empty if none."""
    word = r"(?:feat\.?|featuring|ft\.?|avec|with)\s+"
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (rf"(?i)\({word}([^)]+)\)", rf"(?i)\[{word}([^\]]+)\]", rf"(?i)\b{word}(.+)")]
    return F.coalesce(*found, F.lit(""))


def extract_featured(c: Column) -> Column:
    """(title, artists)."""
    return F.struct(F.trim(drop_featuring(c)).alias("title"), F.array_distinct(parse_artist_list(featured_text(c))).alias("artists"))


def extract_parentheticals(c: Column) -> Column:
    """(text, parts): text without (…) and […], and their contents."""
    parts = F.concat(F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), 1), F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), 1))
    text = squeeze(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""))
    return F.struct(text.alias("text"), parts.alias("parts"))


def normalize_featuring(c: Column) -> Column:
    x = extract_featured(c)
    return F.when(F.size(x["artists"]) > 0, F.concat(x["title"], F.lit(" feat. "), F.array_join(x["artists"], ", "))).otherwise(x["title"])


def name_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def title_key(c: Column) -> Column:
    return name_key(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\[[^\]]*\]", ""))


def identifier(*parts: Column) -> Column:
    return F.md5(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "|"))


def fix_encoding(c: Column) -> Column:
    for wrong, right in MOJIBAKE.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def strip_control_chars(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", ""), r"\(\s*\)", "")


def name_case(c: Column) -> Column:
    words = F.transform(F.split(squeeze(c), " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    return F.array_join(words, " ")


# What stands before and after a person's name.
PERSON_EDGES = (r"(?i)^(by\s+|par\s+|prod\.?\s*by\s+|produced\s*by\s+)", r"(?i)^(mixed\s*by\s+|mixé\s*par\s+)", r"(?i)^(mastered\s*by\s+|masterisé\s*par\s+)", r"(?i)\s*\(uncredited\)$", r"(?i)\s*\[uncredited\]$", r"(?i)\s*\(non\s*crédité\)$")


def clean_person_name(c: Column) -> Column:
    c = F.trim(c)
    for p in PERSON_EDGES:
        c = F.regexp_replace(c, p, "")
    return name_case(c)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value for the lower-cased key, else the key."""
    key = F.lower(F.trim(c))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), key)


def valid_artist_name(c: Column) -> Column:
    return F.coalesce(c.rlike("[a-zA-Z]") & (F.length(c) <= 100), F.lit(False))


def valid_title(c: Column) -> Column:
    return F.coalesce(c.rlike("[a-zA-Z0-9]") & (F.length(c) <= 200), F.lit(False))


def detect_language(c: Column) -> Column:
    """fr or en by which has more of its stop words in the text, French ones counted again as words between any marks; else unknown. The text is normalised and split once."""

    def judged(text: Column) -> Column:
        hits = lambda words, stops: F.size(F.array_intersect(words, F.array(*(F.lit(x) for x in stops))))
        words = F.split(text, " ")
        french = hits(words, FRENCH) + hits(F.split(text, "[^a-z0-9]+"), FRENCH_PATTERNS)
        english = hits(words, ENGLISH)
        return F.when(french > english, "fr").when(english > french, "en").otherwise("unknown")

    return F.transform(F.array(normalize_text(c)), judged)[0]


def text_stats(c: Column) -> Column:
    return F.struct(F.length(c).alias("chars"), F.size(F.split(F.trim(c), r"\s+")).alias("words"), F.length(F.regexp_replace(c, "[^a-zA-Z0-9]", "")).alias("alnum"), (featured_text(c) != "").alias("has_featuring"), c.rlike(r"\([^)]*\)").alias("has_parentheses"))


def search_terms(artist: Column, title: Column) -> Column:
    return search_terms_of(normalize_text(artist), normalize_text(title))


def search_terms_of(a: Column, t: Column) -> Column:
    """`search_terms` of normalised texts."""
    return F.array_distinct(F.filter(F.concat(F.array(F.concat_ws(" ", a, t), a, t), F.split(t, " ")), lambda x: F.length(x) > 2))


def format_duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.when(seconds >= 3600, F.concat(two(h), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(two(m), F.lit(":"), two(s)))


def parse_duration(c: Column) -> Column:
    """Seconds from `m:ss`, seconds, or (over 10000) milliseconds."""
    n = F.expr("1") * c.try_cast("bigint")
    clock = F.regexp_extract(c, r"^(\d+):(\d{2})$", 1).try_cast("bigint") * 60 + F.regexp_extract(c, r"^(\d+):(\d{2})$", 2).try_cast("bigint")
    return F.when(n > 10_000, F.floor(n / 1000)).when(n.isNotNull(), n).otherwise(clock)


def parse_release_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_date(c, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM", "yyyy")))


def to_paris(c: Column) -> Column:
    return F.from_utc_timestamp(c, "Europe/Paris")


def format_age(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    d, h, m = (F.floor(x).cast("string") for x in (s / 86400, s % 86400 / 3600, s % 3600 / 60))
    return F.when(s >= 86400, F.concat(d, F.lit("j "), h, F.lit("h"))).when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def key_name(pitch: Column) -> Column:
    names = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
    return F.when(pitch.between(0, 11), F.element_at(F.array(*(F.lit(n) for n in names)), (pitch + 1).cast("int")))


def coerce(c: Column, exact: tuple[str, ...], parts: tuple[tuple[str, str], ...], default: str) -> Column:
    """The exact member of a domain, else the first substring rule that fits, else the default."""
    low, out = F.lower(F.trim(c)), F.lit(default)
    for part, value in reversed(parts):
        out = F.when(low.contains(part), value).otherwise(out)
    return F.when(low.isin(*exact), low).otherwise(out)


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"\s+", "_"), 1, 100)


def suspicious_title(c: Column) -> Column:
    return F.lower(c).rlike("battle|freestyle|interview|teaser|snippet|remix")


def map_names(df: DataFrame, column: str, clean: Callable[[Column], Column]) -> DataFrame:
    """Any cleaning of a column that the caller gives as a column function."""
    return df.withColumn(f"{column}_clean", clean(F.col(column)))


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised texts; 0 if one is empty."""
    return ratio_of(normalize_text(a), normalize_text(b))


def ratio_of(a: Column, b: Column) -> Column:
    """`ratio` of texts that are normalised already, as rows should be before they meet in pairs."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def words(normalised: Column) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.split(normalised, " "))


def jaccard_of(x: Column, y: Column) -> Column:
    """Shared elements by all of two arrays without repeats."""
    return F.transform(F.array(F.size(F.array_intersect(x, y))), lambda both: both / (F.size(x) + F.size(y) - both))[0]


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.split(normalize_text(c), " ")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def containment(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else word Jaccard."""
    x, y = normalize_text(a), normalize_text(b)
    return containment_of(x, y, words(x), words(y))


def containment_of(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """`containment` of normalised texts with their words."""
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(jaccard_of(xs, ys))


def relevance(query: Column, c: Column) -> Column:
    """1 equal, 0.8 the text holds the query, 0.7 the query holds the text, else the share of query words found."""
    q, x = normalize_text(query), normalize_text(c)
    return relevance_of(q, x, words(q), words(x))


def relevance_of(q: Column, x: Column, qs: Column, xs: Column) -> Column:
    """`relevance` of normalised texts with their words."""
    return F.when(q == x, 1.0).when(x.contains(q), 0.8).when(q.contains(x), 0.7).otherwise(F.size(F.array_intersect(qs, xs)) / F.size(qs))


def release_relevance(title: Column, artist: Column, preferred: Column, year: Column) -> Column:
    """0.6 title, 0.25 artist (none: 0), 0.1 for a preferred format, 0.05 for a year from 2000 on; at most 1."""
    return F.least(F.lit(1.0), 0.6 * title + 0.25 * F.coalesce(artist, F.lit(0.0)) + F.when(preferred, 0.1).otherwise(0.0) + F.when(year >= 2000, 0.05).otherwise(0.0))


def title_artist_similarity(t1: Column, t2: Column, a1: Column, a2: Column) -> Column:
    return 0.7 * ratio(t1, t2) + 0.3 * ratio(a1, a2)


def search_relevance(title: Column, artist: Column, popularity: Column) -> Column:
    return F.least(F.lit(1.0), 0.6 * title + 0.3 * artist + 0.1 * popularity / 100)
