"""Registered queries of functions/text.py, with their SQL (macros below give DuckDB the same functions)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediagrain.functions import blocks as B
from mediagrain.functions import text as T
from mediagrain.operators.components import written
from mediagrain.operators.linkage import once
from mediagrain.sources.catalog import load, sql

C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


def norm(x, aggressive=False):
    folded = f"replace(replace(replace(replace(translate(lower({x}), '{T.ACCENTED}', '{T.FOLDED}'), 'œ', 'oe'), 'æ', 'ae'), '&', 'and'), '@', 'at')"
    keep = "[^a-z0-9\\s\\-]" if aggressive else "[^a-z0-9\\s\\-'']"
    return squeezed(f"regexp_replace({folded}, '{keep}', '', 'g')")


def squeezed(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sub(x, *pairs):
    for p, r in pairs:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


FEAT = "(?:feat\\.?|featuring|ft\\.?|avec|with)\\s+"
NO_FEAT = (f"(?i)\\({FEAT}[^)]+\\)", ""), (f"(?i)\\[{FEAT}[^\\]]+\\]", ""), (f"(?i)\\b{FEAT}.+", "")
TEXTS = "(SELECT doc_id AS id, text AS s FROM documents)"
one = lambda f: lambda k: k.documents.select(C("doc_id").alias("id"), f(C("text")).alias("out"))
of = lambda expr: f"SELECT id, {expr} AS out FROM {TEXTS}"
title = lambda f: lambda k: k.tracks.select("id", f(C("title")).alias("out"))
of_title = lambda expr: sql("tracks", f"SELECT id, {expr} AS out FROM tracks")
names = lambda f: lambda k: k.part.select(C("p_partkey").alias("id"), f(C("p_name")).alias("out"))

add("n01_normalize_text", one(T.normalize_text), of(norm("s")))
add("n01b_normalize_text_aggressive", one(lambda c: T.normalize_text(c, True)), of(norm("s", True)))
add("n02_clean_artist_name", one(lambda c: T.clean_artist_name(F.concat(F.lit(" <b>"), c, F.lit("] & co @x ")))), of("coalesce(nullif(" + squeezed("regexp_replace(replace(replace(trim(' <b>' || s || '] & co @x '), '&', 'and'), '@', 'at'), '[<>{}|\\\\^`\\[\\]\"]', '', 'g')") + ", ''), s)"))
TAIL = "title || ' ( ) ..--'"
tidy = ("\\(\\s*\\)", ""), ("\\[\\s*\\]", ""), ("\\s+", " "), ("\\.{2,}", "."), ("-{2,}", "-")
add("n03_normalize_title", title(lambda c: T.normalize_title(F.concat(c, F.lit(" ( ) ..--")), True, True)), of_title(f"trim({sub(TAIL, *NO_FEAT, ('(?i)\\b(?:remix|version|edit|mix|instrumental|acapella|radio|clean|explicit)\\b', ''), *tidy)})"))
add("n04_clean_album_title", lambda k: k.albums.select("id", T.clean_album_title(F.concat("title", F.lit(" ("), C("release_year").cast("string"), F.lit(")"))).alias("out")), sql("albums", "SELECT id, trim(regexp_replace(title || ' (' || release_year || ')', '\\s*\\(?\\d{4}\\)?$', '')) AS out FROM albums"))
add("n05_remove_special_chars", one(T.remove_special_chars), of(squeezed("regexp_replace(s, '[^a-zA-Z0-9 \\-''&.]', '', 'g')")))
feat_sql = f"coalesce(nullif(regexp_extract(title, '(?i)\\({FEAT}([^)]+)\\)', 1), ''), nullif(regexp_extract(title, '(?i)\\[{FEAT}([^\\]]+)\\]', 1), ''), nullif(regexp_extract(title, '(?i)\\b{FEAT}(.+)', 1), ''), '')"
add("n06_extract_featured", lambda k: k.tracks.select("id", T.extract_featured(C("title")).alias("x")).select("id", "x.title", F.array_join("x.artists", ";").alias("artists")), sql("tracks", f"SELECT id, trim({sub('title', *NO_FEAT)}) AS title, {feat_sql} AS artists FROM tracks"))
add("n07_parse_artist_list", lambda k: k.artists.select("id", F.array_join(T.parse_artist_list(F.concat("name", F.lit(" & B, "), "country", F.lit(" feat. "), "genre")), ";").alias("out")), sql("artists", "SELECT id, name || ';' || country || ';' || genre AS out FROM artists"))
add("n08_extract_parentheticals", lambda k: k.tracks.select("id", T.extract_parentheticals(C("title")).alias("x")).select("id", "x.text", F.array_join("x.parts", ";").alias("parts")), sql("tracks", f"SELECT id, {squeezed(sub('title', ('\\([^)]*\\)', ''), ('\\[[^\\]]*\\]', '')))} AS text, array_to_string(regexp_extract_all(title, '\\(([^)]*)\\)', 1) || regexp_extract_all(title, '\\[([^\\]]*)\\]', 1), ';') AS parts FROM tracks"))
add("n09_normalize_featuring", title(T.normalize_featuring), of_title(f"CASE WHEN {feat_sql} <> '' THEN trim({sub('title', *NO_FEAT)}) || ' feat. ' || {feat_sql} ELSE trim({sub('title', *NO_FEAT)}) END"))
key = lambda x: squeezed(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")
add("n10_name_key", one(T.name_key), of(key("s")))
add("n11_title_key", title(T.title_key), of_title(key(sub("title", ("\\([^)]*\\)", ""), ("\\[[^\\]]*\\]", "")))))
add("n12_unique_identifier", lambda k: k.tracks.select("id", T.identifier(C("artist_id"), C("title"), C("bpm").cast("int")).alias("out")), sql("tracks", "SELECT id, md5(artist_id || '|' || title || '|' || coalesce(CAST(CAST(bpm AS INT) AS VARCHAR), '')) AS out FROM tracks"))
moji = "concat(s, 'Ã©tÃ© Ã§a lâ€™on')"
for wrong, right in T.MOJIBAKE.items():
    moji = f"replace({moji}, '{wrong}', '{right.replace(chr(39), chr(39) * 2)}')"
add("n13_fix_encoding", one(lambda c: T.fix_encoding(F.concat(c, F.lit("Ã©tÃ© Ã§a lâ€™on")))), of(moji))
add("n14_strip_control_chars", one(lambda c: T.strip_control_chars(F.concat(c, F.lit("\t( )\n")))), of(sub("s || chr(9) || '( )' || chr(10)", ("[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}]", ""), ("\\(\\s*\\)", ""))))
cased = "array_to_string(list_transform(string_split({x}, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('de','la','le','du','des','and','the','of','feat','ft') THEN lower(w) ELSE replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:]) END), ' ')"
add("n15_clean_person_name", names(lambda c: T.clean_person_name(F.concat(F.lit("Produced by "), c, F.lit(" DE la x (Uncredited)")))), f"SELECT p_partkey AS id, {cased.format(x=squeezed('p_name || chr(32) || chr(68) || chr(69) || chr(32) || chr(108) || chr(97) || chr(32) || chr(120)'))} AS out FROM part")
add("n16_name_case", one(T.name_case), of(cased.format(x=squeezed("s"))))
add("n17_normalize_instrument", names(lambda c: T.lookup(F.element_at(F.array(*(F.lit(x) for x in ("Keys", "synth ", "tuba", "SAX"))), (F.length(c) % 4 + 1).cast("int")), T.INSTRUMENTS)), "SELECT p_partkey AS id, (['keyboard', 'synthesizer', 'tuba', 'saxophone'])[length(p_name) % 4 + 1] AS out FROM part")
add("n18_validate_names", one(lambda c: F.concat_ws(",", T.valid_artist_name(c).cast("string"), T.valid_title(c).cast("string"))), of("(regexp_matches(s, '[a-zA-Z]') AND length(s) <= 100) || ',' || (regexp_matches(s, '[a-zA-Z0-9]') AND length(s) <= 200)"))
fr = " + ".join([f"CASE WHEN list_contains(ws, '{w}') THEN 1 ELSE 0 END" for w in T.FRENCH] + [f"CASE WHEN regexp_matches(t, '\\b{w}\\b') THEN 1 ELSE 0 END" for w in T.FRENCH_PATTERNS])
en = " + ".join(f"CASE WHEN list_contains(ws, '{w}') THEN 1 ELSE 0 END" for w in T.ENGLISH)
add("n19_detect_language", one(T.detect_language), f"WITH a AS (SELECT id, {norm('s')} AS t FROM {TEXTS}), b AS (SELECT id, t, string_split(t, ' ') AS ws FROM a), c AS (SELECT id, {fr} AS f, {en} AS e FROM b) SELECT id, CASE WHEN f > e THEN 'fr' WHEN e > f THEN 'en' ELSE 'unknown' END AS out FROM c")
add("n20_text_stats", lambda k: k.tracks.select("id", T.text_stats(C("title")).alias("x")).select("id", "x.*"), sql("tracks", f"SELECT id, length(title)::INT AS chars, len(regexp_split_to_array(trim(title), '\\s+'))::INT AS words, length(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g'))::INT AS alnum, {feat_sql} <> '' AS has_featuring, regexp_matches(title, '\\([^)]*\\)') AS has_parentheses FROM tracks"))


def searched(k):
    """Titles are normalised once a value, names once an artist."""
    t = once(written(k.tracks.select("id", "artist_id", "title"), "tracks"), "title", t=T.normalize_text)
    a = k.artists.select(C("id").alias("artist_id"), T.normalize_text(C("name")).alias("a"))
    return t.join(a, "artist_id").select("id", F.array_join(F.array_sort(T.search_terms_of(C("a"), C("t"))), ";").alias("out"))


add("n21_search_terms", searched, sql("tracks artists", f", n AS (SELECT tracks.id, {norm('name')} AS a, {norm('title')} AS t FROM tracks JOIN artists ON artist_id = artists.id) SELECT id, array_to_string(list_sort(list_distinct(list_filter([a || ' ' || t, a, t] || string_split(t, ' '), lambda x: length(x) > 2))), ';') AS out FROM n"))
add("n22_format_duration", lambda k: k.tracks.select("id", T.format_duration(C("duration_seconds") * 12).alias("out")), sql("tracks", "SELECT id, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS out FROM (SELECT id, duration_seconds * 12 AS s FROM tracks)"))
add("n23_parse_duration", lambda k: k.tracks.select("id", T.parse_duration(F.when(C("id") % 3 == 0, F.concat((C("duration_seconds") % 9).cast("string"), F.lit(":05"))).when(C("id") % 3 == 1, (C("duration_seconds") * 1000).cast("string")).otherwise(F.lit("n/a"))).alias("out")), sql("tracks", "SELECT id, CASE WHEN id % 3 = 0 THEN duration_seconds % 9 * 60 + 5 WHEN id % 3 = 1 THEN CASE WHEN duration_seconds * 1000 > 10000 THEN duration_seconds ELSE duration_seconds * 1000 END END AS out FROM tracks"))
add("n24_safe_int", lambda k: k.part.select(C("p_partkey").alias("id"), F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int").alias("n"), C("p_name").try_cast("int").alias("bad"), F.floor(C("p_retailprice") / 1000).alias("s")), "SELECT p_partkey AS id, try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n, try_cast(p_name AS INT) AS bad, CAST(floor(p_retailprice / 1000) AS BIGINT) AS s FROM part")
add("n25_parse_release_date", lambda k: k.albums.select("id", T.parse_release_date(F.when(C("id") % 4 == 0, F.date_format("release_date", "yyyy-MM-dd")).when(C("id") % 4 == 1, F.date_format("release_date", "dd/MM/yyyy")).when(C("id") % 4 == 2, F.date_format("release_date", "yyyy")).otherwise("soon")).alias("d")).withColumn("y", F.year("d")), sql("albums", "SELECT id, CASE WHEN id % 4 < 2 THEN release_date WHEN id % 4 = 2 THEN make_date(release_year, 1, 1) END AS d, CASE WHEN id % 4 < 3 THEN release_year END AS y FROM albums"))
add("n26_to_paris", lambda k: k.sessions.select("id", F.date_format(T.to_paris(C("ts").cast("timestamp")), "dd/MM/yyyy HH:mm").alias("out")), sql("sessions", "SELECT id, strftime(ts + INTERVAL 1 HOUR, '%d/%m/%Y %H:%M') AS out FROM sessions"))
add("n27_format_age", lambda k: k.sessions.select("id", T.format_age((F.lit("2024-01-20").cast("timestamp").cast("long") - C("ts").cast("timestamp").cast("long"))).alias("out")), sql("sessions", ", a AS (SELECT id, greatest(0, CAST(epoch(TIMESTAMP '2024-01-20') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM sessions) SELECT id, CASE WHEN s >= 86400 THEN (s // 86400) || 'j ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || 'm' END AS out FROM a"))
add("n28_key_name", lambda k: k.part.select(C("p_partkey").alias("id"), T.key_name(C("p_size") % 13).alias("key"), F.bround(C("p_retailprice") / 2, 0).cast("long").alias("bpm")), "SELECT p_partkey AS id, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[p_size % 13 + 1] AS key, CAST(round_even(p_retailprice / 2, 0) AS BIGINT) AS bpm FROM part")
add("n29_normalize_genre", lambda k: k.artists.select("id", T.lookup(C("genre"), {"building": "house", "machinery": "industrial", "household": "indoor"}).alias("out")), sql("artists", "SELECT id, CASE genre WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'industrial' WHEN 'HOUSEHOLD' THEN 'indoor' ELSE lower(genre) END AS out FROM artists"))
add("n30_display_name", lambda k: k.credits.select("track_id", F.concat("person_name", F.when(C("credit_type") == "featuring", " (feat.)").otherwise(F.concat(F.lit(" ("), "credit_type", F.lit(")")))).alias("out")), sql("credits", "SELECT track_id, person_name || CASE WHEN credit_type = 'featuring' THEN ' (feat.)' ELSE ' (' || credit_type || ')' END AS out FROM credits"))
add("n31_enum_coercion", lambda k: k.albums.select("id", T.coerce(C("title"), ("album", "ep", "single"), (("deluxe", "reissue"), ("live", "live"), ("urgent", "single")), "album").alias("out")), sql("albums", "SELECT id, CASE WHEN title ILIKE '%deluxe%' THEN 'reissue' WHEN title ILIKE '%live%' THEN 'live' WHEN title ILIKE '%urgent%' THEN 'single' ELSE 'album' END AS out FROM albums"))
add("n32_credit_category", lambda k: k.credits.select("track_id", "person_name", T.lookup(C("credit_type"), {"producer": "production", "songwriter": "songwriting", "featuring": "vocals", "mixing": "technical"}).alias("out")), sql("credits", "SELECT track_id, person_name, CASE credit_type WHEN 'producer' THEN 'production' WHEN 'songwriter' THEN 'songwriting' WHEN 'featuring' THEN 'vocals' ELSE 'technical' END AS out FROM credits"))
add("n33_safe_filename", title(T.safe_filename), of_title(f"left({sub('title', ('[<>:\"/\\\\|?*]', '_'), ('\\s+', '_'))}, 100)"))
add("n34_title_flags", title(T.suspicious_title), of_title("regexp_matches(lower(title), 'battle|freestyle|interview|teaser|snippet|remix')"))
add("u01_custom_cleaner", lambda k: T.map_names(k.artists.select("id", "name"), "name", lambda c: F.upper(F.reverse(c))), sql("artists", "SELECT id, name, upper(reverse(name)) AS name_clean FROM artists"))
add("u02_transform_chain", lambda k: k.tracks.select("id", "bpm").transform(lambda d: d.filter("bpm > 100")).transform(lambda d: d.withColumn("half", C("bpm") / 2)), sql("tracks", "SELECT id, bpm, bpm / 2 AS half FROM tracks WHERE bpm > 100"))

PAIRS = "(SELECT x.p_partkey AS a, y.p_partkey AS b, x.p_name AS s, y.p_name AS t FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey)"


def sim(judged, scored=lambda v: v, trait="0", most=4096, copies=64):
    """A query of the pairs (a < b) of parts of one brand and size: `judged` is what the names decide, `scored` what else of part a counts, by its `trait`.

    The parts of a name are kept in arrays of at most `copies`; a name is normalised, and scored against each name it meets, once for an array of its parts.
    A pair is then but a comparison of ids. A task takes all of a group against blocks of `most` parts or a few more, so that a large group is many tasks'.
    As many tasks as the session has, as the pairs are many more than the rows.
    """

    def build(k):
        tasks, key = int(k.spark.conf.get("spark.sql.shuffle.partitions")), ["p_brand", "p_size"]
        rows = k.part.select(C("p_partkey").alias("a"), "p_name", *key).filter("p_partkey is not null and p_brand is not null and p_size is not null").repartition(tasks, *key)
        x = named(rows.withColumn("trait", F.expr(trait)), [*key, "p_name", "trait"], copies).withColumn("parts", F.sum(F.size("ids")).over(Window.partitionBy(*key)))
        x = x.select(*key, C("ids").alias("ones"), F.element_at("ids", 1).alias("a"), T.normalize_text(C("p_name")).alias("s"), T.normalize_text(C("p_brand")).alias("brand"), F.explode(F.sequence(F.lit(0), F.floor(C("parts") / most).cast("int"))).alias("block"))
        y = named(rows, [*key, "p_name"], copies).withColumn("parts", F.sum(F.size("ids")).over(Window.partitionBy(*key).orderBy("p_name", "nth")))
        y = y.select(*key, C("ids").alias("others"), F.element_at("ids", -1).alias("last"), T.normalize_text(C("p_name")).alias("t"), F.floor(C("parts") / most).cast("int").alias("block"))
        x, y = (d.repartition(tasks, *key, "block").withColumn(w, T.words(C(n))) for d, n, w in ((x, "s", "sw"), (y, "t", "tw")))
        met = x.join(y.hint("merge"), [*key, "block"]).filter("a < last").withColumn("v", judged(*map(C, ("s", "t", "sw", "tw"))))
        met = met.select("ones", "others", "last", F.round(scored(C("v")), 6).alias("out"))
        pairs = met.select("others", "last", "out", F.explode("ones").alias("a")).filter("a < last").select("a", F.explode("others").alias("b"), "out")
        return pairs.filter("a < b")

    return build


def named(rows, by, copies):
    """The ids of each group of `by`, in order, in arrays of at most `copies`."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("a")) - 1
    return rows.withColumn("nth", F.floor(nth / copies)).groupBy(*by, "nth").agg(F.sort_array(F.collect_list("a")).alias("ids"))


ratio = lambda s, t, *_: T.ratio_of(s, t)
jaccard = lambda s, t, *w: T.jaccard_of(*w)
of_sim = lambda e: f"SELECT a, b, round({e}, 6) AS out FROM {PAIRS}"
LEV = f"(1 - levenshtein({norm('s')}, {norm('t')}) / greatest(length({norm('s')}), length({norm('t')})))"
W1, W2 = f"string_split({norm('s')}, ' ')", f"string_split({norm('t')}, ' ')"
JAC = f"(len(list_intersect({W1}, {W2}))::DOUBLE / len(list_distinct({W1} || {W2})))"
add("sim1_ratio", sim(ratio), of_sim(LEV))
add("sim2_containment", sim(T.containment_of), of_sim(f"CASE WHEN s = t THEN 1.0 WHEN contains(s, t) OR contains(t, s) THEN 0.8 ELSE {JAC} END"))
add("sim3_word_jaccard", sim(jaccard), of_sim(JAC))
add("sim4_relevance", sim(T.relevance_of), of_sim(f"CASE WHEN s = t THEN 1.0 WHEN contains(t, s) THEN 0.8 WHEN contains(s, t) THEN 0.7 ELSE len(list_intersect({W1}, {W2}))::DOUBLE / len(list_distinct({W1})) END"))
add("sim5_title_artist", sim(ratio, lambda v: 0.7 * v + 0.3 * T.ratio_of(C("brand"), C("brand"))), of_sim(f"0.7 * {LEV} + 0.3"))
add("sim6_search_relevance", sim(jaccard, lambda v: T.search_relevance(v, F.lit(1.0), C("p_size"))), f"SELECT x.p_partkey AS a, y.p_partkey AS b, round(least(1.0, 0.6 * {JAC.replace('lower(s)', 'lower(x.p_name)').replace('lower(t)', 'lower(y.p_name)')} + 0.3 + 0.1 * x.p_size / 100), 6) AS out FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey")

# formats and years of releases from the part's type and size
add("sim6b_release_relevance", sim(jaccard, lambda v: T.release_relevance(v, F.when(C("a") % 3 > 0, 1.0), C("a") % 2 == 0, 1975 + C("p_size")), "a % 6"), f"SELECT x.p_partkey AS a, y.p_partkey AS b, round(least(1.0, 0.6 * {JAC.replace('lower(s)', 'lower(x.p_name)').replace('lower(t)', 'lower(y.p_name)')} + CASE WHEN x.p_partkey % 3 > 0 THEN 0.25 ELSE 0 END + CASE WHEN x.p_partkey % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN 1975 + x.p_size >= 2000 THEN 0.05 ELSE 0 END), 6) AS out FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey")


def block_pairs(k):
    """Titles of an artist with one first word whose longest-block ratio is 0.7 or more."""
    t = k.tracks.select("artist_id", F.lower("title").alias("title")).distinct().withColumn("word", F.substring_index("title", " ", 1))
    t = written(t.select("artist_id", "word", "title"), "titles")
    pairs = t.withColumnRenamed("title", "title1").join(t.withColumnRenamed("title", "title2"), ["artist_id", "word"]).filter("title1 < title2")
    # written, as else the bound is pushed below the distinct and judged for each artist's pair anew
    return B.block_pairs(written(pairs.select("title1", "title2").distinct(), "pairs"), "title1", "title2", 0.7).withColumn("score", F.round("score", 6))


#: No SQL: the recursion over blocks is tested against a plain one.
Q["sim1b_block_ratio"] = lambda spark, sf: block_pairs(load(spark, sf))
