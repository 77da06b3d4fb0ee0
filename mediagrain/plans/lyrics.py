"""Registered queries of operators/lyrics.py, with their SQL."""

from pyspark.sql import functions as F

from mediagrain.operators import documents as D
from mediagrain.operators import lyrics as Y
from mediagrain.sources.catalog import load, sql

C = F.col
Q, SQL = {}, {}


def texts(k):
    """The lyrics with words, markers and lines that differ by id."""
    tail = F.when(C("id") % 3 == 0, "[feat. Ann ] Damn merde! fortune\nagain\nagain\nthe rain\nin pain").when(C("id") % 3 == 1, "[Bob:] rue, le la les du pour\n[featuring Zoé]").otherwise("top [X: y:] the of and")
    return k.lyrics.select("id", F.concat("lyrics", F.lit(" money, (Love) gun! "), tail).alias("lyrics"))


def listed(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TAIL = "CASE id % 3 WHEN 0 THEN '[feat. Ann ] Damn merde! fortune' || chr(10) || 'again' || chr(10) || 'again' || chr(10) || 'the rain' || chr(10) || 'in pain' WHEN 1 THEN '[Bob:] rue, le la les du pour' || chr(10) || '[featuring Zoé]' ELSE 'top [X: y:] the of and' END"
THEMES = " UNION ALL ".join(f"SELECT {i} AS o, '{t}' AS theme, {listed(ws)} AS ws" for i, (t, ws) in enumerate(Y.THEMES.items()))
CTES = rf""", y AS (SELECT id, lyrics || ' money, (Love) gun! ' || {TAIL} AS lyrics FROM lyrics),
tok AS (SELECT id, lyrics, list_filter(regexp_split_to_array(lower(lyrics), '\s+'), lambda w: w <> '') AS t FROM y),
w AS (SELECT *, list_transform(t, lambda w: trim(w, '{Y.EDGES}')) AS ws FROM tok),
ls AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT id, list_filter(list_transform(string_split(lyrics, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM y)),
st AS (SELECT id, CAST(section AS BIGINT) AS section, CASE WHEN section = 0 THEN 'verse' ELSE 'chorus' END AS kind, count(*) AS lines, arg_min(line, pos) AS first_line, 0.6::DOUBLE AS confidence FROM (SELECT *, sum((repeated AND pos > 0)::INT) OVER (PARTITION BY id ORDER BY pos) AS section FROM (SELECT *, count(*) OVER (PARTITION BY id, line) > 1 AS repeated, count(*) OVER (PARTITION BY id) AS n_lines FROM ls) WHERE n_lines >= 4) GROUP BY id, section),
er AS (SELECT id, right(w, 3) AS r, count(*) AS n FROM (SELECT id, lower(regexp_extract(line, '([\pL\pN_]+)$', 1)) AS w FROM ls) WHERE w <> '' GROUP BY 1, 2),
rh AS (SELECT id, CAST(sum(n) AS BIGINT) AS ends, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rhyming, count(*) FILTER (WHERE n > 1) AS groups FROM er GROUP BY 1),
th AS (SELECT id, theme, CAST(n AS INT) AS n, intensity, CAST(row_number() OVER (PARTITION BY id ORDER BY intensity DESC, o) AS INT) AS rank FROM (SELECT id, theme, o, n, round(100 * n / words, 2) AS intensity FROM (SELECT id, theme, o, len(t) AS words, len(list_filter(w.ws, lambda x: list_contains(k.ws, x))) AS n FROM w, ({THEMES}) k) WHERE n > 0)),
ga AS (SELECT id, list_transform(regexp_extract_all(lyrics, '(?i)\[(feat\.?|featuring|ft\.?)\s*([^\]]+)\]', 2), lambda x: trim(x)) AS feat, list_filter(list_transform(regexp_extract_all(lyrics, '\[([^\]]+):\]', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, ':')) AS own FROM y),
fe AS (SELECT id, coalesce(len(list_filter(ws, lambda x: list_contains({listed(Y.FRENCH)}, x))) / nullif(len(ws), 0), 0) AS f, coalesce(len(list_filter(ws, lambda x: list_contains({listed(Y.ENGLISH)}, x))) / nullif(len(ws), 0), 0) AS e FROM w),
la AS (SELECT id, CASE WHEN f > e AND f > 0.05 THEN 'french' WHEN e > f AND e > 0.05 THEN 'english' WHEN f > 0.03 AND e > 0.03 THEN 'mixed' ELSE 'unknown' END AS language, round(CASE WHEN f > e AND f > 0.05 THEN least(f * 2, 1.0) WHEN e > f AND e > 0.05 THEN least(e * 2, 1.0) WHEN f > 0.03 AND e > 0.03 THEN 0.7 ELSE 0 END, 6)::DOUBLE AS confidence, round(f * 100, 2) AS french, round(e * 100, 2) AS english FROM fe),
vw AS (SELECT id, unnest(v) AS word, unnest(range(len(v))) AS pos FROM (SELECT id, list_filter(list_transform(t, lambda w: trim(w, '{Y.QUOTES.replace(chr(39), chr(39) * 2)}')), lambda w: w <> '' AND NOT list_contains({listed(Y.STOPS)}, w)) AS v FROM tok)),
vc AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM vw GROUP BY 1, 2),
vo AS (SELECT id, CAST(sum(n) AS BIGINT) AS total, count(*) AS different, round(count(*) / sum(n), 6) AS richness, round(sum(n * length(word)) / sum(n), 6) AS mean_length, round(coalesce(sum(n) FILTER (WHERE length(word) >= 6), 0) / sum(n), 6) AS long_share, coalesce(array_to_string(list(word ORDER BY first) FILTER (WHERE n = 1 AND length(word) >= 7)[1:20], ';'), '') AS rare FROM vc GROUP BY 1),
vt AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS rank FROM vc),
ew AS (SELECT id, list_filter(regexp_split_to_array(lower(lyrics), '[^\pL\pN'']+'), lambda w: w <> '') AS w FROM y),
ex AS (SELECT id, explicit, CASE WHEN explicit / nullif(n, 0) > 0.05 THEN 'high' WHEN explicit / nullif(n, 0) > 0.02 THEN 'medium' WHEN explicit > 0 THEN 'low' ELSE 'none' END AS severity FROM (SELECT id, len(list_filter(w, lambda x: list_contains({listed(D.EXPLICIT)}, x)))::INT AS explicit, len(w) AS n FROM ew)),
wide AS (SELECT y.id, length(lyrics)::INT AS chars, array_to_string(feat, ';') AS featuring, array_to_string(own, ';') AS section_artists, len(feat) + len(own) > 0 AS collaboration, language, la.confidence AS language_confidence, explicit, severity, li.lines, se.sections, round(rhyming / ends, 6) AS rhyme_density, round(groups / ends, 6) AS rhyme_complexity, ts.themes, ts.theme_words, total, different, richness, mean_length, long_share, rare, vt.word AS top_word
  FROM y JOIN ga USING (id) JOIN la USING (id) JOIN ex USING (id) LEFT JOIN (SELECT id, count(*) AS lines FROM ls GROUP BY 1) li USING (id) LEFT JOIN (SELECT id, count(*) AS sections FROM st GROUP BY 1) se USING (id) LEFT JOIN rh USING (id)
  LEFT JOIN (SELECT id, coalesce(string_agg(theme, ';' ORDER BY rank) FILTER (WHERE rank <= 3 AND intensity > 0.5), '') AS themes, CAST(sum(n) AS BIGINT) AS theme_words FROM th GROUP BY 1) ts USING (id) LEFT JOIN vo USING (id) LEFT JOIN vt ON vt.id = y.id AND vt.rank = 1)
"""  # noqa: E501


def add(name, build, body):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = sql("lyrics", CTES + body)


lines = lambda k: Y.lines_of(texts(k), "id", "lyrics")
counts = lambda k: Y.word_counts(texts(k), "id", "lyrics")
wide = lambda k: Y.process(texts(k), "id", "lyrics", D.explicit_words(C("lyrics")))
add("l05_estimated_structure", lambda k: Y.estimated_structure(lines(k), "id"), "SELECT * FROM st")
add("l06_end_rhymes", lambda k: Y.end_rhymes(lines(k), "id"), "SELECT *, round(rhyming / ends, 6) AS density, round(groups / ends, 6) AS complexity FROM rh")
add("l07_themes", lambda k: Y.themes(texts(k), "id", "lyrics"), "SELECT *, rank <= 3 AND intensity > 0.5 AS dominant FROM th")
add("l08_section_artists", lambda k: texts(k).select("id", Y.guests(C("lyrics")).alias("g")).select("id", F.array_join("g.featuring", ";").alias("featuring"), F.array_join("g.sections", ";").alias("sections")), "SELECT id, array_to_string(feat, ';') AS featuring, array_to_string(own, ';') AS sections FROM ga")
add("l09_language", lambda k: texts(k).select("id", Y.language(Y.bare(Y.tokens(C("lyrics")))).alias("l")).select("id", "l.*"), "SELECT * FROM la")
add("l11_vocabulary", lambda k: Y.vocabulary(counts(k), "id").withColumn("rare", F.array_join("rare", ";")), "SELECT * FROM vo")
add("l11b_frequent_words", lambda k: Y.frequent_words(counts(k), "id"), "SELECT id, word, n, CAST(rank AS INT) AS rank FROM vt WHERE rank <= 10")
add("l12_process_lyrics", wide, "SELECT * FROM wide")
add("a21_lyrics_insights", lambda k: Y.insights(wide(k), Y.themes(texts(k), "id", "lyrics")), "SELECT 'language' AS kind, language AS name, count(*)::DOUBLE AS value FROM wide GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'theme', theme, sum(n)::DOUBLE AS n FROM th GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL SELECT 'rate', 'explicit', round(avg((explicit > 0)::INT), 6) FROM wide UNION ALL SELECT 'rate', 'collaboration', round(avg(collaboration::INT), 6) FROM wide UNION ALL SELECT 'rate', 'richness', round(avg(richness), 6) FROM wide")
