"""Registered queries of operators/documents.py, with their SQL."""

from pyspark.sql import functions as F

from mediagrain.operators import documents as D
from mediagrain.operators import linkage as L
from mediagrain.plans.textual import norm, sub
from mediagrain.sources.catalog import load, sql

C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


WORDS = "list_filter(regexp_split_to_array(lower(lyrics), '[^\\p{L}\\p{N}'']+'), lambda w: w <> '')"
lines = lambda k: k.lyrics.select("id", F.posexplode(F.split("lyrics", "\n")).alias("pos", "line"))
LINES = ", x AS (SELECT id, unnest(string_split(lyrics, chr(10))) AS line, generate_subscripts(string_split(lyrics, chr(10)), 1) - 1 AS pos FROM lyrics)"


def marked(k):
    label = F.when(C("role") == "user", "[Verse ").when(C("role") == "assistant", "[Chorus ").otherwise("[Bridge ")
    two = F.array(F.struct((C("turn") * 2).alias("pos"), F.concat(label, C("turn").cast("string"), F.lit("]")).alias("line")), F.struct((C("turn") * 2 + 1).alias("pos"), C("text").alias("line")))
    return k.conversations.select("conv_id", F.explode(two).alias("x")).select("conv_id", "x.*")


add("l01_length_gate", lambda k: k.lyrics.select("id", F.length("lyrics").between(50, 50000).alias("ok")), sql("lyrics", "SELECT id, length(lyrics) BETWEEN 50 AND 50000 AS ok FROM lyrics"))
CLEAN = f"trim({sub('lyrics', ('<[^>]+>', ''), ('https?://\\S+', ''), ('@\\w+', ''), ('#\\w+', ''), ('[ \\t]+', ' '), ('\\n\\s*\\n+', chr(10)))})"
add("l02_clean_lyrics", lambda k: k.lyrics.select("id", D.clean_lyrics(F.regexp_replace("lyrics", "\n", " #tag \n")).alias("out")).select("id", F.length("out").alias("n"), F.md5(F.trim(F.regexp_replace("out", "[ \t\n\r\f]+", " "))).alias("digest")), sql("lyrics", f", c AS (SELECT id, {CLEAN} AS out FROM (SELECT id, replace(lyrics, chr(10), ' #tag ' || chr(10)) AS lyrics FROM lyrics)) SELECT id, length(out)::INT AS n, md5(trim(regexp_replace(out, '[ \t\n\r\f]+', ' ', 'g'))) AS digest FROM c"))
add("l03_basic_stats", lambda k: D.basic_stats(k.lyrics, "lyrics").drop("lyrics", "lang"), sql("lyrics", ", w AS (SELECT id, lyrics, list_filter(regexp_split_to_array(lyrics, '\\s+'), lambda w: w <> '') AS w, string_split(lyrics, chr(10)) AS l, list_filter(string_split(lyrics, chr(10)), lambda x: trim(x) <> '') AS f FROM lyrics), u AS (SELECT *, len(list_distinct(list_transform(w, lambda x: trim(lower(x), '.,!?;:'))))::INT AS n FROM w) SELECT id, length(lyrics)::INT AS chars, len(l)::INT AS lines, len(f)::INT AS full_lines, len(w)::INT AS words, n AS unique_words, coalesce(round(n / nullif(len(w), 0), 6), 0)::DOUBLE AS richness, coalesce(round(list_sum(list_transform(f, lambda x: length(x))) / nullif(len(f), 0), 2), 0)::DOUBLE AS mean_line, coalesce(round(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 2), 0)::DOUBLE AS mean_word, coalesce(round(len(f) / nullif(len(w), 0), 4), 0)::DOUBLE AS lines_per_word FROM u"))
MARKED = "WITH m AS (SELECT conv_id, turn * 2 AS pos, CASE role WHEN 'user' THEN '[Verse ' WHEN 'assistant' THEN '[Chorus ' ELSE '[Bridge ' END || turn || ']' AS line FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, text FROM conversations), k AS (SELECT *, lower(regexp_extract(line, '^\\[(\\w+)[^\\]]*\\]', 1)) AS marker FROM m), s AS (SELECT *, sum((marker <> '')::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS section FROM k) "
add("l04_sections", lambda k: D.sections(marked(k), "conv_id"), MARKED + "SELECT conv_id, CAST(section AS BIGINT) AS section, max(marker) AS kind, count(*) FILTER (WHERE marker = '') AS lines FROM s WHERE section > 0 GROUP BY conv_id, section")
add("l05_repeated_lines", lambda k: D.repeated_lines(lines(k), "id"), sql("lyrics", LINES + " SELECT id, lower(trim(line)) AS line, count(*) AS n, min(pos)::INT AS first_pos FROM x WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) > 1"))


add("l10_explicit", lambda k: D.explicit(k.lyrics.withColumn("lyrics", F.concat("lyrics", F.when(C("id") % 3 == 0, " Damn merde!").otherwise(""))), "id", "lyrics"), sql("lyrics", f", w AS (SELECT id, {WORDS} AS w FROM (SELECT id, lyrics || CASE WHEN id % 3 = 0 THEN ' Damn merde!' ELSE '' END AS lyrics FROM lyrics)), n AS (SELECT id, len(list_filter(w, lambda x: x IN ({quoted(D.EXPLICIT)})))::INT AS explicit, len(w) AS n FROM w) SELECT id, explicit, CASE WHEN explicit / nullif(n, 0) > 0.05 THEN 'high' WHEN explicit / nullif(n, 0) > 0.02 THEN 'medium' WHEN explicit > 0 THEN 'low' ELSE 'none' END AS severity FROM n"))


cased = lambda k: k.credits.select("track_id", "credit_type", F.when(C("part") % 3 == 0, F.upper("person_name")).when(C("part") % 3 == 1, F.replace("person_name", F.lit("#"), F.lit("# "))).otherwise(C("person_name")).alias("person_name"))
CASED = ", d AS (SELECT track_id, credit_type, CASE part % 3 WHEN 0 THEN upper(person_name) WHEN 1 THEN replace(person_name, '#', '# ') ELSE person_name END AS person_name FROM credits)"
add("c16_dedup_credits", lambda k: L.dedup_credits(cased(k), "lower"), sql("credits", CASED + " SELECT track_id, credit_type, min(person_name) AS person_name, count(*) AS n FROM d GROUP BY track_id, credit_type, lower(trim(person_name))"))
add("c16b_dedup_folded_credits", lambda k: L.dedup_credits(cased(k), "folded"), sql("credits", CASED + f" SELECT track_id, credit_type, min(person_name) AS person_name, count(*) AS n FROM d GROUP BY track_id, credit_type, replace({norm('person_name')}, ' ', '')"))
# Credit types by normalised role.
TYPES = {"producer": "producer", "executive_producer": "executive_producer", "co_producer": "co_producer", "mixing": "mixing", "mastering": "mastering", "recording": "recording", "featuring": "featuring", "songwriter": "songwriter", "composer": "composer", "guitar": "guitar", "piano": "piano", "drums": "drums", "bass": "bass", "saxophone": "saxophone"}


def fixed_types(k):
    """Types as they come in, by part; their normalised form where it is known, and whether that changes them."""
    raw = F.element_at(F.array(C("credit_type"), F.concat(F.lit(" "), F.upper("credit_type"), F.lit(" ")), F.lit("Co-Producer"), F.lit("executive producer"), F.lit("beatbox")), (C("part") % 5 + 1).cast("int"))
    role = F.regexp_replace(F.lower(F.trim("raw")), "[ -]+", "_")
    out = k.credits.select("track_id", "person_name", raw.alias("raw")).withColumn("new", F.element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), role))
    return out.select("raw", F.coalesce("new", "raw").alias("fixed"), (C("new").isNotNull() & (C("new") != C("raw"))).alias("changed")).groupBy("raw", "fixed", "changed").agg(F.count("*").alias("n"))


add("c17_fix_types", fixed_types, sql("credits", ", r AS (SELECT CASE part % 5 WHEN 0 THEN credit_type WHEN 1 THEN ' ' || upper(credit_type) || ' ' WHEN 2 THEN 'Co-Producer' WHEN 3 THEN 'executive producer' ELSE 'beatbox' END AS raw FROM credits), f AS (SELECT raw, CASE WHEN raw = 'beatbox' THEN NULL ELSE regexp_replace(lower(trim(raw)), '[ -]+', '_', 'g') END AS new FROM r) SELECT raw, coalesce(new, raw) AS fixed, new IS NOT NULL AND new <> raw AS changed, count(*) AS n FROM f GROUP BY 1, 2, 3"))

def music_pages(k):
    """The pages with a heading and fields of a music page that differ by page."""
    n = C("page_id")
    pick = lambda *xs: F.get(F.array(*(F.lit(x) for x in xs)), (n % len(xs)).cast("int"))
    number = lambda m, by: (by + n % m).cast("string")
    tail = F.concat(F.lit("<div class=\"x-date\">"), number(9, 1990), F.lit("</div><p>"), pick("BPM: ", "Tempo:", "", "about "), number(90, 70), pick("", "", " bpm", ""), F.lit("</p><p>"), pick("Key: ", "Musical Key is "), pick("A# minor", "C major", "F"), F.lit("</p><p>"), pick("Duration: 3:", "Length:4:", "in 5:"), F.lpad((n % 60).cast("string"), 2, "0"), pick("", "", " minutes"), F.lit("</p><p>"), pick("Released 1", "Year: 1", "no "), (900 + n % 99).cast("string"), F.lit("</p><p>Record label: L"), number(5, 0), F.lit(", Inc</p><p class=\"my-label\"> "), number(4, 0), F.lit("</p><p>Genre: "), pick("rap", "soul "), F.lit("</p><span class='g'>Album:"), number(3, 1), F.lit("</span>"))
    return k.pages.select("page_id", "url", F.concat(F.when(n % 2 == 0, F.concat(F.lit("<h1> Artist "), number(7, 0), F.lit(" - Song - "), number(5, 0), F.lit("</h1>"))).otherwise(""), "html", tail).alias("html"))


def choose(*xs):
    return "([" + ", ".join("'" + x + "'" for x in xs) + f"])[page_id % {len(xs)} + 1]"


MUSIC = f"WITH h AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '<h1> Artist ' || (page_id % 7) || ' - Song - ' || (page_id % 5) || '</h1>' ELSE '' END || html || '<div class=\"x-date\">' || (1990 + page_id % 9) || '</div><p>' || {choose('BPM: ', 'Tempo:', '', 'about ')} || (70 + page_id % 90) || {choose('', '', ' bpm', '')} || '</p><p>' || {choose('Key: ', 'Musical Key is ')} || {choose('A# minor', 'C major', 'F')} || '</p><p>' || {choose('Duration: 3:', 'Length:4:', 'in 5:')} || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || {choose('', '', ' minutes')} || '</p><p>' || {choose('Released 1', 'Year: 1', 'no ')} || (900 + page_id % 99) || '</p><p>Record label: L' || (page_id % 5) || ', Inc</p><p class=\"my-label\"> ' || (page_id % 4) || '</p><p>Genre: ' || {choose('rap', 'soul ')} || '</p><span class=''g''>Album:' || (1 + page_id % 3) || '</span>' AS html FROM pages)"


def hit(patterns):
    return "coalesce(" + ", ".join("nullif(regexp_extract(html, '" + x + "', 1), '')" for x in patterns) + ")"


one = lambda p: f"nullif(regexp_extract(html, '{p}', 1), '')"
FOUND = f", f AS (SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '')) AS heading, {one('<html lang=\"([^\"]*)\"')} AS lang, {one('charset=\"([^\"]*)\"')} AS charset, " + ", ".join(f"trim({hit(ps)}) AS {c}" for c, ps in D.FIELD_PATTERNS.items()) + " FROM h)"
add("h01_page_details", lambda k: D.page_details(music_pages(k)), MUSIC + FOUND + " SELECT page_id, heading, CASE WHEN contains(heading, ' - ') THEN trim(split_part(heading, ' - ', 1)) END AS artist, CASE WHEN contains(heading, ' - ') THEN trim(heading[position(' - ' IN heading) + 3:]) END AS title, lang, charset, CAST(bpm AS INT) AS bpm, key, CAST(minutes AS INT) * 60 + CAST(seconds AS INT) AS duration_seconds, CAST(year AS INT) AS year, label, genre, album FROM f")
add("h03_page_text", lambda k: k.pages.select("page_id", F.md5(D.page_text(C("html"))).alias("digest")), "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
ANCHOR = '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
LINKS = f", a AS (SELECT page_id, url, unnest(range(len(x))) AS pos, unnest(x) AS href, unnest(y) AS label FROM (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) AS x, regexp_extract_all(html, '{ANCHOR}', 2) AS y FROM h)), l AS (SELECT page_id, url, CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(href, '^[a-zA-Z]+:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || href WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href WHEN regexp_matches(href, '^[?#]|^$') THEN regexp_extract(url, '^([^?#]*)', 1) || href ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)', 1) || CASE WHEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)', 1) LIKE '%/' THEN '' ELSE '/' END || href END AS target, trim(label) AS label FROM a)"
linked = lambda k: music_pages(k).withColumn("html", F.concat("html", F.lit('<a href="track/1?x=2">One</a><a class="t" href="//cdn.x/song/2"> Two </a><a href="#top">Top</a><a href="mailto:a@b">M</a>')))
LINKED = MUSIC + ", g AS (SELECT page_id, url, html || '<a href=\"track/1?x=2\">One</a><a class=\"t\" href=\"//cdn.x/song/2\"> Two </a><a href=\"#top\">Top</a><a href=\"mailto:a@b\">M</a>' AS html FROM h)" + LINKS.replace("FROM h)", "FROM g)")
add("h04_page_links", lambda k: D.page_links(linked(k)), LINKED + " SELECT * FROM l")
add("h04b_track_links", lambda k: D.page_links(linked(k), "/(track|morceau|song)/"), LINKED + " SELECT * FROM l WHERE regexp_matches(regexp_extract(target, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/(track|morceau|song)/')")
add("p01_event_payload", lambda k: D.flatten_payload(k.events.select("event_id", "props"), "props", "k bigint, missing string"), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events")
album = lambda k: k.albums.join(k.tracks.groupBy(C("album_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("track_number", "title"))).alias("tracks")), "id").select("id", F.to_json(F.struct("title", "tracks")).alias("doc"))
add("p02_album_payload", lambda k: D.flatten_payload(album(k), "doc", "title string, tracks array<struct<track_number:int,title:string>>").select("id", F.inline_outer("tracks")), sql("albums tracks", "SELECT albums.id, track_number, tracks.title FROM albums JOIN tracks ON album_id = albums.id"))

vec = lambda k, most=64: k.embeddings.select("vec_id", "label", F.transform(F.slice("embedding", 1, most), lambda x: x.cast("double")).alias("v"))
TURNED = " UNION ALL ".join(f"SELECT {i} AS i, '{name}' AS key, {profile} AS p" for i, (name, profile) in enumerate(D.key_profiles()))
add("f01_key_detection", lambda k: vec(k, 12).select("vec_id", D.key_of(C("v")).alias("x")).select("vec_id", "x.*"), f"WITH v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: (x - list_sum(v) / 12) ** 2))) AS size FROM v), s AS (SELECT vec_id, i, key, round(list_inner_product(v, p::DOUBLE[]) / size, 6) AS r FROM m, ({TURNED}) t), b AS (SELECT vec_id, arg_max(key, (r, -i)) AS key, max(r) AS r FROM s GROUP BY 1) SELECT vec_id, key, round(r * CASE WHEN contains(key, 'minor') THEN 1.1 ELSE 1 END, 6) AS confidence FROM b")
add("f06_per_dimension", lambda k: D.per_dimension(vec(k), "label", "v"), "SELECT label, dim::INT AS dim, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
BANDS = [("sub", 0, 4), ("low", 4, 12), ("mid", 12, 32), ("high", 32, 64)]
add("f07_band_energy", lambda k: D.band_energy(vec(k), "vec_id", "v", BANDS), "SELECT vec_id, CASE WHEN dim < 4 THEN 'sub' WHEN dim < 12 THEN 'low' WHEN dim < 32 THEN 'mid' ELSE 'high' END AS band, round(avg(abs(x)), 5) AS energy FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
PAIRS = "WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v), p AS (SELECT a.label, list_inner_product(a.v, b.v) / (a.n * b.n) AS d FROM u a JOIN u b ON a.label = b.label AND b.vec_id > a.vec_id)"
add("f02_repetition", lambda k: D.repetition_of_all(vec(k), "label", "vec_id", "v").drop("skipped"), PAIRS + " SELECT label, CAST(count(*) FILTER (WHERE d > 0.8) AS BIGINT) AS alike, count(*) AS pairs, round(count(*) FILTER (WHERE d > 0.8) / count(*), 6) AS density FROM p GROUP BY 1")
# events as onsets: an hour of the log stands for ten seconds of sound
add("f08_onset_density", lambda k: D.onset_density(k.sessions.withColumn("second", F.unix_timestamp("ts") / 360.0), ["session"], "second"), sql("sessions", ", d AS (SELECT session, count(*) AS n, (epoch(max(date_trunc('second', ts))) - epoch(min(date_trunc('second', ts)))) / 360.0 AS seconds FROM sessions GROUP BY 1) SELECT session, n, round(n / nullif(seconds, 0), 6) AS density, coalesce(n / nullif(seconds, 0) > 8, false) AS dense FROM d"))
