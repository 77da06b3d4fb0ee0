"""Registered queries of operators/shaping.py and what remains of parsing, grouping and payloads, with their SQL."""

from pyspark.sql import functions as F

from mediagrain.functions import text as T
from mediagrain.operators import documents as D
from mediagrain.operators import linkage as L
from mediagrain.operators import ranking as R
from mediagrain.operators import shaping as S
from mediagrain.operators.components import written
from mediagrain.plans.documents import MUSIC, hit, music_pages
from mediagrain.plans.linkage import FOLD, RELEASES
from mediagrain.plans.textual import norm
from mediagrain.sources.catalog import load, sql

C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


LABELS = ("Produit par", "Mix", "PAROLES", "noise", "label ", "Produit Par")


def sheets(k):
    """Two lines for each supplier, whose labels and names differ."""
    label = lambda by: F.get(F.array(*(F.lit(x) for x in LABELS)), (by % len(LABELS)).cast("int"))
    line = F.concat(label(C("s_suppkey")), F.lit(": "), "s_name", F.when(C("s_suppkey") % 2 == 0, F.concat(F.lit(" , Ann "), (C("s_suppkey") % 7).cast("string"))).otherwise(F.lit("")))
    second = F.concat(label(F.floor(C("s_suppkey") / 6)), F.lit(" : one two "), F.when(C("s_suppkey") % 3 == 0, "three four five").otherwise("three"), F.lit(" & Zoe"))
    return k.supplier.select(C("s_suppkey").alias("id"), F.concat(line, F.lit("\n"), second).alias("text"))


SHEETS = f"WITH l AS (SELECT s_suppkey AS k, s_name, {list(LABELS)} AS ls FROM supplier), t AS (SELECT k AS id, ls[k % 6 + 1] AS label, s_name || CASE WHEN k % 2 = 0 THEN ' , Ann ' || (k % 7) ELSE '' END AS names FROM l UNION ALL SELECT k, ls[(k // 6) % 6 + 1], 'one two ' || CASE WHEN k % 3 = 0 THEN 'three four five' ELSE 'three' END || ' & Zoe' FROM l), n AS (SELECT id, lower(trim(label)) AS label, trim(unnest(regexp_split_to_array(names, '[,&]'))) AS name FROM t)"
add("c14_labelled_lines", lambda k: S.labelled_lines(sheets(k), "id", "text"), SHEETS + " SELECT id, CASE label WHEN 'produit par' THEN 'producer' WHEN 'mix' THEN 'mixing_engineer' WHEN 'paroles' THEN 'songwriter' ELSE 'label' END AS kind, name FROM n WHERE label IN ('produit par', 'mix', 'paroles', 'label') AND name <> '' AND len(string_split(name, ' ')) <= 4")
def page_text(k):
    """Texts of conversations with credit lines put in at their ends and in between."""
    i = C("conv_id") * 1000 + C("turn")
    lines = F.get(F.array(*(F.lit(x) for x in ("\nProduced by Jean Petit\nMIXED BY ANNA\nmastered by nobody", " Featuring Ana and Beat by Leo\nok", "\nExecutive Producer: Zoë\nWritten by\nPaul"))), (i % 4).cast("int"))
    return k.conversations.select(i.alias("id"), F.concat(F.coalesce(lines, F.lit("")), F.lit("\n"), F.substring("text", 1, 40), F.coalesce(lines, F.lit("")), "text").alias("text"))


HITS = " UNION ALL ".join(f"SELECT id, text, '{kind}' AS kind, regexp_extract_all(text, '(?i){p}') AS m, regexp_split_to_array(text, '(?i){p}') AS s FROM t" for kind, ps in S.PAGE_PATTERNS.items() for p in ps)
PAGE_LINES = ["\nProduced by Jean Petit\nMIXED BY ANNA\nmastered by nobody", " Featuring Ana and Beat by Leo\nok", "\nExecutive Producer: Zoë\nWritten by\nPaul"]
add("c13_page_credits", lambda k: S.page_credits(page_text(k), "id", "text"), "WITH l AS (SELECT conv_id * 1000 + turn AS id, text, coalesce([" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in PAGE_LINES) + "][(conv_id * 1000 + turn) % 4 + 1], '') AS line FROM conversations), t AS (SELECT id, line || chr(10) || left(text, 40) || line || text AS text FROM l), h AS (" + HITS + "), e AS (SELECT id, text, kind, m, s, unnest(range(1, len(m) + 1)) AS i FROM h), p AS (SELECT id, text, kind, length(m[i]) AS n, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS pos FROM e), c AS (SELECT id, kind, pos, substr(text, greatest(pos - 50, 0) + 1, pos + n + 100 - greatest(pos - 50, 0)) AS context FROM p), n AS (SELECT id, kind, pos, trim(unnest(string_split(context, chr(10)))) AS name FROM c) SELECT id, kind, pos, name FROM n WHERE length(name) > 2 AND regexp_matches(name, '\\p{Lu}') AND regexp_matches(name, '\\p{Ll}')")
add("c15_infer_role", lambda k: k.credits.groupBy(S.infer_role(F.concat(F.lit("by "), "credit_type")).alias("role")).agg(F.count("*").alias("n")), sql("credits", "SELECT CASE credit_type WHEN 'producer' THEN 'producer' WHEN 'mixing' THEN 'mixing_engineer' WHEN 'featuring' THEN 'featuring' ELSE 'other' END AS role, count(*) AS n FROM credits GROUP BY 1"))
SENTENCES = ("Produced by {n}, Ann & Bob", "{n} and Zoe et Max", "credits: {n};show more", "Lucy,{n}\nA")
prose = lambda k: k.supplier.select(C("s_suppkey").alias("id"), F.replace(F.get(F.array(*(F.lit(x) for x in SENTENCES)), (C("s_suppkey") % 4).cast("int")), F.lit("{n}"), C("s_name")).alias("text"))
add("c15b_names_in_text", lambda k: prose(k).select("id", F.posexplode(S.names_in_text(C("text"))).alias("pos", "name")), "WITH t AS (SELECT s_suppkey AS id, replace((" + str(list(SENTENCES)).replace("\\n", "' || chr(10) || '") + ")[s_suppkey % 4 + 1], '{n}', s_name) AS text FROM supplier), n AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '[,;&\n]| and | et '), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT regexp_matches(lower(x), 'produced|mixed|written|by|credits|show|more')) AS ns FROM t) SELECT id, CAST(unnest(range(len(ns))) AS INT) AS pos, unnest(ns) AS name FROM n")
def raw_credits(k):
    """Credits with invalid names, names and instruments in other forms."""
    i = C("part")
    return k.credits.select("track_id", "credit_type", F.when(i % 5 == 0, F.lit("123")).when(i % 5 == 1, F.concat(F.lit(" "), C("person_name"), F.lit(" [x]"))).otherwise(C("person_name")).alias("person_name"), F.when(i % 4 == 0, F.lit("keys")).when(i % 4 == 1, F.lit("drums")).alias("instrument"))


add("c18_drop_invalid_credits", lambda k: S.cleaned_credits(raw_credits(k)).groupBy("person_name", "instrument").agg(F.count("*").alias("n")), sql("credits", "SELECT CASE WHEN part % 5 = 1 THEN person_name || ' x' ELSE person_name END AS person_name, CASE part % 4 WHEN 0 THEN 'keyboard' WHEN 1 THEN 'drums' END AS instrument, count(*) AS n FROM credits WHERE part % 5 <> 0 GROUP BY 1, 2"))
add("c18b_cleaning_counts", lambda k: S.cleaning_counts(raw_credits(k)), sql("credits", "SELECT count(*) AS credits, count(*) FILTER (WHERE part % 5 = 0) AS dropped, count(*) FILTER (WHERE part % 5 = 1) AS names_changed, count(*) FILTER (WHERE part % 5 <> 0 AND part % 4 = 0) AS instruments_changed FROM credits"))
def release_metadata(k):
    """Per album: modal genre (rap if it has none), length, earliest date and year, any explicit track, mean page views."""
    t = k.tracks.withColumns({"genre": F.when(C("album_id") % 6 > 0, C("genre")), "explicit": C("has_lyrics") & (C("id") % 4 == 0), "pageviews": F.when(C("id") % 3 > 0, C("id") % 1000)})
    # one pass: facts of each genre of an album, then of the album, whose genre is the most frequent one (ties: the smallest)
    own = t.groupBy("album_id", "genre").agg(F.sum(F.when(C("duration_seconds") > 0, C("duration_seconds"))).alias("seconds"), F.min("release_date").alias("first_date"), F.bool_or("explicit").alias("explicit"), F.sum("pageviews").alias("views"), F.count("pageviews").alias("viewed"), F.count("*").alias("n"))
    modal = F.min(F.when(C("genre").isNotNull(), F.struct((-C("n")).alias("m"), "genre")))
    facts = own.groupBy("album_id").agg(F.sum("seconds").alias("seconds"), F.min("first_date").alias("first_date"), F.bool_or("explicit").alias("explicit"), F.round(F.try_divide(F.sum("views"), F.sum("viewed")), 4).alias("pageviews"), modal.alias("x"))
    return facts.select("album_id", "seconds", "first_date", "explicit", "pageviews", F.coalesce("x.genre", F.lit("rap")).alias("genre"), F.year("first_date").alias("year"))


add("g05_release_metadata", release_metadata, sql("tracks", ", m AS (SELECT album_id, genre FROM (SELECT album_id, genre, row_number() OVER (PARTITION BY album_id ORDER BY count(*) DESC, genre) AS rn FROM tracks WHERE album_id % 6 > 0 GROUP BY 1, 2) WHERE rn = 1), f AS (SELECT album_id, CAST(sum(duration_seconds) FILTER (WHERE duration_seconds > 0) AS BIGINT) AS seconds, min(release_date) AS first_date, bool_or(has_lyrics AND id % 4 = 0) AS explicit, round(avg(CASE WHEN id % 3 > 0 THEN id % 1000 END), 4) AS pageviews FROM tracks GROUP BY 1) SELECT f.*, coalesce(genre, 'rap') AS genre, year(first_date)::INT AS year FROM f LEFT JOIN m USING (album_id)"))
add("g07_primary_source", lambda k: R.modal(k.credits, ["track_id"], "credit_type"), sql("credits", "SELECT track_id, credit_type, n FROM (SELECT track_id, credit_type, count(*) AS n, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, credit_type) AS rn FROM credits GROUP BY 1, 2) WHERE rn = 1"))


def merged_groups(k):
    """Release groups alike to 0.85 to an earlier one of the artist that stays; with the tracks of the albums that bear each key."""
    keyed = k.albums.select(C("id").alias("album_id"), "artist_id", L.release_key(C("title")).alias("key"))
    own = k.tracks.select("album_id").join(keyed, "album_id")
    groups = written(L.group_releases(k.albums, k.tracks).select("artist_id", "key", "release_id", "albums"), "groups")
    return L.merged_releases(groups, own)


Q["g03_merged_groups"] = lambda spark, sf: merged_groups(load(spark, sf))
SQL["g03_merged_groups"] = sql("albums tracks", RELEASES + ", e AS (SELECT x.release_id AS a, y.release_id AS b, x.artist_id AS grp FROM g x JOIN g y ON x.artist_id = y.artist_id AND x.release_id < y.release_id AND 1 - levenshtein(x.key, y.key) / greatest(length(x.key), length(y.key)) >= 0.85)" + FOLD.format(kind="BIGINT") + " SELECT g.artist_id, coalesce(leader, release_id) AS release, count(*) AS groups, CAST(sum(albums) AS BIGINT) AS albums, CAST(sum(tracks) AS BIGINT) AS tracks, arg_min(key, (-tracks, length(key), len(key) - len(replace(key, '(', '')), len(key) - len(replace(key, '[', '')), key)) AS best_key FROM g LEFT JOIN l ON l.id = release_id GROUP BY 1, 2").replace("WITH albums", "WITH RECURSIVE albums", 1)
CLASSES = ("date", "label", "nav")
add("h02_page_metadata", lambda k: music_pages(k).select("page_id", *(S.by_class(C("html"), c).alias(c) for c in CLASSES), *(F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit("")).alias(c) for c, p in (("title", "<title>([^<]*)</title>"), ("h1", "<h1[^>]*>([^<]*)</h1>"), ("description", 'name="description" content="([^"]*)"'))), D.first_hit(C("html"), D.FIELD_PATTERNS["album"]).alias("album"), F.trim(D.first_hit(C("html"), D.FIELD_PATTERNS["genre"])).alias("genre")), MUSIC + " SELECT page_id, " + ", ".join(f"nullif(trim(regexp_extract(html, 'class=\"[^\"]*{c}[^\"]*\"[^>]*>([^<]*)<', 1)), '') AS {c}" for c in CLASSES) + ", nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), '') AS h1, nullif(trim(regexp_extract(html, 'name=\"description\" content=\"([^\"]*)\"', 1)), '') AS description, " + hit(D.FIELD_PATTERNS["album"]) + " AS album, trim(" + hit(D.FIELD_PATTERNS["genre"]) + ") AS genre FROM h")
add("p05_scrobble_tags", lambda k: k.events.select("event_id", F.array_join(S.scrobble_tags(F.when(C("event_id") % 2 == 0, F.concat(F.lit('{"tag":[{"name":"rap","count":'), (C("event_id") % 100).cast("string"), F.lit('},{"name":"jazz","count":50},{"name":"pop","count":5}]}'))).otherwise(F.lit('{"tag":{"name":"solo","count":20}}')), 10, 2), ",").alias("tags")), "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'solo' WHEN event_id % 100 > 50 THEN 'rap,jazz' WHEN event_id % 100 = 50 THEN 'jazz,rap' WHEN event_id % 100 >= 10 THEN 'jazz,rap' ELSE 'jazz' END AS tags FROM events")
song = lambda k: k.tracks.select("id", F.to_json(F.struct(C("title").alias("name"), F.array(F.struct(C("artist_id").alias("id")), F.struct((C("artist_id") + 1).alias("id"))).alias("artists"), F.struct(C("album_id").alias("id")).alias("album"), (C("duration_seconds") * 1000).alias("duration_ms"))).alias("doc"))
SONG = "name string, artists array<struct<id:bigint>>, album struct<id:bigint>, duration_ms bigint"
def features_doc(k):
    """Audio feature payloads of vectors: some without a key or a tempo, some broken."""
    v, i = lambda n: F.round(F.abs(F.col("embedding")[n].cast("double")), 6), C("vec_id")
    doc = F.to_json(F.struct(v(0).alias("danceability"), v(1).alias("energy"), F.when(i % 4 > 0, i % 12).alias("key"), v(2).alias("loudness"), F.when(i % 3 < 2, i % 3).alias("mode"), F.when(i % 7 > 0, 60 + v(3) * 50).alias("tempo"), F.lit(4).alias("time_signature"), F.lit("x").alias("more")))
    return k.embeddings.select("vec_id", F.when(i % 20 == 0, F.substring(doc, 1, 30)).otherwise(doc).alias("doc"))


add("p03b_audio_features", lambda k: S.audio_features(features_doc(k), "vec_id", "doc").select("vec_id", "danceability", "energy", "key", "mode", "time_signature", "bpm", "key_name", "mode_name").filter("vec_id % 20 > 0"), "WITH e AS (SELECT vec_id AS i, embedding, 60 + round(abs(embedding[4]::DOUBLE), 6) * 50 AS tempo FROM embeddings WHERE vec_id % 20 > 0) SELECT i AS vec_id, round(abs(embedding[1]::DOUBLE), 6) AS danceability, round(abs(embedding[2]::DOUBLE), 6) AS energy, CASE WHEN i % 4 > 0 THEN i % 12 END::INT AS key, CASE WHEN i % 3 < 2 THEN i % 3 END::INT AS mode, 4 AS time_signature, CASE WHEN i % 7 > 0 THEN round_even(tempo, 0) END::INT AS bpm, CASE WHEN i % 4 > 0 THEN ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][i % 12 + 1] END AS key_name, CASE i % 3 WHEN 1 THEN 'Major' WHEN 0 THEN 'Minor' END AS mode_name FROM e")


def scrobbles(k):
    """Artist payloads: images with and without addresses; similar artists as a list, an object or not at all."""
    i = C("event_id")
    name = F.concat(F.lit('{"name":"a'), (i % 50).cast("string"), F.lit('","match":"0.'), (i % 10).cast("string"), F.lit('"}'))
    similar = F.when(i % 3 == 0, F.concat(F.lit("["), name, F.lit(',{"name":"b"}]'))).when(i % 3 == 1, name)
    images = F.when(i % 4 == 0, F.lit('[{"#text":"","size":"small"}]')).when(i % 4 == 1, F.lit('[{"#text":"http://s","size":"small"},{"#text":"http://l","size":"large"},{"#text":"","size":"mega"}]')).otherwise(F.lit('[{"#text":"http://s","size":"small"}]'))
    return k.events.select("event_id", F.concat(F.lit('{"image":'), images, F.coalesce(F.concat(F.lit(',"similar":{"artist":'), similar, F.lit("}")), F.lit("")), F.lit("}")).alias("doc"))


add("p05b_scrobble_artists", lambda k: scrobbles(k).select("event_id", S.scrobble_image(C("doc")).alias("image"), S.similar_artists(C("doc")).alias("s")).select("event_id", "image", F.array_join(F.transform("s", lambda a: a["name"]), ",").alias("similar"), F.round(F.aggregate("s", F.lit(0.0), lambda n, a: n + a["match"]), 6).alias("matches")), "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'http://l' ELSE 'http://s' END AS image, CASE event_id % 3 WHEN 0 THEN 'a' || event_id % 50 || ',b' WHEN 1 THEN 'a' || event_id % 50 ELSE '' END AS similar, CASE WHEN event_id % 3 < 2 THEN round(event_id % 10 / 10, 6) ELSE 0 END::DOUBLE AS matches FROM events")
add("p03_track_payload", lambda k: D.flatten_payload(song(k), "doc", SONG).select("id", C("artists")[0]["id"].alias("artist"), F.array_join(F.transform(F.slice("artists", F.lit(2), F.greatest(F.size("artists") - 1, F.lit(0))), lambda a: a["id"].cast("string")), ",").alias("others"), C("album.id").alias("album"), F.floor(C("duration_ms") / 1000).alias("seconds")), sql("tracks", "SELECT id, artist_id AS artist, CAST(artist_id + 1 AS VARCHAR) AS others, album_id AS album, CAST(duration_seconds AS BIGINT) AS seconds FROM tracks"))
# The confidence of a rhythm by its level.
rhythm = lambda: F.when(C("bpm").isNotNull(), F.when(C("id") % 3 == 0, 0.9).when(C("id") % 3 == 1, 0.7).otherwise(0.5))
add("f05_analysis_quality", lambda k: k.tracks.select("id", S.analysis_quality({"rhythm": rhythm(), "harmonic": F.when(C("id") % 5 > 0, C("id") % 11 / 20), "timbre": F.when(C("duration_seconds").isNotNull(), 0.8), "structure": F.when(C("id") % 7 > 1, 0.8)}, C("bpm")).alias("x")).select("id", "x.*"), sql("tracks", ", a AS (SELECT id, bpm, list_filter([CASE WHEN bpm IS NOT NULL THEN CASE id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END END, CASE WHEN id % 5 > 0 THEN id % 11 / 20 END, CASE WHEN duration_seconds IS NOT NULL THEN 0.8 END, CASE WHEN id % 7 > 1 THEN 0.8 END]::DOUBLE[], lambda x: x IS NOT NULL) AS c FROM tracks), q AS (SELECT id, bpm, len(c) / 4 AS complete, coalesce(list_sum(c) / nullif(len(c), 0), 0) AS sure FROM a) SELECT id, round(complete, 6) AS completeness, round(sure, 6) AS confidence, round((complete + sure) / 2, 6) AS overall, concat_ws(',', CASE WHEN complete < 0.8 THEN 'incomplete' END, CASE WHEN sure < 0.6 THEN 'unsure' END, CASE WHEN bpm < 60 OR bpm > 200 THEN 'odd_tempo' END) AS issues FROM q"))


add("u03_one_to_many", lambda k: k.tracks.select("id", F.inline(F.transform(F.split(T.normalize_text(C("title")), " "), lambda w, i: F.struct(i.alias("pos"), w.alias("word"))))), sql("tracks", f", n AS (SELECT id, string_split({norm('title')}, ' ') AS w FROM tracks) SELECT id, (unnest(range(len(w))))::INT AS pos, unnest(w) AS word FROM n"))
add("u04_custom_fold", lambda k: k.embeddings.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda m, x: (m + x.cast("double")) / 2), 5).alias("fold")), "SELECT vec_id, round(list_reduce([0.0::DOUBLE] || list_transform(embedding, lambda x: x::DOUBLE), lambda m, x: (m + x) / 2), 5) AS fold FROM embeddings")
