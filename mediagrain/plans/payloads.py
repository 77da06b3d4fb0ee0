"""Registered queries of payloads, file round trips and feature summaries, with their SQL.

Payloads are JSON made of the catalogue's rows, with missing, single and repeated parts by id; the SQL gives the
expected columns from the rows themselves.
"""

from pyspark.sql import functions as F

from mediagrain.operators import documents as D
from mediagrain.operators import shaping as S
from mediagrain.operators.components import new_folder
from mediagrain.sources import exports as X
from mediagrain.sources.catalog import load, sql
from mediagrain.streaming import events as E

C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


def every(n, yes, no=None):
    """`yes` for ids that n divides, else `no` (null, of the same type)."""
    return F.when(C("id") % n == 0, yes) if no is None else F.when(C("id") % n == 0, yes).otherwise(no)


def releases(k):
    inner = k.tracks.groupBy(C("album_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("track_number", "title", "duration_seconds"))).alias("ts"))
    credit = lambda name, role: F.struct(name.alias("name"), role.alias("role"))
    text = lambda c: c.cast("string")
    length = lambda s: F.concat(text(F.floor(s / 60)), F.lit(":"), F.lpad(text(s % 60), 2, "0"))
    track = lambda t: F.struct(text(t["track_number"]).alias("position"), t["title"].alias("title"), length(t["duration_seconds"]).alias("duration"), F.when(t["track_number"] % 2 == 1, F.array(credit(F.concat(F.lit("Zed & "), text(t["track_number"])), F.lit("Mixed by")))).alias("extraartists"))
    person = lambda i, name: F.struct(i.alias("id"), name.alias("name"))
    one, ident = F.array(person(C("artist_id"), C("name"))), lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    image = lambda t, u: F.struct(F.lit(t).alias("type"), F.concat(F.lit(u), text(C("id"))).alias("uri"))
    codes = F.concat(F.array(ident("Barcode", text(C("id") * 7))), every(2, F.array(ident("Matrix / Runout", F.concat(F.lit("M"), text(C("id"))))), F.array().cast("array<struct<type:string,value:string>>")), every(5, F.array(ident("Barcode", F.lit("last"))), F.array().cast("array<struct<type:string,value:string>>")))
    df = k.albums.join(k.artists.select(C("id").alias("artist_id"), "name", "country"), "artist_id").join(inner, "id")
    return df.select(
        F.to_json(
            F.struct(
                "id", "title", C("release_year").alias("year"), "country",
                every(3, F.concat(one, F.array(person(C("artist_id") + 1, F.lit(" B & C ")))), one).alias("artists"),
                F.when(C("id") % 4 > 0, F.array(F.struct(F.concat(F.lit("Label "), text(C("id") % 9)).alias("name"), F.concat(F.lit("CAT-"), text(C("id"))).alias("catno")))).alias("labels"),
                F.array(F.struct(every(2, F.lit("Vinyl"), F.lit("CD")).alias("name"), F.lit("1").alias("qty"), F.array(F.lit("LP"), F.lit("Album")).alias("descriptions"))).alias("formats"),
                codes.alias("identifiers"),
                F.when(C("id") % 3 == 1, F.array(image("secondary", "s"), image("primary", "p"))).when(C("id") % 3 == 2, F.array(image("secondary", "s"))).alias("images"),
                F.transform("ts", track).alias("tracklist"),
                F.array(credit(C("name"), F.lit("Producer")), credit(F.lit("Ann"), F.lit("Saxophone"))).alias("extraartists"),
            )
        ).alias("doc")
    )


BASE = ", b AS (SELECT albums.*, name, country FROM albums JOIN artists ON artists.id = artist_id WHERE albums.id IN (SELECT album_id FROM tracks))"
add("p04_release_payload", lambda k: D.release_payload(releases(k), "doc"), sql("albums artists tracks", BASE + " SELECT b.id, title, release_year AS year, country, name || CASE WHEN id % 3 = 0 THEN ';B and C' ELSE '' END AS artists, artist_id AS main_artist_id, name AS main_artist, CASE WHEN id % 4 > 0 THEN 'Label ' || (id % 9) END AS main_label, CASE WHEN id % 4 > 0 THEN 'CAT-' || id END AS catalog_number, CASE WHEN id % 2 = 0 THEN 'Vinyl' ELSE 'CD' END AS main_format, 'LP;Album' AS format_descriptions, CASE WHEN id % 5 = 0 THEN 'last' ELSE CAST(id * 7 AS VARCHAR) END AS barcode, CASE WHEN id % 2 = 0 THEN 'M' || id END AS matrix_number, CASE id % 3 WHEN 1 THEN 'p' || id WHEN 2 THEN 's' || id END AS cover_art_url, (SELECT count(*) FROM tracks WHERE album_id = b.id)::INT AS tracks, 'Producer=' || name || ';Instrumentalist=Ann' AS credits FROM b"))
add("p04b_release_tracks", lambda k: D.release_tracks(releases(k), "doc"), sql("albums artists tracks", " SELECT album_id AS id, CAST(track_number AS VARCHAR) AS position, title, duration_seconds AS seconds, CASE WHEN track_number % 2 = 1 THEN 'Mixing Engineer=Zed and ' || track_number ELSE '' END AS credits FROM tracks"))


def track_docs(k):
    df = k.tracks.join(k.albums.select(C("id").alias("album_id"), C("title").alias("album")), "album_id").join(k.artists.select(C("id").alias("artist_id"), "name"), "artist_id")
    person = lambda i, n: F.struct(i.alias("id"), n.alias("name"))
    artists = F.concat(F.array(person(C("artist_id"), C("name"))), F.when(C("id") % 2 == 0, F.array(person(F.lit(1), F.lit("Ann")), person(F.lit(2), F.lit("Bob")))).otherwise(F.array().cast("array<struct<id:int,name:string>>")))
    record = F.struct(C("album_id").alias("id"), C("album").alias("name"), C("release_date").cast("string").alias("release_date"), C("track_number").alias("total_tracks"), F.when(C("id") % 3 > 0, F.array(F.struct(F.concat(F.lit("u"), C("id").cast("string")).alias("url")))).alias("images"))
    return df.select(F.to_json(F.struct("id", C("title").alias("name"), artists.alias("artists"), record.alias("album"), (C("duration_seconds") * 1000 + 7).alias("duration_ms"), C("has_lyrics").alias("explicit"), (C("id") % 101).alias("popularity"), "track_number")).alias("doc"))


NAMED = ", b AS (SELECT tracks.*, albums.title AS album, name FROM tracks JOIN albums ON albums.id = album_id JOIN artists ON artists.id = tracks.artist_id)"
add("p01b_track_payload", lambda k: D.track_payload(track_docs(k), "doc"), sql("tracks albums artists", NAMED + " SELECT id, title, name AS artist, CASE WHEN id % 2 = 0 THEN 'Ann;Bob' ELSE '' END AS others, CAST(duration_seconds AS BIGINT) AS seconds, has_lyrics AS explicit, CAST(id % 101 AS INT) AS popularity, track_number, album_id, album, release_date, track_number AS total_tracks, CASE WHEN id % 3 > 0 THEN 'u' || id END AS cover_url FROM b"))


def song_docs(k):
    df = k.tracks.join(k.albums.select(C("id").alias("album_id"), C("title").alias("album")), "album_id").join(k.artists.select(C("id").alias("artist_id"), "name"), "artist_id")
    person = lambda n: F.struct(F.lit(1).alias("id"), n.alias("name"))
    return df.select(F.to_json(F.struct("id", "title", F.struct(C("artist_id").alias("id"), "name").alias("primary_artist"), F.when(C("id") % 2 == 0, F.array(person(F.lit("Ann")), person(C("genre")))).alias("featured_artists"), F.when(C("id") % 3 == 0, F.array(person(F.concat(F.lit("P"), (C("id") % 50).cast("string"))))).alias("producer_artists"), F.when(C("id") % 5 > 0, F.struct(C("album_id").alias("id"), C("album").alias("name"))).alias("album"), F.struct((C("id") * 3).alias("pageviews")).alias("stats"), C("release_date").cast("string").alias("release_date"))).alias("doc"))


add("p06_song_payload", lambda k: D.song_payload(song_docs(k), "doc"), sql("tracks albums artists", NAMED + " SELECT id, title, name AS artist, CASE WHEN id % 2 = 0 THEN 'Ann;' || genre ELSE '' END AS guests, CASE WHEN id % 3 = 0 THEN 'P' || (id % 50) ELSE '' END AS producers, CASE WHEN id % 5 > 0 THEN album_id END AS album_id, CASE WHEN id % 5 > 0 THEN album END AS album, id * 3 AS pageviews, release_date FROM b"))


# features
def styles(k):
    e = lambda i: F.abs(C("embedding")[i].cast("double"))
    return k.embeddings.select("vec_id", S.subgenre_scores((C("vec_id") % 120 + 80).cast("double"), C("vec_id") % 7 == 0, e(0), e(1), e(2), e(3)).alias("x")).select("vec_id", *(F.round(f"x.{c}", 6).alias(c) for c in ("trap", "boom_bap", "drill")))


add("f03_subgenre_scores", styles, "WITH e AS (SELECT vec_id, vec_id % 120 + 80 AS t, vec_id % 7 = 0 AS p, abs(embedding[1]::DOUBLE) AS s, abs(embedding[2]::DOUBLE) AS a, abs(embedding[3]::DOUBLE) AS h, abs(embedding[4]::DOUBLE) AS m FROM embeddings) SELECT vec_id, round((CASE WHEN t BETWEEN 130 AND 150 THEN 0.3 ELSE 0 END + CASE WHEN p THEN 0.4 ELSE 0 END + CASE WHEN s > 0.15 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS trap, round((CASE WHEN t BETWEEN 85 AND 105 THEN 0.4 ELSE 0 END + CASE WHEN a > 0.8 * h THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS boom_bap, round((CASE WHEN t BETWEEN 140 AND 180 THEN 0.4 ELSE 0 END + CASE WHEN m > 0.25 THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS drill FROM e")


def analyses(k):
    v = C("vec_id")
    return k.embeddings.select("vec_id", F.to_json(F.struct(F.struct((v % 300).alias("duration_seconds"), (v / 4).alias("rms_energy")).alias("basic"), F.when(v % 2 == 0, F.struct((v % 90 + 70).alias("bpm"), (v % 3 == 0).alias("trap_pattern_detected"))).alias("rhythm"), F.struct(F.concat(F.lit("K"), (v % 12).cast("string")).alias("detected_key")).alias("harmonic"), F.when(v % 5 > 0, F.struct(v.alias("mid_energy"))).alias("energy"), F.struct(F.when(v % 7 == 0, "fast").alias("flow_style")).alias("rap_specific"))).alias("doc"))


add("f04_summary_features", lambda k: S.summary_features(analyses(k), "vec_id", "doc"), "SELECT vec_id, (vec_id % 300)::DOUBLE AS duration_seconds, vec_id / 4 AS energy_level, NULL::DOUBLE AS brightness, CASE WHEN vec_id % 2 = 0 THEN (vec_id % 90 + 70)::DOUBLE END AS bpm, NULL::DOUBLE AS rhythm_regularity, CASE WHEN vec_id % 2 = 0 THEN vec_id % 3 = 0 END AS trap_detected, 'K' || (vec_id % 12) AS detected_key, NULL::DOUBLE AS key_confidence, NULL::DOUBLE AS harmonic_complexity, NULL::DOUBLE AS bass_energy, CASE WHEN vec_id % 5 > 0 THEN vec_id::DOUBLE END AS vocal_energy, NULL::DOUBLE AS dynamic_range, NULL::DOUBLE AS vocal_density, CASE WHEN vec_id % 7 = 0 THEN 'fast' END AS flow_style FROM embeddings")


# reading and writing
def entities(k):
    """A row for each of the five tables: rows, ids, least and greatest name."""
    tables = {"artists": (k.artists, "id", "name"), "albums": (k.albums, "id", "title"), "tracks": (k.tracks, "id", "title"), "credits": (k.credits, "track_id", "person_name"), "sessions": (k.sessions, "id", "status")}
    out = None
    for name, (df, key, text) in tables.items():
        one = df.agg(F.count("*").alias("n"), F.sum(key).alias("ids"), F.min(text).alias("least"), F.max(text).alias("greatest")).select(F.lit(name).alias("entity"), "*")
        out = one if out is None else out.unionByName(one)
    return out


add("io01_read_entities", entities, sql("artists albums tracks credits sessions", " UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n, CAST(sum({i}) AS BIGINT) AS ids, min({x}) AS least, max({x}) AS greatest FROM {t}" for t, i, x in (("artists", "id", "name"), ("albums", "id", "title"), ("tracks", "id", "title"), ("credits", "track_id", "person_name"), ("sessions", "id", "status")))))


def there_and_back(df, fmt, by=(), schema=None, **options):
    """The table written in a format to the shared folder and read again."""
    path = new_folder(df.sparkSession, "export")
    X.write_table(df, path, fmt, list(by), row_tag="row")
    return df.sparkSession.read.format(fmt).schema(schema or df.schema).options(**options).load(path).select(*df.columns)


def broken_payloads(k):
    path = new_folder(k.spark, "payloads")
    k.tracks.select(F.when(C("id") % 10 == 3, F.concat(F.lit('{"id": '), C("id").cast("string"), F.lit(', "title"'))).otherwise(F.to_json(F.struct("id", "title", F.struct("bpm", "genre").alias("audio")))).alias("value")).write.text(path)
    return X.read_payloads(k.spark, path, "id long, title string, audio struct<bpm:double,genre:string>").select("id", "title", "audio.bpm", "audio.genre", C("_corrupt_record").alias("broken"))


add("io02_read_payloads", broken_payloads, sql("tracks", "SELECT CASE WHEN id % 10 <> 3 THEN id END AS id, CASE WHEN id % 10 <> 3 THEN title END AS title, CASE WHEN id % 10 <> 3 THEN bpm END AS bpm, CASE WHEN id % 10 <> 3 THEN genre END AS genre, CASE WHEN id % 10 = 3 THEN '{\"id\": ' || id || ', \"title\"' END AS broken FROM tracks"))
NESTED = "name string, tracks array<struct<id:long,title:string,duration_seconds:int,credits:array<struct<credit_type:string,person_name:string>>>>, albums array<struct<album_id:long,title:string,release_date:date>>, stats struct<tracks:int,albums:int,credits:int>"


def nested(k):
    """The nested export as JSON, read again and flattened: a row for each artist and track."""
    df = X.nested_artists(k.artists.select("id", "name"), k.tracks, k.albums, k.credits).select("id", F.to_json(F.struct("name", "tracks", "albums", "stats")).alias("doc"))
    back = df.select("id", F.from_json("doc", NESTED).alias("d")).select("id", "d.*")
    back = back.select("id", "name", C("stats.tracks").alias("n_tracks"), C("stats.albums").alias("n_albums"), C("stats.credits").alias("n_credits"), F.get("albums", F.lit(0))["title"].alias("first_album"), F.explode_outer("tracks").alias("t"))
    return back.select("id", "name", "n_tracks", "n_albums", "n_credits", "first_album", C("t.id").alias("track"), "t.title", F.array_join(F.transform("t.credits", lambda c: F.concat_ws("=", c["credit_type"], c["person_name"])), ";").alias("credits"))


add("io04_nested_export", nested, sql("artists albums tracks credits", ", c AS (SELECT track_id, string_agg(credit_type || '=' || person_name, ';' ORDER BY credit_type, person_name) AS credits, count(*) AS n FROM credits GROUP BY 1), t AS (SELECT tracks.id, title, artist_id, coalesce(credits, '') AS credits, coalesce(n, 0) AS n FROM tracks LEFT JOIN c ON track_id = tracks.id), s AS (SELECT artist_id, count(*) AS nt, sum(n) AS nc FROM t GROUP BY 1), a AS (SELECT artist_id, count(*) AS na, arg_min(title, id) AS first FROM albums GROUP BY 1) SELECT artists.id, name, coalesce(nt, 0)::INT AS n_tracks, coalesce(na, 0)::INT AS n_albums, coalesce(nc, 0)::INT AS n_credits, first AS first_album, t.id AS track, title, credits FROM artists LEFT JOIN t ON t.artist_id = artists.id LEFT JOIN s ON s.artist_id = artists.id LEFT JOIN a ON a.artist_id = artists.id"))
PART = "id, title, bpm, genre, release_date"
columns = ("id", "title", "bpm", "genre", "release_date")
add("io06_csv_round_trip", lambda k: there_and_back(k.tracks.select(*columns), "csv", header=True), sql("tracks", f"SELECT {PART} FROM tracks"))
add("io07_xml_round_trip", lambda k: there_and_back(k.tracks.select(*columns), "xml", rowTag="row"), sql("tracks", f"SELECT {PART} FROM tracks"))
add("io09_partitioned_round_trip", lambda k: there_and_back(k.tracks.select(*columns), "parquet", ["genre"]), sql("tracks", f"SELECT {PART} FROM tracks"))


def streamed(k):
    """The event files (a pattern, as they may be one file) as a stream, written batch by batch and read again: rows and values of each type."""
    path, mark = new_folder(k.spark, "stream"), new_folder(k.spark, "mark")
    E.write_stream(E.events_stream(k.spark, f"{k.dir}/events.parque[t]").select("event_id", "event_type", "ts", "value"), path, mark)
    back = k.spark.read.parquet(path).select("event_id", "event_type", "value")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.round(F.sum("value"), 2).alias("value"))


add("io10_stream_round_trip", streamed, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1")
