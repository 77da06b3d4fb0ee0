"""Registered queries of lookup.py and ranking.py, with their SQL."""

from pyspark.sql import functions as F

from mediagrain.operators import lookup as L
from mediagrain.operators import ranking as R
from mediagrain.sources.catalog import load, sql

AS_OF = "2024-01-20 00:00:00"
C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    if text:
        SQL[name] = text


T = "id, title, artist_id"
add("q01_get_by_id", lambda k: L.get_by_id(k.artists, 7).select("id", "name", "country"), sql("artists", "SELECT id, name, country FROM artists WHERE id = 7"))
add("q02_get_by_name", lambda k: L.get_by_name(k.artists, "customer#000000012").select("id", "name"), sql("artists", "SELECT id, name FROM artists WHERE lower(name) = 'customer#000000012'"))
add("q03_list_sessions", lambda k: L.list_rows(k.sessions, [F.desc("ts"), "id"], 50, C("status") == "failed").select("id", "session", "ts"), sql("sessions", "SELECT id, session, ts FROM sessions WHERE status = 'failed' ORDER BY ts DESC, id LIMIT 50"))
add("q04_list_artists", lambda k: L.list_rows(k.artists, ["name"], 100).select("id", "name"), sql("artists", "SELECT id, name FROM artists ORDER BY name LIMIT 100"))
add("q05_tracks_by_artist", lambda k: L.list_rows(k.tracks, ["artist_id", "title", "id"]).select("id", "title", "artist_id"), sql("tracks", "SELECT id, title, artist_id FROM tracks"))
add("q06_albums_by_artist", lambda k: L.list_rows(k.albums, ["artist_id", F.desc_nulls_last("release_year"), "title", "id"]).select("id", "title", "release_year", "artist_id"), sql("albums", "SELECT id, title, release_year, artist_id FROM albums"))
add("q07_credits_by_track", lambda k: L.list_rows(k.credits, ["track_id", "credit_type", "person_name", "part"]), sql("credits", "SELECT * FROM credits"))
add("q08_search_tracks", lambda k: L.search(k.tracks, "(ReMix)", ["title", "genre"], 200, ("title", "id")).select("id", "title", "artist_id"), sql("tracks", "SELECT id, title, artist_id FROM tracks WHERE title ILIKE '%(remix)%' OR genre ILIKE '%(remix)%' ORDER BY title, id LIMIT 200"))
add("q09_tracks_with_credits", lambda k: L.with_any(k.tracks, k.credits.filter("credit_type = 'producer'"), "id", "track_id").select("id", "title"), sql("tracks credits", "SELECT id, title FROM tracks WHERE id IN (SELECT track_id FROM credits WHERE credit_type = 'producer')"))
add("q10_tracks_without_producer", lambda k: L.without_any(k.tracks, k.credits.filter("credit_type = 'producer'"), "id", "track_id").select("id", "title"), sql("tracks credits", "SELECT id, title FROM tracks WHERE NOT EXISTS (SELECT 1 FROM credits WHERE credit_type = 'producer' AND track_id = id)"))
add("q11_credits_of_artist", lambda k: k.credits.join(k.tracks, C("track_id") == C("id")).select("artist_id", "track_id", "person_name", "credit_type"), sql("tracks credits", "SELECT artist_id, track_id, person_name, credit_type FROM credits JOIN tracks ON track_id = id"))
add("q12_attach_credits", lambda k: L.attach_credits(k.tracks, k.credits).select("id", F.array_join(F.transform("credits", lambda c: F.concat_ws("=", c["credit_type"], c["person_name"])), ";").alias("credits")), sql("tracks credits", "SELECT id, coalesce(string_agg(credit_type || '=' || person_name, ';' ORDER BY credit_type, person_name), '') AS credits FROM tracks LEFT JOIN credits ON track_id = id GROUP BY id"))


def cascade(k):
    left = L.cascade_delete(k.artists, k.albums, k.tracks, k.credits, C("id") % 3 == 0)
    return L.table_counts(left)


add("q13_cascade_delete", cascade, sql("artists albums tracks credits", "SELECT 'artists' AS table_name, count(*) AS n FROM artists WHERE id % 3 <> 0 UNION ALL SELECT 'albums', count(*) FROM albums WHERE artist_id % 3 <> 0 UNION ALL SELECT 'tracks', count(*) FROM tracks WHERE artist_id % 3 <> 0 UNION ALL SELECT 'credits', count(*) FROM credits WHERE track_id NOT IN (SELECT id FROM tracks WHERE artist_id % 3 = 0)"))
add("q14_upsert", lambda k: L.upsert(k.artists.filter("id % 4 <> 0").select("id", "name", "genre"), k.artists.filter("id % 3 = 0 or id % 4 = 0").select("id", F.upper("name").alias("name"), "genre"), "id"), sql("artists", "SELECT id, CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN upper(name) ELSE name END AS name, genre FROM artists"))
add(
    "q15_upsert_fill_missing",
    lambda k: L.upsert_fill_missing(k.tracks.filter("id % 3 <> 0").select("id", "bpm", "duration_seconds", F.lit(2).alias("priority")), k.tracks.filter("id % 2 = 0 or id % 3 = 0").select("id", F.lit(120.0).alias("bpm"), F.lit(180).alias("duration_seconds"), (C("id") % 4 + 1).cast("int").alias("priority")), "id"),
    sql("tracks", ", e AS (SELECT id, bpm, duration_seconds, 2 AS priority FROM tracks WHERE id % 3 <> 0), n AS (SELECT id, 120.0::DOUBLE AS bpm, 180 AS duration_seconds, CAST(id % 4 + 1 AS INT) AS priority FROM tracks WHERE id % 2 = 0 OR id % 3 = 0) SELECT coalesce(e.id, n.id) AS id, coalesce(e.bpm, n.bpm) AS bpm, coalesce(e.duration_seconds, n.duration_seconds) AS duration_seconds, least(e.priority, n.priority) AS priority FROM e FULL JOIN n ON e.id = n.id"),
)
add("q16_update_where", lambda k: L.update_where(k.tracks, C("bpm") > 200, {"bpm": C("bpm") / 2, "status": F.lit("fixed")}).select("id", "bpm", "status"), sql("tracks", "SELECT id, CASE WHEN bpm > 200 THEN bpm / 2 ELSE bpm END AS bpm, CASE WHEN bpm > 200 THEN 'fixed' ELSE status END AS status FROM tracks"))
add("q17_latest_checkpoint", lambda k: L.latest(k.sessions, ["session", "status"], "ts", "metadata", "id").withColumn("step", F.get_json_object("metadata", "$.k").cast("long")), sql("sessions", "SELECT session, status, arg_max(metadata, (ts, id)) AS metadata, max(ts) AS ts, count(*) AS n, CAST(json_extract(arg_max(metadata, (ts, id)), '$.k') AS BIGINT) AS step FROM sessions GROUP BY session, status"))
add("q18_active_entries", lambda k: L.active(k.cache, F.lit(AS_OF).cast("timestamp")).select("key", "event_id"), sql("cache", "SELECT key, event_id FROM cache WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20'"))
add("q18b_expired_entries", lambda k: L.expired(k.cache, F.lit(AS_OF).cast("timestamp")).select("key", "event_id"), sql("cache", "SELECT key, event_id FROM cache WHERE expires_at <= TIMESTAMP '2024-01-20'"))
add("q19_keys_matching", lambda k: L.keys_matching(k.cache, "c?ick:1*").select("key", "event_id"), sql("cache", "SELECT key, event_id FROM cache WHERE key LIKE 'c_ick:1%'"))
add("q20_evict_oldest", lambda k: L.evict_oldest(k.cache, 0.2, "created_at", "event_id").select("key", "event_id"), sql("cache", "SELECT key, event_id FROM (SELECT *, row_number() OVER (ORDER BY created_at, event_id) AS rn, count(*) OVER () AS n FROM cache) WHERE rn > floor(n * 0.2)"))
add("q21_sample_rows", lambda k: L.sample_rows(k.tracks, 1000, "id").select("id", "title"), sql("tracks", "SELECT id, title FROM tracks ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 1000"))
add("q22_filter_sessions", lambda k: L.since(k.sessions.filter("status = 'failed'"), F.lit(AS_OF).cast("timestamp"), 7, "ts").select("id", "session", "ts"), sql("sessions", "SELECT id, session, ts FROM sessions WHERE status = 'failed' AND ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20'"))
add("q23_old_final_sessions", lambda k: L.old_final(k.sessions, F.lit(AS_OF).cast("timestamp"), 10).select("id", "session", "status"), sql("sessions", "SELECT id, session, status FROM sessions WHERE status IN ('completed', 'failed') AND ts < TIMESTAMP '2024-01-10'"))
add("q23b_open_sessions_by_status", lambda k: L.open_by_status(k.sessions).select("status", F.array_join("sessions", ",").alias("sessions")), sql("sessions", "SELECT status, string_agg(session, ',' ORDER BY session) AS sessions FROM (SELECT DISTINCT status, session FROM sessions WHERE status <> 'completed') GROUP BY status"))
add("q24_filter_for_extraction", lambda k: L.for_extraction(k.tracks, k.tracks.filter("status = 'failed'")).select("id", "status"), sql("tracks", "SELECT id, status FROM tracks WHERE status = 'pending' AND title <> ''"))
add("q25_prioritise_and_batch", lambda k: L.prioritise(k.tracks, 50).select("id", "priority", "batch"), sql("tracks", ", p AS (SELECT id, CASE WHEN duration_seconds IS NULL THEN 3 ELSE 0 END + CASE WHEN bpm IS NULL THEN 2 ELSE 0 END + CASE WHEN has_lyrics THEN 0 ELSE 1 END AS priority FROM tracks) SELECT id, priority, (row_number() OVER (ORDER BY priority DESC, id) - 1) // 50 + 1 AS batch FROM p"))
add("q26_table_counts", lambda k: L.table_counts({"artists": k.artists, "albums": k.albums, "tracks": k.tracks, "credits": k.credits, "sessions": k.sessions}), sql("artists albums tracks credits sessions", "SELECT 'artists' AS table_name, count(*) AS n FROM artists UNION ALL SELECT 'albums', count(*) FROM albums UNION ALL SELECT 'tracks', count(*) FROM tracks UNION ALL SELECT 'credits', count(*) FROM credits UNION ALL SELECT 'sessions', count(*) FROM sessions"))


def invalidated(k):
    rules = k.spark.createDataFrame([("error", "click:{id}"), ("signup", "view:*"), ("none", "*")], "event string, pattern string")
    events = k.events.select(C("event_type").alias("event"), (C("user_id") % 50).alias("id"))
    return L.invalidate(k.cache, events, rules).select("key", "event_id")


add("q27_invalidate_on_event", invalidated, sql("cache", ", f AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'click:' || (user_id % 50) ELSE 'view:%' END AS p FROM events WHERE event_type IN ('error', 'signup')) SELECT key, event_id FROM cache WHERE NOT EXISTS (SELECT 1 FROM f WHERE key LIKE p)"))

add("w01_union_sources", lambda k: R.union_all(k.artists.select("id", "name"), k.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name"), F.lit("s").alias("src"))), sql("artists", "SELECT id, name, NULL::VARCHAR AS src FROM artists UNION ALL SELECT s_suppkey, s_name, 's' FROM supplier"))
add("w02_add_if_absent", lambda k: R.add_absent(k.part.filter("p_partkey % 2 = 0").select("p_partkey", "p_name"), k.part.filter("p_partkey % 3 = 0 or p_partkey % 2 = 1").select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey"), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS p_name FROM part")
add("w03_set_overlap", lambda k: k.part.select("p_partkey", R.set_overlap(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("x")).select("p_partkey", C("x.shared").cast("long").alias("shared"), C("x.together").cast("long").alias("together")), "SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(a || b)) AS together FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)")
add("w04_distinct_in_order", lambda k: k.lyrics.select("id", F.array_join(F.array_distinct(F.split("lyrics", " ")), " ").alias("words")), sql("lyrics", ", w AS (SELECT id, unnest(string_split(lyrics, ' ')) AS w, unnest(range(1, len(string_split(lyrics, ' ')) + 1)) AS i FROM lyrics), f AS (SELECT id, w, min(i) AS i FROM w GROUP BY id, w) SELECT id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY id"))
add("w05_keep_first", lambda k: R.keep_first(k.credits.select("track_id", "person_name", "credit_type"), ["track_id", "credit_type"], ["person_name"]), sql("credits", "SELECT track_id, min(person_name) AS person_name, credit_type FROM credits GROUP BY track_id, credit_type"))
add("w06_best_source", lambda k: k.credits.groupBy("track_id").agg(F.min_by("person_name", F.struct(F.when(C("credit_type") == "producer", 1).when(C("credit_type") == "songwriter", 2).otherwise(3), "person_name")).alias("best")), sql("credits", "SELECT track_id, arg_min(person_name, (CASE credit_type WHEN 'producer' THEN 1 WHEN 'songwriter' THEN 2 ELSE 3 END, person_name)) AS best FROM credits GROUP BY track_id"))
add("w07_top_k", lambda k: k.credits.groupBy("person_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_name").limit(10), sql("credits", "SELECT person_name, count(*) AS n FROM credits GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
add("w08_top_in_group", lambda k: R.top_in_group(k.tracks.select("artist_id", "id", "duration_seconds"), ["artist_id"], [F.desc_nulls_last("duration_seconds"), "id"], 3), sql("tracks", "SELECT * FROM (SELECT artist_id, id, duration_seconds, row_number() OVER (PARTITION BY artist_id ORDER BY duration_seconds DESC NULLS LAST, id)::INT AS rank FROM tracks) WHERE rank <= 3"))
add("w09_modal_value", lambda k: R.modal(k.tracks, ["artist_id"], "genre"), sql("tracks", "SELECT artist_id, genre, n FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, genre) AS rn FROM (SELECT artist_id, genre, count(*) AS n FROM tracks GROUP BY ALL)) WHERE rn = 1"))
add("w10_share_of_total", lambda k: R.share_of_total(k.tracks, "genre"), sql("tracks", "SELECT genre, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tracks), 4)::DOUBLE AS pct FROM tracks GROUP BY genre"))
add("w11_oldest_nonzero", lambda k: k.sessions.filter("found > 0").groupBy("session").agg(F.min_by("found", F.struct("ts", "id")).alias("found")), sql("sessions", "SELECT session, arg_min(found, (ts, id)) AS found FROM sessions WHERE found > 0 GROUP BY session"))
add("w12_running_mean", lambda k: R.running_mean(k.sessions.select("session", "id", "ts", "found"), "session", ["ts", "id"], "found"), sql("sessions", "SELECT session, id, ts, found, round(avg(found) OVER (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM sessions"))
add("w12b_exponential_mean", lambda k: R.exponential_mean(k.sessions, "session", ["ts", "id"], "found").select("session", F.round("ema", 6).alias("ema")), sql("sessions", "SELECT session, round(list_reduce(list(found::DOUBLE ORDER BY ts, id), lambda m, x: (m + x) / 2), 6) AS ema FROM sessions GROUP BY session"))
add("w13_recent_trend", lambda k: R.recent_trend(k.sessions, "session", ["ts", "id"], "found"), sql("sessions", ", r AS (SELECT session, found, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS rn FROM sessions), m AS (SELECT session, avg(found) FILTER (WHERE rn <= 10) AS a, avg(found) FILTER (WHERE rn > 10 AND rn <= 20) AS b FROM r GROUP BY session) SELECT session, round(a, 6) AS recent, round(b, 6) AS previous, CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS trend FROM m"))
add("w14_first_last", lambda k: R.first_last(k.sessions, "session", ["ts", "id"], "found"), sql("sessions", ", m AS (SELECT session, arg_min(found, (ts, id)) AS first_value, arg_max(found, (ts, id)) AS last_value FROM sessions GROUP BY session) SELECT *, CASE WHEN last_value > first_value THEN 'improving' WHEN last_value < first_value THEN 'declining' ELSE 'stable' END AS trend FROM m"))
add("w15_islands", lambda k: R.islands(k.sessions, "session", ["ts", "id"], "ts", "found"), sql("sessions", ", m AS (SELECT session, avg(found) + 0.5 * stddev_pop(found) AS bound FROM sessions GROUP BY 1), a AS (SELECT session, ts, id, found > bound AS f, lead(ts) OVER (PARTITION BY session ORDER BY ts, id) AS nxt FROM sessions JOIN m USING (session)), b AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY session ORDER BY ts, id) THEN 1 ELSE 0 END AS n FROM a), c AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY ts, id) AS g FROM b) SELECT session, min(ts) AS started, max(coalesce(nxt, ts)) AS ended, count(*) AS n, CAST(floor(epoch(max(coalesce(nxt, ts)))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM c WHERE f GROUP BY session, g HAVING seconds > 0.5"))
add("w16_intervals", lambda k: R.intervals(k.sessions, "session", ["ts", "id"], "ts"), sql("sessions", ", g AS (SELECT session, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session ORDER BY ts, id))) / 1e6 AS gap FROM sessions), m AS (SELECT session, count(*) AS n, avg(gap) AS a, stddev_pop(gap) AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM g GROUP BY session) SELECT session, n, round(a, 4) AS mean_gap, round(s, 4) AS std_gap, round(1 - s / nullif(a, 0), 6) AS regularity, round(3600 * n / nullif(span, 0), 6) AS per_hour, CASE WHEN s < 0.1 * a THEN 'regular' WHEN s > 0.3 * a THEN 'irregular' ELSE 'moderate' END AS style FROM m"))
add("w17_daily_series", lambda k: R.daily(k.sessions, "ts", "found"), sql("sessions", "SELECT CAST(ts AS DATE) AS day, CAST(sum(found) AS BIGINT) AS total, count(*) AS n FROM sessions GROUP BY 1"))
