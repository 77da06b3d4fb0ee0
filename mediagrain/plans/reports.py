"""Aggregations and reports over the catalogue, each one declarative query, with its SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediagrain.functions import text as T
from mediagrain.operators import partials as P
from mediagrain.operators import ranking as R
from mediagrain.operators import reports as O
from mediagrain.operators.quality import with_credit_facts
from mediagrain.plans.textual import feat_sql
from mediagrain.sources.catalog import load, sql

C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


def artist_stats(k):
    """Per artist: tracks, with lyrics, mean length, credits, albums. Each table is reduced before it is joined."""
    credits = k.credits.groupBy(C("track_id").alias("id")).agg(F.count("*").alias("c"))
    t = k.tracks.join(credits, "id", "left").groupBy(C("artist_id").alias("id")).agg(F.count("*").alias("tracks"), F.count_if("has_lyrics").alias("with_lyrics"), F.round(F.avg("duration_seconds"), 6).alias("mean_seconds"), F.sum("c").alias("credits"))
    a = k.albums.groupBy(C("artist_id").alias("id")).agg(F.count("*").alias("albums"))
    return k.artists.select("id", "name").join(t, "id", "left").join(a, "id", "left").na.fill(0, ["tracks", "with_lyrics", "credits", "albums"])


add("a01_artist_stats", artist_stats, sql("artists albums tracks credits", ", c AS (SELECT track_id, count(*) AS c FROM credits GROUP BY 1), t AS (SELECT artist_id, count(*) AS tracks, count(*) FILTER (WHERE has_lyrics) AS with_lyrics, round(avg(duration_seconds), 6) AS mean_seconds, CAST(sum(c) AS BIGINT) AS credits FROM tracks LEFT JOIN c ON track_id = id GROUP BY 1), a AS (SELECT artist_id, count(*) AS albums FROM albums GROUP BY 1) SELECT id, name, coalesce(tracks, 0) AS tracks, coalesce(with_lyrics, 0) AS with_lyrics, mean_seconds, coalesce(credits, 0) AS credits, coalesce(albums, 0) AS albums FROM artists LEFT JOIN t ON t.artist_id = id LEFT JOIN a ON a.artist_id = id"))
add("a02_global_stats", lambda k: k.tracks.agg(F.count("*").alias("tracks"), F.countDistinct("artist_id").alias("artists"), F.countDistinct("album_id").alias("albums"), F.count_if("has_lyrics").alias("with_lyrics"), F.sum("duration_seconds").alias("seconds")), sql("tracks", "SELECT count(*) AS tracks, count(DISTINCT artist_id) AS artists, count(DISTINCT album_id) AS albums, count(*) FILTER (WHERE has_lyrics) AS with_lyrics, CAST(sum(duration_seconds) AS BIGINT) AS seconds FROM tracks"))
add("a03_artist_export_stats", lambda k: k.tracks.groupBy("artist_id").agg(F.sum("duration_seconds").alias("seconds"), F.round(F.avg(F.when(C("bpm") > 0, C("bpm"))), 6).alias("mean_bpm"), F.min("release_date").alias("first_release"), F.max("release_date").alias("last_release")), sql("tracks", "SELECT artist_id, CAST(sum(duration_seconds) AS BIGINT) AS seconds, round(avg(bpm) FILTER (WHERE bpm > 0), 6) AS mean_bpm, min(release_date) AS first_release, max(release_date) AS last_release FROM tracks GROUP BY 1"))
add("a04_top_contributors", lambda k: k.credits.groupBy("person_name").agg(F.count("*").alias("n"), F.countDistinct("credit_type").alias("types")).orderBy(F.desc("n"), "person_name").limit(20), sql("credits", "SELECT person_name, count(*) AS n, count(DISTINCT credit_type) AS types FROM credits GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"))
add("a05_credit_type_stats", lambda k: k.credits.groupBy("credit_type").agg(F.count("*").alias("n")).withColumn("most_common", C("n") == F.max("n").over(Window.partitionBy())), sql("credits", "SELECT credit_type, count(*) AS n, count(*) = max(count(*)) OVER () AS most_common FROM credits GROUP BY 1"))
bucket = F.lit
add("a06_quality_distribution", lambda k: k.albums.agg(F.count_if(C("price") >= 200000).alias("high"), F.count_if((C("price") >= 100000) & (C("price") < 200000)).alias("medium"), F.count_if(~(C("price") >= 100000)).alias("low")), sql("albums", "SELECT count(*) FILTER (WHERE price >= 200000) AS high, count(*) FILTER (WHERE price >= 100000 AND price < 200000) AS medium, count(*) FILTER (WHERE NOT price >= 100000) AS low FROM albums"))


def status_counts(k):
    domain = k.spark.createDataFrame([(s,) for s in ("created", "in_progress", "paused", "completed", "failed", "cancelled")], "status string")
    return domain.join(k.sessions.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("found"), 6).alias("mean_found")), "status", "left").na.fill(0, ["n"])


add("a07_status_counts", status_counts, sql("sessions", "SELECT status, count(id) AS n, round(avg(found), 6) AS mean_found FROM (VALUES ('created'), ('in_progress'), ('paused'), ('completed'), ('failed'), ('cancelled')) d(status) LEFT JOIN sessions USING (status) GROUP BY status"))
def session_stats(k):
    """(kind, name, value): sessions of every status, mean seconds of completed sessions, the ten busiest sessions."""
    row = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), C(name).cast("string").alias("name"), C(value).cast("double").alias("value"))
    last = k.sessions.groupBy("session").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"), F.count("*").alias("n"))
    domain = k.spark.createDataFrame([(s,) for s in ("created", "in_progress", "paused", "completed", "failed", "cancelled")], "status string")
    counts = domain.join(last.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0, ["n"])
    done = last.agg(F.lit("all").alias("name"), F.round(F.avg(F.when(C("status") == "completed", C("seconds"))), 4).alias("value"))
    return row(counts, "status", "status", "n").unionByName(row(done, "completion_seconds", "name", "value")).unionByName(row(last.orderBy(F.desc("n"), "session").limit(10), "busiest", "session", "n")).unionByName(row(last.agg(F.lit("sessions").alias("name"), F.count("*").alias("n")), "total", "name", "n"))


add("a07b_session_global_stats", session_stats, sql("sessions", ", l AS (SELECT session, arg_max(status, (ts, id)) AS status, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS seconds, count(*) AS n FROM sessions GROUP BY 1) SELECT 'status' AS kind, status AS name, count(session)::DOUBLE AS value FROM (VALUES ('created'), ('in_progress'), ('paused'), ('completed'), ('failed'), ('cancelled')) d(status) LEFT JOIN l USING (status) GROUP BY 2 UNION ALL SELECT 'completion_seconds', 'all', round(avg(seconds) FILTER (WHERE status = 'completed'), 4) FROM l UNION ALL SELECT * FROM (SELECT 'busiest', CAST(session AS VARCHAR), n::DOUBLE FROM l ORDER BY n DESC, session LIMIT 10) UNION ALL SELECT 'total', 'sessions', count(*)::DOUBLE FROM l"))
add("a08_session_summary", lambda k: k.sessions.groupBy("session").agg(F.round(100 * F.avg((C("status") == "completed").cast("double")), 6).alias("progress"), F.min("ts").alias("started"), F.max("ts").alias("ended")).join(R.last_k(k.sessions, ["session"], [F.desc("ts"), F.desc("id")], "id", 5), "session").withColumn("latest", F.array_join("latest", ",")), sql("sessions", "SELECT session, round(100 * avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS progress, min(ts) AS started, max(ts) AS ended, array_to_string(list(id ORDER BY ts DESC, id DESC)[1:5], ',') AS latest FROM sessions GROUP BY 1"))
add("a09_dashboard_stats", lambda k: k.sessions.agg(F.count_if(C("status") == "in_progress").alias("active"), F.countDistinct("session").alias("sessions"), F.count_if(C("ts") >= F.lit("2024-01-13").cast("timestamp")).alias("last_week")), sql("sessions", "SELECT count(*) FILTER (WHERE status = 'in_progress') AS active, count(DISTINCT session) AS sessions, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-13') AS last_week FROM sessions"))
add("a10_selected_sessions", lambda k: k.sessions.groupBy("session").agg(F.sum("found").alias("found"), F.round(F.try_divide(100.0 * F.count_if(C("status") == "completed"), F.count_if(C("status").isin("completed", "failed"))), 6).alias("success")), sql("sessions", "SELECT session, CAST(sum(found) AS BIGINT) AS found, round(100.0 * count(*) FILTER (WHERE status = 'completed') / nullif(count(*) FILTER (WHERE status IN ('completed', 'failed')), 0), 6)::DOUBLE AS success FROM sessions GROUP BY 1"))
add("a11_sessions_by_status", lambda k: k.sessions.groupBy(F.initcap(F.replace("status", F.lit("_"), F.lit(" "))).alias("label")).agg(F.count("*").alias("n")), sql("sessions", "SELECT CASE status WHEN 'in_progress' THEN 'In Progress' ELSE upper(status[1]) || status[2:] END AS label, count(*) AS n FROM sessions GROUP BY 1"))
add("a15_quality_metrics", lambda k: O.quality_metrics(with_credit_facts(k.tracks, k.credits), F.lit("1995-06-30").cast("date")), sql("tracks credits", ", c AS (SELECT track_id, count(*) AS n, bool_or(credit_type = 'producer') AS p FROM credits GROUP BY 1), t AS (SELECT tracks.*, coalesce(n, 0) AS n, coalesce(p, false) AS p, coalesce(DATE '1995-06-30' - release_date < 30, false) AS fresh FROM tracks LEFT JOIN c ON track_id = id) SELECT count(*) AS tracks, count(*) FILTER (WHERE p) AS with_producer, count(*) FILTER (WHERE duration_seconds > 0) AS with_duration, count(*) FILTER (WHERE n > 0) AS with_credits, count(*) FILTER (WHERE album_id IS NOT NULL) AS with_album, count(*) FILTER (WHERE bpm > 0) AS with_bpm, count(*) FILTER (WHERE has_lyrics) AS with_lyrics, count(*) FILTER (WHERE duration_seconds BETWEEN 30 AND 600) AS valid_duration, round(avg(n), 6) AS mean_credits, round(100 * avg(fresh::INT), 6) AS freshness, round(100 * (avg(p::INT) + avg(coalesce(duration_seconds > 0, false)::INT) + avg((n > 0)::INT) + avg((album_id IS NOT NULL)::INT) + avg(fresh::INT)) / 5, 6) AS overall FROM t"))
add("a17_grouping_report", lambda k: k.credits.groupingSets([[C("credit_type")], [C("person_name")], []], "credit_type", "person_name").agg(F.count("*").alias("n")), sql("credits", "SELECT credit_type, person_name, count(*) AS n FROM credits GROUP BY GROUPING SETS ((credit_type), (person_name), ())"))
add("a18_enrichment_summary", lambda k: k.api_log.groupingSets([[C("api")], [C("ok")], []], "api", "ok").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("confidence")), sql("api_log", "SELECT api, ok, count(*) AS n, round(avg(value), 4) AS confidence FROM api_log GROUP BY GROUPING SETS ((api), (ok), ())"))
def gappy(k):
    """Tracks with gaps in every field and the eight fields of the report."""
    produced = k.credits.filter("credit_type = 'producer'").select(C("track_id").alias("id"), F.lit(True).alias("producer")).distinct()
    gap = lambda c, n: F.when(C("id") % n > 0, C(c))
    t = k.tracks.join(produced, "id", "left")
    return t.select("id", "artist_id", gap("album_id", 7).alias("album"), gap("release_date", 4).alias("release_date"), C("duration_seconds").alias("duration"), "bpm", F.when(C("id") % 10 < 4, C("track_number")).alias("key"), gap("genre", 3).alias("genres"), "producer", C("has_lyrics").alias("lyrics"))


priorities = lambda k: O.enrichment_priorities(gappy(k), "artist_id")
plan = lambda k: O.enrichment_plan(priorities(k), "artist_id")
# the fields as the report lists them: field, missing if, weight, effort, seconds, sources, calls
GAPS = (
    ("album", "id % 7 = 0", 15, "Low", 0.5, "Database;Spotify;Discogs", "missing + missing // 10"), ("release_date", "id % 4 = 0", 10, "Low", 0.5, "Database;Spotify;Discogs", "missing + missing // 10"),
    ("duration", "duration_seconds IS NULL", 10, "Low", 1, "Spotify;YouTube", "missing"), ("bpm", "bpm IS NULL", 10, "Medium", 2, "Spotify;Essentia;Inference", "missing"),
    ("key", "id % 10 >= 4", 5, "Medium", 2, "Spotify;Essentia", "missing"), ("genres", "id % 3 = 0", 10, "Low", 1, "Database;Spotify;LastFM;Inference", "missing"),
    ("producer", "p.track_id IS NULL", 20, "High", 3, "Genius;Discogs;Database", "missing + missing // 10"), ("lyrics", "NOT has_lyrics", 20, "High", 5, "Genius;Musixmatch", "missing"),
)
PRIORITIES = ", p AS (SELECT DISTINCT track_id FROM credits WHERE credit_type = 'producer'), c AS (SELECT artist_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {w}) AS {f}" for f, w, *_ in GAPS) + " FROM tracks LEFT JOIN p ON track_id = id GROUP BY 1), k AS (SELECT *, round(100 * (" + " + ".join(f"({f} < 0.5 * total)::INT" for f, *_ in GAPS) + ") / 8, 1) AS completeness FROM c), l AS (" + " UNION ALL ".join(f"SELECT artist_id, total, completeness, '{f}' AS field, {f} AS missing, {i} AS place, {w} AS weight, '{e}' AS effort, {s} AS item, '{src}' AS sources, {calls.replace('missing', f)} AS calls FROM k WHERE {f} > 0" for i, (f, _, w, e, s, src, calls) in enumerate(GAPS)) + "), v AS (SELECT *, round(100 * missing / total, 1) AS pct, CASE WHEN field IN ('producer', 'album', 'duration') AND 100 * missing / total > 20 THEN 'High' WHEN 100 * missing / total > 50 THEN 'High' WHEN 100 * missing / total > 30 THEN 'Medium' WHEN 100 * missing / total > 10 THEN 'Low' ELSE 'Optional' END AS priority FROM l), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY artist_id ORDER BY CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END, pct DESC, place) AS INT) AS rank FROM v)"
TASKS = ", g AS (SELECT *, missing / total * weight AS gain, item * missing / 3600 AS hours FROM q), b AS (SELECT *, coalesce(sum(gain) OVER (PARTITION BY artist_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), w AS (SELECT * FROM b WHERE completeness + round(before, 9) < 80)"
add("a19_enrichment_priorities", lambda k: priorities(k).select("artist_id", "completeness", "rank", "field", "missing", "pct", "priority", "effort", F.array_join("sources", ";").alias("sources")), sql("tracks credits", PRIORITIES + " SELECT artist_id, completeness::DOUBLE AS completeness, rank, field, missing, pct::DOUBLE AS pct, priority, effort, sources FROM q"))
add("a20_enrichment_plan", lambda k: plan(k).select("artist_id", "rank", "field", "missing", F.round("gain", 4).alias("gain"), F.round("hours", 6).alias("hours"), "calls"), sql("tracks credits", PRIORITIES + TASKS + " SELECT artist_id, rank, field, missing, round(gain, 4)::DOUBLE AS gain, round(hours, 6)::DOUBLE AS hours, calls FROM w"))
add("a20b_plan_totals", lambda k: O.plan_totals(plan(k), "artist_id"), sql("tracks credits", PRIORITIES + TASKS + " SELECT artist_id, max(completeness)::DOUBLE AS completeness, round(least(100, max(completeness) + sum(gain)), 4)::DOUBLE AS expected, count(*) AS tasks, count(*) FILTER (WHERE priority = 'High') AS urgent, round(sum(hours), 6)::DOUBLE AS hours, CAST(sum(calls) AS BIGINT) AS calls FROM w GROUP BY 1"))
add("a23_processor_quality", lambda k: k.api_log.groupBy("api").agg(F.round((F.avg(C("ok").cast("double")) * 100 + F.avg(F.least("value", F.lit(100.0)))) / 2, 6).alias("quality"), F.count("*").alias("n")), sql("api_log", "SELECT api, round((avg(ok::INT) * 100 + avg(least(value, 100.0))) / 2, 6) AS quality, count(*) AS n FROM api_log GROUP BY 1"))
add("a24_enricher_quality", lambda k: k.api_log.groupBy("api").agg(F.round((F.avg(C("ok").cast("double")) + F.avg((C("value") > 10).cast("double")) + F.avg(F.least(C("value") / 100, F.lit(1.0)))) / 3, 6).alias("quality")), sql("api_log", "SELECT api, round((avg(ok::INT) + avg((value > 10)::INT) + avg(least(value / 100, 1.0))) / 3, 6) AS quality FROM api_log GROUP BY 1"))
add("a25_credit_compilation", lambda k: k.credits.join(k.tracks.select(C("id").alias("track_id"), "artist_id"), "track_id").groupBy("artist_id").agg(F.count("*").alias("credits"), F.array_sort(F.collect_set("person_name")).alias("set")).select("artist_id", "credits", F.array_join("set", ",").alias("people"), F.size("set").cast("long").alias("n_people")), sql("tracks credits", "SELECT artist_id, count(*) AS credits, array_to_string(list_sort(list(DISTINCT person_name)), ',') AS people, count(DISTINCT person_name) AS n_people FROM credits JOIN tracks ON track_id = id GROUP BY 1"))
add("a26_frequent_collaborators", lambda k: k.credits.join(k.tracks.select(C("id").alias("track_id"), "artist_id"), "track_id").groupBy("artist_id", "person_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("credit_type")), ",").alias("types")).filter("n >= 3"), sql("tracks credits", "SELECT artist_id, person_name, count(*) AS n, array_to_string(list_sort(list(DISTINCT credit_type)), ',') AS types FROM credits JOIN tracks ON track_id = id GROUP BY 1, 2 HAVING count(*) >= 3"))
add("a27_timer_stats", lambda k: k.api_log.groupBy("api").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(~C("ok")).alias("errors")), sql("api_log", "SELECT api, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(*) FILTER (WHERE NOT ok) AS errors FROM api_log GROUP BY 1"))
RATE = "CASE WHEN ops >= 10 THEN 40 WHEN ops >= 5 THEN 30 WHEN ops >= 1 THEN 20 ELSE 10 END + CAST(trunc(hit * 40 + (1 - err) * 20) AS INT)"


def rating(k):
    x = k.api_log.groupBy("api").agg((F.count("*") / 3600.0).alias("ops"), F.avg((C("value") > 20).cast("double")).alias("hit"), F.avg((~C("ok")).cast("double")).alias("err"))
    p = F.when(C("ops") >= 10, 40).when(C("ops") >= 5, 30).when(C("ops") >= 1, 20).otherwise(10) + (C("hit") * 40 + (1 - C("err")) * 20).cast("int")
    return x.select("api", p.alias("points")).withColumn("label", F.when(C("points") >= 90, "excellent").when(C("points") >= 75, "good").when(C("points") >= 50, "fair").otherwise("poor"))


add("a28_performance_rating", rating, sql("api_log", f", x AS (SELECT api, count(*) / 3600.0 AS ops, avg((value > 20)::INT) AS hit, avg((NOT ok)::INT) AS err FROM api_log GROUP BY 1), p AS (SELECT api, {RATE} AS points FROM x) SELECT api, points, CASE WHEN points >= 90 THEN 'excellent' WHEN points >= 75 THEN 'good' WHEN points >= 50 THEN 'fair' ELSE 'poor' END AS label FROM p"))
add("a29_cache_stats", lambda k: k.cache.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"), F.count_if(C("expires_at") <= F.lit("2024-01-20").cast("timestamp")).alias("expired"), F.sum(F.length("data")).alias("bytes")), sql("cache", "SELECT split_part(key, ':', 1) AS prefix, count(*) AS n, count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-01-20') AS expired, CAST(sum(length(data)) AS BIGINT) AS bytes FROM cache GROUP BY 1"))
HEALTH = "100 - CASE WHEN expired / n > 0.5 THEN 30 WHEN expired / n > 0.3 THEN 15 ELSE 0 END - CASE WHEN n > 1500 THEN 20 ELSE 0 END"
LABEL = "CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'bad' END"


def health(k):
    x = Q_cache(k)
    s = 100 - F.when(C("expired") / C("n") > 0.5, 30).when(C("expired") / C("n") > 0.3, 15).otherwise(0) - F.when(C("n") > 1500, 20).otherwise(0)
    return x.select("prefix", s.alias("score")).withColumn("label", F.when(C("score") >= 90, "excellent").when(C("score") >= 75, "good").when(C("score") >= 60, "fair").when(C("score") >= 40, "poor").otherwise("bad"))


def Q_cache(k):
    return k.cache.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"), F.count_if(C("expires_at") <= F.lit("2024-01-20").cast("timestamp")).alias("expired"))


add("a30_cache_health", health, sql("cache", f", x AS (SELECT split_part(key, ':', 1) AS prefix, count(*) AS n, count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-01-20') AS expired FROM cache GROUP BY 1), s AS (SELECT prefix, {HEALTH} AS score FROM x) SELECT prefix, score, {LABEL} AS label FROM s"))
add("a31_processing_quality", lambda k: k.albums.groupBy("status").agg(F.round(F.avg(F.when(C("price") >= 200000, 100.0).when(C("price") >= 100000, 70.0).otherwise(40.0)), 6).alias("quality"), F.round(100 * (F.count_if(C("id") % 3 > 0) + F.count_if(C("id") % 5 == 0) + F.count_if(C("id") % 7 == 0)) / F.count("*"), 6).alias("success_rate")), sql("albums", "SELECT status, round(avg(CASE WHEN price >= 200000 THEN 100.0 WHEN price >= 100000 THEN 70.0 ELSE 40.0 END), 6)::DOUBLE AS quality, round(100 * (count(*) FILTER (WHERE id % 3 > 0) + count(*) FILTER (WHERE id % 5 = 0) + count(*) FILTER (WHERE id % 7 = 0)) / count(*), 6) AS success_rate FROM albums GROUP BY 1"))
def recommendations(k):
    """Per artist: advice where the quality score is under 70, over 10 % of the tracks failed, over 50 % have no lyrics or over 30 % no tempo; and the score."""
    present = C("has_lyrics").cast("int") + C("bpm").isNotNull().cast("int")
    share = lambda c: F.avg(c.cast("double"))
    x = k.tracks.groupBy("artist_id").agg(
        F.round(F.avg(F.when(present == 2, 100.0).when(present == 1, 70.0).otherwise(40.0)), 6).alias("score"),
        share(C("status") == "failed").alias("failed"), share(~C("has_lyrics")).alias("mute"), share(C("bpm").isNull()).alias("slack"),
    )
    advice = ((C("score") < 70, "extract_again"), (C("failed") > 0.1, "check_sources"), (C("mute") > 0.5, "add_lyrics"), (C("slack") > 0.3, "add_bpm"))
    return x.select("artist_id", "score", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(a)) for c, a in advice))), ",").alias("advice"))


add("a32_recommendations", recommendations, sql("tracks", ", x AS (SELECT artist_id, round(avg(CASE has_lyrics::INT + (bpm IS NOT NULL)::INT WHEN 2 THEN 100 WHEN 1 THEN 70 ELSE 40 END), 6)::DOUBLE AS score, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE NOT has_lyrics) AS mute, count(*) FILTER (WHERE bpm IS NULL) AS slack FROM tracks GROUP BY 1) SELECT artist_id, score, concat_ws(',', CASE WHEN score < 70 THEN 'extract_again' END, CASE WHEN failed > 0.1 * n THEN 'check_sources' END, CASE WHEN mute > 0.5 * n THEN 'add_lyrics' END, CASE WHEN slack > 0.3 * n THEN 'add_bpm' END) AS advice FROM x"))
add("a33_artist_completion", lambda k: k.tracks.groupBy("artist_id").agg((100 * F.avg((C("status") == "completed").cast("double"))).alias("p")).select("artist_id", F.when(C("p") >= 90, "completed").when(C("p") >= 50, "in_progress").otherwise("failed").alias("state")), sql("tracks", "SELECT artist_id, CASE WHEN p >= 90 THEN 'completed' WHEN p >= 50 THEN 'in_progress' ELSE 'failed' END AS state FROM (SELECT artist_id, 100 * avg((status = 'completed')::INT) AS p FROM tracks GROUP BY 1)"))
add("a34_progress_rollup", lambda k: k.sessions.groupBy("session", "status").agg(F.max("found").alias("best"), F.max_by("found", F.struct("ts", "id")).alias("latest")).withColumn("pct", F.round(F.try_divide(100.0 * C("latest"), C("best")), 6)).groupBy("session").agg(F.round(F.avg("pct"), 4).alias("overall")), sql("sessions", ", s AS (SELECT session, status, max(found) AS best, arg_max(found, (ts, id)) AS latest FROM sessions GROUP BY 1, 2) SELECT session, round(avg(round(100.0 * latest / nullif(best, 0), 6)), 4)::DOUBLE AS overall FROM s GROUP BY 1"))
def discovery_quality(k):
    """Mean weight of the fields that a found track has, in percent: lyrics, artist, date, album, guests, producer."""
    produced = k.credits.filter("credit_type = 'producer'").select(C("track_id").alias("id"), F.lit(True).alias("produced")).distinct()
    # The weights of the fields.
    weights = ((C("has_lyrics"), 0.3), (C("artist_id").isNotNull(), 0.2), (C("release_date").isNotNull(), 0.15), (C("album_id").isNotNull(), 0.15), (T.featured_text(C("title")) != "", 0.1), (C("produced"), 0.1))
    score = sum((F.when(c, w).otherwise(0.0) for c, w in weights), F.lit(0.0))
    return k.tracks.join(produced, "id", "left").groupBy("genre").agg(F.round(100 * F.avg(score), 4).alias("quality"))


add("a35_discovery_quality", discovery_quality, sql("tracks credits", f", p AS (SELECT DISTINCT track_id FROM credits WHERE credit_type = 'producer') SELECT genre, round(avg(30 * has_lyrics::INT + 20 * (artist_id IS NOT NULL)::INT + 15 * (release_date IS NOT NULL)::INT + 15 * (album_id IS NOT NULL)::INT + 10 * ({feat_sql} <> '')::INT + 10 * (track_id IS NOT NULL)::INT), 4)::DOUBLE AS quality FROM tracks LEFT JOIN p ON track_id = id GROUP BY 1"))
add("a36_catalog_rollup", lambda k: k.tracks.rollup("genre", "has_lyrics").agg(F.count("*").alias("tracks"), F.sum("duration_seconds").alias("seconds"), F.grouping_id().alias("level")), sql("tracks", "SELECT genre, has_lyrics, count(*) AS tracks, CAST(sum(duration_seconds) AS BIGINT) AS seconds, CAST(grouping(genre, has_lyrics) AS BIGINT) AS level FROM tracks GROUP BY ROLLUP (genre, has_lyrics)"))
add("a37_request_stats", lambda k: k.api_log.groupBy("api").agg(F.count("*").alias("total"), F.count_if("ok").alias("successful"), F.round(100 * F.avg(C("ok").cast("double")), 6).alias("success_pct")).join(R.last_k(k.api_log.filter("not ok"), ["api"], [F.desc("ts"), F.desc("event_id")], "event_id", 5, "last_errors"), "api", "left").withColumn("last_errors", F.array_join(C("last_errors"), ",")), sql("api_log", "SELECT api, count(*) AS total, count(*) FILTER (WHERE ok) AS successful, round(100 * avg(ok::INT), 6) AS success_pct, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC) FILTER (WHERE NOT ok)[1:5], ',') AS last_errors FROM api_log GROUP BY 1"))
del bucket


def period_stats(k):
    """Statistics of each kind of event merged from daily partials; whether the sketches' answers lie within three of their standard errors of the exact ones."""
    events = k.events.select("event_type", "ts", "user_id", "value")
    merged = P.merged_partials(P.daily_partials(events, "ts", ["event_type"], "value", "user_id", C("value") > 90), ["event_type"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), *(F.percentile("value", q).alias(f"q{round(100 * q)}") for q in (0.47, 0.53, 0.92, 0.98)))
    near = F.abs(C("distinct") - C("users")) <= F.greatest(F.lit(1.0), 3 * P.DISTINCT_ERROR * C("users"))
    return merged.join(exact, "event_type").select("event_type", "n", "failures", "mean", "least", "most", near.alias("distinct_near"), C("p50").between(C("q47"), C("q53")).alias("median_near"), C("p95").between(C("q92"), C("q98")).alias("p95_near"))


add("a27b_period_stats", period_stats, "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 90) AS failures, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, true AS distinct_near, true AS median_near, true AS p95_near FROM events GROUP BY 1")
