"""Registered queries: the batch twins of streaming/events.py, and exports, with their SQL."""

from pyspark.sql import functions as F

from mediagrain.operators.lookup import attach_credits
from mediagrain.plans.reports import artist_stats
from mediagrain.sources import exports as X
from mediagrain.sources.catalog import load, sql
from mediagrain.streaming import chained as H
from mediagrain.streaming import events as S
from mediagrain.streaming import logs as G

C = F.col
Q, SQL = {}, {}


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


add("st01_rate_windows", lambda k: S.rate_windows(k.api_log, "1 hour", None, 2), sql("api_log", "SELECT api, date_trunc('hour', ts) AS started, count(*) AS n, count(*) > 2 AS exceeded FROM api_log GROUP BY 1, 2"))
add("st01b_sliding_rates", lambda k: S.rate_windows(k.api_log, "1 hour", "30 minutes", 2), sql("api_log", ", b AS (SELECT api, time_bucket(INTERVAL 30 MINUTES, ts) AS s FROM api_log), w AS (SELECT api, s FROM b UNION ALL SELECT api, s - INTERVAL 30 MINUTES FROM b) SELECT api, s AS started, count(*) AS n, count(*) > 2 AS exceeded FROM w GROUP BY 1, 2"))
add("st02_adaptive_limits", lambda k: S.adaptive_limits(k.api_log), sql("api_log", "SELECT api, CAST(ts AS DATE) AS day, greatest(1, CAST(trunc(60 * list_reduce([1.0::DOUBLE] || list(CASE WHEN ok THEN 2.0 ELSE 3.0 END::DOUBLE ORDER BY ts, event_id), lambda m, x: CASE WHEN x = 2 THEN least(1.0, m * 1.02) ELSE greatest(0.1, m * 0.8) END)) AS INT)) AS lim FROM api_log GROUP BY 1, 2"))
add("st03_activity_sessions", lambda k: S.activity_sessions(k.sessions, "session", "2 hours"), sql("sessions", ", g AS (SELECT session, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY session ORDER BY ts) + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS fresh FROM sessions), i AS (SELECT session, ts, sum(fresh) OVER (PARTITION BY session ORDER BY ts) AS g FROM g) SELECT session, min(ts) AS started, max(ts) + INTERVAL 2 HOURS AS ended, count(*) AS n FROM i GROUP BY session, g"))
add("st04_latest_states", lambda k: S.latest_states(k.sessions, "session"), sql("sessions", "SELECT session, arg_max(status, (ts, id)) AS status, min(ts) AS started, max(ts) AS ended, count(*) FILTER (WHERE status = 'failed') AS failures FROM sessions GROUP BY 1"))
add("st05_cache_view", lambda k: S.cache_view(k.cache), sql("cache", "SELECT key, arg_max(data, (created_at, event_id)) AS data, max(created_at) AS written, max(expires_at) AS expires_at, count(*) AS writes FROM cache GROUP BY 1"))
add("st06_progress", lambda k: S.progress(k.sessions), sql("sessions", "SELECT session, status, arg_max(found, (ts, id)) AS latest, max(found) AS best FROM sessions GROUP BY 1, 2"))
add("st07_first_arrivals", lambda k: S.first_arrivals(k.sessions, ["session", "status"]).select("session", "status"), sql("sessions", "SELECT DISTINCT session, status FROM sessions"))
add("st08_hourly_snapshots", lambda k: S.rate_windows(k.api_log, "6 hours").select("api", "started", "n"), sql("api_log", "SELECT api, time_bucket(INTERVAL 6 HOURS, ts) AS started, count(*) AS n FROM api_log GROUP BY 1, 2"))
add("st09_daily_means", lambda k: S.daily_means(k.sessions, "found"), sql("sessions", "SELECT CAST(ts AS DATE) AS day, round(avg(found), 6) AS mean, count(*) AS n FROM sessions GROUP BY 1"))
add("st10_alerts", lambda k: S.alerts(k.sessions, 2), sql("sessions", "SELECT session, date_trunc('hour', ts) AS started, count(*) AS failures FROM sessions WHERE status = 'failed' GROUP BY 1, 2 HAVING count(*) >= 2"))
add("st11_log_summary", lambda k: S.log_summary(k.api_log), sql("api_log", "SELECT api, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE value > 50) AS slow FROM api_log GROUP BY 1, 2"))

add("io03_mapping_table", lambda k: k.credits.join(F.broadcast(X.mapping_table(k.spark, {"Production": ["producer"], "Writing": ["songwriter"], "Studio": ["mixing", "mastering"]})), C("credit_type") == C("alias"), "left").groupBy(F.coalesce("canonical", F.lit("other")).alias("canonical")).agg(F.count("*").alias("n")), sql("credits", "SELECT CASE credit_type WHEN 'producer' THEN 'Production' WHEN 'songwriter' THEN 'Writing' WHEN 'mixing' THEN 'Studio' ELSE 'other' END AS canonical, count(*) AS n FROM credits GROUP BY 1"))
add("io05_flat_credits", lambda k: attach_credits(k.tracks.select("id"), k.credits).select("id", X.flat_credits(C("credits")).alias("credits")), sql("tracks credits", "SELECT id, coalesce(string_agg(person_name || ' (' || credit_type || ')', '; ' ORDER BY credit_type, person_name), '') AS credits FROM tracks LEFT JOIN credits ON track_id = id GROUP BY id"))
add("io08_render_report", lambda k: X.render_report(artist_stats(k)), sql("artists tracks credits", ", c AS (SELECT track_id, count(*) AS c FROM credits GROUP BY 1), t AS (SELECT artist_id, count(*) AS tracks, count(*) FILTER (WHERE has_lyrics) AS l, CAST(sum(c) AS BIGINT) AS credits FROM tracks LEFT JOIN c ON track_id = id GROUP BY 1) SELECT id, '# ' || name || chr(10) || chr(10) || '- tracks: ' || coalesce(tracks, 0) || chr(10) || '- with lyrics: ' || coalesce(l, 0) || chr(10) || '- credits: ' || coalesce(credits, 0) AS report FROM artists LEFT JOIN t ON artist_id = id"))
add("io11_export_filter", lambda k: X.export_filter(k.tracks.withColumn("quality", C("bpm") / 2), min_quality=60).select("id", "quality"), sql("tracks", "SELECT id, bpm / 2 AS quality FROM tracks WHERE status <> 'failed' AND coalesce(bpm / 2, 0) >= 60"))
add("io12_project_export", lambda k: X.project_export(attach_credits(k.tracks, k.credits).withColumn("_raw", F.lit(1)).withColumn("has_complete_credits", F.size("credits") > 2).drop("credits"), ["genre", "release_date"]).select("id", "title", "has_complete_credits"), sql("tracks credits", "SELECT id, title, count(track_id) > 2 AS has_complete_credits FROM tracks LEFT JOIN credits ON track_id = id GROUP BY id, title"))

requests = lambda k: k.cache.select("key", C("created_at").alias("ts"), "event_id", F.when(C("event_id") % 4 == 0, "write").otherwise("read").alias("kind"))
add("st04b_session_machine", lambda k: S.session_machine(k.sessions), sql("sessions", ", b AS (SELECT *, lag(status) OVER (PARTITION BY session ORDER BY ts, id) AS before FROM sessions) SELECT session, arg_max(status, (ts, id)) AS status, count(*) FILTER (WHERE before = 'failed' AND status IN ('in_progress', 'created')) AS restarts, count(*) FILTER (WHERE status = 'paused' AND before IS DISTINCT FROM 'paused') AS pauses, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, arg_max(status, (ts, id)) IN ('completed', 'failed') AS over FROM b GROUP BY 1"))
add("st05b_cache_hits", lambda k: S.cache_hits(requests(k)), sql("cache", ", r AS (SELECT key, created_at AS ts, event_id, event_id % 4 = 0 AS w FROM cache), l AS (SELECT *, max(CASE WHEN w THEN ts END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r), h AS (SELECT CAST(ts AS DATE) AS day, coalesce(last > ts - INTERVAL 7 DAY, false) AS hit FROM l WHERE NOT w) SELECT day, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(avg(hit::INT), 6) AS hit_rate FROM h GROUP BY 1"))
steps = lambda k: k.sessions.groupBy("session", C("status").alias("step")).agg(F.count_if(C("found") > 20).alias("done"), F.count("*").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
add("st06b_overall_progress", lambda k: S.overall_progress(steps(k)), sql("sessions", ", s AS (SELECT session, count(*) FILTER (WHERE found > 20) AS done, count(*) AS total, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS elapsed FROM sessions GROUP BY 1) SELECT session, done, total, round(100.0 * done / total, 4)::DOUBLE AS pct, round(elapsed * (total - done) / nullif(done, 0), 4) AS eta_seconds FROM s"))
add("st08b_snapshots", lambda k: S.snapshots(S.rate_windows(k.api_log, "6 hours"), "api"), sql("api_log", ", w AS (SELECT api, time_bucket(INTERVAL 6 HOURS, ts) AS started, count(*) AS n FROM api_log GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY api ORDER BY started DESC) AS rn FROM w), m AS (SELECT api, count(*) FILTER (WHERE rn <= 100) AS kept, avg(n) FILTER (WHERE rn <= 100) AS mean, avg(n) FILTER (WHERE rn <= 10) AS a, avg(n) FILTER (WHERE rn > 10 AND rn <= 20) AS b FROM r GROUP BY 1) SELECT api, kept, round(mean, 6) AS mean, round(a, 6) AS recent, round(b, 6) AS previous, CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS trend FROM m"))
add("st09b_daily_trend", lambda k: S.daily_trend(k.sessions, "found"), sql("sessions", ", d AS (SELECT CAST(ts AS DATE) AS day, round(avg(found), 6) AS mean, count(*) AS n FROM sessions GROUP BY 1), l AS (SELECT *, lag(mean) OVER (ORDER BY day) AS b FROM d) SELECT day, mean, n, CASE WHEN b IS NULL OR mean = b THEN 'stable' WHEN mean > b THEN 'improving' ELSE 'declining' END AS trend FROM l"))
add("st10b_size_alerts", lambda k: S.size_alerts(k.cache.withColumn("ts", C("created_at")), 200), sql("cache", "SELECT CAST(created_at AS DATE) AS day, CAST(sum(strlen(data)) AS BIGINT) AS bytes, count(*) AS writes FROM cache GROUP BY 1 HAVING sum(strlen(data)) > 200"))
add("st06c_progress_windows", lambda k: H.overall_progress_windows(k.sessions, 20), sql("sessions", ", s AS (SELECT CAST(ts AS DATE)::TIMESTAMP AS started, session, status, count(*) FILTER (WHERE found > 20) AS done, count(*) AS total, min(ts) AS f, max(ts) AS l FROM sessions GROUP BY 1, 2, 3), o AS (SELECT session, started, count(*) AS steps, CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total, floor(epoch(max(l))) - floor(epoch(min(f))) AS elapsed FROM s GROUP BY 1, 2) SELECT session, started, steps, done, total, round(100.0 * done / total, 4)::DOUBLE AS pct, round(elapsed * (total - done) / nullif(done, 0), 4) AS eta_seconds FROM o"))


def lines(k):
    """A log line for every event: JSON of three shapes, some broken off, some no object, some without a time."""
    e, i = k.events, C("event_id")
    head = [F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"), C("user_id").alias("session"), F.when(i % 4 == 0, "warning").when(i % 4 == 1, "INFO").when(i % 4 == 2, "debug").otherwise("ERROR").alias("level")]
    api = F.to_json(F.struct(*head, F.struct((200 + i % 5 * 75).cast("int").alias("code"), F.round(C("value") / 40, 3).alias("seconds")).alias("api")))
    check = F.to_json(F.struct(*head, F.struct((10 + i % 7).alias("total"), (i % 3).alias("errors")).alias("validation")))
    line = F.when(i % 11 == 0, F.substring(api, 1, 20)).when(i % 11 == 1, F.lit("[1, 2]")).when(i % 11 == 2, F.lit('{"level":"INFO"}')).when(i % 2 == 0, api).otherwise(check)
    return e.select(line.alias("value"))


add("st11b_log_report", lambda k: G.log_report(lines(k)), "WITH e AS (SELECT event_id AS i, CAST(ts AS DATE)::TIMESTAMP AS started, user_id AS session, value FROM events WHERE event_id % 11 > 2), x AS (SELECT *, i % 2 = 0 AS api, 200 + i % 5 * 75 AS code, round(value / 40, 3) AS seconds, 10 + i % 7 AS total, i % 3 AS errors FROM e) SELECT session, started, count(*) AS entries, count(*) FILTER (WHERE i % 4 = 2) AS debug, count(*) FILTER (WHERE i % 4 = 1) AS info, count(*) FILTER (WHERE i % 4 = 0) AS warning, count(*) FILTER (WHERE i % 4 = 3) AS error, count(*) FILTER (WHERE api AND code >= 400) AS failed_calls, count(*) FILTER (WHERE api AND seconds > 1) AS slow, round(100 * (sum(total) FILTER (WHERE NOT api) - sum(errors) FILTER (WHERE NOT api)) / sum(total) FILTER (WHERE NOT api), 4) AS valid_pct FROM x GROUP BY 1, 2")
add("st11c_broken_lines", lambda k: G.broken(lines(k)).groupBy("value").agg(F.count("*").alias("n")).filter("value not like '%20%'"), "SELECT CASE event_id % 11 WHEN 1 THEN '[1, 2]' ELSE '{\"level\":\"INFO\"}' END AS value, count(*) AS n FROM events WHERE event_id % 11 IN (1, 2) GROUP BY 1")
