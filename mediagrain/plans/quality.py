"""Registered queries of operators/quality.py, with their SQL."""

from pyspark.sql import functions as F

from mediagrain.functions import text as T
from mediagrain.operators import quality as K
from mediagrain.operators import reports as O
from mediagrain.operators.components import written
from mediagrain.plans.textual import feat_sql
from mediagrain.sources.catalog import load, sql

C = F.col
Q, SQL = {}, {}
AS_OF = "1998-12-31"


def add(name, build, text):
    Q[name] = lambda spark, sf: build(load(spark, sf))
    SQL[name] = text


FACTS = ", t AS (SELECT tracks.*, coalesce(n_credits, 0) AS n_credits, coalesce(has_producer, false) AS has_producer FROM tracks LEFT JOIN (SELECT track_id, count(*) AS n_credits, bool_or(credit_type = 'producer') AS has_producer FROM credits GROUP BY track_id) c ON c.track_id = tracks.id)"


def duck(predicate: str) -> str:
    """Spark's RLIKE as DuckDB's function (fixed small grammar: column RLIKE 'pattern')."""
    import re

    return re.sub(r"(lower\(\w+\)|\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", predicate)


def rule_sql(rules, bonuses=(), source="t", key="id", base=100, extra=""):
    names = ", ".join(f"CASE WHEN {duck(r.when)} THEN '{r.name}' END" for r in rules)
    score = f"{base}.0" + "".join(f" - CASE WHEN {duck(r.when)} THEN {r.points} ELSE 0 END" for r in rules) + "".join(f" + CASE WHEN {duck(w)} THEN {p} ELSE 0 END" for w, p in bonuses)
    bad = " OR ".join(f"coalesce({duck(r.when)}, false)" for r in rules if r.severity == "critical") or "false"
    return f"SELECT {key}, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS issues, CAST(least(100, greatest(0, {score})) AS DOUBLE) AS score, NOT ({bad}) AS is_valid{extra} FROM {source}"


out = lambda df, key="id": df.select(key, F.array_join(F.transform("issues", lambda x: x["name"]), ",").alias("issues"), "score", "is_valid")
tracks = lambda k: K.with_credit_facts(k.tracks, k.credits)
validated = lambda k, level="standard": K.apply_rules(tracks(k), K.track_rules(level), K.TRACK_BONUSES)
V = "tracks credits"
STD = rule_sql(K.track_rules(), K.TRACK_BONUSES)

add("v01_validate_tracks", lambda k: out(validated(k)), sql(V, FACTS + STD))
add("v02_title_rules", lambda k: out(K.apply_rules(k.tracks.withColumn("title", F.when(C("id") % 5 == 0, F.concat(F.lit("test "), "title")).when(C("id") % 5 == 1, F.lit("")).when(C("id") % 5 == 2, "??").otherwise(C("title"))), K.track_rules()[:3])), sql("tracks", ", t AS (SELECT id, CASE id % 5 WHEN 0 THEN 'test ' || title WHEN 1 THEN '' WHEN 2 THEN '??' ELSE title END AS title FROM tracks)" + rule_sql(K.track_rules()[:3])))
add("v03_artist_rules", lambda k: out(K.apply_rules(k.artists.withColumn("name", F.when(C("id") % 4 == 0, C("id").cast("string")).when(C("id") % 4 == 1, F.lit("unknown")).otherwise(C("name"))), K.ARTIST_RULES)), sql("artists", ", t AS (SELECT id, balance, CASE id % 4 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN 'unknown' ELSE name END AS name FROM artists)" + rule_sql(K.ARTIST_RULES)))
add("v04_ranges_paranoid", lambda k: out(validated(k, "paranoid")), sql(V, FACTS + rule_sql(K.track_rules("paranoid"), K.TRACK_BONUSES)))
add("v04b_ranges_strict", lambda k: out(validated(k, "strict")), sql(V, FACTS + rule_sql(K.track_rules("strict"), K.TRACK_BONUSES)))
add("v05_producer_rule", lambda k: tracks(k).filter("not has_producer").select("id", "n_credits"), sql(V, FACTS + "SELECT id, n_credits FROM t WHERE NOT has_producer"))
add("v06_album_rules", lambda k: k.tracks.join(k.albums.select(C("id").alias("album_id"), C("artist_id").alias("owner"), C("release_date").alias("album_date")), "album_id", "left").select("id", (C("owner") == C("artist_id")).alias("same_artist"), C("track_number").between(1, 100).alias("number_ok")), sql("tracks albums", "SELECT tracks.id, albums.artist_id = tracks.artist_id AS same_artist, track_number BETWEEN 1 AND 100 AS number_ok FROM tracks LEFT JOIN albums ON album_id = albums.id"))
identified = lambda k: k.tracks.withColumns({"genius_id": F.when(C("id") % 9 == 0, F.lit("x12")).when(C("id") % 9 > 1, C("id").cast("string")), "spotify_id": F.when(C("id") % 8 == 0, F.lit("short")).when(C("id") % 8 > 1, F.substring(F.sha2(C("id").cast("string"), 256), 1, 22))})
add("v07_technical_rules", lambda k: identified(k).select("id", F.round(C("duration_seconds") / 60.0 * C("bpm"), 4).alias("beats"), F.array_join(K.technical_issues(), ",").alias("issues")).filter("issues <> ''"), sql("tracks", ", i AS (SELECT id, round(duration_seconds / 60.0 * bpm, 4) AS beats, concat_ws(',', CASE WHEN duration_seconds / 60.0 * bpm < 50 OR duration_seconds / 60.0 * bpm > 1000 THEN 'technical_inconsistency' END, CASE WHEN id % 9 = 0 THEN 'invalid_genius_id' END, CASE WHEN id % 8 = 0 THEN 'invalid_spotify_id' END) AS issues FROM tracks) SELECT * FROM i WHERE issues <> ''"))
add("v08_track_score", lambda k: validated(k).groupBy("artist_id").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("low")), sql(V, FACTS + f"SELECT artist_id, round(avg(score), 6) AS mean_score, min(score) AS low FROM ({rule_sql(K.track_rules(), K.TRACK_BONUSES, extra=', artist_id')}) GROUP BY artist_id"))
add("v09_validate_artists", lambda k: out(K.apply_rules(k.artists, K.ARTIST_RULES, K.ARTIST_BONUSES)), sql("artists", rule_sql(K.ARTIST_RULES, K.ARTIST_BONUSES, "artists")))
add("v10_validate_credits", lambda k: out(K.apply_rules(k.credits, K.CREDIT_RULES), "track_id"), sql("credits", rule_sql(K.CREDIT_RULES, (), "credits", "track_id")))
LADDER = "CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'average' WHEN score >= 50 THEN 'poor' ELSE 'very_poor' END"
add("v11_label_ladder", lambda k: validated(k).groupBy(K.ladder(C("score"), K.VALIDATION_STEPS, "very_poor").alias("level")).agg(F.count("*").alias("n")), sql(V, FACTS + f"SELECT {LADDER} AS level, count(*) AS n FROM ({STD}) GROUP BY 1"))
add("v12_pipeline_validation", lambda k: out(K.apply_rules(k.tracks, K.PIPELINE_RULES, critical="error")), sql("tracks", rule_sql([r._replace(severity="critical") for r in K.PIPELINE_RULES], (), "tracks")))
add("v13_integrity", lambda k: out(K.apply_rules(tracks(k), K.INTEGRITY_RULES, critical="error")), sql(V, FACTS + rule_sql([r._replace(severity="critical") for r in K.INTEGRITY_RULES])))
FIELDS = ["title", "artist_id", "album_id", "duration_seconds", "bpm", "genre", "has_lyrics", "release_date", "track_number"]
COMPLETE = "(" + " + ".join(f"CASE WHEN {f} IS NOT NULL AND CAST({f} AS VARCHAR) NOT IN ('', '0', '0.0', 'false') THEN 1 ELSE 0 END" for f in FIELDS) + ") * 100.0 / 9"
add("v14_completeness", lambda k: k.tracks.select("id", F.round(K.completeness(FIELDS), 6).alias("completeness")), sql("tracks", f"SELECT id, round({COMPLETE}, 6)::DOUBLE AS completeness FROM tracks"))
CHECKS = [("duration_seconds", "duration_seconds BETWEEN 30 AND 600"), ("bpm", "bpm BETWEEN 60 AND 200"), ("title", "length(title) <= 200"), ("track_number", "track_number BETWEEN 1 AND 50")]
VALID = "CASE WHEN p = 0 THEN 0 ELSE v * 100.0 / p END"
add("v15_validity", lambda k: k.tracks.select("id", F.round(K.validity(CHECKS), 6).alias("validity")), sql("tracks", f", c AS (SELECT id, {' + '.join(f'CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END' for c, _ in CHECKS)} AS p, {' + '.join(f'CASE WHEN {p} THEN 1 ELSE 0 END' for _, p in CHECKS)} AS v FROM tracks) SELECT id, round({VALID}, 6)::DOUBLE AS validity FROM c"))
add("v16_freshness", lambda k: k.albums.select("id", K.freshness(C("release_date"), F.lit("1995-06-30").cast("date")).alias("freshness")), sql("albums", "SELECT id, CASE WHEN DATE '1995-06-30' - release_date <= 30 THEN 100.0 WHEN DATE '1995-06-30' - release_date <= 60 THEN 50.0 ELSE 25.0 END::DOUBLE AS freshness FROM albums"))
WORD_SETS = ", ws AS (SELECT id, artist_id, list_sort(list_distinct(regexp_split_to_array(trim(lower(title)), '\\s+'))) AS w FROM tracks), sets AS (SELECT artist_id, w, count(*) AS n FROM ws GROUP BY 1, 2), near AS (SELECT DISTINCT x.artist_id, x.w FROM sets x JOIN sets y ON x.artist_id = y.artist_id AND x.w <> y.w AND len(list_intersect(x.w, y.w)) > 0.9 * len(list_distinct(x.w || y.w))), uq AS (SELECT ws.id, CASE WHEN n > 1 OR near.w IS NOT NULL THEN 0.0 ELSE 100.0 END::DOUBLE AS uniqueness FROM ws JOIN sets ON sets.artist_id = ws.artist_id AND sets.w = ws.w LEFT JOIN near ON near.artist_id = ws.artist_id AND near.w = ws.w)"
FEATURED = T.featured_text
add("v16b_consistency", lambda k: tracks(k).select("id", K.consistency(FEATURED(C("title")) != "", C("n_credits")).alias("consistency")), sql(V, FACTS + f" SELECT id, CASE WHEN {feat_sql} <> '' OR n_credits > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS consistency FROM t"))
add("v17_uniqueness", lambda k: K.uniqueness(k.tracks), sql("tracks", WORD_SETS + " SELECT * FROM uq"))


def measured(k):
    """Validated tracks with the five metrics and the overall score; the tracks are made once and written."""
    df = validated(k).withColumns({"completeness": K.completeness(FIELDS), "validity": K.validity(CHECKS), "consistency": K.consistency(FEATURED(C("title")) != "", C("n_credits")), "freshness": K.freshness(C("release_date"), F.lit(AS_OF).cast("date"))})
    kept = ("id", "artist_id", "title", "n_credits", "issues", "score", "is_valid", "completeness", "validity", "consistency", "freshness")
    return K.with_uniqueness(written(df.select(*kept), "measured")).drop("title").withColumn("overall", F.round(K.weighted(K.METRICS), 4))


MEASURED = FACTS + WORD_SETS + f", pv AS (SELECT id, {' + '.join(f'CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END' for c, _ in CHECKS)} AS p, {' + '.join(f'CASE WHEN {x} THEN 1 ELSE 0 END' for _, x in CHECKS)} AS v FROM t), me AS (SELECT t.*, {COMPLETE} AS completeness, {VALID} AS validity, CASE WHEN {feat_sql} <> '' OR n_credits > 0 THEN 100 ELSE 0 END AS consistency, CASE WHEN release_date IS NULL THEN 0 WHEN DATE '{AS_OF}' - release_date <= 30 THEN 100 WHEN DATE '{AS_OF}' - release_date <= 60 THEN 50 ELSE 25 END AS freshness, uniqueness FROM t JOIN pv USING (id) JOIN uq USING (id)), o AS (SELECT *, round(({' + '.join(f'{m} * {w}' for m, w in K.METRICS)})::DOUBLE, 4) AS overall FROM me)"
QLADDER = "CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'average' WHEN overall >= 40 THEN 'poor' ELSE 'very_poor' END"
CRITICAL = "(" + " + ".join(f"CASE WHEN {duck(r.when)} THEN 1 ELSE 0 END" for r in K.track_rules() if r.severity == "critical") + ")"
add("v18_overall_quality", lambda k: measured(k).select("id", "overall", K.ladder(C("overall"), K.QUALITY_STEPS, "very_poor").alias("level"), F.array_join(K.recommendations(C("issues")), ",").alias("recommendations")), sql(V, MEASURED + f" SELECT id, overall, {QLADDER} AS level, concat_ws(',', CASE WHEN {CRITICAL} > 0 THEN 'fix_critical:' || {CRITICAL} END, CASE WHEN completeness < 70 THEN 'enrich' END, CASE WHEN freshness < 50 THEN 'refresh' END, CASE WHEN NOT has_producer THEN 'add_producer' END, CASE WHEN n_credits = 0 THEN 'extract_credits' END) AS recommendations FROM o"))
STEPS = " UNION ALL ".join(f"SELECT id, {1 if r.severity == 'critical' else 2} AS priority, {i} AS i, '{r.name}' AS step, {10.0 if r.severity == 'critical' else 5.0}::DOUBLE AS gain FROM o WHERE {duck(r.when)}" for i, r in enumerate(K.track_rules()) if r.severity != "info")
WEAK = " UNION ALL ".join(f"SELECT id, 3 AS priority, {100 + i} AS i, '{m}' AS step, round((100 - {m}) / 2, 4)::DOUBLE AS gain FROM o WHERE {m} < 50" for i, (m, _) in enumerate(K.METRICS))
add("v19_improvement_plan", lambda k: K.improvement_plan(measured(k)), sql(V, MEASURED + f", s AS ({STEPS} UNION ALL {WEAK}), r AS (SELECT *, row_number() OVER (PARTITION BY id, priority ORDER BY i) AS own FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, i)::INT AS rank FROM r WHERE priority <> 2 OR own <= 5) SELECT id, rank, priority, step, gain FROM q WHERE rank <= 10"))
add("v19b_suggestions", lambda k: K.suggestions(measured(k)), sql(V, MEASURED + " " + " UNION ALL ".join(f"SELECT id, '{m}' AS category, '{p}' AS priority FROM o WHERE {m} < 60" for m, p in (("completeness", "high"), ("validity", "high"), ("consistency", "medium"), ("freshness", "medium")))))
add("v20_deduction_score", lambda k: out(K.apply_rules(k.tracks, K.DEDUCTIONS, [("genre IS NOT NULL AND status IS NOT NULL", 5)])), sql("tracks", rule_sql(K.DEDUCTIONS, [("genre IS NOT NULL AND status IS NOT NULL", 5)], "tracks")))
points = [("title IS NOT NULL", 3), ("artist_id IS NOT NULL", 3), ("bpm IS NOT NULL", 1), ("has_lyrics", 2), ("duration_seconds IS NOT NULL", 1)]
add("v21_source_quality", lambda k: k.tracks.select("id", sum((F.when(F.expr(p), n).otherwise(0) for p, n in points), F.lit(0)).alias("points")).withColumn("level", F.when(C("points") >= 8, "high").when(C("points") >= 5, "medium").otherwise("low")), sql("tracks", f", p AS (SELECT id, {' + '.join(f'CASE WHEN {p} THEN {n} ELSE 0 END' for p, n in points)} AS points FROM tracks) SELECT id, points, CASE WHEN points >= 8 THEN 'high' WHEN points >= 5 THEN 'medium' ELSE 'low' END AS level FROM p"))


def schema_query(name, source, rules, table, view):
    """Rows with their broken constraints; the SQL reads `view`, a table t of the same columns."""
    add(name, lambda k: out(K.apply_rules(source(k), rules, critical="error")).filter("issues <> ''"), sql(table, view + " SELECT * FROM (" + rule_sql([r._replace(severity="critical") for r in rules]) + ") WHERE issues <> ''"))


KEYS = ("C", "f# minor", "Bb Maj", "H", "c##", " G min ", "Do")
keyed = lambda k: k.tracks.withColumns({"musical_key": F.get(F.array(*(F.lit(x) for x in KEYS)), (C("id") % 8).cast("int")), "title": F.when(C("id") % 40 == 1, F.lit("  ")).when(C("id") % 40 == 2, F.repeat("title", 30)).otherwise(C("title")), "snippet": F.when(C("id") % 50 == 0, F.repeat(F.lit("la"), 251)), "release_year": F.year("release_date") + F.when(C("id") % 30 == 3, 1).when(C("id") % 30 == 4, 100).otherwise(0), "track_number": C("track_number") - 1})
schema_query("v22_schema_constraints", keyed, K.SCHEMA_RULES, "tracks", f", t AS (SELECT id, CASE id % 40 WHEN 1 THEN '  ' WHEN 2 THEN repeat(title, 30) ELSE title END AS title, track_number - 1 AS track_number, duration_seconds, bpm, release_date, year(release_date) + CASE id % 30 WHEN 3 THEN 1 WHEN 4 THEN 100 ELSE 0 END AS release_year, {list(KEYS)}[id % 8 + 1] AS musical_key, CASE WHEN id % 50 = 0 THEN repeat('la', 251) END AS snippet FROM tracks)")
listed = lambda k: k.albums.withColumns({"total_tracks": F.when(C("id") % 9 > 0, C("id") % 230), "label": F.repeat(F.lit("l"), (C("id") % 250).cast("int")), "release_year": C("release_year") - F.when(C("id") % 11 == 0, 2).otherwise(0)})
schema_query("v22b_album_schema", listed, K.ALBUM_SCHEMA, "albums", ", t AS (SELECT id, title, release_date, release_year - CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END AS release_year, CASE WHEN id % 9 > 0 THEN id % 230 END AS total_tracks, repeat('l', (id % 250)::INT) AS label FROM albums)")
schema_query("v22c_artist_schema", lambda k: k.artists.withColumns({"name": F.when(C("id") % 5 == 0, F.lit(" ")).when(C("id") % 5 == 1, F.repeat("name", 12)).otherwise(C("name")), "country": F.repeat("country", (C("id") % 30).cast("int"))}), K.ARTIST_SCHEMA, "artists", ", t AS (SELECT id, CASE id % 5 WHEN 0 THEN ' ' WHEN 1 THEN repeat(name, 12) ELSE name END AS name, repeat(country, (id % 30)::INT) AS country FROM artists)")
sized = lambda c, n: F.when(C("part") % n == 0, F.repeat(F.lit("x"), (C("part") % 260).cast("int")))
schema_query("v22d_credit_schema", lambda k: k.credits.groupBy(C("track_id").alias("id")).agg(F.min("person_name").alias("person_name"), F.min("part").alias("part")).withColumns({"role_detail": sized("part", 3), "instrument": sized("part", 4)}), K.CREDIT_SCHEMA, "credits", ", g AS (SELECT track_id AS id, min(person_name) AS person_name, min(part) AS part FROM credits GROUP BY 1), t AS (SELECT id, person_name, CASE WHEN part % 3 = 0 THEN repeat('x', (part % 260)::INT) END AS role_detail, CASE WHEN part % 4 = 0 THEN repeat('x', (part % 260)::INT) END AS instrument FROM g)")
schema_query("v22e_session_schema", lambda k: k.sessions.groupBy(C("session").alias("id")).agg((F.count("*") - C("session") % 4).alias("total_tracks"), F.count_if(C("status") == "completed").alias("completed_tracks"), F.count_if(C("status") != "completed").alias("failed_tracks")), K.SESSION_SCHEMA, "sessions", ", t AS (SELECT session AS id, count(*) - session % 4 AS total_tracks, count(*) FILTER (WHERE status = 'completed') AS completed_tracks, count(*) FILTER (WHERE status <> 'completed') AS failed_tracks FROM sessions GROUP BY 1)")
add("v23_clean_numbers", lambda k: K.clean_numbers(k.tracks.withColumn("track_number", C("track_number") - 3)).select("id", "bpm", "track_number"), sql("tracks", "SELECT id, CASE WHEN bpm >= 40 AND bpm < 60 THEN bpm * 2 ELSE bpm END AS bpm, CASE WHEN track_number - 3 >= 0 THEN track_number - 3 END AS track_number FROM tracks"))
add("v24_fold_bpm", lambda k: k.tracks.select("id", K.fold_bpm(C("bpm")).alias("bpm")), sql("tracks", "SELECT id, CASE WHEN bpm < 60 AND bpm * 2 BETWEEN 60 AND 200 THEN bpm * 2 WHEN bpm > 200 AND bpm / 2 BETWEEN 60 AND 200 THEN bpm / 2 ELSE bpm END AS bpm FROM tracks"))
add("v25_modal_fix", lambda k: K.modal_fix(k.tracks.select("id", "artist_id", "genre"), "artist_id", "genre"), sql("tracks", ", m AS (SELECT artist_id, genre FROM (SELECT artist_id, genre, row_number() OVER (PARTITION BY artist_id ORDER BY count(*) DESC, genre) AS rn FROM tracks GROUP BY artist_id, genre) WHERE rn = 1) SELECT id, tracks.artist_id, m.genre, tracks.genre <> m.genre AS fixed FROM tracks JOIN m USING (artist_id)"))
add("v26_change_counts", lambda k: K.change_counts(k.tracks, K.clean_numbers(k.tracks).withColumn("title", T.normalize_title(C("title"), True)), "id", ["bpm", "title", "track_number"]), sql("tracks", "SELECT count(*) FILTER (WHERE bpm >= 40 AND bpm < 60) AS bpm_changed, count(*) FILTER (WHERE title LIKE '% feat. %') AS title_changed, count(*) FILTER (WHERE track_number < 0) AS track_number_changed FROM tracks"))

# reports over validated tracks
INTEGRITY = " + ".join(f"CASE WHEN {r.when} THEN 1 ELSE 0 END" for r in K.INTEGRITY_RULES)
GONE = {"bpm": "bpm IS NULL", "duration": "duration_seconds IS NULL", "producer": "NOT has_producer", "album": "album_id IS NULL"}
add("a12_cleaning_report", lambda k: O.cleaning_report(K.apply_rules(tracks(k), K.INTEGRITY_RULES), GONE), sql(V, FACTS + f", n AS (SELECT {INTEGRITY} AS n FROM t), i AS (" + " UNION ALL ".join(f"SELECT '{r.name}' AS name FROM t WHERE {r.when}" for r in K.INTEGRITY_RULES) + "), y AS (SELECT 'tracks' AS section, 'with_issues' AS name, count(*) FILTER (WHERE n > 0) AS n FROM n UNION ALL SELECT 'level', CASE WHEN n = 0 THEN 'excellent' WHEN n <= 1 THEN 'good' WHEN n <= 3 THEN 'average' ELSE 'poor' END, count(*) FROM n GROUP BY 2 UNION ALL SELECT 'issue', name, count(*) FROM i GROUP BY 2 UNION ALL " + " UNION ALL ".join(f"SELECT 'missing', '{n}', count(*) FILTER (WHERE {w}) FROM t" for n, w in GONE.items()) + ") SELECT section, name, n, round(100 * n / (SELECT count(*) FROM t), 4) AS pct FROM y"))
ADVICE = {"missing_producer": "extract production credits", "missing_title": "check titles", "missing_duration": "fill lengths", "missing_bpm": "fill tempos", "short_duration": "check lengths", "long_duration": "check lengths"}
add("a13_validation_report", lambda k: O.validation_report(validated(k), "id", K.ladder(C("score"), K.VALIDATION_STEPS, "very_poor"), ADVICE), sql(V, FACTS + f", s AS ({STD}), i AS (" + " UNION ALL ".join(f"SELECT id, '{r.name}' AS name FROM t WHERE {duck(r.when)}" for r in K.track_rules()) + f"), r AS (SELECT name, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS detail FROM i GROUP BY 1), p AS (SELECT name, n FROM r ORDER BY n DESC, name LIMIT 5), y AS (SELECT 'total' AS section, 'valid' AS name, count(*) FILTER (WHERE is_valid) AS n, 'mean ' || printf('%.2f', avg(score)) AS detail FROM s UNION ALL SELECT 'level', {LADDER}, count(*), '' FROM s GROUP BY 2 UNION ALL SELECT 'range', CASE WHEN score < 50 THEN '0-50' WHEN score < 70 THEN '50-70' WHEN score < 85 THEN '70-85' WHEN score < 95 THEN '85-95' ELSE '95-100' END, count(*), '' FROM s GROUP BY 2 UNION ALL SELECT 'rule', name, n, detail FROM r UNION ALL SELECT 'top', name, n, CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ADVICE.items()) + " ELSE '' END FROM p) SELECT section, name, n, round(100 * n / (SELECT count(*) FROM s), 4) AS pct, detail FROM y"))
add("a14_validation_stats", lambda k: validated(k).agg(F.count_if("is_valid").alias("valid"), F.count_if(~C("is_valid")).alias("invalid"), F.sum(F.size("issues")).alias("issues"), F.round(F.avg("score"), 6).alias("mean_score")), sql(V, FACTS + f", s AS ({STD}) SELECT count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS invalid, CAST(sum(CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END) AS BIGINT) AS issues, round(avg(score), 6) AS mean_score FROM s"))
METRIC_NAMES = [m for m, _ in K.METRICS]
ISSUES16 = " UNION ALL ".join(f"SELECT artist_id, '{r.name}' AS issue FROM o WHERE {duck(r.when)}" for r in K.track_rules())
add("a16_artist_quality", lambda k: O.group_quality(measured(k), "artist_id", METRIC_NAMES), sql(V, MEASURED + f", i AS ({ISSUES16}), m AS (SELECT artist_id, count(*) AS rows, {', '.join(f'(floor(avg({m}) * 10000 + 0.001) / 10000)::DOUBLE AS {m}' for m in [*METRIC_NAMES, 'overall'])}, round(avg(CASE WHEN overall < 40 THEN 1.0 ELSE 0.0 END), 6) AS low_share FROM o GROUP BY 1), n AS (SELECT artist_id, issue, count(*) AS n FROM i GROUP BY 1, 2), f AS (SELECT n.*, row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, issue) AS place FROM n JOIN m USING (artist_id) WHERE n > 0.5 * rows), g AS (SELECT artist_id, string_agg(issue, ',' ORDER BY place) AS recurring FROM f WHERE place <= 3 GROUP BY 1) SELECT m.*, coalesce(recurring, '') AS recurring FROM m LEFT JOIN g USING (artist_id)"))
