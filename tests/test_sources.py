"""The SQLite source, log lines, kept snapshots, chained streams and daily partials."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from mediagrain.operators import partials as P
from mediagrain.sources import sqlite as L
from mediagrain.sources.catalog import load
from mediagrain.streaming import chained as H
from mediagrain.streaming import events as S
from mediagrain.streaming import logs as G
from mediagrain.streaming.stateful import with_state_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "music.db")
    k = load(spark, SF)
    tables = {
        "artists": k.artists.select("id", "name", "genre"),
        "albums": k.albums.select("id", "artist_id", "title", "price"),
        "tracks": k.tracks.select("id", "album_id", "title", "bpm", "duration_seconds"),
        "credits": k.credits.select("track_id", "person_name", "credit_type"),
        "sessions": k.sessions.select("id", "session", "status", "found"),
    }
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[t]}' for c, t in df.dtypes)})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", list(map(tuple, df.collect())))
        db.execute("INSERT INTO artists VALUES (NULL, 'no id', NULL)")
        db.execute('CREATE TABLE "nothing" (id INTEGER, x BLOB)')
    return path, tables


@pytest.mark.parametrize("table,key", [("artists", "id"), ("albums", "id"), ("tracks", "id"), ("credits", "track_id"), ("sessions", "id")])
def test_five_tables_in_four_partitions(spark, database, table, key):
    path, tables = database
    df = L.read_sqlite(spark, path, table, key)
    assert df.rdd.getNumPartitions() == 4
    want = list(map(tuple, tables[table].collect())) + ([(None, "no id", None)] if table == "artists" else [])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_filters_run_in_the_database(spark, database):
    path, tables = database
    reader = L.SqliteReader(path, "tracks", "id", 4, 100, L.read_sqlite(spark, path, "tracks", "id").schema)
    left = list(reader.pushFilters([L.GreaterThan(("bpm",), 100.0), L.In(("album_id",), (1, 2)), L.IsNotNull(("bpm",)), L.EqualTo(("elsewhere",), 1)]))
    assert [f.attribute for f in left] == [("elsewhere",)] and len(reader.where) == 3
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == tables["tracks"].filter("bpm > 100 and album_id in (1, 2)").count()
    df = L.read_sqlite(spark, path, "tracks", "id").filter("bpm > 100 and title <> ''").select("id", "title")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, tables["tracks"].filter("bpm > 100 and title <> ''").select("id", "title").collect()))


def test_empty_and_missing_tables(spark, database):
    assert L.read_sqlite(spark, database[0], "nothing", "id").collect() == []
    with pytest.raises(Exception, match="no table"):
        L.read_sqlite(spark, database[0], "missing", "id").collect()


LINES = [
    {"ts": "2024-01-01 10:00:00", "session": 1, "level": "warning", "api": {"code": 404, "seconds": 0.2}},
    {"ts": "2024-01-01 11:00:00", "session": 1, "level": "INFO", "api": {"code": 200, "seconds": 1.5}, "more": [1]},
    {"ts": "2024-01-01 12:00:00", "session": 1, "level": "INFO", "validation": {"total": 8, "errors": 2}},
    {"ts": "2024-01-02 12:00:00", "session": 2, "level": "ERROR"},
]
BROKEN = ['{"ts": "2024', "", "[1]", '"text"', "12", "null", '{"level": "INFO"}', '{"ts": "no time"}']


def test_log_lines_of_any_shape(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([*map(json.dumps, LINES), *BROKEN]) + "\n")
    table = G.log_lines(spark, str(tmp_path / "in"))
    assert sorted(r.value for r in G.broken(table).collect()) == sorted(BROKEN)
    got = {r.session: r for r in G.log_report(table).collect()}
    r = got[1]
    assert (r.entries, r.debug, r.info, r.warning, r.error, r.failed_calls, r.slow, r.valid_pct) == (3, 0, 2, 1, 0, 1, 1, 75.0)
    assert (got[2].entries, got[2].error, got[2].valid_pct) == (1, 1, None)
    end = {"ts": "2030-01-01 00:00:00", "session": 9, "level": "INFO"}
    (tmp_path / "in" / "b.log").write_text(json.dumps(end) + "\n")
    S.write_stream(G.log_report(G.log_lines(spark, str(tmp_path / "in"), stream=True)), str(tmp_path / "out"), str(tmp_path / "cp"))
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch").filter("session <> 9")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, got.values()))


def windows(spark, path):
    return S.rate_windows(S.events_stream(spark, path, 1).select((F.col("user_id") % 4).alias("api"), "ts"), "6 hours").select("api", "started", "n")


def content(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("api", "started", "n").collect()))


def test_kept_snapshots(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(4, "ts").write.parquet(path)
    table = H.SnapshotTable(out, "api", buckets=3, keep=20)
    table.run(windows(spark, path), str(tmp_path / "cp"))
    want = S.rate_windows(load(spark, SF).api_log, "6 hours")
    rows = {}
    for r in want.collect():
        rows.setdefault(r.api, []).append((r.started, r.n))
    kept = content(spark, out)
    assert kept == sorted((api, *x) for api, xs in rows.items() for x in sorted(xs)[-20:])
    got = S.snapshots(table.read(spark), "api", 20, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.snapshots(want, "api", 20, 5).collect()))

    batch = table.read(spark).filter("api = 1").select("api", "started", "n").orderBy(F.desc("started")).limit(3)
    again = spark.createDataFrame(batch.collect(), batch.schema)
    other = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "kept").glob("bucket=*/*.parquet")}
    for _ in range(2):  # a batch that is run again changes nothing
        table.save(again, 99)
        assert content(spark, out) == kept
    touched = {r.b for r in again.select(F.pmod(F.xxhash64("api"), F.lit(3)).alias("b")).collect()}
    left = {f.name for f in (tmp_path / "kept").glob("bucket=*/*.parquet") if int(f.parent.name.split("=")[1]) not in touched}
    assert left and left <= set(other)
    table.save(again.filter("false"), 100)
    assert content(spark, out) == kept


def test_chained_windows_and_the_day_before(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with_state_store(spark)
    path = str(tmp_path / "in")
    sessions = load(spark, SF).sessions.select("session", "status", "found", F.col("ts").cast("timestamp").alias("ts"))
    end = spark.createDataFrame([(-1, "created", 0, 4_102_444_800), (-1, "created", 0, 4_202_444_800)], "session long, status string, found int, at long").select("session", "status", "found", F.timestamp_seconds("at").alias("ts"))
    sessions.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    for i in (0, 1):
        end.filter(f"ts {'<' if i == 0 else '>'} timestamp'2102-01-01'").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(sessions.schema).option("maxFilesPerTrigger", 2).parquet(path)
    try:
        S.write_stream(H.daily_trend_stream(stream(), "found"), str(tmp_path / "days"), str(tmp_path / "cp1"))
        S.write_stream(H.overall_progress_windows(stream(), 20), str(tmp_path / "progress"), str(tmp_path / "cp2"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    days = spark.read.parquet(str(tmp_path / "days")).filter("day < '2100-01-01'").select("day", "mean", "n", "trend")
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, S.daily_trend(sessions, "found").select("day", "mean", "n", "trend").collect()))
    got = spark.read.parquet(str(tmp_path / "progress")).filter("session >= 0").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, H.overall_progress_windows(sessions, 20).collect()))


def test_partials_merge_like_the_whole(spark):
    events = load(spark, SF).events
    daily = P.daily_partials(events, "ts", ["event_type"], "value", "user_id", F.col("value") > 90)
    some = F.col("day").between("2024-01-05", "2024-01-20")
    for part, rows in ((daily, events), (daily.filter(some), events.withColumn("day", F.to_date("ts")).filter(some))):
        got = P.merged_partials(part, []).first()
        want = rows.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("f"), F.round(F.avg("value"), 6).alias("m"), F.min("value").alias("a"), F.max("value").alias("b"), F.count_distinct("user_id").alias("d"), F.percentile("value", 0.46).alias("lo"), F.percentile("value", 0.54).alias("hi")).first()
        assert (got.n, got.failures, got.mean, got.least, got.most) == (want.n, want.f, want.m, want.a, want.b)
        assert abs(got.distinct - want.d) <= max(1, 3 * P.DISTINCT_ERROR * want.d) and want.lo <= got.p50 <= want.hi
    assert P.merged_partials(daily.filter("false"), ["event_type"]).collect() == []
