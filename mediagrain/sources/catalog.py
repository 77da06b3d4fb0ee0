"""Media-catalogue tables over the driver's tables, in Spark and as DuckDB common table expressions.

`load(spark, sf_dir)` gives the views lazily by name: artists, albums, tracks, credits, sessions, api_log,
cache, lyrics and the raw tables. A track is one (order, line) pair, whose attributes come from its smallest
line item; every line item is a credit of its track.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items of a task from which on tracks are made in more tasks than the session shuffles to.
LINES = 2**19
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def titled(key: Column) -> Column:
    """A track's title: the part's name with a mark by the track's id."""
    suffix = F.when(key % 10 == 1, F.concat(F.lit(" feat. Guest "), (key % 7).cast("string"))).when(key % 10 == 2, " (Remix)").when(key % 10 == 3, " (Live)").when(key % 10 == 4, " [Deluxe Edition]").otherwise("")
    return F.concat("p_name", suffix)


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def artists(self) -> DataFrame:
        return self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("genre"), F.col("n_name").alias("country"), F.col("c_acctbal").alias("balance"))

    @cached_property
    def albums(self) -> DataFrame:
        title = F.concat(F.lit("Album "), F.col("o_orderpriority"), F.lit(" "), (F.col("o_orderkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 6 == 0, " (Deluxe Edition)").when(F.col("o_orderkey") % 6 == 1, " Live").otherwise(""))
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("artist_id"), title.alias("title"), F.to_date("o_orderdate").alias("release_date"), F.year("o_orderdate").alias("release_year"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))

    @cached_property
    def tasks(self) -> int | None:
        """As many tasks as line items need, so that none holds more as tables grow; None if the session's partitions do."""
        need = -(-self.lineitem.count() // LINES)
        return need if need > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else None

    @cached_property
    def tracks(self) -> DataFrame:
        line = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
        used = self.lineitem.select("l_orderkey", "l_linenumber", line.alias("x"))
        # dealt first: few lines share a track, so sorting them for a partial minimum would be in vain
        used = used.repartition(*filter(None, [self.tasks]), "l_orderkey", "l_linenumber")
        lines = used.groupBy("l_orderkey", "l_linenumber").agg(F.min("x").alias("x")).select("l_orderkey", "l_linenumber", "x.*")
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        lines = lines.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return (
            (lines.repartition(self.tasks, "l_orderkey") if self.tasks else lines)
            .join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                key.alias("id"),
                F.col("l_orderkey").alias("album_id"),
                F.col("o_custkey").alias("artist_id"),
                titled(key).alias("title"),
                F.col("l_linenumber").alias("track_number"),
                F.nullif((F.col("l_quantity") * 12).cast("int"), F.lit(12)).alias("duration_seconds"),
                F.nullif(F.lit(40) + F.col("p_size") * 4, F.lit(44)).cast("double").alias("bpm"),
                F.col("p_type").alias("genre"),
                (F.col("l_returnflag") == "R").alias("has_lyrics"),
                F.to_date("o_orderdate").alias("release_date"),
                F.when(F.col("l_linestatus") == "F", "completed").when(key % 5 == 0, "failed").otherwise("pending").alias("status"),
            )
        )

    @cached_property
    def titles(self) -> DataFrame:
        """(id, artist_id, title) of all tracks: of a track's least line item only the part is dealt, which orders line items first."""
        used = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").repartition(*filter(None, [self.tasks]), "l_orderkey")
        lines = used.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part")).join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("artist_id"), "part")
        return lines.join(self.part, F.col("part") == F.col("p_partkey")).select("id", "artist_id", titled(F.col("id")).alias("title"))

    @cached_property
    def credits(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "R", "producer").when(F.col("l_returnflag") == "A", "songwriter").when(F.col("l_linestatus") == "O", "featuring").otherwise("mixing")
        return self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("track_id"), F.col("s_name").alias("person_name"), kind.alias("credit_type"), F.col("l_partkey").alias("part"))

    @cached_property
    def sessions(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "in_progress").otherwise("paused")
        return self.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), status.alias("status"), F.col("ts"), F.col("value").cast("int").alias("found"), F.col("props").alias("metadata"))

    @cached_property
    def api_log(self) -> DataFrame:
        return self.events.select("event_id", (F.col("user_id") % 4).alias("api"), (F.col("event_type") != "error").alias("ok"), "ts", "value")

    @cached_property
    def cache(self) -> DataFrame:
        return self.events.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("props").alias("data"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 10 != 0, F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), "event_id")

    @cached_property
    def lyrics(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("lyrics"), "lang")


def load(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sf_dir)


VIEWS = {
    "artists": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS genre, n_name AS country, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "albums": "SELECT o_orderkey AS id, o_custkey AS artist_id, 'Album ' || o_orderpriority || ' ' || (o_orderkey % 40) || CASE o_orderkey % 6 WHEN 0 THEN ' (Deluxe Edition)' WHEN 1 THEN ' Live' ELSE '' END AS title, CAST(o_orderdate AS DATE) AS release_date, CAST(year(o_orderdate) AS INT) AS release_year, o_orderstatus AS status, o_totalprice AS price FROM orders",
    "tracks": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS album_id, o_custkey AS artist_id,
  p_name || CASE (l_orderkey * 10 + l_linenumber) % 10 WHEN 1 THEN ' feat. Guest ' || ((l_orderkey * 10 + l_linenumber) % 7) WHEN 2 THEN ' (Remix)' WHEN 3 THEN ' (Live)' WHEN 4 THEN ' [Deluxe Edition]' ELSE '' END AS title,
  l_linenumber AS track_number, nullif(CAST(trunc(l_quantity * 12) AS INT), 12) AS duration_seconds, CAST(nullif(40 + p_size * 4, 44) AS DOUBLE) AS bpm, p_type AS genre, l_returnflag = 'R' AS has_lyrics, CAST(o_orderdate AS DATE) AS release_date,
  CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN (l_orderkey * 10 + l_linenumber) % 5 = 0 THEN 'failed' ELSE 'pending' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1""",
    "credits": "SELECT l_orderkey * 10 + l_linenumber AS track_id, s_name AS person_name, CASE WHEN l_returnflag = 'R' THEN 'producer' WHEN l_returnflag = 'A' THEN 'songwriter' WHEN l_linestatus = 'O' THEN 'featuring' ELSE 'mixing' END AS credit_type, l_partkey AS part FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "sessions": "SELECT event_id AS id, user_id AS session, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'created' WHEN 'view' THEN 'in_progress' ELSE 'paused' END AS status, ts, CAST(trunc(value) AS INT) AS found, props AS metadata FROM events",
    "api_log": "SELECT event_id, user_id % 4 AS api, event_type <> 'error' AS ok, ts, value FROM events",
    "cache": "SELECT event_type || ':' || user_id AS key, props AS data, ts AS created_at, CASE WHEN event_id % 10 <> 0 THEN ts + INTERVAL 7 DAY END AS expires_at, event_id FROM events",
    "lyrics": "SELECT doc_id AS id, text AS lyrics, lang FROM documents",
}


def sql(views: str, body: str) -> str:
    """`body` after WITH clauses for the named views; `body` may go on with further clauses after a comma."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    if body.lstrip().startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}" if ctes else body
