"""Reading and writing: payloads, mapping tables, nested JSON, flattened CSV, XML, partitioned Parquet, reports."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with an explicit schema; broken ones go to a column of their own."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16) -> DataFrame:
    """A relational table, read in ranges of its key at once."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def mapping_table(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """{canonical: [aliases]} as a lookup table (alias, canonical)."""
    return spark.createDataFrame([(a.lower(), c) for c, aliases in mapping.items() for a in aliases], "alias string, canonical string")


def nested_artists(artists: DataFrame, tracks: DataFrame, albums: DataFrame, credits: DataFrame) -> DataFrame:
    """An artist to a row, with sorted tracks (and their credits) and albums inside, and a struct of totals."""
    c = credits.groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("credit_type", "person_name"))).alias("credits"))
    t = tracks.join(c, "id", "left").groupBy(F.col("artist_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "title", "duration_seconds", F.coalesce("credits", F.array().cast("array<struct<credit_type:string,person_name:string>>")).alias("credits")))).alias("tracks"))
    a = albums.groupBy(F.col("artist_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("album_id"), "title", "release_date"))).alias("albums"))
    out = artists.join(t, "id", "left").join(a, "id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    stats = F.struct(n("tracks").alias("tracks"), n("albums").alias("albums"), F.coalesce(F.aggregate("tracks", F.lit(0), lambda x, t: x + F.size(t["credits"])), F.lit(0)).alias("credits"))
    return out.withColumn("stats", stats)


def flat_credits(c: Column) -> Column:
    """`name (role); …`."""
    return F.array_join(F.transform(c, lambda x: F.concat(x["person_name"], F.lit(" ("), x["credit_type"], F.lit(")"))), "; ")


def export_filter(tracks: DataFrame, include_failed: bool = False, min_quality: float = 0) -> DataFrame:
    out = tracks if include_failed else tracks.filter("status <> 'failed'")
    return out.filter(F.coalesce("quality", F.lit(0.0)) >= min_quality) if min_quality else out


def project_export(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Without the columns in `drop` and those that start with an underscore."""
    return df.drop(*drop, *(c for c in df.columns if c.startswith("_")))


#: The most rows of an XML file, unless more are asked for: a file is read whole, by one task.
XML_ROWS = 500_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] = (), max_rows: int | None = None, row_tag: str = "row") -> None:
    """Writes Parquet, JSON, CSV (with header) or XML (null fields left out), a folder for each value of `by`."""
    w = df.write.mode("overwrite").format(fmt)
    if max_rows is None and fmt == "xml":
        max_rows = XML_ROWS
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        w = w.option("header", True)
    if fmt == "xml":
        w = w.option("rowTag", row_tag).option("rootTag", "rows")
    (w.partitionBy(*by) if by else w).save(path)


def render_report(summary: DataFrame, fmt: str = "markdown") -> DataFrame:
    """A text report to a row of a summary (name, tracks, with_lyrics, credits)."""
    if fmt == "html":
        text = F.format_string("<h1>%s</h1><ul><li>tracks: %d</li><li>with lyrics: %d</li><li>credits: %d</li></ul>", "name", "tracks", "with_lyrics", "credits")
    else:
        text = F.format_string("# %s\n\n- tracks: %d\n- with lyrics: %d\n- credits: %d", "name", "tracks", "with_lyrics", "credits")
    return summary.select("id", text.alias("report"))
