"""Log lines as semi-structured rows: JSON lines of any shape, read by path; lines that are no JSON objects are kept apart.

Both functions take a streaming or static DataFrame of text lines (`value`).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.streaming.events import timed

#: Operations that take longer than this (seconds) are slow; response codes from here on are errors.
SLOW_SECONDS, ERROR_CODE = 1.0, 400


def log_lines(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Lines of the text files of a folder, as a stream of the files that come or as a table."""
    return spark.readStream.text(folder) if stream else spark.read.text(folder)


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get("line", f"$.{path}", kind)


def parsed(lines: DataFrame) -> DataFrame:
    """value, line (a variant; null for what is no JSON object) and ts, session, level, logger, code, seconds, validated, errors."""
    line = F.try_parse_json("value")
    out = lines.select("value", F.when(F.schema_of_variant(line).startswith("OBJECT"), line).alias("line"))
    return out.select(
        "value", "line", _at("ts", "timestamp").alias("ts"), _at("session", "bigint").alias("session"), F.upper(_at("level", "string")).alias("level"), _at("logger", "string").alias("logger"),
        _at("api.code", "int").alias("code"), _at("api.seconds", "double").alias("seconds"), _at("validation.total", "bigint").alias("validated"), _at("validation.errors", "bigint").alias("errors"),
    )


def broken(lines: DataFrame) -> DataFrame:
    """The lines that can't be read, or have no time."""
    return parsed(lines).filter("line is null or ts is null").select("value")


def log_report(lines: DataFrame, length: str = "1 day") -> DataFrame:
    """Per session and window: entries by level, response codes from 400, slow operations and the share of validated rows without an error."""
    rows = timed(parsed(lines).filter("line is not null and ts is not null").drop("line"))
    level = lambda name: F.count_if(F.col("level") == name).alias(name.lower())
    total, wrong = F.sum("validated"), F.sum("errors")
    out = rows.groupBy(F.window("ts", length).alias("w"), "session").agg(
        F.count("*").alias("entries"), level("DEBUG"), level("INFO"), level("WARNING"), level("ERROR"),
        F.count_if(F.col("code") >= ERROR_CODE).alias("failed_calls"), F.count_if(F.col("seconds") > SLOW_SECONDS).alias("slow"),
        F.round(100 * F.try_divide(total - wrong, total), 4).alias("valid_pct"),
    )
    return out.select("session", F.col("w.start").alias("started"), *(c for c in out.columns if c not in ("w", "session")))
