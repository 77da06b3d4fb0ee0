"""URL filters: rules by host and path, else logistic regression on hashed character n-grams.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins.
URLs without a rule are judged by a logistic regression over the hashed byte n-grams (2 to 5) of host and
path, trained in the driver from a small labelled table of at most `rows` URLs. Rules are column
expressions; the model's score is one numpy pass inside the scan's tasks, and only the url column is read.

Nulls and odd cases: a null url or one without `://` has empty host and path, fits no rule and gets the
model's verdict on nothing (its bias); labels must be allow or block, other and null labels train nothing;
without both labels the model allows; an empty table gives no rows; repeated rows are judged one by one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.textkit import Words, bounded_batches, gram_hashes, inside, mix, text_slices

#: (host, path, verdict): fixed values of the production query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
BITS = 16
SIZES = (2, 3, 4, 5)
ANY = np.ones(256, bool)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def gram_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url, hashed n-gram, share of the url's n-grams) of a slice of `host\\npath` strings."""
    w = Words(data, off, ANY)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    values = mix(data.astype(np.uint64) + np.uint64(1))
    parts = []
    for k in SIZES:
        m = inside(rows, k)
        h = (gram_hashes(values, k, k)[m] >> np.uint64(64 - BITS)).astype(np.int64)
        parts.append(rows[: len(m)][m] << BITS | h)
    pairs, n = np.unique(np.concatenate(parts), return_counts=True)
    url = pairs >> BITS
    norm = np.sqrt(np.bincount(url, n.astype(float) ** 2, len(w.off) - 1))
    return url, pairs & (1 << BITS) - 1, n / np.maximum(norm[url], 1)


def fit(url: np.ndarray, gram: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the n-grams that occur."""
    kinds, col = np.unique(gram, return_inverse=True)
    w, b = np.zeros(len(kinds)), 0.0
    m, v = np.zeros(len(kinds) + 1), np.zeros(len(kinds) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(url, w[col] * value, len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.append(np.bincount(col, d[url] * value, len(kinds)) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(1 << BITS)
    weights[kinds] = w
    return weights, float(b)


def train(labelled: DataFrame, rows: int = 5000) -> tuple[np.ndarray, float]:
    """Weights and bias from a table (url, label: allow or block); at most `rows` of its distinct urls, by hash order."""
    host, path = host_path(F.col("url"))
    table = labelled.filter(F.col("label").isin("allow", "block") & F.col("url").isNotNull())
    table = table.select(F.concat(host, F.lit("\n"), path).alias("key"), "label").groupBy("key").agg(F.max("label").alias("label"))
    got = table.orderBy(F.xxhash64("key"), "key").limit(rows).toPandas()
    y = (got["label"] == "block").to_numpy(float)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS), -1.0
    parts = [(u + lo, g, v) for lo, _, data, off in text_slices(pa.array(got["key"], pa.large_string())) for u, g, v in [gram_counts(data, off)]]
    return fit(*(np.concatenate(x) for x in zip(*parts, strict=True)), y)


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability of block) of every row."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, off in text_slices(batch.column("key")):
                u, g, v = gram_counts(data, off)
                out.append(1 / (1 + np.exp(-np.clip(np.bincount(u, weights[g] * v, hi - lo) + bias, -40, 40))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(np.concatenate(out))], names=["page_id", "host", "path", "score"])

    host, path = host_path(F.col("url").cast("string"))
    df = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", F.lit("\n"), "path"))
    df = df.mapInArrow(run, df.select("page_id", "host", "path", F.lit(0.0).alias("score")).schema)
    found = longest_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumn("found", found)
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table is that of the pages that fit a rule."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labelled = pages.select("url", longest_rule(*host_path(F.col("url")), RULES)["verdict"].alias("label"))
    return judge(pages, train(labelled))
