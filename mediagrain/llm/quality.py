"""Quality by Bradley-Terry pairwise ranking.

A linear score over text statistics is learned from preference pairs: one document marked good, one
marked bad; the logistic loss of the feature difference is minimised. The cut is a quantile of the
training scores (the share of bad labels), and the published score maps the cut to 0.7, so that
`score >= 0.7` keeps what lies above the quantile.

Fitting takes all labelled documents and all pairs of them (`pair_loss`): some ten passes over their
statistics, of which only sums reach the driver. Statistics are made once, in a numpy pass inside the scan's
tasks over whole texts; texts are not shuffled, statistics only if there are over 65 536 labels.

Nulls and odd cases: a null or empty text has all statistics 0 and is scored like any other; null labels
and ids are no training rows; repeated labels count once (the largest); repeated rows are scored one by one;
equal texts tie, and a text at the very cut passes; without both classes every score is 0.5; an empty table
gives no rows; other columns, whatever their names, are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.components import written
from mediagrain.llm.pair_loss import fitted, gathered, merged_moments, merged_ranks, merged_spread, moments, order_values, pair_sums, ranks_within, spread_of
from mediagrain.llm.repetition import NOT_NEWLINE, repeats
from mediagrain.llm.samples import fold
from mediagrain.llm.textkit import NOT_SPACE, Words, _table, bounded_batches, gram_hashes, inside, mix, per_row, text_slices, word_hashes

SYMBOL = _table(b"#*$%&<>@^~={}[]\\/_+")
UPPER = _table(range(0x41, 0x5B))
DIGIT = _table(range(0x30, 0x3A))
NAMES = ("log_words", "symbols", "upper", "pipes", "bangs", "digits", "mean_word", "same_as_last", "repeated_grams", "repeated_lines", "short_words", "long_words", "line_words", "stops")

#: Labelled rows of a task, and the most labels that are sent to all tasks.
ROWS, SENT = 250_000, 65_536


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of a slice, each a share or a logarithm."""
    w = Words(data, off, NOT_SPACE)
    rows, h, n = w.rows(), word_hashes(w), w.counts
    size, words = np.maximum(np.diff(off), 1), np.maximum(n, 1)
    length = w.ends - w.starts
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    at = np.flatnonzero(inside(rows, 3))
    again = np.zeros(len(h), bool)
    if len(at):
        again[at[repeats(gram_hashes(h, 3)[at] ^ mix(rows[at].astype(np.uint64)))[1]]] = True
    lines = Words(data, off, NOT_NEWLINE)
    later = repeats(word_hashes(lines, 3) ^ mix(lines.rows().astype(np.uint64)))[1]
    share = lambda table: per_row(table[data], off) / size
    cols = [
        np.log1p(n),
        share(SYMBOL),
        share(UPPER),
        per_row((data == 0x7C), off) / words,
        per_row((data == 0x21), off) / words,
        share(DIGIT),
        per_row(length, w.first) / words / 10,
        per_row(same, w.first) / words,
        per_row(again, w.first) / words,
        per_row(later, lines.first) / np.maximum(lines.counts, 1),
        per_row(length <= 2, w.first) / words,
        per_row(length >= 12, w.first) / words,
        np.log1p(words / np.maximum(lines.counts, 1)),
        per_row((data == 0x2E), off) / words,
    ]
    return np.stack(cols, axis=1)


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, steps: int = 500, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights that make good rows score above bad ones, by drawn pairs in the driver: what `fit` does for all pairs."""
    rng = np.random.default_rng(7)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))) / len(d) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _expand(x: np.ndarray) -> np.ndarray:
    """The statistics, their square roots and a few bounded steps, so that a linear score can bend."""
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(np.abs(x) * 20, 1)], axis=1)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics x, and whether there is a text, for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            x = np.concatenate([np.zeros((0, len(NAMES))), *(statistics(data, off) for _, _, data, off in text_slices(text))])
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), text.is_valid()], names=["doc_id", "x", "known"])

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, df.select("doc_id", F.array(F.lit(0.0)).alias("x"), F.lit(True).alias("known")).schema)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model; `labels` has doc_id and quality, of training rows only."""
    return fit(described(docs), labels)


def fit(rows: DataFrame, labels: DataFrame, decay: float = 1e-3) -> dict | None:
    """The model from `described` rows: all labelled ones with a text, and all pairs of a good and a bad one."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = written(known, "labels")
    known = F.broadcast(known) if known.count() <= SENT else known.hint("merge")
    table = written(rows.filter("known").select("doc_id", "x").join(known, "doc_id").select("x", "y"), "training")
    n = table.count()
    if not n:
        return None
    table = table.coalesce(n // ROWS + 1)
    n, good, bad, mean, apart = gathered(table, lambda x, y: spread_of(_expand(x), y), merged_spread)
    if not good or not bad:
        return None
    spread = np.sqrt(apart / n) + 1e-6
    scaled = lambda x: np.clip((_expand(x) - mean) / spread, -8, 8)
    w = fitted(lambda w: pair_sums(gathered(table, lambda x, y: moments(scaled(x), y, w), merged_moments)), len(mean), decay)
    most = float(8 * np.abs(w).sum()) + 1
    at = bad / n * (n - 1)  # the share of bad rows, as a place among the scores
    ranks = [int(at), min(int(at) + 1, n - 1)]
    lo, hi = order_values(lambda ranges: gathered(table, lambda x, y: ranks_within(scaled(x) @ w, ranges), merged_ranks), ranks, -most, most)
    return {"mean": mean, "spread": spread, "w": w, "cut": lo + (hi - lo) * (at - int(at))}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (0 to 1)."""
    return scored(described(docs), model)


def scored(rows: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score (0 to 1) of `described` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if m is not None:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                x = np.clip((_expand(x) - m["mean"]) / m["spread"], -8, 8)
                out = 1 / (1 + np.exp(-np.clip(x @ m["w"] - m["cut"] + np.log(0.7 / 0.3), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    df = rows.select("doc_id", "x")
    return df.mapInArrow(run, df.select("doc_id", F.lit(0.0).alias("score")).schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(fold("doc_id", 4) != 2)
    rows = written(described(docs), "statistics")  # for the fit and for the scores
    out = scored(rows, fit(rows, labels))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
