"""Toxicity by non-negative positive-unlabelled learning (nnPU) in numpy.

Positives are confirmed toxic documents, everything else in the training folds is unlabelled. The linear
model over hashed words and word beginnings (dampened counts) minimises  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))  with the logistic
loss; where the corrected negative risk falls below zero, its gradient is reversed, as published, so that
the model can't call all unlabelled text negative by memory alone.

The model is fitted in the driver on a bounded sample: at most `positives` and `unlabelled` documents,
taken by hash order. Tasks count the documents of each hash (below 2**18) by class, the features are chosen
from these counts, and only the chosen columns of the sample are gathered; `prior` is the share of toxic
rows among the training labels unless given. Scoring is a numpy pass inside the scan's tasks over whole
texts, with nothing shuffled.

Nulls and odd cases: a null or empty text has no words and gets the score of the bias alone; null labels
and ids are no training rows; repeated labels count once (the largest); repeated rows are scored one by one;
equal texts get equal scores, and a score of just the threshold is toxic; without positives every score is 0; an
empty table gives no rows; other columns, whatever their names, are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.samples import first_by_hash, fold, with_texts
from mediagrain.llm.textkit import ALNUM, LOWER, Words, bounded_batches, span_hasher, text_slices

BITS = 18
#: Lengths in bytes of the word beginnings that are features beside whole words (inflected forms share them).
PREFIXES = (4, 5, 6, 7, 8)


def word_counts(data: np.ndarray, off: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, number) of each distinct hash of a word or word beginning in a text; `keep` says which hashes matter."""
    low = LOWER[data]
    w = Words(low, off, ALNUM)
    of, rows, size = span_hasher(low), w.rows(), w.ends - w.starts
    parts = []
    for k in (0, *PREFIXES):
        m = np.flatnonzero(size > k) if k else slice(None)
        starts = w.starts[m]
        h = of(starts, starts + k if k else w.ends) ^ np.uint64(k * 0x9E3779B97F4A7C1)
        h = (h >> np.uint64(64 - BITS)).astype(np.int64)
        r = rows[m]
        if keep is not None:
            wanted = keep[h]
            h, r = h[wanted], r[wanted]
        parts.append(r << BITS | h)
    pairs, n = np.unique(np.concatenate(parts), return_counts=True)
    return pairs >> BITS, pairs & (1 << BITS) - 1, n


def scaled(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1.0 + n), 3)


def nnpu_risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray]:
    """prior * R_P(+), the corrected negative risk R_U(-) - prior * R_P(-), and the gradient for (w, b) of the step to take.

    The gradient is that of both risks; where the negative risk is below zero, that of its opposite alone.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    own = w.astype(p.dtype)  # so that the sample is not copied to a wider type
    fp, fu = p @ own + b, u @ own + b
    positive = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    on_p = -prior * sigmoid(-fp) / len(fp)  # of prior * R_P(+)
    neg_p, neg_u = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
    if negative < 0:
        on_p, neg_p, neg_u = 0 * on_p, -neg_p, -neg_u
    gp = on_p + neg_p
    return positive, negative, np.append(p.T @ gp.astype(p.dtype) + u.T @ neg_u.astype(u.dtype), gp.sum() + neg_u.sum())


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear nnPU classifier, by Adam on the whole sample."""
    p, u = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = nnpu_risk(p, u, w, b, prior)[2] + decay * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def hash_counts(sample: DataFrame) -> DataFrame:
    """(h, in_p, in_u): positive and other rows of `sample` (text, positive) with each hash; h = -1 counts all rows."""

    def run(batches):
        for batch in batches:
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            in_p, in_u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
            for lo, _, data, off in text_slices(batch.column("text")):
                rows, h, _ = word_counts(data, off)
                is_p = positive[lo + rows]
                in_p += np.bincount(h[is_p], minlength=1 << BITS)
                in_u += np.bincount(h[~is_p], minlength=1 << BITS)
            h = np.flatnonzero(in_p + in_u)
            columns = np.append(h, -1), np.append(in_p[h], positive.sum()), np.append(in_u[h], (~positive).sum())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "in_p", "in_u"])

    return sample.mapInArrow(run, "h long, in_p long, in_u long").groupBy("h").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))


def sparse_rows(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """positive and words (hash << 8 | number, at most 255) of each row of `sample`, of the chosen hashes only."""
    keep = np.zeros(1 << BITS, bool)
    keep[chosen] = True
    shared = sample.sparkSession.sparkContext.broadcast(keep)

    def run(batches):
        for batch in batches:
            lists = []
            for lo, hi, data, off in text_slices(batch.column("text")):
                rows, h, n = word_counts(data, off, shared.value)
                lists += [x.astype(np.int32) for x in np.split(h << 8 | np.minimum(n, 255), np.searchsorted(rows, np.arange(1, hi - lo)))]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(lists, pa.list_(pa.int32()))], names=["positive", "words"])

    return sample.mapInArrow(run, "positive boolean, words array<int>")


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, features: int = 1024, prior: float | None = None) -> tuple[np.ndarray, float]:
    """(weight of each hashed word, bias). `labels` has doc_id and toxic, of training rows only; `docs` likewise."""
    bounded_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = float(known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0)
    weights = np.zeros(1 << BITS, np.float32)
    pos = first_by_hash(known.filter("toxic = 1").select("doc_id"), "doc_id", positives).withColumn("positive", F.lit(True))
    free = first_by_hash(docs.select("doc_id").filter("doc_id is not null"), "doc_id", unlabelled).withColumn("positive", F.lit(False))

    sample = with_texts(docs, pos.unionByName(free))
    counted = hash_counts(sample).filter("h < 0 or in_p + in_u >= 5").toArrow()
    found, p, u = (counted.column(c).to_numpy() for c in ("h", "in_p", "in_u"))
    n_p, n_u = p[found < 0].sum(), u[found < 0].sum()
    if not n_p or not n_u:
        return weights, -40.0
    in_p, in_u = np.zeros(1 << BITS), np.zeros(1 << BITS)
    in_p[found[found >= 0]], in_u[found[found >= 0]] = p[found >= 0], u[found >= 0]
    rate = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u) + 1e-9)
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:features])
    chosen = chosen[np.abs(z[chosen]) > 3]
    got = sparse_rows(sample, chosen).toArrow()
    positive, words = got.column("positive").to_numpy().astype(bool), got.column("words").combine_chunks()
    counts, h = words.value_lengths().to_numpy(), words.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(positive)), counts)
    h, n = h >> 8, h & 255
    x = np.zeros((len(positive), len(chosen)), np.float32)
    x[rows, np.searchsorted(chosen, h)] = scaled(n)
    w, bias = fit_nnpu(x, positive, prior)
    weights[chosen] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1); doc_id may be any type, so a struct of a whole row too."""
    spark = docs.sparkSession
    bounded_batches(spark)
    weights, bias = model
    shared = spark.sparkContext.broadcast((weights, weights != 0, bias))

    def run(batches):
        w, keep, b = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, data, off in text_slices(batch.column("text")):
                rows, h, n = word_counts(data, off, keep)
                out.append(1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[h] * scaled(n), hi - lo), -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, df.select("doc_id", F.lit(0.0).alias("score")).schema)


def model_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    """Trained on the documents and labels whose crc32 modulo 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(fold("doc_id", 3) != 1)
    return train(docs.filter(fold("doc_id", 3) != 1), labels)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """The documents, columns unchanged, whose score is below the threshold."""
    shared = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    return score(shared, model_for(spark, docs, sf_dir)).filter(F.col("score") < threshold).select("doc_id.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, model_for(spark, docs, sf_dir))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
