"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of depth three: the counts of the bytes that follow every context of
three, two, one and no bytes. A byte costs -log2 of its share under the longest context; where it never
followed that context, the escape probability (method C) is paid and the next shorter context is asked,
down to one byte in 256. The statistics are frozen after training, so the code length of a text is the
sum of fixed costs of its four-byte windows: the tasks look these up in a table of all windows that
training saw and work out the others exactly. The language of the shortest code wins; the score is its
posterior probability under equal priors.

Texts are lower-cased (A-Z) and runs of ASCII non-letters become one space. Training takes at most
`per_language` whole documents of each language by hash order; their window counts are summed by Spark.
Scoring is a numpy pass inside the scan's tasks over whole texts; nothing is shuffled.

Nulls and odd cases: a null text or one without a letter is `und` with score 0; rows with a null language,
text or id train nothing; equal code lengths go to the first language by name; without training rows all
is `und`; repeated rows are judged one by one; an empty table gives no rows; other columns, whatever their
names, are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediagrain.llm.samples import fold, with_texts
from mediagrain.llm.textkit import LOWER, _table, bounded_batches, per_row, text_slices

LETTER = _table([*range(0x61, 0x7B), *range(0x80, 0x100)])
UND = "und"


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four-byte windows, first window of each text, number of each text's windows): one for each byte of the reduced text."""
    low = LOWER[data]
    letter = LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    keep[heads] = letter[heads]
    n = per_row(keep, off)
    first = np.concatenate(([0], np.cumsum(n + 3)))
    x = np.full(first[-1] + 3, 0x20, np.uint32)
    at = np.arange(n.sum()) + 3 * (np.repeat(np.arange(len(n)), n) + 1)
    x[at] = np.where(letter, low, 0x20)[keep]
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:], first[:-1], n


class Tree:
    """The frozen context tree of one language."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in (4, 3, 2, 1):
            keys, inverse = np.unique(grams & np.uint32((1 << 8 * k) - 1), return_inverse=True)
            n = np.bincount(inverse, counts)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            self.levels.append((k, keys, -np.log2(n / (total + kinds)[of]), contexts, -np.log2(kinds / (total + kinds))))

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window after the three before it."""
        bits, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k, keys, costs, contexts, escapes in self.levels:
            key = grams[open_] & np.uint32((1 << 8 * k) - 1)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[i] == key
            bits[open_[found]] += costs[i[found]]
            open_, context = open_[~found], key[~found] >> np.uint32(8)
            j = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            seen = contexts[j] == context
            bits[open_[seen]] += escapes[j[seen]]
        bits[open_] += 8
        return bits


class Model:
    """All trees, with the costs of every window seen in training by a hash table."""

    SLOTS = 21

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        self.trees = [Tree(*counts[k]) for k in self.names]
        self.grams = np.unique(np.concatenate([counts[k][0] for k in self.names])) if counts else np.zeros(0, np.uint32)
        self.costs = np.stack([t.cost(self.grams) for t in self.trees], 1).astype(np.float32) if counts else None

    def ready(self) -> "Model":
        if not hasattr(self, "slots"):
            self.slots = np.zeros(1 << self.SLOTS, np.int32)
            self.slots[self._slot(self.grams)] = np.arange(len(self.grams), dtype=np.int32)
        return self

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(2654435769)) >> np.uint32(32 - self.SLOTS)

    def bits(self, g: np.ndarray) -> np.ndarray:
        """A row of costs by language for each window."""
        at = self.slots[self._slot(g)]
        out = self.costs[at]
        if len(miss := np.flatnonzero(self.grams[at] != g)):
            kinds, inverse = np.unique(g[miss], return_inverse=True)
            out[miss] = np.stack([t.cost(kinds) for t in self.trees], 1).astype(np.float32)[inverse]
        return out

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        g, first, n = windows(data, off)
        out = np.zeros((len(n), len(self.names)))
        bits = self.bits(g)
        c = np.zeros(len(g) + 1)
        for k in range(len(self.names)):
            np.cumsum(bits[:, k], out=c[1:], dtype=float)
            out[:, k] = c[first + n] - c[first]
        return out


def train(docs: DataFrame, per_language: int = 200) -> Model:
    """Trees of every language in `docs` (doc_id, text, lang: training rows only)."""
    bounded_batches(docs.sparkSession)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = docs.filter("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang").withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id", "lang").distinct()

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {}
            langs = batch.column("lang").to_pylist()
            for lo, _, data, off in text_slices(batch.column("text")):
                g, first, n = windows(data, off)
                for r in range(len(n)):
                    out.setdefault(langs[lo + r], []).append(g[first[r] : first[r] + n[r]])
            for lang, parts in out.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = with_texts(docs, ids).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model({k: (x.gram.to_numpy().astype(np.uint32), x.n.to_numpy().astype(float)) for k, x in counted.groupby("lang") if len(x)})



def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value.ready()
        for batch in batches:
            names, scores = [], []
            for _, _, data, off in text_slices(batch.column("text")):
                ascii_letters = per_row(LETTER[LOWER[data]] & (data < 0x80), off)
                others = per_row(data >= 0x80, off)
                bits = m.lengths(data, off) if m.names else None
                for r in range(len(off) - 1):
                    if not m.names or not ascii_letters[r] and not (others[r] and any(map(str.isalpha, data[off[r] : off[r + 1]].tobytes().decode()))):
                        names.append(UND)
                        scores.append(0.0)
                        continue
                    b = bits[r]
                    best = int(np.argmin(b))
                    names.append(m.names[best])
                    scores.append(float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
