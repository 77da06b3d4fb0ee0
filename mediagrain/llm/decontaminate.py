"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, checked word by word.

The benchmark's word windows are hashed into sorted arrays (about 5 bytes for each of its own), which every
task holds. A task hashes all windows of its documents with numpy, asks a bit table, then the hash set, and
compares the words of each hit with the item's, so the result doesn't rest on hashes. Nothing is shuffled.

A benchmark over `block_mb` is cut into blocks by item, built one at a time in the driver; each block is a
job of its own over the documents, which carry their hit words along in a written table, so no broadcast
exceeds the bound (but for a single item that is longer by itself).

Nulls and odd cases: a null or empty text has no words and is clean; a null item id is the empty id;
items without words never occur; repeated items or item ids count once; an empty benchmark hits nothing;
repeated document rows are judged one by one; windows of equal words are one window, whose items all count;
a doc_id may be of any type. Other columns of the input, whatever their names, are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.components import written
from mediagrain.llm.textkit import ALNUM, LOWER, Words, bounded_batches, gram_hashes, inside, per_row, text_slices, window_sums, word_hashes


class Windows:
    """The distinct windows of some benchmark items.

    For each window length: the sorted hashes, the place of one such window in the benchmark's words, and the
    bounds of its items in `items`; a bit table answers most questions.
    """

    def __init__(self, table: pa.Table, n: int):
        """`table` has item_id and text."""
        self.ids = table.column("item_id").combine_chunks()
        data_, starts, ends, base, words = [], [], [], 0, 0
        found: dict[int, list] = {}
        for lo, _, data, off in text_slices(table.column("text")):
            w = Words(LOWER[data], off, ALNUM)
            rows, counts, h1, h2 = w.rows(), w.counts, word_hashes(w), word_hashes(w, 1)
            data_.append(w.data)
            starts.append(w.starts + base)
            ends.append(w.ends + base)
            at = np.flatnonzero(inside(rows, n))
            if len(at):
                found.setdefault(n, []).append((gram_hashes(h1, n)[at], gram_hashes(h2, n)[at], at + words, rows[at] + lo))
            for k in np.unique(counts[(counts > 0) & (counts < n)]).tolist():
                r = np.flatnonzero(counts == k)
                a, e = w.first[r], w.first[r] + k
                found.setdefault(k, []).append((window_sums(h1, a, e), window_sums(h2, a, e), a + words, r + lo))
            base += len(data)
            words += len(rows)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.data, self.starts, self.ends = join(data_, np.uint8), join(starts, np.uint32), join(ends, np.uint32)
        self.known, self.bits = {}, {}
        for k, parts in found.items():
            h, h2, at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, h2, h))
            h, h2, at, item = h[order], h2[order], at[order], item[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(new)
            self.known[k] = h[first], at[first].astype(np.uint32), np.append(first, len(h)).astype(np.int64), item.astype(np.int32)
            size = min(26, max(12, int(len(first) * 16 - 1).bit_length()))
            self.bits[k] = size, np.zeros(1 << size, bool)
            self.bits[k][1][h[first] >> np.uint64(64 - size)] = True

    def nbytes(self) -> int:
        parts = [self.data, self.starts, self.ends, *(a for x in self.known.values() for a in x), *(b for _, b in self.bits.values())]
        return sum(a.nbytes for a in parts)

    def _words(self, i: int, k: int) -> list[bytes]:
        return [self.data[self.starts[x] : self.ends[x]].tobytes() for x in range(i, i + k)]

    def mark(self, w: Words, hashes: np.ndarray, rows: np.ndarray, items: list[set]) -> np.ndarray:
        """Which words are inside an occurring window; adds the items (as numbers) to each text's set."""
        delta = np.zeros(len(hashes) + 1, np.int64)
        for k, (known, place, bounds, item) in self.known.items():
            g, (size, bits) = gram_hashes(hashes, k), self.bits[k]
            at = np.flatnonzero(bits[g >> np.uint64(64 - size)] & inside(rows, k))
            first = np.searchsorted(known, g[at])
            hit = first < len(known)
            hit[hit] = known[first[hit]] == g[at[hit]]
            for i, x in zip(at[hit].tolist(), first[hit].tolist(), strict=True):
                own = None
                while x < len(known) and known[x] == g[i]:
                    own = own or [w.data[w.starts[y] : w.ends[y]].tobytes() for y in range(i, i + k)]
                    if own == self._words(int(place[x]), k):
                        delta[i] += 1
                        delta[i + k] -= 1
                        items[rows[i]].update(item[bounds[x] : bounds[x + 1]].tolist())
                    x += 1
        return np.cumsum(delta[:-1]) > 0

    def names(self, items: set) -> list[str]:
        return [self.ids[i].as_py() for i in items]


def _kept(data: np.ndarray, w: Words, hit: np.ndarray, r: int) -> bytes:
    """A text without its runs of hit words (and what stands between the words of a run)."""
    a, b, lo, hi = w.first[r], w.first[r + 1], w.off[r], w.off[r + 1]
    h = hit[a:b].astype(np.int8)
    edge = np.diff(np.concatenate(([0], h, [0])))
    out, at = [], lo
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(data[at : w.starts[a + i]].tobytes())
        at = w.ends[a + j - 1]
    return b"".join([*out, data[at:hi].tobytes()])


def _blocks(items: DataFrame, block_mb: float) -> list:
    """For each of the benchmark's blocks of about `block_mb` a function that fetches its items."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // int(block_mb * (1 << 20))))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [lambda b=b: items.filter(block == b).toArrow() for b in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_mb: float = 16, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (array), and kept_text (hit spans cut out) if asked for."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(None).cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("item_ids"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("string").alias("kept_text"))
    schema = df.schema
    blocks = _blocks(items, block_mb)
    for b, fetch in enumerate(blocks):
        shared, last = spark.sparkContext.broadcast(Windows(fetch(), n)), b == len(blocks) - 1

        def run(batches, shared=shared, last=last, first=b == 0):
            windows: Windows = shared.value
            for batch in batches:
                text = batch.column("text")
                out = {"hits": [], "item_ids": [], "n_words": [], "n_hit": [], "kept_text": []}
                for lo, hi, data, off in text_slices(text):
                    w = Words(LOWER[data], off, ALNUM)
                    items = [set() for _ in range(hi - lo)]
                    hit = windows.mark(w, word_hashes(w), w.rows(), items)
                    names = [windows.names(x) for x in items]
                    if not first:
                        for r, old in enumerate(batch.column("hits").slice(lo, hi - lo).to_pylist()):
                            hit[np.asarray(old or [], np.int64) + w.first[r]] = True
                        names = [x + y for x, y in zip(names, batch.column("item_ids").slice(lo, hi - lo).to_pylist(), strict=True)]
                    hits = per_row(hit, w.first)
                    out["n_words"].append(w.counts)
                    out["n_hit"].append(hits)
                    out["item_ids"] += [sorted(set(x)) for x in names]
                    out["hits"] += [None] * (hi - lo) if last else [(np.flatnonzero(hit[w.first[r] : w.first[r + 1]])).tolist() for r in range(hi - lo)]
                    out["kept_text"] += [_kept(data, w, hit, r).decode() if h else None for r, h in enumerate(hits)] if last and with_text else [None] * (hi - lo)
                arrays = {"doc_id": batch.column("doc_id"), "text": text if with_text or not last else pa.nulls(len(text), text.type)}
                arrays["hits"] = pa.array(out["hits"], pa.list_(pa.int32()))
                arrays["item_ids"] = pa.array(out["item_ids"], pa.list_(pa.string()))
                for c in ("n_words", "n_hit"):
                    arrays[c] = pa.array(np.concatenate([np.zeros(0, np.int64), *out[c]]))
                arrays["kept_text"] = pa.array(out["kept_text"], pa.string())
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

        df = df.select("doc_id", "text", "hits", "item_ids", "n_words", "n_hit", "kept_text").mapInArrow(run, schema)
        if not last:
            df = written(df, "block")
            shared.unpersist()
    if with_text:
        df = df.withColumn("kept_text", F.coalesce("kept_text", "text"))
    return df.drop("hits", "text", *([] if with_text else ["kept_text"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5) -> DataFrame:
    """The documents with hit spans cut out of their text; those with more than `drop_share` of their words hit go.

    Returns the columns of `docs`; where a span was cut, n_chars (if there) is counted anew. Clean rows pass unchanged.
    """
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    keyed = docs.select(F.struct("doc_id", *rest).alias("doc_id"), "text")
    df = scan(keyed, benchmark, n, with_text=True).filter(F.col("n_hit") <= drop_share * F.col("n_words"))
    cut = F.col("n_hit") > 0
    cols = {c: F.col("doc_id")[c].alias(c) for c in names if c != "text"} | {"text": F.col("kept_text").alias("text")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("doc_id")["n_chars"]).cast(kind).alias("n_chars")
    return df.select(*[cols[c] for c in names])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    ids = F.array_sort("item_ids")
    return scan(docs, bench).select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bk AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bk)),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
