"""Substring de-duplication by a log-structured fingerprint index.

Words that lie in a window of `window` consecutive words which also starts in an earlier document (smaller
doc_id) are removed. The windows of a text are indexed in segments: of the word grams inside a window the
one with the least hash is its anchor, and consecutive windows with one anchor hash are a segment (so a
word repeated a thousand times is one segment). Equal windows have equal anchors, so each window of the
corpus is found under its anchor's hash, at about two rows for `window - gram + 1` words. A segment's
content is named by a BLAKE2 digest of its words.

The index is a folder with a manifest and immutable runs: tables bucketed and sorted by anchor hash, and
dealt out by it. `add` takes the next batch of documents (ids above those of the runs):

1. its segments are scanned; of equal segments that meet in a task only the earliest goes on to the new
   run, the others know their match already (so a hot group of copies is a row for each task);
2. the run is merge-joined with itself and with the older runs on the anchor hash, without a shuffle;
3. a segment whose content is known from an earlier document removes all its windows. Where an anchor has
   several segments (at the edges of a shared passage), one document of each segment lists its windows,
   which are compared one by one, by digest;
4. verification: the ranges to be removed are merged by earlier document and shift, the earlier document's
   words are fetched in cells of `CELL` words, and a range goes only if all its words equal the fetched ones;
5. every `fanout` runs of a level are compacted into one run of the next, which keeps one row (the
   earliest) for each segment; the manifest then names the new list of runs.

Nothing grows with the square of a group; hot keys of the joins are spread (`spread_join`). An index
outlives its driver: `SubstringIndex.open` takes the folder of an earlier one, `drop` deletes it.

Nulls and odd cases: a null or empty text has no words; rows with a null doc_id are kept whole and
remove nothing; of rows that share a doc_id none removes words of another; an empty table gives no rows;
texts shorter than a window are kept whole; a doc_id that isn't an integer is refused; other columns,
whatever their names, are never looked at.
"""

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mediagrain.llm.components import new_folder, removed, sent, spread_join, written
from mediagrain.llm.textkit import NOT_SPACE, Words, bounded_batches, gram_hashes, inside, signed, text_slices, word_hashes

RUN = "g long, s long, doc_id long, a int, t int"
MANIFEST = "version long, level int, run string, window int, gram int, fanout int, buckets int"
#: Words of an earlier document are fetched in cells of so many words, counted from its first word.
CELL = 32
U64 = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Plain:
    """The words of a slice joined by one space, with the bounds of each."""

    def __init__(self, w: Words):
        raw, words = w.data.tobytes(), []
        for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True):
            words += raw[a:b].split()
        self.words, self.joined = words, b" ".join(words)
        size = w.ends - w.starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit BLAKE2 digest of words first to end-1 of each pair."""
        joined, lo, hi = self.joined, self.starts[first].tolist(), self.ends[end - 1].tolist()
        return np.frombuffer(b"".join(blake2b(joined[x:y], digest_size=8).digest() for x, y in zip(lo, hi, strict=True)), np.int64)


def segments(w: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content digest, text, first window, number of windows) of each segment of a slice."""
    rows = w.rows()
    if len(rows) < window:
        return (np.zeros(0, np.int64),) * 5
    g = gram_hashes(word_hashes(w), gram)
    place = np.arange(len(g), dtype=U64)
    least = sliding_min((g & U64(0xFFFFFFFF00000000)) | place, window - gram + 1)
    at = np.flatnonzero(inside(rows, window))
    anchor = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
    hashes = g[anchor]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(fresh)
    t = np.diff(np.append(heads, len(at)))
    first = at[heads]
    s = Plain(w).digests(first, first + t - 1 + window)
    return signed(hashes[heads]), s, rows[first], first - w.first[rows[first]], t


def _scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The columns of RUN with (f, fa): the document and place of an equal segment of an earlier document in the same batch of rows, or nulls."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = []
            for lo, _, data, off in text_slices(batch.column("text")):
                g, s, row, a, t = segments(Words(data, off, NOT_SPACE), window, gram)
                parts.append((g, s, ids[lo + row].astype(np.int64), a, t))
            if not parts:
                continue
            g, s, doc, a, t = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((a, doc, s, g))
            g, s, doc, a, t = g[order], s[order], doc[order], a[order], t[order]
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
            later = doc[head] < doc
            f, fa = pa.array(doc[head], mask=~later), pa.array(a[head].astype(np.int32), mask=~later)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(doc), pa.array(a.astype(np.int32)), pa.array(t.astype(np.int32)), f, fa], names=["g", "s", "doc_id", "a", "t", "f", "fa"])

    return docs.filter("doc_id is not null and text is not null").mapInArrow(run, f"{RUN}, f long, fa int")


def _lists(column, fields) -> tuple[np.ndarray, list]:
    """Bounds of each row's part in the flattened fields of a column of arrays of structs; a null has none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate(([0], np.cumsum(sizes))), [flat.field(f) for f in fields]


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """A hash and a digest (w1, w2) of the windows of wanted segments: wanted has doc_id and spans, an array of (a, t)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            bounds, lists = _lists(batch.column("spans"), "at")
            start, count = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            for lo, hi, data, off in text_slices(batch.column("text")):
                w = Words(data, off, NOT_SPACE)
                x, y = bounds[lo], bounds[hi]
                t = count[x:y]
                row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])), t)
                pos = np.repeat(start[x:y], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                fits = pos + window <= w.counts[row]
                pos, row = pos[fits], row[fits]
                at = w.first[row] + pos
                w1 = gram_hashes(word_hashes(w), window)[at] if len(at) else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(Plain(w).digests(at, at + window)), pa.array(ids[lo + row].astype(np.int64)), pa.array(pos.astype(np.int32))], names=["w1", "w2", "doc_id", "a"])

    return docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "w1 long, w2 long, doc_id long, a int")


def _cells(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words (joined by one space) of wanted cells: wanted has doc_id and cells, an array of (cell, n); gives f, cell, n, words."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            bounds, lists = _lists(batch.column("cells"), ("cell", "n"))
            cell, n = (x.to_pylist() for x in lists)
            for lo, hi, data, off in text_slices(batch.column("text"), 8 << 20):
                raw, out = data.tobytes(), []
                for r in range(hi - lo):
                    words = raw[off[r] : off[r + 1]].split()
                    out += [(ids[lo + r], cell[k], n[k], b" ".join(words[cell[k] * CELL : (cell[k] + 1) * CELL])) for k in range(bounds[lo + r], bounds[lo + r + 1])]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["f", "cell", "n", "words"])

    return docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "cells").mapInArrow(run, "f long, cell int, n long, words binary")


def _equal(words: list[bytes], a: int, e: int, shift: int, cell: int, other: list[bytes]) -> bool:
    """Whether words a to e-1 of a document, as far as the cell holds them, are those of the earlier document, which stand `shift` words further on there."""
    lo, hi = max(a + shift, cell * CELL), min(e + shift, (cell + 1) * CELL)
    return len(other) >= hi - cell * CELL and words[lo - shift : hi - shift] == other[lo - cell * CELL : hi - cell * CELL]


def _cut(docs: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: of docs (doc_id, text, ranges: array of (a, e, shift, cell, words) or null)."""

    def run(batches):
        for batch in batches:
            bounds, lists = _lists(batch.column("ranges"), ("a", "e", "shift", "cell", "words"))
            found = list(zip(*(x.to_pylist() for x in lists), strict=True))
            n_words, n_removed, shas, texts = [], [], [], []
            for lo, hi, data, off in text_slices(batch.column("text")):
                raw = data.tobytes()
                for r in range(hi - lo):
                    words = raw[off[r] : off[r + 1]].split()
                    n = len(words)
                    seen: dict[tuple[int, int, int], dict[int, bool]] = {}
                    for a, e, shift, cell, other in found[bounds[lo + r] : bounds[lo + r + 1]]:
                        cells = seen.setdefault((a, e, shift), {})
                        cells[cell] = cells.get(cell, False) or e <= n and _equal(words, a, e, shift, cell, other.split())
                    gone = [(a, e) for (a, e, shift), cells in seen.items() if all(cells.values()) and len(cells) == (e + shift - 1) // CELL - (a + shift) // CELL + 1]
                    if gone:
                        at = 0
                        kept = []
                        for a, e in sorted(gone):
                            kept += words[at:a] if a > at else []
                            at = max(at, e)
                        words = kept + words[at:]
                    left = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    shas.append(sha256(left).hexdigest())
                    texts.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = docs.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def _islands(matches: DataFrame) -> DataFrame:
    """(doc_id, f, shift, a, e): overlapping and touching matches (doc_id, a, e, f, fa) of one earlier document and shift as one range."""
    same = Window.partitionBy("doc_id", "f", "shift").orderBy("a", "e")
    rows = matches.select("doc_id", "f", (F.col("fa") - F.col("a")).alias("shift"), "a", "e")
    rows = rows.withColumn("fresh", (F.col("a") > F.coalesce(F.max("e").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    rows = rows.withColumn("k", F.sum("fresh").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "f", "shift", "k").agg(F.min("a").alias("a"), F.max("e").alias("e")).drop("k")


def _known(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have an id."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class SubstringIndex:
    """An index folder: its runs and the operations on them."""

    def __init__(self, spark: SparkSession, window: int = 50, gram: int = 16, fanout: int = 4, buckets: int | None = None, folder: str | None = None):
        bounded_batches(spark)
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or new_folder(spark, "index")
        self.runs: list[tuple[int, str]] = []  # (level, table)
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "SubstringIndex":
        """The index that another driver left in `folder`, as of its last manifest."""
        listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
        last = listed.filter(F.col("version") == (listed.agg(F.max("version")).first()[0] or 0)).collect()
        out = cls(spark, last[0].window, last[0].gram, last[0].fanout, last[0].buckets, folder)
        out.version, out.runs = last[0].version, [(r.level, r.run) for r in last if r.run]
        for _, name in out.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (g LONG, s LONG, doc_id LONG, a INT, t INT) USING parquet CLUSTERED BY (g) SORTED BY (g, s) INTO {out.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return out

    def _save(self) -> None:
        self.version += 1
        own = (self.window, self.gram, self.fanout, self.buckets)
        rows = [(self.version, level, name, *own) for level, name in self.runs] or [(self.version, None, None, *own)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _write_run(self, rows: DataFrame, level: int) -> str:
        name = new_folder(self.spark, "run").rsplit("/", 1)[1].replace("-", "_")
        dealt = rows.repartition(self.buckets, "g")
        dealt.write.bucketBy(self.buckets, "g").sortBy("g", "s").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        self.runs.append((level, name))
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Takes the tables out of this session; the folder stays."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Deletes the index."""
        self.close()
        removed(self.spark, self.folder)
        self.runs = []

    def compact(self) -> None:
        """Merges the runs of every full level into one run of the next."""
        level, old = 0, []
        while self.runs and level <= max(k for k, _ in self.runs):
            own = [name for k, name in self.runs if k == level]
            if len(own) >= self.fanout:
                self.runs = [x for x in self.runs if x[0] != level]
                rows = self.spark.table(own[0])
                for name in own[1:]:
                    rows = rows.unionByName(self.spark.table(name))
                rows = rows.groupBy("g", "s").agg(F.min(F.struct("doc_id", "a", "t")).alias("x")).select("g", "s", "x.*")
                self._write_run(rows, level + 1)
                old += own
            level += 1
        self._save()
        for name in old:  # only after the manifest stopped naming them
            self._forget(name)

    def add(self, batch: DataFrame, history: DataFrame | None = None, with_text: bool = False) -> DataFrame:
        """Indexes the batch and returns its rows as `_cut` does; `history` holds the documents of the older runs."""
        spark, work = self.spark, new_folder(self.spark, "add")
        keep = lambda df, name: written(df, name, work)
        batch = _known(batch)
        named = batch.filter("doc_id is not null")
        older = _known(history).filter("doc_id is not null") if history is not None and self.runs else None
        old = [spark.table(name) for _, name in self.runs]
        scanned = keep(_scan(batch, self.window, self.gram), "scan")
        new = spark.table(self._write_run(scanned.filter("f is null").drop("f", "fa"), 0))

        by_anchor = new.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        known = F.col("lo") < F.col("hi")
        for k, run in enumerate(old):
            by_anchor = by_anchor.join(run.groupBy("g").agg(F.lit(True).alias(f"known{k}")), "g", "left")
            known |= F.col(f"known{k}").isNotNull()
        shared = by_anchor.filter(known).select("g")
        rows = new.join(shared, "g").withColumn("new", F.lit(True))
        for run in old:
            rows = rows.unionByName(run.join(shared, "g", "left_semi").withColumn("new", F.lit(False)))
        rows = keep(rows, "shared")

        first = rows.groupBy("g", "s").agg(F.min(F.struct("doc_id", "a")).alias("x"), F.count("*").alias("n"))
        first = keep(first.select("g", "s", F.col("x.doc_id").alias("f"), F.col("x.a").alias("fa"), "n"), "first")
        judged = keep(spread_join(rows, first, ["g", "s"]).filter("f = doc_id or new").select("g", "doc_id", "a", "t", "new", "f", "fa"), "judged")
        whole = judged.filter("f < doc_id").select("doc_id", "a", "t", "f", "fa").unionByName(scanned.filter("f is not null").select("doc_id", "a", "t", "f", "fa"))
        matches = whole.select("doc_id", "a", (F.col("a") + F.col("t") - 1 + self.window).alias("e"), "f", "fa")

        heads = judged.filter("f = doc_id").select("g", "doc_id", "a", "t", "new")
        several = keep(heads.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("g", "n"), "several")
        listed = spread_join(heads, several, ["g"])
        spans = keep(listed.groupBy("doc_id", "new").agg(F.collect_set(F.struct("a", "t")).alias("spans")), "spans")
        windows = _windows(named, spans.filter("new").drop("new"), self.window)
        if older is not None:
            windows = windows.unionByName(_windows(self._only(older, spans.filter("not new")), spans.filter("not new").drop("new"), self.window))
        windows = keep(windows, "windows")
        earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "a")).alias("x"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("x.doc_id < last")
        earliest = keep(earliest.select("w1", "w2", F.col("x.doc_id").alias("f"), F.col("x.a").alias("fa"), "n"), "earliest")
        single = spread_join(windows, earliest, ["w1", "w2"]).filter("f < doc_id")
        matches = matches.unionByName(single.select("doc_id", "a", (F.col("a") + self.window).alias("e"), "f", "fa"))

        cell = F.sequence(F.floor((F.col("a") + F.col("shift")) / CELL).cast("int"), F.floor((F.col("e") + F.col("shift") - 1) / CELL).cast("int"))
        need = keep(_islands(matches).withColumn("cell", F.explode(cell)), "islands")
        wanted = need.groupBy("f", "cell").agg(F.count("*").alias("n"))
        wanted = keep(wanted.groupBy(F.col("f").alias("doc_id")).agg(F.collect_list(F.struct("cell", "n")).alias("cells")), "wanted")
        cells = _cells(named, wanted)
        if older is not None:
            cells = cells.unionByName(_cells(self._only(older, wanted), wanted))
        ranges = spread_join(need, keep(cells, "cells"), ["f", "cell"])
        ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("a", "e", "shift", "cell", "words")).alias("ranges"))
        out = written(_cut(batch.join(ranges, "doc_id", "left"), with_text), "kept")
        removed(spark, work)
        self.compact()
        return out

    def _only(self, history: DataFrame, ids: DataFrame) -> DataFrame:
        """The history's rows with these ids: read past the others where the ids fit a broadcast, else left to the join's own filters."""
        return history.join(sent(ids.select("doc_id")), "doc_id", "left_semi")


def dedup_substrings(docs: DataFrame, batches: int = 2, window: int = 50, with_text: bool = False, gram: int = 16, fanout: int = 2) -> DataFrame:
    """All documents, added to a new index in `batches` batches by doc_id; the index is dropped at the end.

    With a fan-out of two every second batch ends with a compaction, after which the next ones are joined with the merged run.
    """
    index = SubstringIndex(docs.sparkSession, window, gram, fanout)
    cuts = _known(docs).agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    parts, before = [], None
    for k in range(len(cuts) + 1):
        inside_ = F.lit(True)
        if k:
            inside_ &= F.col("doc_id") > cuts[k - 1]
        if k < len(cuts):
            inside_ &= F.col("doc_id") <= cuts[k]
        inside_ = inside_ if k else F.col("doc_id").isNull() | inside_
        parts.append(index.add(docs.filter(inside_), before, with_text))
        if k < len(cuts):
            before = docs.filter(F.col("doc_id") <= cuts[k])
    index.drop()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
