"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, per text, in numpy.

For each text: how many of its word characters lie in n-grams that repeat an earlier n-gram of the same
text (n = 5 to 10), and in lines that repeat an earlier line. A text is rejected when a share exceeds its
bound. Longer n-grams are only sought where a shorter one repeats, so one sort of the 3-word hashes does
most of the work. All work is inside the scan's tasks; nothing is shuffled or gathered.

Nulls and odd cases: a null or empty text has no words, so all its counts are 0 and it fails the base
rule; a null doc_id stays null; repeated rows are judged one by one; other columns are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.textkit import NOT_SPACE, Words, _table, bounded_batches, gram_hashes, inside, mix, per_row, text_slices, word_hashes

#: Largest share of word characters in repeated n-grams by n, and in repeated lines (fixed values, as published for web text).
MAX_GRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
SYMBOLS = _table(b"#*$%&|<>")
NOT_NEWLINE = ~_table(b"\n")


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which repeat an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def cover(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words the windows of k words at `at` hold."""
    d = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


def _of_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))


def measure(data: np.ndarray, off: np.ndarray, gram_sizes=tuple(MAX_GRAM_SHARE)) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    w = Words(data, off, NOT_SPACE)
    rows, n = w.rows(), len(w.starts)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & NOT_SPACE[data], out=points[1:])
    chars = points[w.ends] - points[w.starts]
    total = np.zeros(n + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    out = {"n_words": w.counts, "word_chars": np.diff(points[off]), "n_symbols": per_row(SYMBOLS[data], off)}

    lines = Words(data, off, NOT_NEWLINE)
    held = points[lines.ends] - points[lines.starts]  # a line's word characters
    line_rows = lines.rows()
    _, later = repeats(_of_row(word_hashes(lines, 3), line_rows))
    later &= held > 0
    out["n_dup_lines"] = per_row(later, lines.first)
    out["dup_line_chars"] = per_row(np.where(later, held, 0), lines.first)

    hashes = word_hashes(w)
    at = np.flatnonzero(inside(rows, 3))
    many, _ = repeats(_of_row(gram_hashes(hashes, 3)[at], rows[at])) if len(at) else (np.zeros(0, bool),) * 2
    at = at[many]
    out["n_repeat_words"] = per_row(cover(at, 3, n), w.first) if n else np.zeros(len(off) - 1, np.int64)
    for k in gram_sizes:
        at = at[at + k <= n]
        at = at[rows[at] == rows[at + k - 1]]
        many, later = repeats(_of_row(gram_hashes(hashes, k)[at], rows[at])) if len(at) else (np.zeros(0, bool),) * 2
        covered = cover(at[later], k, n)
        at = at[many]
        out[f"gram{k}_chars"] = per_row(np.where(covered, chars, 0), w.first)
    return out


def repetition_coverage(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of `measure` as longs."""
    bounded_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"gram{k}_chars" for k in MAX_GRAM_SHARE)]
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            parts = [measure(data, off) for _, _, data, off in text_slices(batch.column("text"))]
            cols = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)])) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept to the counts."""
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= MAX_LINE_SHARE * chars
    for k, most in MAX_GRAM_SHARE.items():
        fine &= F.col(f"gram{k}_chars") <= most * chars
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & fine)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge(repetition_coverage(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
