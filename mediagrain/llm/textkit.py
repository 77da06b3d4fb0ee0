"""Vectorised text primitives that run inside Arrow tasks.

A task gets Arrow batches; `text_slices` cuts a batch into runs of rows of bounded bytes, and the
functions below work on the bytes of such a run at once: word bounds, 64-bit word hashes and hashes of
word windows. A window's hash is built from those of its halves, doubling the length with a mixing step
each time, so all windows of a length cost its logarithm; equal words give equal hashes in any task.
"""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64


def _table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: Bytes of words: everything but ASCII white space; ASCII digits, lower-case letters and all non-ASCII.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def bounded_batches(spark, megabytes: int = 8) -> None:
    """Keeps the Arrow batches of this session to a few MB whatever the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def text_slices(col, limit: int = SLICE_BYTES):
    """Yields (first row, end row, bytes, offsets): runs of rows of about `limit` bytes, or one longer row."""
    raw, off = column_bytes(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Word bounds of a run of texts: `starts`, `ends` (byte positions) and `first` (word index of each text, and the total)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray):
        self.data, self.off = data, off
        m = kind[data]
        before, after = np.zeros_like(m), np.zeros_like(m)
        before[1:], after[:-1] = m[:-1], m[1:]
        heads = off[:-1][off[:-1] < off[1:]]
        before[heads] = False
        after[heads[heads > 0] - 1] = False
        self.starts = np.flatnonzero(m & ~before)
        self.ends = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.first[-1] = len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def join(self, i: int, j: int) -> bytes:
        """Words i to j-1, joined by one space."""
        d, s, e = self.data, self.starts, self.ends
        return b" ".join(d[s[x] : e[x]].tobytes() for x in range(i, j))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order; no sum or product of the parts survives it, so like halves can't cancel out."""
    t = (a ^ (a >> U64(31))) * U64(0x9FB21C651E98DF25) + (b ^ (b >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return t ^ (t >> U64(32))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def span_hasher(data: np.ndarray, seed: int = 0):
    """A function of (starts, ends) that gives 64-bit hashes of data[start:end].

    Eight bytes at a time are mixed with their block's number before they are added up.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    own = U64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix(eight[starts] & _LOW_BYTES[np.minimum(size, 8)] ^ own)
        if len(long := np.flatnonzero(size > 8)):
            blocks = (size[long] - 1) // 8
            first = np.cumsum(blocks) - blocks
            number = np.arange(blocks.sum()) - np.repeat(first, blocks) + 1
            at = np.repeat(starts[long], blocks) + 8 * number
            left = np.minimum(np.repeat(ends[long], blocks) - at, 8)
            h[long] += np.add.reduceat(mix((eight[at] & _LOW_BYTES[left]) ^ (own + number.astype(U64) * U64(0xC2B2AE3D27D4EB4F))), first)
        return mix(h + size.astype(U64) * U64(0x9E3779B97F4A7C15))

    return of


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hasher(w.data, seed)(w.starts, w.ends)


def _of_length(size, seed: int):
    return mix(np.atleast_1d(np.asarray(size)).astype(U64) + U64((seed + 1) << 40))


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair of bounds: of the two halves that cover it, each of a power of two."""
    size, out = ends - starts, np.zeros(len(starts), U64)
    most, width, h = int(size.max(initial=0)), 1, values
    while width <= most:
        m = np.flatnonzero((size >= width) & (size < 2 * width))
        out[m] = combine(h[starts[m]], h[ends[m] - width])
        width *= 2
        if width <= most:
            h = combine(h[: len(h) - width // 2], h[width // 2 :])
    return out ^ _of_length(size, seed)


def gram_hashes(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive values (across texts too: mask with `inside`)."""
    n, width, h = len(values) - k + 1, 1, values
    if n <= 0:
        return np.zeros(0, U64)
    while 2 * width <= k:
        h = combine(h[: len(h) - width], h[width:])
        width *= 2
    return combine(h[:n], h[k - width : k - width + n]) ^ _of_length(k, seed)


def inside(rows: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k words from each word on stays in its text."""
    return rows[: len(rows) - k + 1] == rows[k - 1 :] if len(rows) >= k else np.zeros(0, bool)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of `flags` between consecutive bounds."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[bounds])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
