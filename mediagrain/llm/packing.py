"""Hierarchical multi-length packing into windows of several context sizes.

Each task tokenises its rows and packs them in bounded pools, so nothing is shuffled and memory doesn't
grow with the input. In a pool:

1. Route: whole longest windows are cut off long documents; what is left of each document goes to the
   smallest tier that holds it.
2. Pack each tier, longest first: a window takes the longest waiting piece of its tier, then the largest
   pieces that still fit, from its own or a shorter tier.
3. Fill: a gap that no whole piece fits is filled by cutting one from a shorter tier, so every window is
   full (a power of two) and needs no padding.
4. Balance: the pool's windows of a tier are dealt to step groups of equal token numbers in snake order of
   their attention cost (the sum of squared piece lengths).

What is left when a task ends goes down through the tiers as full windows; only the last, shorter than the
smallest tier, is padded. sequence_id = task's partition * 2**36 + a running number, step_group alike; a
task that is run anew reads the same rows in the same order and so gives the same ids.

A DataFrame that isn't read from files alone (a join, a shuffle) is written to the shared folder first, because
a task that is run anew must see the same rows in the same order.

Nulls and odd cases: a null text is the empty text, whose document is the closing token alone; an empty
table gives no rows; repeated rows are packed one by one; very long texts are cut over many windows; pieces of
equal length are taken by row order; a doc_id may be null or of any type; other columns, whatever their names,
are never looked at.
"""

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.components import written
from mediagrain.llm.textkit import bounded_batches, column_bytes

TIERS = (256, 512, 1024, 2048)
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: Latin letters, then ASCII punctuation: the tokenizer lower-cases the former and always splits between the two.
STEM = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+)([!-/:-@\[-`{-~]*)")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, by a bounded cache of white-space-separated words.

    The tokenizer normalises white space to one space, drops it, and never joins across it, so the ids of
    a text are those of its words in turn. A new word of Latin letters and closing punctuation is coded as
    its lower-cased letters and its punctuation, which other words share; for these the vocabulary's merges
    are asked directly, as there is nothing else to normalise or split. Other words take the whole way.
    """

    def __init__(self, path: str, room: int):
        from tokenizers import Tokenizer

        self.encoder, self.known, self.room = Tokenizer.from_file(path), {}, room
        self.merges, self.alphabet = self.encoder.model, _byte_alphabet()

    def _piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.merges.tokenize(plain)], "<u4").tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, whole = self.known, []
        for w in new:
            if m := STEM.fullmatch(w.decode()):
                stem, rest = m[1].lower(), m[2]
                if (key := stem.encode()) not in known:
                    known[key] = self._piece(stem)
                ids = known[key]
                if rest:
                    if (tail := rest.encode()) not in known:
                        known[tail] = self._piece(rest)
                    ids += known[tail]
                known[w] = ids
            else:
                whole.append(w)
        for lo in range(0, len(whole), 4096):
            part = whole[lo : lo + 4096]
            coded = self.encoder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in coded), strict=True))

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split() for t in texts]
        known = self.known
        new = {w for words in split for w in words if w not in known}
        if len(known) + 2 * len(new) > self.room:  # keeps the words at hand, frequent ones among them
            self.known = known = {w: known[w] for words in split for w in words if w in known}
        self._learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]


_coders: dict[tuple[str, int], WordIds] = {}


def coder_for(path: str, room: int) -> WordIds:
    """This worker's coder, kept from task to task."""
    if (path, room) not in _coders:
        _coders.clear()
        _coders[path, room] = WordIds(path, room)
    return _coders[path, room]


class Packer:
    """Packs pieces (row, start, length) into windows; `closed` gets a list of pieces for each."""

    def __init__(self, tiers=TIERS):
        self.tiers = tiers
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.tokens = 0

    def add(self, row: int, length: int) -> list[list[tuple[int, int, int]]]:
        """Routes a document; returns the whole longest windows that it fills by itself."""
        most = self.tiers[-1]
        whole = length // most
        left = length - whole * most
        if left:
            self.waiting[next(t for t in self.tiers if t >= left)].append((row, whole * most, left))
            self.tokens += left
        return [[(row, i * most, most)] for i in range(whole)]

    def _take(self, size: int, room: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of at most `room` tokens, from tier `size` or a shorter one."""
        for t in reversed(self.tiers):
            pieces = self.waiting[t]
            if t <= size and pieces and pieces[-1][2] <= room:
                lo, hi = 0, len(pieces)  # pieces are sorted longest first: the first that fits
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if pieces[mid][2] <= room else (mid + 1, hi)
                return pieces.pop(lo)
        return None

    def _cut(self, size: int, room: int) -> list[tuple[int, int, int]]:
        """`room` tokens off a longer piece, from the shortest tier that has one."""
        for t in self.tiers:
            if t <= size and self.waiting[t] and self.waiting[t][0][2] > room:
                row, start, length = self.waiting[t].pop(0)
                rest = (row, start + room, length - room)
                to = self.waiting[next(x for x in self.tiers if x >= rest[2])]
                lo, hi = 0, len(to)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if to[mid][2] > rest[2] else (lo, mid)
                to.insert(lo, rest)
                return [(row, start, room)]
        return []

    def drain(self, last: bool) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(tier, pieces) of every full window that the waiting pieces make; if last, of all that is left."""
        out = []
        for t in self.tiers:
            self.waiting[t].sort(key=lambda p: (-p[2], p[0], p[1]))
        for size in reversed(self.tiers):
            below = [t for t in self.tiers if t <= size]
            while self.waiting[size] or last:
                many = size != self.tiers[0] and len(self.waiting[size]) >= 8  # each over size / 2
                there = size if many else sum(p[2] for t in below for p in self.waiting[t])
                if there < size:
                    break
                window, room = [], size
                while room and (p := self._take(size, room)):
                    window.append(p)
                    room -= p[2]
                if room:
                    window += self._cut(size, room)
                out.append((size, window))
        if last and (rest := [p for t in self.tiers for p in self.waiting[t]]):
            out.append((self.tiers[-1], rest))
            self.waiting = {t: [] for t in self.tiers}
        self.tokens = sum(p[2] for t in self.tiers for p in self.waiting[t])
        return out


def step_groups(windows: list[tuple[int, list]], step_tokens: int, longest: int) -> list[int]:
    """A group number for each window: groups of a tier have equal token numbers and like attention costs."""
    out, base = [0] * len(windows), 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(i)
    for tier, own in sorted(by_tier.items()):
        groups = -(-len(own) * tier // step_tokens)
        own.sort(key=lambda i: (-sum(p[2] ** 2 for p in windows[i][1]), i))
        for k, i in enumerate(own):
            turn, place = divmod(k, groups)
            out[i] = base + (place if turn % 2 == 0 else groups - 1 - place)
        base += groups
    return out


def from_files(df: DataFrame) -> bool:
    """Whether the rows come from files by narrow steps alone, so that a task sees the same rows each time it is run."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(any(x in line for x in ("Project ", "Filter ", "Relation ")) for line in plan.splitlines() if line.strip())


def pack(docs: DataFrame, tokenizer: str, tiers=TIERS, end_id: int = 1, pool_tokens: int = 1 << 19, step_tokens: int = 32_768, cache_words: int = 800_000) -> DataFrame:
    """One row per piece: doc_id and the columns of SCHEMA."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        coder = coder_for(tokenizer, cache_words)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        packer, rows, sequence, group = Packer(tiers), {}, 0, 0
        seen, windows = 0, []

        def flush(last: bool):
            nonlocal sequence, group, windows, rows
            windows += packer.drain(last)
            found = step_groups(windows, step_tokens, tiers[-1])
            out = []
            for (tier, pieces), g in zip(windows, found, strict=True):
                at = 0
                for row, start, length in pieces:
                    doc, ids = rows[row]
                    out.append((doc, start, length, crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + sequence, at, tier, base + group + g))
                    at += length
                sequence += 1
            group += max(found, default=-1) + 1
            windows = []
            kept = {p[0] for t in tiers for p in packer.waiting[t]}
            rows = {k: v for k, v in rows.items() if k in kept}
            cols = list(zip(*out, strict=True)) if out else [[]] * (len(names) + 1)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *(pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, cols[1:], strict=True))], names=["doc_id", *names])

        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            raw, off = column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(ids), 256):
                hi = min(len(ids), lo + 256)
                for r, coded in enumerate(coder.texts([raw[off[i] : off[i + 1]].tobytes() for i in range(lo, hi)]), lo):
                    rows[seen] = (ids[r], coded + end)
                    windows += [(tiers[-1], w) for w in packer.add(seen, len(coded) // 4 + 1)]
                    seen += 1
                    if packer.tokens + len(windows) * tiers[-1] >= pool_tokens:
                        yield flush(False)
        if doc_type is not None and rows:
            yield flush(True)

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not from_files(rows):
        rows = written(rows, "to_pack")
    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
