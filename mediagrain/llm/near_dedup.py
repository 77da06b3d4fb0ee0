"""MinHash near-de-duplication with sequential Bayesian verification.

Documents are sets of word shingles; two link when 100 * |A and B| >= percent * |A or B|. Every link that is
returned is confirmed on the full sets; the result is the connected components. Steps:

1. Sketch (one pass over the texts): set size, a 128-bit digest of the set, `BANDS * ROWS` min-hashes, of
   which a byte each is the signature, and a key for each band of `ROWS` of them. Equal sets are one (the head).
2. Candidates are heads that share a band's key. A bucket's holders are counted, never listed: each holder
   meets the bucket's smallest id, and these pairs, a few for a document, are verified on their signatures.
   Only buckets whose holders aren't in one component by then are looked at again: in nodes of at most
   `node_docs`, each by itself and with pivots first, and then what is outside the largest component.
3. Signatures are compared `BATCH` hashes at a time. After each batch a pair is dropped if the posterior
   probability of a similarity of `percent` or more, from a uniform prior and the matches so far, is below
   `miss`; the least number of matches that stays is worked out once (`least_matches`).
4. What survives forms close groups. Their texts are read again; pairs that aren't connected yet go through
   the same sequential comparison, and survivors are tested on the full sets.

A pair at exactly the bound shares no band with probability (1 - 0.8 ** 6) ** 40 = 5e-6; a pair of higher
similarity less. Bands and batches decide cost and these odds only.

Nulls and odd cases: null and empty texts have no shingles and link with nothing; a text of fewer than
`size` words is one shingle; rows with a null doc_id are their own (null) component; rows that share a doc_id
are one document for linking; of equal sets the smallest id names the group (ties can't arise); an empty
table gives no rows; other columns, whatever their names, are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrain.llm.components import components, sent, spread_join, written
from mediagrain.llm.shingle_join import _by_unit, _grouped, labelled, links_in_groups, set_digest, shingle_sets
from mediagrain.llm.textkit import bounded_batches, combine, mix, signed, text_slices

U64 = np.uint64
BANDS, ROWS, BATCH = 40, 6, 40
HASHES = BANDS * ROWS
#: One odd multiplier for each hash function, spread over all 64 bits.
FACTORS = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def min_hashes(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """A row of HASHES 32-bit minima for each set (that isn't empty); some `block` shingles at a time."""
    out, i = np.zeros((len(sets), HASHES), np.uint32), 0
    sizes = np.array([len(s) for s in sets], np.int64)
    while i < len(sets):
        j, room = i + 1, block - sizes[i]
        while j < len(sets) and sizes[j] <= room:
            room -= sizes[j]
            j += 1
        run = np.concatenate(sets[i:j])
        starts = np.cumsum(sizes[i:j]) - sizes[i:j]
        hashed = np.empty_like(run)
        for k, factor in enumerate(FACTORS):
            np.multiply(run, factor, out=hashed)
            out[i:j, k] = np.minimum.reduceat(hashed, starts) >> U64(32)
        i = j
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 32-bit key of each band."""
    parts = minima.astype(U64).reshape(len(minima), BANDS, ROWS)
    key = mix(parts[:, :, 0])
    for r in range(1, ROWS):
        key = combine(key, mix(parts[:, :, r] + U64(r << 32)))
    return (key >> U64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest), sig (a byte of each min-hash) and bands (null for an empty set)."""

    def run(batches):
        for batch in batches:
            sets = [s for _, _, data, off in text_slices(batch.column("text")) for s in shingle_sets(data, off, size)]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            minima = min_hashes([sets[i] for i in full])
            at = np.full(len(sets), -1)
            at[full] = np.arange(len(full))
            place = pa.array(at, mask=at < 0)
            sig = pa.array([row.tobytes() for row in (minima & np.uint32(255)).astype(np.uint8)], pa.binary()).take(place)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(full) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_keys(minima).ravel())).take(place)
            d = np.array([set_digest(s) for s in sets], U64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(signed(d[:, 0].copy())), pa.array(signed(d[:, 1].copy())), sig, keys], names=["doc_id", "n", "d1", "d2", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary, bands array<int>")


def least_matches(percent: int, miss: float, hashes: int = HASHES, batch: int = BATCH, values: int = 256) -> np.ndarray:
    """After each batch, the least number of matches with which a pair may still have the wanted similarity.

    A hash matches with probability s + (1 - s) / values at similarity s; the prior of s is uniform.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / values
    wanted, out = 100 * s >= percent, []
    for k in range(batch, hashes + 1, batch):
        m = np.arange(k + 1)[:, None]
        weight = m * np.log(p) + (k - m) * np.log1p(-p)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        out.append(int(np.argmax(weight[:, wanted].sum(1) / weight.sum(1) >= miss)))
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """The pairs of signatures (rows of `a` and `b`; one of them may be a single row) that no batch drops."""
    left, count = np.arange(max(len(a), len(b))), np.zeros(max(len(a), len(b)), np.int64)
    for k, bound in enumerate(least):
        cut = slice(k * batch, (k + 1) * batch)
        x, y = (v[:, cut] if len(v) == 1 else v[left, cut] for v in (a, b))
        count = count + (x == y).sum(1)
        stay = count >= bound
        left, count = left[stay], count[stay]
    return left


def signatures(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), HASHES)


def spanning(unit: np.ndarray, sig: np.ndarray, sides: np.ndarray, least: np.ndarray, test=None) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs in each unit for which `test(i, j)`, if given, holds.

    Sides are 0, 1 or 2: two documents of side 1, or two of side 2, meet elsewhere.
    """
    out, label = [], np.arange(len(unit))
    ends = np.append(np.flatnonzero(np.diff(unit)) + 1, len(unit))
    for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
        for i in range(lo, hi - 1):
            j = np.arange(i + 1, hi)
            apart = label[j] != label[i]
            if sides[i]:
                apart &= sides[j] != sides[i]
            j = j[apart]
            if not len(j):
                continue
            for k in j[survivors(sig[i : i + 1], sig[j], least)]:
                if label[k] != label[i] and (test is None or test(i, k)):
                    label[lo:hi][label[lo:hi] == label[k]] = label[i]
                    out.append((i, k))
    return out


def link_signatures(units: DataFrame, least: np.ndarray) -> DataFrame:
    """Pairs whose signatures survive; rows: unit, side, doc_id, sig."""
    return _by_unit(units, ["sig"], lambda unit, held, sides: spanning(unit, signatures(held), sides, least), lambda batch: batch.column("sig").to_pylist(), len)


def link_texts(units: DataFrame, percent: int, size: int, least: np.ndarray) -> DataFrame:
    """Links confirmed on full sets; rows: unit, side, doc_id, sig, text."""

    def work(unit, held, sides):
        sets, sig = zip(*held, strict=True)

        def test(i: int, k: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            return 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both)

        return spanning(unit, signatures(sig), sides, least, test)

    def prepare(batch):
        sig = iter(batch.column("sig").to_pylist())
        for _, _, data, off in text_slices(batch.column("text")):
            for s in shingle_sets(data, off, size):
                known = next(sig)
                yield (s, known) if len(s) else None

    return _by_unit(units, ["sig", "text"], work, prepare, lambda x: 8 * len(x[0]) + HASHES)


def link_pairs(pairs: DataFrame, least: np.ndarray) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that survive."""

    def run(batches):
        for batch in batches:
            kept = survivors(signatures(batch.column("sig_a").to_pylist()), signatures(batch.column("sig_b").to_pylist()), least) if batch.num_rows else []
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def candidate_groups(heads: DataFrame, least: np.ndarray, node_docs: int) -> DataFrame:
    """(id, label): groups of heads (doc_id, sig, bands) such that no pair that shares a bucket, and whose signatures may link, is parted."""
    holders = heads.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("h"))
    buckets = written(holders.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).filter("n > 1"), "buckets")
    shared = written(spread_join(holders, buckets, ["h"]), "shared")
    stars = written(shared.filter("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    sig = heads.select("doc_id", "sig")
    pivots = stars.groupBy("b").agg(F.count("*").alias("n")).join(sig, F.col("b") == F.col("doc_id")).select("b", "n", F.col("sig").alias("sig_b"))
    met = stars.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    found = link_pairs(spread_join(met, written(pivots, "pivots"), ["b"]), least)

    labels = written(components(found), "labels")
    held = shared.join(labels, F.col("doc_id") == F.col("id"), "left").select("h", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    mixed = written(held.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high").select("h", "n"), "mixed")
    if mixed.isEmpty():
        return labels
    members = spread_join(shared.select("h", "doc_id"), mixed, ["h"]).select(F.col("h").alias("grp"), "doc_id", F.lit(1).cast("long").alias("n"))
    rest = links_in_groups(_grouped(members, "apart", F.lit(1)), lambda units: link_signatures(units.join(sig, "doc_id"), least), F.lit(1), node_docs)

    # what is linked now joins the groups that there were
    label_of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    between = rest.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    between = between.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b").distinct()
    merged = written(components(between), "merged")
    moved = sent(merged).select(F.col("id").alias("label"), F.col("label").alias("merged"))
    kept = labels.join(moved, "label", "left").select("id", F.coalesce("merged", "label").alias("label"))
    return kept.unionByName(merged.join(labels.select("id"), "id", "left_anti"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 4, miss: float = 1e-6, room: int = 1 << 18, node_docs: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = least_matches(percent, miss)
    sketches = written(sketch(docs, size), "sketch")
    ids = sketches.filter("n > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    heads = written(ids.groupBy("d1", "d2").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    own = heads.select(F.col("head").alias("doc_id"), "d1", "d2")
    full = written(sketches.filter("n > 0").select("doc_id", "n", "d1", "d2", "sig", "bands").join(own, ["doc_id", "d1", "d2"]).drop("d1", "d2"), "full")

    close = candidate_groups(full, least, node_docs)
    close = full.select("doc_id", "n").join(close, full.doc_id == close.id).select(F.col("label").alias("grp"), "doc_id", "n").distinct()
    texts = docs.filter("doc_id is not null and text is not null")
    sig = full.select("doc_id", "sig")
    link = lambda units: link_texts(texts.join(sent(units), "doc_id").join(sig, "doc_id"), percent, size, least)
    found = links_in_groups(_grouped(close, "close", F.col("n")), link, F.col("n"), room)
    return labelled(sketches, ids, heads, found)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
