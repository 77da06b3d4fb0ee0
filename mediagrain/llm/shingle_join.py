"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles; two link when 100 * |A and B| >= percent * |A or B|. The join is exact
on 64-bit shingle hashes and gives the connected components of the links, without listing all pairs:

1. Sketch (one pass over the texts): set size, a 128-bit digest and a bitmap of the set, and the prefix of
   the set under one global order: sets that link share a prefix shingle. Shingles that a bounded sample
   finds frequent come last in that order; the order decides cost, never results. Equal sets in a batch
   give one prefix, so a hot group of copies is a row for each batch and shingle.
2. The forest: a prefix shingle names a tree over the sets that hold it (shingles with the same holders name
   one tree; equal sets are one leaf). Above these trees nothing could be pruned: the OR of some 16 sets
   already allows any overlap, so one tree of all documents would compare nearly all pairs of its nodes.
3. Every tree is traversed against itself: its nodes hold OR-combined bitmaps, size ranges and the largest
   bit-collision excess, and node pairs whose greatest possible overlap is too small are dropped. Trees of
   more than `node_docs` leaves are cut into subtrees by size range, of which those meet that may link
   (`links_in_groups`). What may link forms the close groups; a task gives a spanning forest of it.
4. Only the texts of close groups are read again; the sets are compared exactly, by the same traversal over
   new trees, unless both are linked already.

Nulls and odd cases: null and empty texts have no shingles and link with nothing; a text of fewer than
`size` words is one shingle; rows with a null doc_id are their own (null) component; rows that share a
doc_id are one document for linking; equal sets are one group, named by the smallest id (ties can't arise);
an empty table gives no rows; other columns, whatever their names, are never looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediagrain.llm.components import components, sent, spread_join, written
from mediagrain.llm.samples import first_by_hash, with_texts
from mediagrain.llm.textkit import LOWER, NOT_SPACE, Words, bounded_batches, gram_hashes, inside, mix, signed, text_slices, window_sums, word_hashes

U64 = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    w = Words(LOWER[data], off, NOT_SPACE)
    hashes, rows = word_hashes(w), w.rows()
    at = np.flatnonzero(inside(rows, size))
    grams = gram_hashes(hashes, size)[at] if len(at) else np.zeros(0, U64)
    bounds = np.searchsorted(at, w.first)
    short = (w.counts > 0) & (w.counts < size)
    whole = window_sums(hashes, w.first[:-1][short], w.first[1:][short])
    out = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for r, h in zip(np.flatnonzero(short), whole, strict=True):
        out[r] = np.array([h], U64)
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(s).sum()), int((mix(s ^ U64(0x5851F42D4C957F2D)) * U64(2862933555777941757)).sum() + U64(len(s)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(shingles: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The first shingles in the global order (frequent ones last, then by hash)."""
    if not len(shingles):
        return shingles
    p = prefix_length(len(shingles), percent)
    last = _among(shingles, frequent)
    return np.concatenate([shingles[~last], shingles[last]])[:p]


def frequent_shingles(docs: DataFrame, size: int, sample: int = 8000, least: int = 3, most: int = 200_000, hot: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least `least` of `sample` documents (by hash order), at most `most` of them, and those of at least `hot`."""

    def run(batches):
        for batch in batches:
            for _, _, data, off in text_slices(batch.column("text")):
                h, n = np.unique(np.concatenate([np.zeros(0, U64), *shingle_sets(data, off, size)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])

    ids = first_by_hash(docs.select("doc_id").filter("doc_id is not null"), "doc_id", sample).distinct()
    counted = with_texts(docs, ids).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = counted.orderBy(F.desc("n"), "h").limit(most).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(U64), got["n"].to_numpy(np.int64)
    return np.sort(h), np.sort(h[n >= hot])


def _among(shingles: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(shingles), bool)
    return listed[np.minimum(np.searchsorted(listed, shingles), len(listed) - 1)] == shingles


def sketch(docs: DataFrame, percent: int, size: int, frequent: np.ndarray, hot: np.ndarray) -> DataFrame:
    """doc_id, n, d1, d2 (digest), least (shingle), bits, and of the prefix the hot shingles and the others (none if an equal set came before in its batch)."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, hot))

    def run(batches):
        for batch in batches:
            known = batch.column("doc_id").is_valid().to_pylist()
            n, digests, prefixes, least, bits = [], [], [], [], []
            for _, _, data, off in text_slices(batch.column("text")):
                for s in shingle_sets(data, off, size):
                    n.append(len(s))
                    least.append(s[0] if len(s) else U64(0))
                    bits.append(bitmap(s, bitmap_size(len(s))).tobytes() if len(s) else None)
                    digests.append(set_digest(s))
                    prefixes.append(prefix(s, percent, shared.value[0]))
            fresh, seen = [], set()
            for d, k in zip(digests, known, strict=True):
                fresh.append(bool(k) and d not in seen)
                seen.add(d)
            prefixes = [p if f else p[:0] for p, f in zip(prefixes, fresh, strict=True)]
            all_ = np.concatenate([np.zeros(0, U64), *prefixes])
            of, is_hot = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes]), _among(all_, shared.value[1])
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(of[m], np.arange(len(prefixes) + 1)).astype(np.int32)), pa.array(signed(all_[m]))) for m in (~is_hot, is_hot)]
            d = np.array(digests, U64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(signed(d[:, 0].copy())), pa.array(signed(d[:, 1].copy())), pa.array(signed(np.array(least, U64))), pa.array(bits, pa.binary()), *lists], names=["doc_id", "n", "d1", "d2", "least", "bits", "prefix", "hot"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, least long, bits binary, prefix array<long>, hot array<long>")


def bitmap_size(n: int) -> int:
    """Bits for a set of n shingles: 2 to 4 for each, a power of two."""
    return max(256, min(1 << 16, 1 << (2 * n - 1).bit_length()))


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    flags = np.zeros(bits, bool)
    flags[(shingles & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(U64)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class SignatureTrees:
    """A tree for each unit, over its documents in the order of size and least shingle; `fan` children to a node.

    A node holds the OR of its documents' bitmaps, their least and greatest size and the largest excess (of a
    set's size over its bits). Trees of many units are kept side by side, level by level.
    """

    def __init__(self, unit: np.ndarray, maps: np.ndarray, sizes: np.ndarray, least: np.ndarray, fan: int = 8):
        self.fan = fan
        self.order = np.lexsort((least, sizes, unit))
        unit, maps, low = unit[self.order], maps[self.order], sizes[self.order]
        self.levels = [(maps, low, low, low - np.bitwise_count(maps).sum(1).astype(np.int64), None)]
        while len(unit):
            fresh = np.ones(len(unit), bool)
            fresh[1:] = unit[1:] != unit[:-1]
            if fresh.all():
                break
            heads = np.flatnonzero(fresh)
            place = np.arange(len(unit)) - np.repeat(heads, np.diff(np.append(heads, len(unit))))
            at = np.flatnonzero(place % fan == 0)
            maps, low, high, excess, _ = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.append(at, len(unit))))
            unit = unit[at]

    def pairs(self, percent: int, skip=None, chunk_bytes: int = 4 << 20):
        """Yields arrays (i, j) of documents of one unit that may link, by dual traversal; `skip(i, j)` drops pairs of documents meanwhile linked."""
        top = len(self.levels) - 1
        if not top:
            return
        roots = np.arange(len(self.levels[top][0]))
        chunk = min(1 << 13, max(256, chunk_bytes // (8 * self.levels[0][0].shape[1])))  # a pair of nodes makes fan * fan below
        stack = [(top, roots, roots)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > chunk:
                stack += [(level, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
                continue
            maps, low, high, excess, at = self.levels[level]
            ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
            i, j = i[ok], j[ok]
            if level == 0 and skip is not None:
                ok = ~skip(self.order[i], self.order[j])
                i, j = i[ok], j[ok]
            most = np.bitwise_count(maps[i] & maps[j]).sum(1).astype(np.int64) + np.minimum(excess[i], excess[j])
            most = np.minimum(most, np.minimum(high[i], high[j]))
            ok = most * (100 + percent) >= percent * (low[i] + low[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            f = np.arange(self.fan)
            ci, cj = np.broadcast_arrays(at[i][:, None, None] + f[None, :, None], at[j][:, None, None] + f[None, None, :])
            ok = (ci < at[i + 1][:, None, None]) & (cj < at[j + 1][:, None, None]) & ((ci < cj) if level == 1 else (ci <= cj))
            stack.append((level - 1, ci[ok], cj[ok]))


def _folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the size."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


def spanning(unit: np.ndarray, bits: list[bytes], sizes: np.ndarray, least: np.ndarray, sides: np.ndarray, percent: int, test=None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs in each unit whose trees allow a link and for which `test(a, b)`, if given, holds.

    Sides are 0, 1 or 2: two documents of side 1, or two of side 2, meet elsewhere. Sets that link have bitmaps of one
    length or of neighbouring ones: each length has its trees, in which the next longer bitmaps are folded once.
    """
    forest, out, length = Forest(len(bits)), [], np.array([len(b) for b in bits])
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        twice = np.flatnonzero(length == 2 * size)
        twice = twice[np.isin(unit[twice], unit[own])]
        stack = lambda at: np.frombuffer(b"".join(bits[i] for i in at), U64).reshape(len(at), -1)
        maps, at = stack(own), np.concatenate([own, twice])
        if len(twice):
            maps = np.concatenate([maps, _folded(stack(twice))])
        folded = length[at] != size

        def skip(i, j, at=at, folded=folded):
            root, side = np.array([forest.find(x) for x in at.tolist()]), sides[at]
            return (root[i] == root[j]) | ((side[i] != 0) & (side[i] == side[j])) | (folded[i] & folded[j])

        for i, j in SignatureTrees(unit[at], maps, sizes[at], least[at]).pairs(percent, skip):
            for a, b in zip(at[i].tolist(), at[j].tolist(), strict=True):
                if forest.find(a) != forest.find(b) and (test is None or test(a, b)):
                    forest.join(a, b)
                    out.append((a, b))
    return out


def may_link(unit: np.ndarray, rows: list[tuple[bytes, int, int]], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """What bitmaps and sizes allow; rows of (bits, size, least shingle)."""
    bits, sizes, least = zip(*rows, strict=True)
    return spanning(unit, list(bits), np.array(sizes), np.array(least, np.int64).view(U64), sides, percent)


def linked(unit: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The links among sets."""

    def test(a: int, b: int) -> bool:
        x, y = sets[a], sets[b]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    sizes = np.array([len(s) for s in sets])
    bits = [bitmap(s, bitmap_size(len(s))).tobytes() for s in sets]
    return spanning(unit, bits, sizes, np.array([s[0] for s in sets]), sides, percent, test)


def _by_unit(rows: DataFrame, columns: list[str], work, prepare, weight, room: int = 1 << 22) -> DataFrame:
    """What `work` links inside each unit, as stars: (a, b), b the smallest id of a's component there; a unit's rows meet in a task, which takes whole units of about `room` bytes together."""
    keyed = rows.select("unit", "side", "doc_id", *columns).repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        held, names, sides, ids, size = [], [], [], [], 0

        def flush():
            number = np.cumsum([0, *(a != b for a, b in zip(names[1:], names[:-1], strict=True))])
            forest = Forest(len(held))
            joined = set()
            for a, b in work(number, held, np.array(sides)) if len(held) > 1 else []:
                forest.join(a, b)
                joined |= {a, b}
            least: dict[int, int] = {}
            for a in joined:
                root = forest.find(a)
                least[root] = min(least.get(root, ids[a]), ids[a])
            found = [(ids[a], least[forest.find(a)]) for a in joined]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            unit, side, own = (batch.column(c).to_pylist() for c in ("unit", "side", "doc_id"))
            for r, value in enumerate(prepare(batch)):
                if size >= room and unit[r] != names[-1]:
                    yield flush()
                    held, names, sides, ids, size = [], [], [], [], 0
                if value is not None:
                    held.append(value)
                    names.append(unit[r])
                    sides.append(side[r])
                    ids.append(own[r])
                    size += weight(value)
        if held:
            yield flush()

    return keyed.mapInArrow(run, "a long, b long")


def _link_texts(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Exact links; rows: unit, side, doc_id, text."""

    def sets(batch):
        for _, _, data, off in text_slices(batch.column("text")):
            for s in shingle_sets(data, off, size):
                yield s if len(s) else None

    return _by_unit(rows, ["text"], lambda unit, held, sides: linked(unit, held, sides, percent), sets, lambda s: 8 * len(s))


def _link_bitmaps(rows: DataFrame, percent: int) -> DataFrame:
    """Links that the bitmaps allow; rows: unit, side, doc_id, n, least, bits."""

    def given(batch):
        yield from zip(*(batch.column(c).to_pylist() for c in ("bits", "n", "least")), strict=True)

    return _by_unit(rows, ["n", "least", "bits"], lambda unit, held, sides: may_link(unit, held, sides, percent), given, lambda x: len(x[0]))


def _nodes(members: DataFrame, by: list[str], weight, room: int) -> DataFrame:
    """Adds band (size class) and block: nodes inside the columns `by`, each of about `room` of the summed weight."""
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    blocks = banded.groupBy(*by, "band").agg(F.ceil(F.sum(weight) / room).alias("blocks"))
    return banded.join(blocks, [*by, "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks")


def _neighbours(band):
    """Sets that link are in the same or in neighbouring bands (one more for rounding)."""
    return F.explode(F.array(*(band + k for k in (-1, 0, 1))))


def _pair_units(nodes: DataFrame, by: list[str], meets) -> DataFrame:
    """(unit, side, by..., band, block) for every pair of nodes in neighbouring bands for which `meets` holds."""
    key = [*by[1:], "band", "block"]
    ends = nodes.select(*by, "band", "block").distinct()
    left = ends.select(by[0], *(F.col(c).alias(f"{c}_l") for c in key), _neighbours(F.col("band")).alias("band"))
    met = left.join(ends, [by[0], "band"]).filter(meets)
    same = F.struct(*(f"{c}_l" for c in key)) == F.struct(*key)
    side = lambda k: F.when(same, 0).otherwise(k).alias("side")
    ends = F.array(F.struct(*(F.col(f"{c}_l").alias(c) for c in key), side(1)), F.struct(*key, side(2)))
    return met.select(by[0], F.concat_ws("/", by[0], *(f"{c}_l" for c in key), *key).alias("unit"), F.explode(ends).alias("x")).select(by[0], "unit", "x.*").distinct()


def _grouped(members: DataFrame, name: str, weight) -> DataFrame:
    """The rows of groups of two or more, with the group's summed weight; written."""
    members = written(members, f"{name}_all")
    sizes = written(members.groupBy("grp").agg(F.count("*").alias("n"), F.sum(weight).alias("weight")).filter("n > 1"), f"{name}_sizes")
    rows = members.withColumnRenamed("n", "size")
    return written(spread_join(rows, sizes, ["grp"]).select("grp", "doc_id", F.col("size").alias("n"), "weight"), name)


def links_in_groups(members: DataFrame, link, weight, room: int) -> DataFrame:
    """The links that `link` finds in the groups of members (grp, doc_id, n, and the group's weight).

    `link` takes units (unit, side, doc_id). A group of at most `room` is a unit. Larger ones are cut into nodes of
    neighbouring sizes, in two rounds: each node by itself and with a few pivots; then, if the group isn't one
    component yet, only the documents outside its largest component meet the other nodes.
    """
    unit = lambda *c: F.concat_ws("/", *c).alias("unit")
    alone = F.lit(0).alias("side")
    small = members.filter(F.col("weight") <= room).select("doc_id", unit("grp"), alone)
    large = members.filter(F.col("weight") > room).drop("weight")
    if large.isEmpty():
        return written(link(written(small.distinct(), "units")), "links")
    large = written(_nodes(large, ["grp"], weight, room), "nodes")
    # pivots: one document of each size class, which meets every node of its class and of the next ones
    pivots = large.groupBy("grp", "band").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("pivot"))
    near = large.select("grp", "band", "block").distinct().select("grp", "band", "block", _neighbours(F.col("band")).alias("of"))
    near = near.join(pivots.select("grp", F.col("band").alias("of"), "pivot"), ["grp", "of"])
    visiting = near.select(F.col("pivot").alias("doc_id"), unit("grp", "band", "block"), alone)
    first = small.unionByName(large.select("doc_id", unit("grp", "band", "block"), alone)).unionByName(visiting).distinct()
    found = written(link(written(first, "units")), "links")

    labels = components(found)
    state = large.select("doc_id", "n", "grp").join(labels, large.doc_id == labels.id, "left").select("doc_id", "n", "grp", F.coalesce("label", "doc_id").alias("label"))
    biggest = state.groupBy("grp", "label").agg(F.count("*").alias("docs")).groupBy("grp").agg(F.max_by("label", F.struct("docs", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    state = written(state.join(biggest, "grp").withColumn("out", (F.col("label") != F.col("main")).cast("int")), "state")
    if state.isEmpty():
        return found
    nodes = written(_nodes(state, ["grp", "out"], weight, room), "nodes")
    meets = (F.col("out_l") == 1) & ((F.col("out") == 0) | (F.struct("band_l", "block_l") <= F.struct("band", "block")))
    second = nodes.join(_pair_units(nodes, ["grp", "out"], meets), ["grp", "out", "band", "block"]).select("doc_id", "unit", "side")
    return found.unionByName(written(link(written(second, "units")), "links"))


def rough_groups(some: DataFrame) -> DataFrame:
    """Distinct (grp, doc_id): the holders of each prefix shingle that has several; equal lists of holders are one group.

    The holders of a shingle are counted where they meet; those of hot shingles are counted in every task first.
    """
    same = Window.partitionBy("h")
    k = [F.xxhash64("doc_id").alias("k1"), F.xxhash64("doc_id", F.lit(7)).alias("k2")]
    grp = F.xxhash64("n", "x1", "x2").alias("grp")
    held = some.select(F.explode("prefix").alias("h"), "doc_id", *k)
    held = held.select("doc_id", F.count("*").over(same).alias("n"), F.bit_xor("k1").over(same).alias("x1"), F.bit_xor("k2").over(same).alias("x2"))
    out = held.filter("n > 1").select(grp, "doc_id")
    hot = some.filter("size(hot) > 0").select(F.explode("hot").alias("h"), "doc_id", *k)
    counted = written(hot.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2")).filter("n > 1"), "hot")
    return out.unionByName(spread_join(hot, counted, ["h"]).select(grp, "doc_id")).distinct()


def labelled(sketches: DataFrame, ids: DataFrame, heads: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, from links (a, b) between heads of equal sets.

    sketches: doc_id, n, ...; ids: doc_id and digest of rows with an id and shingles; heads: digest, head, n.
    """
    # a doc_id with several rows ties their sets together
    twice = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    if not twice.isEmpty():
        own = written(spread_join(spread_join(ids, twice, ["doc_id"]).drop("n"), heads, ["d1", "d2"]).select("doc_id", "head"), "own")
        least = written(own.groupBy("doc_id").agg(F.min("head").alias("least"), F.count("*").alias("n")), "least")
        found = found.unionByName(spread_join(own, least, ["doc_id"]).select(F.col("head").alias("a"), F.col("least").alias("b")))
    labels = components(found)
    named = written(heads.join(labels, heads["head"] == labels["id"], "left").select("d1", "d2", "n", F.coalesce("label", "head").alias("label")), "named")
    label = spread_join(ids, named, ["d1", "d2"]).groupBy("doc_id").agg(F.min("label").alias("label"))
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5, room: int = 1 << 18, node_docs: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(sketch(docs, percent, size, *frequent_shingles(docs, size)), "sketch")
    some = sketches.filter("n > 0 and doc_id is not null")
    ids = some.select("doc_id", "d1", "d2")
    heads = ids.groupBy("d1", "d2").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    heads = written(heads, "heads")

    members = rough_groups(some).join(ids, "doc_id").select("grp", "d1", "d2").distinct().join(heads.select("d1", "d2", F.col("head").alias("doc_id")), ["d1", "d2"])
    bits = some.select("doc_id", "d1", "d2", "n", "least", "bits").join(heads.select(F.col("head").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"])
    bits = written(bits.drop("d2"), "bits")
    members = members.join(bits.select("doc_id", "d1", "n"), ["doc_id", "d1"]).select("grp", "doc_id", "n").distinct()
    rough = _grouped(members, "rough", F.lit(1))
    close = components(links_in_groups(rough, lambda units: _link_bitmaps(units.join(bits, "doc_id"), percent), F.lit(1), node_docs))
    close = bits.select("doc_id", "n").join(close, bits.doc_id == close.id).select(F.col("label").alias("grp"), "doc_id", "n").distinct()
    texts = docs.filter("doc_id is not null and text is not null")
    found = links_in_groups(_grouped(close, "close", F.col("n")), lambda units: _link_texts(texts.join(sent(units), "doc_id"), percent, size), F.col("n"), room)
    return labelled(sketches, ids, heads, found)


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The documents, columns unchanged, of which each component keeps the one with the smallest id."""
    gone = written(jaccard_components(docs, percent, size).filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(sent(gone), "doc_id", "left_anti").select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
