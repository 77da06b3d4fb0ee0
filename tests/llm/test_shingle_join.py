import random
import re

import numpy as np
import pyarrow as pa

from mediagrain.llm import components
from mediagrain.llm import shingle_join as j
from mediagrain.llm.textkit import column_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(docs):
    """docs: (doc_id, text). component of every doc_id."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    for k, (i, a) in enumerate(sets):
        shared = {}
        for g in a:
            for m in by[g]:
                if m < k:
                    shared[m] = shared.get(m, 0) + 1
        for m, both in shared.items():
            if 100 * both >= 80 * (len(a) + len(sets[m][1]) - both):
                x, y = find(i), find(sets[m][0])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def check(got, docs):
    want = brute(docs)
    sizes = {}
    for i, t in docs:
        sizes.setdefault(i, []).append(len(shingles(t)))
    assert len(got) == len(docs)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None), r
        assert r.n_shingles in sizes[r.doc_id]


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(j.op4(spark, sf).collect(), docs)


def near_copies(seed, groups=6, each=40, words=60):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(each):
            t = base[: rng.choice([words, words, words - 9, words - 3])]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


def test_large_groups_in_several_nodes(spark, monkeypatch):
    docs = near_copies(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(j, "prefix_length", lambda n, percent: n)  # all that share a shingle are one group
    check(j.jaccard_components(df, room=300, node_docs=20).collect(), docs)


def test_odd_texts(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(j.jaccard_components(odd_docs).collect(), docs)
    assert j.jaccard_components(no_docs).count() == 0
    kept = j.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 9


def trees(sets):
    sizes = np.array([len(s) for s in sets])
    bits = j.bitmap_size(int(sizes.max()))
    return j.SignatureTrees(np.zeros(len(sets), int), np.stack([j.bitmap(s, bits) for s in sets]), sizes, np.array([s[0] for s in sets]))


def test_tree_finds_every_link():
    docs = near_copies(9, groups=3, each=60)
    data, off = column_bytes(pa.array([t for _, t in docs]))
    sets = j.shingle_sets(data, off, 5)
    found = {(min(a, b), max(a, b)) for i, k in trees(sets).pairs(80) for a, b in zip(i.tolist(), k.tolist())}
    plain = [shingles(t) for _, t in docs]
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            both = len(plain[a] & plain[b])
            if 100 * both >= 80 * (len(plain[a]) + len(plain[b]) - both):
                assert (a, b) in found
    assert len(found) < len(docs) ** 2 / 4
    unit, sides = np.zeros(len(sets), int), np.zeros(len(sets), int)
    rows = [(j.bitmap(s, j.bitmap_size(len(s))).tobytes(), len(s), int(s[:1].view(np.int64)[0])) for s in sets]
    want = list(brute(docs).values())
    close = j.Forest(len(sets))
    for a, b in j.may_link(unit, rows, sides, 80):
        close.join(a, b)
    assert all(close.find(a) == close.find(w) for a, w in enumerate(want))
    forest = j.Forest(len(sets))
    assert all(forest.join(a, b) for a, b in j.linked(unit, sets, sides, 80))
    assert [forest.find(a) for a in range(len(sets))] == want


def test_many_units_and_sides_at_once():
    """Small units (two documents and more) go through trees like large ones, and never meet one another."""
    docs = near_copies(3, groups=4, each=30)
    data, off = column_bytes(pa.array([t for _, t in docs]))
    sets = j.shingle_sets(data, off, 5)
    rng = np.random.default_rng(1)
    unit = np.sort(rng.integers(0, 40, len(sets)))
    for sides in (np.zeros(len(sets), int), rng.integers(0, 3, len(sets))):
        near = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
        plain, forest = j.Forest(len(sets)), j.Forest(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                if unit[a] == unit[b] and (sides[a] == 0 or sides[a] != sides[b]) and near(a, b):
                    plain.join(a, b)
        found = j.linked(unit, sets, sides, 80)
        assert all(unit[a] == unit[b] and near(a, b) for a, b in found) and all(forest.join(a, b) for a, b in found)
        assert [forest.find(a) for a in range(len(sets))] == [plain.find(a) for a in range(len(sets))]


def test_folded_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in (100, 127, 128, 129, 140, 255, 257, 300):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        for m in (int(n * 0.81), int(n * 1.24)):
            b = a[:m] if m < n else np.union1d(a, rng.integers(0, 1 << 62, m - n, dtype=np.uint64))
            rows = [(j.bitmap(s, j.bitmap_size(len(s))).tobytes(), len(s), int(s[:1].view(np.int64)[0])) for s in (a, b)]
            for copies in (1, 4):
                found = j.may_link(np.zeros(2 * copies, int), rows * copies, np.zeros(2 * copies, int), 80)
                assert len(found) >= 2 * copies - 1


def test_words_that_cancel_out_in_polynomials(spark):
    """Two long words that no polynomial hash modulo a power of two tells apart make different shingles."""
    x, y = ["a"], ["b"]
    for _ in range(11):
        x, y = x + y, y + x
    docs = [(i, " ".join([*(f"w{k}" for k in range(4)), "".join(w)])) for i, w in enumerate((x, y, x))]
    check(j.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_repeated_ids_tie_sets_and_clashing_columns(spark):
    base = [[f"{g}w{k}" for k in range(30)] for g in "abc"]
    docs = [(5, " ".join(base[0])), (5, " ".join(base[1])), (9, " ".join(base[0])), (7, " ".join(base[1])), (3, " ".join(base[1] + ["x"])), (8, " ".join(base[2])), (8, " ".join(base[2])), (5, "")]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], "doc_id long, text string, n long, head long, grp string, label int")
    got = j.jaccard_components(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 3), (8, 8), (8, 8), (9, 3)]
    kept = j.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 8}


def test_hot_shingles_are_counted_apart(spark, monkeypatch):
    docs = near_copies(6, groups=2, each=40)
    whole = j.frequent_shingles
    monkeypatch.setattr(j, "frequent_shingles", lambda d, size: whole(d, size, hot=5))
    monkeypatch.setattr(j, "spread_join", lambda rows, by, keys: components.spread_join(rows, by, keys, most=4, floor=3))
    check(j.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect(), docs)


def test_prefixes_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 60, rng.integers(0, 5), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            frequent = np.sort(rng.permutation(np.union1d(a, b))[:20])
            assert len(np.intersect1d(j.prefix(a, 80, frequent), j.prefix(b, 80, frequent)))
