import random

import numpy as np
import pytest

from mediagrain.llm import near_dedup as d
from tests.llm.test_shingle_join import WORD, near_copies

U64 = np.uint64


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(docs, percent=80, size=4):
    """docs: (doc_id, text). (component of every doc_id, links)."""
    sets = [(i, shingles(t, size)) for i, t in docs if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by, links = {}, 0
    for k, (i, a) in enumerate(sets):
        shared = {}
        for g in a:
            for m in by.setdefault(g, []):
                shared[m] = shared.get(m, 0) + 1
            by[g].append(k)
        for m, both in shared.items():
            if 100 * both >= percent * (len(a) + len(sets[m][1]) - both):
                links += 1
                x, y = find(i), find(sets[m][0])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}, links


def check(got, docs):
    want, links = brute(docs)
    sizes = {}
    for i, t in docs:
        sizes.setdefault(i, []).append(len(shingles(t, 4)))
    assert len(got) == len(docs)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None), r
        assert r.n_shingles in sizes[r.doc_id]
    return links


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = d.op13(spark, sf).collect()
    assert check(got, docs) > 10
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_in_several_nodes_and_mixed_buckets(spark, monkeypatch):
    docs = near_copies(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    apart = []
    grouped = d._grouped
    monkeypatch.setattr(d, "_grouped", lambda members, name, weight: apart.append(name) or grouped(members, name, weight))
    assert check(d.near_duplicates(df, room=300, node_docs=10).collect(), docs) > 1000
    assert apart == ["apart", "close"]


def test_a_common_passage(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 6, 20, 40]))])) for i in range(400)]
    assert check(d.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), node_docs=50).collect(), docs) > 0


def test_odd_rows(spark, odd_docs):
    check(d.near_duplicates(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])


def test_repeated_ids_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, 0, "s"), (1, b, 1, "t"), (2, b + " more", 2, "u"), (3, a, 3, "v"), (4, "other", 4, "w"), (4, "other", 4, "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n int, sig string")
    assert {(r.doc_id, r.component_id) for r in d.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_empty_table(spark, no_docs):
    assert d.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_hashes_match_with_the_similarity(share):
    rng, matches, banded = np.random.default_rng(7), [], []
    for _ in range(150):
        u = rng.integers(0, 2**63, 200, dtype=np.uint64)
        k = int(200 * share)
        half = (200 - k) // 2
        h = d.min_hashes([np.sort(np.concatenate([u[:k], x])) for x in (u[k : k + half], u[k + half :])])
        matches.append((h[0] == h[1]).mean())
        banded.append((d.band_keys(h)[0] == d.band_keys(h)[1]).any())
    assert abs(np.mean(matches) - share) < 0.02
    assert abs(np.std(matches) - (share * (1 - share) / d.HASHES) ** 0.5) < 0.01
    assert share < 0.8 or all(banded)


def test_posterior_bounds():
    """The bounds are those of the posterior, drop a pair of 0.8 rarely, and one of 0.4 after one batch."""
    least = d.least_matches(80, 1e-6)
    assert (np.diff(least) > 0).all()
    k, m = d.BATCH, int(least[0])
    s = np.linspace(0, 1, 2_000_001)[1:-1]
    p = s + (1 - s) / 256
    tail = lambda x: ((w := p**x * (1 - p) ** (k - x))[s >= 0.8].sum()) / w.sum()
    assert tail(m) >= 1e-6 > tail(m - 1)
    rng = np.random.default_rng(3)
    tosses = lambda s: (rng.random((20_000, d.HASHES)) < s).astype(np.uint8)
    ones = np.ones((1, d.HASHES), np.uint8)
    assert len(d.survivors(ones, tosses(0.8), least)) >= 19_998
    assert len(d.survivors(ones, tosses(0.4), least)) == 0
    assert len(d.survivors(ones, tosses(0.4), least[:1])) < 5_000
