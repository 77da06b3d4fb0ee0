import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from mediagrain.llm import substring_dedup as d
from mediagrain.llm import textkit
from mediagrain.llm.textkit import column_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, window=50):
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, words in sorted((x for x in split if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if first[tuple(words[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(d.op2(spark, sf)) == brute(docs)


def passages(seed, n=120):
    rng = random.Random(seed)
    shared = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.randrange(8, 60))] for k in range(5)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(10_000)}" for _ in range(rng.randrange(12))]
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            words += (p * 2)[a : a + rng.randrange(3, 50)]
        out.append(" \n".join(words))
    return [*enumerate(out), (n, out[3]), (n + 1, "a " * 70), (n + 2, "a " * 90), (n + 3, None), (n + 4, "a a")]


def test_short_windows_in_many_batches(spark):
    docs = passages(4)
    df = spark.createDataFrame([(None, docs[0][1]), *docs], "doc_id long, text string").repartition(6)
    want = brute([(None, docs[0][1]), *docs], 12)
    for batches in (1, 3):
        assert rows(d.dedup_substrings(df, batches, 12, gram=4, fanout=2)) == want, batches


def test_compaction_keeps_results(spark):
    docs = passages(8, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = d.SubstringIndex(spark, 12, 4, fanout=2, buckets=3)
    got = []
    for k in range(0, 65, 13):
        got += rows(index.add(df.filter(f"doc_id >= {k} and doc_id < {k + 13}"), df.filter(f"doc_id < {k}"), with_text=True))
    assert sorted(got, key=str) == brute(docs, 12)
    assert sorted(k for k, _ in index.runs) == [0, 2]


def test_the_registered_query_compacts(spark, sf, monkeypatch):
    levels, drop = [], d.SubstringIndex.drop
    monkeypatch.setattr(d.SubstringIndex, "drop", lambda self: (levels.append(sorted(k for k, _ in self.runs)), drop(self))[1])
    got = {r.doc_id: r.n_removed for r in d.op2(spark, sf).collect()}
    assert levels == [[1]]
    assert got == {i: n for i, _, n, _ in brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])}


def test_an_index_outlives_its_session_tables(spark):
    docs = passages(6, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = d.SubstringIndex(spark, 12, 4, fanout=2, buckets=3)
    got = rows(index.add(df.filter("doc_id < 15")))
    for lo, hi in ((15, 30), (30, 99)):
        index.close()
        assert not spark.catalog.tableExists(index.runs[0][1])
        index = d.SubstringIndex.open(spark, index.folder)
        assert (index.window, index.gram, index.fanout, index.buckets) == (12, 4, 2, 3)
        got += rows(index.add(df.filter(f"doc_id >= {lo} and doc_id < {hi}"), df.filter(f"doc_id < {lo}")))
    assert sorted(got, key=str) == brute(docs, 12)
    names = [n for _, n in index.runs]
    plan = spark.table(names[0]).groupBy("g").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def flat(w, seed=0):
    return np.full(len(w.starts), 7, np.uint64)


def equal_digests(self, first, end):
    return np.zeros(len(first), np.int64)


def scanned(spark, docs, patches, monkeypatch):
    """The result with parts of the module replaced in the tasks as well (they get the patched functions by value)."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(d)
    for owner, name, f in patches:
        monkeypatch.setattr(owner, name, f)
    try:
        return rows(d.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 2, 12, gram=4))
    finally:
        cloudpickle.unregister_pickle_by_value(d)


def test_equal_hashes_change_nothing():
    docs = [x for x in passages(4, 30) if x[1]]
    data, off = column_bytes(pa.array([t for _, t in docs]))
    w = d.Words(data, off, d.NOT_SPACE)
    assert len(set(d.segments(w, 12, 4)[0].tolist())) > 50


def test_windows_of_equal_hash_stay(spark, monkeypatch):
    """With all rolling hashes equal, results are those of brute force: contents are named by digest and compared by words."""
    docs = passages(4, 30)
    assert scanned(spark, docs, [(d, "word_hashes", flat)], monkeypatch) == brute(docs, 12)


def test_words_are_compared(spark, monkeypatch):
    """With all digests equal too, every match is a guess; what is removed is still only what repeats."""
    docs = passages(4, 30)
    got = scanned(spark, docs, [(d, "word_hashes", flat), (d.Plain, "digests", equal_digests)], monkeypatch)
    want = {i: n for i, _, n, _ in brute(docs, 12)}
    assert all(n <= want[i] for i, _, n, _ in got) and sum(n for _, _, n, _ in got) < sum(want.values())


def thue_morse(a, b, levels=11):
    x, y = [a], [b]
    for _ in range(levels):
        x, y = x + y, y + x
    return x, y


def test_words_that_cancel_out_in_polynomials(spark):
    """Two long words (and two long word sequences) that no polynomial hash modulo a power of two tells apart."""
    x, y = thue_morse("a", "b")
    p, q = thue_morse("on", "off")
    docs = [(1, " ".join(["x"] * 30 + ["".join(x)] + ["y"] * 30)), (2, " ".join(["x"] * 30 + ["".join(y)] + ["y"] * 30)), (3, " ".join(p)), (4, " ".join(q)), (5, " ".join(p))]
    assert rows(d.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    data, off = column_bytes(pa.array(["".join(x) + " " + "".join(y), " ".join(p), " ".join(q)]))
    w = d.Words(data, off, d.NOT_SPACE)
    for seed in (0, 1, 3):
        h = textkit.word_hashes(w, seed)
        assert h[0] != h[1]
        sums = textkit.window_sums(h, w.first[1:-1], w.first[2:], seed)
        assert sums[0] != sums[1]


def test_no_whole_numbers_no_index(spark):
    with pytest.raises(TypeError):
        d.dedup_substrings(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_clashing_columns_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = [(1, text), (2, "head " + text), (2, "head " + text), (2, "other text"), (3, text)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in docs], "doc_id long, text string, g int, s int, a int, words string")
    assert rows(d.dedup_substrings(df)) == brute(docs)


def test_odd_texts(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(d.dedup_substrings(odd_docs)) == brute(docs)
    assert d.dedup_substrings(no_docs).count() == 0


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 3, 7, 35, 200):
        assert d.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
