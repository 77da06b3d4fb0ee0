import random
from hashlib import md5, sha256

import pytest

from mediagrain.llm import line_dedup as d


def chunks(lines):
    v = [int(md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [(v[i] + 31 * (v[i - 1] if i else 0)) % 2**32 for i in range(len(v))]
    ends = [i for i in range(1, len(v) - 2) if r[i] < r[i - 1] and r[i] <= r[i + 1]] + [len(v) - 1]
    return [lines[a + 1 : e + 1] for a, e in zip([-1, *ends], ends)]


def brute(docs):
    """docs: (doc_id, text); distinct ids. (doc_id, n_lines, n_removed_lines, kept_sha256) of each."""
    seen, out = set(), []
    for i, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        kept, n = [], 0
        for c in chunks(t.split("\n")) if t is not None else ():
            if len(c) > 1 and tuple(c) in seen:
                n += len(c)
            else:
                kept += c
            seen.add(tuple(c))
        out.append((i, len(t.split("\n")) if t is not None else 0, n, sha256("\n".join(kept).encode()).hexdigest() if t is not None else None))
    return sorted(out)


def rows(spark, docs, tmp_path, monkeypatch=None):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(tuple(r) for r in d.op10(spark, str(tmp_path)).collect())


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"p{k} line {rng.randrange(30)}" for _ in range(rng.randrange(2, 30))] for k in range(4)]
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(6))]
            lines += rng.choice(shared) if rng.random() < 0.7 else ["menu", "menu"]
        out.append((i, "\n".join(lines)))
    return [*out, (n, out[3][1]), (n + 1, out[3][1]), (n + 2, None), (n + 3, ""), (n + 4, "\n"), (n + 5, "\n\n\n\n"), (n + 6, "\n\n\n\n"), (n + 7, "one line"), (n + 8, "one line"), (n + 9, "é\nü\n" * 4000)]


@pytest.mark.parametrize("floor", [1000, 1])
def test_against_brute_force(spark, tmp_path, monkeypatch, floor):
    """With a floor of 1 all repeated chunks are hot ones."""
    whole = d.with_removed
    monkeypatch.setattr(d, "with_removed", lambda docs: whole(docs, floor))
    docs = passages(floor)
    assert rows(spark, docs, tmp_path) == brute(docs)


def test_every_chunk_has_two_lines_or_more():
    for _, t in passages(8):
        lines = (t or "").split("\n")
        assert all(len(c) > 1 for c in chunks(lines)) or len(lines) == 1


def test_odd_rows(spark, no_docs):
    text = "\n".join(f"line {i}" for i in range(9))
    given = [(1, text, "a"), (2, text, "b"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, "x " * 50_000, "f")]
    df = spark.createDataFrame([(i, t, r, 1, 2, "k", 3) for i, t, r in given], "doc_id long, text string, row string, s int, lines int, h string, n_chars int")
    got = {r["row"]: r for r in d.dedup_lines(df).collect()}
    assert set(got) == {"a", "d", "e", "f"}  # a repeated row loses the same chunks as its double
    assert got["a"].text == text and got["d"].text == text and got["e"].text is None and got["a"].n_chars == 3
    assert d.dedup_lines(df).columns == df.columns
    assert d.dedup_lines(no_docs).count() == 0 and d.with_removed(no_docs).count() == 0


def test_only_built_in_functions(spark):
    df = spark.createDataFrame(passages(5), "doc_id long, text string")
    plan = d.with_removed(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
