import hashlib
import random
import zlib

import duckdb
import pytest

from mediagrain.llm import manifest as m


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes, fan):
    """The root, and for each node its siblings level by level with its place."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fan * fan : i // fan * fan + fan]
            paths[k].append((i % fan, run[: i % fan] + run[i % fan + 1 :]))
            at[k] = i // fan
        level = [sha(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def brute(rows, fan=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r, leaf(*r)))
    names = sorted(groups, key=str.encode)
    inner = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        inner[name] = tree([h for _, h in groups[name]], fan)
    root, tops = tree([inner[name][0] for name in names], fan)
    out = []
    for name, top in zip(names, tops, strict=True):
        for (r, h), path in zip(groups[name], inner[name][1], strict=True):
            whole = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(*r[:4], lower(r[4])) if tampered else h
            for place, others in whole:
                node = sha(*others[:place], node, *others[place:])
            out.append((r[0], h, inner[name][0], root, sha(*(x for _, others in whole for x in others)), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=repr)


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return order(map(tuple, m.op11(spark, str(tmp_path)).collect()))


ODD = [
    (None, None, None, None, None),
    (None, "a", None, None, ""),
    (1, None, "en", 3, "Été A"),
    (1, "", "en", 0, ""),
    (2, "", "EN", 7, "UPPER lower \n ÀÉ"),
    (2, "", "EN", 7, "UPPER lower \n ÀÉ"),
    (2, "", "EN", 7, "another text of the same id"),
    (-3, "a", "x", -1, "X" * 70_000),
    (9, "é", "x", 1, "b"),
    (9, "z", "x", 1, "\U0001f600"),
]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = order(map(tuple, m.op11(spark, sf).collect()))
    assert got == order(brute(list(map(tuple, docs.collect()))))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fan,stride", [(2, 2), (2, 1), (3, 3)])
def test_deep_trees_and_odd_rows(spark, tmp_path, monkeypatch, fan, stride):
    for name, value in (("FAN", fan), ("STRIDE", stride), ("BLOCK", fan**stride)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(fan * stride)
    rows = ODD + [(rng.randrange(400), rng.choice(["hot", "hot", "hot", *map(str, range(9))]), "en", i, f"Text {i} Of") for i in range(150)]
    assert run(spark, rows, tmp_path) == order(brute(rows, fan))


def test_only_every_few_levels_are_stored(spark):
    leaves = spark.range(70_000).selectExpr("'s' as grp", "id as doc_id", "sha2(cast(id as string), 256) as hash")
    kept = m.committed(leaves, ["doc_id"]).groups
    assert [t.count() for t in kept.levels] == [70_000, 274, 2, 1]
    assert kept.roots.first().hash == tree([sha(str(i)) for i in range(70_000)], 16)[0]


@pytest.mark.parametrize("rows", [[], [(5, "only", None, None, "A")], ODD])
def test_small_tables_and_sql(spark, tmp_path, rows):
    got = run(spark, rows, tmp_path)
    assert got == order(brute(rows) if rows else [])
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert order(c.execute(m.SQL11).fetchall()) == got


def test_extra_columns_that_clash(spark, tmp_path):
    rows = [(i, "s", "en", i, "Text") for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, pos long, hash string, n long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert order(map(tuple, m.op11(spark, str(tmp_path)).collect())) == order(brute(rows))
