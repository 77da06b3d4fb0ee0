import numpy as np
import pyarrow as pa

from mediagrain.llm import decontaminate as d
from mediagrain.llm.textkit import ALNUM, Words, column_bytes, gram_hashes, word_hashes


def test_spans_items_and_odd_rows(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame(
        [(1, "Start " + ", ".join(words[:10]).upper() + " end.", 7, "x"), (2, " ".join(words[5:14]), 7, "x"), (3, "the short item here", 7, "x"), (4, None, 7, "x"), (5, " ".join(words[:30]) + " tail" * 90, 7, "x")],
        "doc_id long, text string, n_words int, hits string",
    )
    bench = spark.createDataFrame([("10", " ".join(words)), ("9", " ".join(words[:12])), ("7", "short, ITEM"), ("8", ""), (None, "zz"), ("7", "short, ITEM"), ("6", None)], "item_id string, text string")
    for block_mb in (16, 0.0002):
        assert (len(d._blocks(bench.select("item_id", "text").filter("text is not null"), block_mb)) > 1) == (block_mb < 1)
        got = {r.doc_id: r for r in d.scan(docs, bench, block_mb=block_mb).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].item_ids) == (12, 10, ["10", "9"])
        assert (got[2].n_hit, got[2].item_ids) == (0, [])
        assert (got[3].n_hit, got[3].item_ids) == (2, ["7"])
        assert (got[4].n_words, got[4].n_hit) == (0, 0)
        assert got[5].n_hit == 30
    kept = {r.doc_id: r for r in d.decontaminate(docs, bench).collect()}
    assert set(kept) == {2, 3, 4, 5} and kept[3].text == "the  here" and kept[2].text == " ".join(words[5:14])
    assert kept[5].text == " tail" * 90 and kept[5].hits == "x"
    assert d.scan(no_docs, bench).count() == 0
    assert d.scan(odd_docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert d.decontaminate(odd_docs, bench).count() == 9


def test_blocks_give_the_same_texts(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, d.scan(docs, bench, with_text=True).collect()))
    assert sorted(map(str, d.scan(docs, bench, block_mb=0.002, with_text=True).collect())) == whole
    assert len(d._blocks(bench, 0.002)) > 2


def test_windows_are_compact_and_compare_words():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 50_000, 4000)) for _ in range(100)]
    table = pa.table({"item_id": [str(i) for i in range(100)], "text": texts})
    windows = d.Windows(table, 10)
    size = sum(map(len, texts))
    assert windows.nbytes() < 8 * size
    data, off = column_bytes(pa.array([" ".join(texts[7].split()[100:130]), "word1 " * 40]))
    w = Words(data, off, ALNUM)
    items = [set(), set()]
    assert windows.mark(w, word_hashes(w), w.rows(), items).sum() == 30 and items == [{7}, set()]
    other = word_hashes(w).copy()
    known, place, bounds, item = windows.known[10]
    known[:] = np.sort(gram_hashes(other, 10)[-1:].repeat(len(known)))  # every hash is that of the last window
    windows.bits[10][1][:] = True
    items = [set(), set()]
    assert windows.mark(w, other, w.rows(), items).sum() == 0 and items == [set(), set()]
