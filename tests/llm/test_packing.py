import random
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from mediagrain.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(df, docs):
    """Every id of every document lies in one piece, and windows are gapless and at most 2048."""
    got = df.toPandas()
    coder = Tokenizer.from_file(PATH)
    for doc in docs:
        ids = np.array(coder.encode(doc.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        own = got[got.doc_id.isna() if doc.doc_id is None else got.doc_id == doc.doc_id].sort_values("start").drop_duplicates(["start", "length"])
        assert (own.doc_tokens == len(ids) // 4).all() and own.length.sum() == len(ids) // 4
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
    padding = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.values == np.concatenate(([0], np.cumsum(s.length.values)[:-1]))).all()
        used = int(s.length.sum())
        assert used <= 2048 and (s.length > 0).all()
        padding += 0 if used & (used - 1) == 0 else 2048 - used
    return got, padding


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, padding = whole(packing.op3(spark, sf), docs.collect())
    parts = docs.rdd.getNumPartitions()
    assert padding < 2048 * parts
    full = got.groupby(["step_group", "tier"]).length.sum()
    assert (full <= 32_768).all()


def test_odd_texts(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    got, _ = whole(packing.pack(odd_docs, PATH), [d for d in docs if d.doc_id != 4])
    assert (got[got.doc_id == 1][["start", "length", "doc_tokens"]].values == [[0, 1, 1]]).all()
    assert packing.pack(no_docs, PATH).count() == 0


def test_words_are_coded_as_in_their_text():
    rng, coder, words = random.Random(3), Tokenizer.from_file(PATH), packing.WordIds(PATH, room=50)
    alphabet = list("aeIÉß'’1９ \t\n\r\x0b\x0c\x1c  ́ͅΣσçÅ!?.,<|>") + ["'re", "<|endoftext|>", "don't ", "Abc,", "ÉTÉ.", "\u0130x", "<|EndOfText|>", "ſÿŸ!!"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(800)]
    for text, ids in zip(texts, words.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids, repr(text)


def test_packer_fills_and_balances():
    rng, p = random.Random(1), packing.Packer()
    sizes = [rng.choice([1, 20, 300, 700, 1500, 2048, 5000]) + rng.randrange(90) for _ in range(500)]
    windows = [(2048, w) for i, n in enumerate(sizes) for w in p.add(i, n)] + p.drain(False) + p.drain(True)
    seen = pd.DataFrame([x for _, w in windows for x in w], columns=["row", "start", "length"]).sort_values(["row", "start"])
    assert seen.groupby("row").length.sum().tolist() == sizes
    assert all(sum(x[2] for x in w) == t for t, w in windows[:-1])
    groups = packing.step_groups(windows, 32_768, 2048)
    tokens = pd.Series([t for t, _ in windows]).groupby(groups).sum()
    assert tokens.max() <= 32_768 + 2048


def test_rows_behind_a_shuffle_and_clashing_columns(spark, sf):
    """Rows of a join are written first, so that a task sees the same rows whenever it is run."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    assert not packing.from_files(docs)
    assert packing.from_files(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").select("doc_id", "text"))
    clashing = docs.selectExpr("doc_id", "text", "1 as start", "2 as length", "'x' as sequence_id", "3 as tier")
    joined = clashing.join(spark.range(40).withColumnRenamed("id", "doc_id"), "doc_id")
    packed = packing.pack(joined, PATH)
    first, second = (sorted(map(tuple, packed.collect())) for _ in range(2))
    assert first == second
    whole(packed, joined.collect())
    assert packing.pack(joined.limit(0), PATH).count() == 0


def test_a_repeated_row_is_packed_again(spark):
    df = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "none")], "doc_id long, text string")
    got = packing.pack(df, PATH).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
