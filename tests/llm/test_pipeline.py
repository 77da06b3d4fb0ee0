"""Each stage against a plain version of its rule on its own input."""

import hashlib
import math
import re

import pyarrow as pa
import pytest

from mediagrain.llm import toxicity
from mediagrain.llm.textkit import column_bytes
from tests.llm.test_packing import whole
from tests.llm.test_shingle_join import brute as brute_components

pipeline = pytest.importorskip("corpus_pipeline")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_toxicity(docs, model):
    """The documents whose score, summed word by word, is below 0.7."""
    weights, bias = model
    out = []
    for r in docs:
        _, h, n = toxicity.word_counts(*column_bytes(pa.array([r.text])))
        z = bias + sum(float(weights[a]) * min(math.log2(1 + c), 3) for a, c in zip(h.tolist(), n.tolist()))
        if 1 / (1 + math.exp(-max(-40, min(40, z)))) < 0.7:
            out.append(r)
    return out


def plain_line_dedup(docs):
    seen, out = set(), {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        lines = r.text.split("\n")
        v = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        rolled = [(v[i] + 31 * (v[i - 1] if i else 0)) % 2**32 for i in range(len(v))]
        chunks, at = [], 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or (1 <= i <= len(lines) - 3 and rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]):
                chunks.append(lines[at : i + 1])
                at = i + 1
        kept = []
        for c in chunks:
            key = "\n".join(c)
            if len(c) == 1 or key not in seen:
                kept += c
            if len(c) > 1:
                seen.add(key)
        text = "\n".join(kept)
        if text.strip(" \n\t\r") or text == r.text:
            out[r.doc_id] = text
    return out


def plain_decontamination(docs, bench):
    known = {}
    for b in bench:
        ws = ALNUM.findall(lower(b.text))
        k = min(10, len(ws))
        for i in range(len(ws) - k + 1) if k else ():
            known.setdefault(k, set()).add(tuple(ws[i : i + k]))
    out = {}
    for r in docs:
        found = list(ALNUM.finditer(lower(r.text)))
        ws = [m[0] for m in found]
        hit = set()
        for k, wins in known.items():
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in wins:
                    hit.update(range(i, i + k))
        if len(hit) > 0.5 * len(ws):
            continue
        text, at, i = [], 0, 0
        while i < len(ws):
            if i in hit:
                j = i
                while j + 1 in hit:
                    j += 1
                text.append(r.text[at : found[i].start()])
                at = found[j].end()
                i = j
            i += 1
        out[r.doc_id] = "".join([*text, r.text[at:]])
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs
    texts = {}
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        rows, given = after.collect(), before.collect()
        if name != "packing":
            assert after.columns == names
            texts = {r.doc_id: r.text for r in rows}
            assert len(texts) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "toxicity":
            assert 0.7 * len(given) < len(rows) < len(given) and sorted(rows) == sorted(plain_toxicity(given, toxicity.model_for(spark, before, sf)))
        elif name == "line dedup":
            assert texts == plain_line_dedup(given)
        elif name == "n-gram Jaccard join":
            label = brute_components([(r.doc_id, r.text) for r in given])
            assert texts == {r.doc_id: r.text for r in given if label[r.doc_id] == r.doc_id}
        elif name == "benchmark decontamination":
            assert texts == plain_decontamination(given, spark.read.parquet(f"{sf}/benchmark.parquet").collect())
        else:
            _, padding = whole(after, given)  # every id in one piece, gapless windows, checksums
            assert padding < 2048 * before.rdd.getNumPartitions()
        before = after


def test_run_is_the_stages_in_turn(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.agg({"length": "sum"}).first()[0] > 0 and "sequence_id" in got.columns


def test_odd_documents_pass_every_stage(spark, sf, odd_docs, no_docs):
    """Null, empty and very long texts, a null id, repeated rows and clashing columns; and no rows at all."""
    for docs in (odd_docs.withColumnsRenamed({"lang": "label", "source": "h"}), no_docs):
        for name, stage in pipeline.STAGES:
            after = stage(spark, docs, sf).cache()
            assert name == "packing" or after.columns == docs.columns
            assert after.count() <= docs.count() or name == "packing"
            docs = after
