import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mediagrain.llm import toxicity
from mediagrain.llm.textkit import column_bytes


def test_only_chosen_columns_are_gathered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", (F.col("doc_id") % 3 == 0).alias("positive")).repartition(3)
    sample = docs.collect()
    rows, h, n = toxicity.word_counts(*column_bytes(pa.array([r.text for r in sample])))
    is_p = np.array([r.positive for r in sample])
    want = {-1: (is_p.sum(), (~is_p).sum())}
    for k in np.unique(h):
        of = is_p[rows[h == k]]
        want[k] = of.sum(), (~of).sum()
    assert {r.h: (r.in_p, r.in_u) for r in toxicity.hash_counts(docs).collect()} == want
    chosen = np.unique(h)[::50]
    got = sorted((r.positive, tuple(r.words)) for r in toxicity.sparse_rows(docs, chosen).collect())
    kept = np.isin(h, chosen)
    plain = h[kept] << 8 | np.minimum(n[kept], 255)
    assert got == sorted((r.positive, tuple(plain[rows[kept] == i].tolist())) for i, r in enumerate(sample))


def test_sample_bound():
    assert inspect.signature(toxicity.train).parameters["unlabelled"].default >= 6000
