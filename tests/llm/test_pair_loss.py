"""The loss over all pairs and the ranks of scores, against plain ones; op8 trains on all labelled rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediagrain.llm import pair_loss as P
from mediagrain.llm import quality
from mediagrain.llm.textkit import column_bytes


def plain(x, y, w):
    apart = x[y == 1][:, None] - x[y == 0][None]
    e = apart @ w
    return np.logaddexp(0, -e).mean(), -np.einsum("ij,ijk->k", 1 / (1 + np.exp(e)), apart) / e.size


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.8).astype(int)
    y[7] = 2  # neither good nor bad
    return np.clip(rng.normal(size=(300, 6)) + 0.4 * (y == 1)[:, None], -8, 8), y


@pytest.mark.parametrize("scale", [0, 0.3, 2, 30])
def test_sums_are_those_of_all_pairs(rows, scale):
    x, y = rows
    w = np.random.default_rng(1).normal(size=6) * scale
    loss, grad, curve = P.pair_sums(P.merged_moments(P.moments(x[:90], y[:90], w), P.moments(x[90:], y[90:], w)))
    want = plain(x, y, w)
    assert abs(loss - want[0]) < 1e-12 * (1 + want[0]) and np.abs(grad - want[1]).max() < 1e-12
    assert np.linalg.eigvalsh(curve).min() > -1e-12


@pytest.mark.parametrize("apart", [0, 6])
def test_fitted_weights_are_the_least_of_all_pairs(rows, apart):
    """Also where a line parts both classes."""
    x, y = rows[0] + apart * (rows[1] == 1)[:, None], rows[1]
    w = P.fitted(lambda w: P.pair_sums(P.moments(x, y, w)), 6, 1e-3)
    assert np.abs(plain(x, y, w)[1] + 1e-3 * w).max() < 1e-9


def test_values_of_ranks():
    rng = np.random.default_rng(4)
    for s in (rng.normal(size=999), np.repeat([-1.0, 2.0], 400), np.zeros(5), 3 + rng.random(500) * 1e-15):
        parts = np.array_split(s, 4)

        def count(ranges):
            out = P.ranks_within(parts[0], ranges)
            for part in parts[1:]:
                out = P.merged_ranks(out, P.ranks_within(part, ranges))
            return out

        ranks = [0, len(s) // 2 - 1, len(s) // 2, len(s) - 1]
        assert P.order_values(count, ranks, -50.0, 50.0) == np.sort(s)[ranks].tolist()


def test_all_labelled_rows_are_trained_on(spark, monkeypatch):
    """before, 8 000 labelled rows and 20 000 pairs of them; more rows than a task's share, with labels sent and shuffled."""
    texts = ["Word one, two. " * (i % 7 + 1) + "#" * (i % 5) + "AB 12" * (i % 3) for i in range(105)]
    docs = spark.range(9100).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 105 + 1).cast("int")).alias("text"))
    labels = docs.select("doc_id", F.when((F.col("doc_id") % 5 < 3) | (F.col("doc_id") % 11 == 0), 1).otherwise(0).alias("quality"))
    x = quality._expand(quality.statistics(*column_bytes(pa.array(texts))))[np.arange(9100) % 105]
    y = np.array([int(i % 5 < 3 or i % 11 == 0) for i in range(9100)])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    models = [quality.train(docs, labels)]
    monkeypatch.setattr(quality, "SENT", 10)
    monkeypatch.setattr(quality, "ROWS", 3000)
    models.append(quality.train(docs.repartition(5), labels))
    for m in models:
        assert np.allclose(m["mean"], mean, rtol=0, atol=1e-10) and np.allclose(m["spread"], spread, rtol=0, atol=1e-10)
        _, grad, _ = P.pair_sums(P.moments(z, y, m["w"]))
        assert np.abs(grad + 1e-3 * m["w"]).max() < 1e-8
        assert abs(m["cut"] - np.quantile(z @ m["w"], (y == 0).mean())) < 1e-9
