"""The trained operators' features, statistics, losses and scores against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediagrain.llm import language, quality, toxicity, urls
from mediagrain.llm.textkit import column_bytes

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = ["", " \n ", "a", "A.B!! |x| a a a\n\na a a\nélan élan 12", "word " * 40 + "\nword word\n" * 3, "ÀÉ ñandú überlange-Wörter, 100%!"]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]


# quality


def plain_statistics(t):
    b, words = t.encode(), WORD.findall(t)
    n, lines = len(words), [x for x in t.split("\n") if x]
    per_word, per_byte = max(n, 1), max(len(b), 1)
    size = [len(w.encode()) for w in words]
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    return [
        math.log1p(n),
        sum(c in b"#*$%&<>@^~={}[]\\/_+" for c in b) / per_byte,
        sum(65 <= c <= 90 for c in b) / per_byte,
        t.count("|") / per_word,
        t.count("!") / per_word,
        sum(48 <= c <= 57 for c in b) / per_byte,
        sum(size) / per_word / 10,
        sum(x == y for x, y in zip(words, words[1:])) / per_word,
        sum(g in grams[:i] for i, g in enumerate(grams)) / per_word,
        sum(x in lines[:i] for i, x in enumerate(lines)) / max(len(lines), 1),
        sum(s <= 2 for s in size) / per_word,
        sum(s >= 12 for s in size) / per_word,
        math.log1p(per_word / max(len(lines), 1)),
        t.count(".") / per_word,
    ]


def test_quality_statistics(texts):
    got = quality.statistics(*column_bytes(pa.array(texts)))
    assert np.allclose(got, [plain_statistics(t) for t in texts])


def test_pair_loss_falls_and_orders():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.6, 1, (80, 3)), rng.normal(-0.6, 1, (70, 3))
    w = quality.fit_pairs(good, bad, 4000)
    pick = np.random.default_rng(7)
    d = good[pick.integers(0, 80, 4000)] - bad[pick.integers(0, 70, 4000)]
    loss = lambda v: np.mean(np.logaddexp(0, -d @ v)) + 1e-3 / 2 * v @ v
    assert loss(w) < loss(0 * w) and np.mean(d @ w > 0) > 0.8
    for k in range(3):  # a minimum: no step along an axis lowers the loss
        e = np.eye(3)[k] * 0.02
        assert loss(w + e) >= loss(w) - 1e-6 and loss(w - e) >= loss(w) - 1e-6


def test_quality_score_is_the_plain_one_and_ties_pass(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(texts))], "doc_id long, quality int")
    m = quality.train(docs, labels)
    x = np.array([plain_statistics(t) for t in texts])
    x = np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(np.abs(x) * 20, 1)], axis=1)
    y = np.array([i % 3 > 0 for i in range(len(texts))])
    assert np.allclose(m["mean"], x.mean(0)) and np.allclose(m["spread"], x.std(0) + 1e-6)
    s = np.clip((x - m["mean"]) / m["spread"], -8, 8) @ m["w"]
    assert abs(m["cut"] - np.quantile(s, (~y).mean())) < 1e-9
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], 1 / (1 + np.exp(-(s - m["cut"] + math.log(7 / 3)))))
    double = docs.filter("doc_id = 4")
    assert len({r.score for r in quality.score(double.unionByName(double), m).collect()}) == 1
    at_cut = m | {"w": 0 * m["w"], "cut": 0.0}
    assert all(abs(r.score - 0.7) < 1e-12 for r in quality.score(docs, at_cut).collect())


# toxicity


def plain_features(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = [w.encode() for w in ALNUM.findall(low)]
    return Counter([(0, w) for w in words] + [(k, w[:k]) for k in toxicity.PREFIXES for w in words if len(w) > k])


def test_toxicity_features(texts):
    rows, h, n = toxicity.word_counts(*column_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        want = plain_features(t)
        own = dict(zip(h[rows == i].tolist(), n[rows == i].tolist()))
        assert sum(own.values()) == sum(want.values()) and len(own) <= len(want)
    # one feature alone gives one hash, and the same one in any text
    for w in ("word", "Überlange", "a"):
        _, one, _ = toxicity.word_counts(*column_bytes(pa.array([w])))
        _, other, _ = toxicity.word_counts(*column_bytes(pa.array([f"xx {w}, yy"])))
        assert set(one) <= set(other) and len(one) == len(plain_features(w))


def plain_nnpu(p, u, w, b, prior):
    loss = lambda z: np.log1p(np.exp(z))
    positive = prior * np.mean(loss(-(p @ w + b)))
    negative = np.mean(loss(u @ w + b)) - prior * np.mean(loss(p @ w + b))
    return positive, negative


@pytest.mark.parametrize("prior", [0.1, 0.95])
def test_nnpu_risk_and_gradient(prior):
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (30, 4)), rng.normal(0 if prior < 0.5 else -3, 1, (50, 4))
    w, b = rng.normal(0, 1, 4), 0.3
    positive, negative, g = toxicity.nnpu_risk(p, u, w, b, prior)
    assert np.allclose((positive, negative), plain_nnpu(p, u, w, b, prior))
    assert (negative < 0) == (prior > 0.5)
    risk = lambda v: sum(plain_nnpu(p, u, v[:4], v[4], prior)) if negative >= 0 else -plain_nnpu(p, u, v[:4], v[4], prior)[1]
    at = np.append(w, b)
    for k in range(5):
        e = np.eye(5)[k] * 1e-5
        assert abs((risk(at + e) - risk(at - e)) / 2e-5 - g[k]) < 1e-6


def test_toxicity_score_is_the_plain_one(spark, texts):
    weights = np.random.default_rng(1).normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weights, -1.0)).collect()}
    rows, h, n = toxicity.word_counts(*column_bytes(pa.array(texts)))
    for i in range(len(texts)):
        z = -1.0 + sum(float(weights[a]) * min(math.log2(1 + c), 3) for a, c in zip(h[rows == i].tolist(), n[rows == i].tolist()))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


# language


def reduced(t):
    out = []
    for c in t.encode().lower() if t.isascii() else bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()):
        letter = 97 <= c <= 122 or c >= 128
        if letter:
            out.append(c)
        elif not out or out[-1] != 32:
            out.append(32) if out else None
    return bytes(out)


def plain_tree(texts):
    """counts[context][byte] for contexts of no to three bytes, after three spaces."""
    counts = defaultdict(Counter)
    for t in texts:
        s = b"   " + reduced(t)
        for i in range(3, len(s)):
            for k in range(4):
                counts[s[i - k : i]][s[i]] += 1
    return counts


def plain_cost(counts, s, i):
    bits = 0.0
    for k in (3, 2, 1, 0):
        own = counts.get(s[i - k : i])
        if own is None:
            continue
        total = sum(own.values()) + len(own)
        if s[i] in own:
            return bits - math.log2(own[s[i]] / total)
        bits -= math.log2(len(own) / total)
    return bits + 8


def test_code_lengths_from_raw_counts(spark):
    given = [(1, "the cat sat on the mat", "en"), (2, "Der Hund! der Hund bellt.", "de"), (3, "un été là-bas", "fr"), (4, "the dog", "en")]
    model = language.train(spark.createDataFrame(given, "doc_id long, text string, lang string")).ready()
    asked = ["the hound", "Hund und Katze 42", "été", "xyzzy", "a"]
    bits = model.lengths(*column_bytes(pa.array(asked)))
    for k, lang in enumerate(model.names):
        counts = plain_tree([t for _, t, x in given if x == lang])
        for r, t in enumerate(asked):
            s = b"   " + reduced(t)
            assert abs(bits[r, k] - sum(plain_cost(counts, s, i) for i in range(3, len(s)))) < 1e-3, (lang, t)


# urls


def plain_grams(key):
    b = key.encode()
    n = Counter(b[i : i + k] for k in urls.SIZES for i in range(len(b) - k + 1))
    norm = math.sqrt(sum(v * v for v in n.values()))
    return {g: v / norm for g, v in n.items()}


def test_url_features_and_score(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(30).select("page_id", "url", F.lit("x").alias("score"), F.lit(1).alias("key"))
    keys = {r.page_id: f"{r.h}\n{r.p}" for r in pages.select("page_id", urls.host_path(F.col("url"))[0].alias("h"), urls.host_path(F.col("url"))[1].alias("p")).collect()}
    weights = np.random.default_rng(5).normal(0, 1, 1 << urls.BITS)
    got = {r.page_id: r.score for r in urls.judge(pages.unionByName(pages.limit(1)), (weights, 0.2)).collect()}
    for i, key in keys.items():
        url, gram, value = urls.gram_counts(*column_bytes(pa.array([key])))
        want = plain_grams(key)
        assert sorted(value.round(9)) == sorted(np.round(list(want.values()), 9)) or len(set(gram)) < len(want)
        assert abs(got[i] - 1 / (1 + math.exp(-(float(weights[gram] @ value) + 0.2)))) < 1e-9
    assert urls.judge(pages.limit(0), (weights, 0.2)).count() == 0


def test_logistic_regression_reaches_its_minimum():
    url, gram, value = np.array([0, 0, 1, 1, 2, 3]), np.array([5, 9, 5, 7, 9, 7]), np.array([0.6, 0.8, 0.8, 0.6, 1.0, 1.0])
    y = np.array([1.0, 0, 1, 0])
    weights, bias = urls.fit(url, gram, value, y)

    def loss(w, b):
        z = np.bincount(url, w[gram] * value, 4) + b
        return np.mean(np.logaddexp(0, z) - y * z)

    assert loss(weights, bias) < 0.05 < loss(0 * weights, 0.0)
