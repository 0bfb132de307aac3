"""Both classifiers: held-out accuracy, calibration, whole corpora, odd rows."""

from __future__ import annotations

import numpy as np
import odd
import pyarrow as pa
import pytest
from compare import rows_of
from pyspark.sql import functions as F

from emberline.llm import labelled, quality_net, quality_rules
from emberline.llm import textkit as K


@pytest.fixture(scope="module")
def split(spark):
    """Documents, labels to learn from, and labels held out."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    return docs, labels.where(~held), {r["doc_id"]: r["quality"] for r in labels.where(held).collect()}


@pytest.mark.parametrize("run", [quality_net.classify, quality_rules.judge])
def test_held_out_accuracy_and_calibration(split, run):
    docs, labels, held = split
    got = run(docs, labels)
    assert got.count() == docs.count()
    p = {r["doc_id"]: (r["probability"], r["keep"]) for r in got.collect()}
    y = np.array([held[d] for d in held if d in p])
    q = np.array([p[d][0] for d in held if d in p])
    assert len(y) > 50
    assert np.mean((q >= 0.5) == (y == 1)) > 0.9
    assert abs(q.mean() - y.mean()) < 0.1
    share = y.mean()
    loss = -np.mean(y * np.log(np.clip(q, 1e-6, 1)) + (1 - y) * np.log(np.clip(1 - q, 1e-6, 1)))
    assert loss < 0.6 * -(share * np.log(share) + (1 - share) * np.log(1 - share))


def test_probabilities_do_not_depend_on_partitions(split):
    docs, labels, _ = split
    docs = docs.where("doc_id < 200")
    for run in (quality_net.classify, quality_rules.judge):
        one, other = (dict(run(docs.repartition(n), labels).select("doc_id", "probability").collect()) for n in (1, 5))
        assert all(abs(other[d] - p) < 1e-3 for d, p in one.items())


def test_context_sums_against_brute_force():
    texts = ["a b c A B 12 13 !!", "", "b b b c", "x"]
    (got,) = list(quality_net._context_sums(iter([pa.record_batch([pa.array(texts)], names=["t"])])))
    table = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, quality_net.DIM + 1) for x in got.column(1).to_pylist()])
    at, sign = quality_net._index()
    index = np.zeros((quality_net.SLOTS, quality_net.DIM))
    for s in range(quality_net.SLOTS):
        for j in range(quality_net.NONZERO):
            index[s, at[s, j]] += sign[s, j]
    want = np.zeros((quality_net.SLOTS, quality_net.DIM + 1))
    for t in texts:
        buf, off = K.string_buffers(pa.array([t]))
        own = quality_net.slots(buf, off)[0].tolist()
        for i, s in enumerate(own):
            want[s, -1] += 1
            for j in range(max(0, i - quality_net.REACH), min(len(own), i + quality_net.REACH + 1)):
                if j != i:
                    want[s, :-1] += index[own[j]]
    assert np.allclose(table, want)


def test_a_long_text_is_pooled_whole():
    vectors = np.random.default_rng(1).normal(size=(quality_net.SLOTS, quality_net.DIM)).astype(np.float32)
    text = odd.prose(1, 400_000)
    x, some = quality_net.pooled(pa.array(["short", text, None, ""]), vectors)
    buf, off = K.string_buffers(pa.array([text]))
    s, _ = quality_net.slots(buf, off)
    assert some.tolist() == [True, True, False, False]
    assert np.allclose(x[1, : quality_net.DIM], vectors[s].mean(0), atol=1e-3)
    assert np.isclose(x[1, -1], np.log1p(len(s)))


def test_temperature_and_platt_do_not_raise_the_loss():
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 500).astype(float)
    z = (y * 2 - 1) * 6 + r.normal(0, 9, 500)
    t = labelled.temperature(z, y)
    assert t > 1.5 and labelled.log_loss(z / t, y) < labelled.log_loss(z, y)
    a, b = labelled.platt(z, y)
    assert labelled.log_loss(a * z + b, y) < labelled.log_loss(z, y)
    assert labelled.temperature(z, np.ones(500)) == 1.0 and labelled.platt(z, np.zeros(500)) == (1.0, 0.0)


def plain_features(text: str) -> dict[int, float]:
    """Hashed n-grams of a text and their shares, by loops over characters and Python's integers."""
    mask, shift = (1 << 64) - 1, 64 - quality_rules.BITS

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    raw = text.encode()
    is_word = [b >= 128 or chr(b).isalnum() or b == 95 for b in raw]
    tokens, at = [], 0
    while at < len(raw):
        if raw[at] <= 32 or raw[at] == 127:
            at += 1
            continue
        end = at
        while end < len(raw) and raw[end] > 32 and raw[end] != 127 and is_word[end] == is_word[at]:
            end += 1
        h = sum((raw[at + i] + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(end - at))
        tokens.append(mix((h + (end - at) * 0xC2B2AE3D27D4EB4F) & mask))
        at = end
    out: dict[int, float] = {}

    def add(found):
        for f in found:
            out[f] = out.get(f, 0.0) + 1 / len(found)

    for g in (1, 2):
        found = []
        for i in range(len(tokens) - g + 1):
            h = 0
            for t in tokens[i : i + g]:
                h = (h * 0xD1342543DE82EF95 + t) & mask
            found.append(mix((h + g) & mask) >> shift)
        add(found)
    for g in (3, 4, 5):
        found = []
        for i in range(len(raw) - g + 1):
            h = 0
            for b in raw[i : i + g]:
                h = h * 0x01000193 & 0xFFFFFFFF ^ b + 1
            h ^= g * 0x9E3779B9 & 0xFFFFFFFF
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 13
            h = h * 0xC2B2AE35 & 0xFFFFFFFF
            found.append(h >> 32 - quality_rules.BITS)
        add(found)
    return out


TEXTS = ["The cat  sat, on THE mat.", "", None, "a", "ab", "Ünïcode — 東京!! 12", odd.prose(3, 800)]


def test_ngram_scores_and_features_against_brute_force():
    w = np.random.default_rng(4).normal(size=1 << quality_rules.BITS).astype(np.float32)
    got = quality_rules.scores(pa.array(TEXTS), w, 0.25)
    want = [0.25 + sum(float(w[f]) * x for f, x in plain_features(t or "").items()) for t in TEXTS]
    assert np.allclose(got, want, atol=1e-4)
    assert got[1] == got[2] == 0.25
    start, index, value = quality_rules._features(pa.array(TEXTS))
    for t, a, b in zip(TEXTS, start, start[1:]):
        own: dict[int, float] = {}
        for f, x in zip(index[a:b].tolist(), value[a:b].tolist()):
            own[f] = own.get(f, 0.0) + x
        want_own = plain_features(t or "")
        assert own.keys() == want_own.keys() and all(abs(own[f] - want_own[f]) < 1e-6 for f in own)


def test_the_regression_finds_the_least_loss():
    """Against plain gradient descent over a dense matrix of the features that occur."""
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["good", "fine", "text", "bad", "spam", "x1"], 12, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05] if i % 2 else [0.1, 0.1, 0.2, 0.2, 0.2, 0.2])) for i in range(60)]
    y = np.array([i % 2 for i in range(60)], float)
    rows = [plain_features(t) for t in texts]
    names = sorted(set().union(*rows))
    x = np.array([[row.get(f, 0.0) for f in names] for row in rows])
    w, b, decay = np.zeros(len(names)), 0.0, 1e-4
    loss = lambda w, b: labelled.log_loss(x @ w + b, y) + decay * (w @ w) / 2 / len(y)
    for _ in range(6000):
        e = (labelled.sigmoid(x @ w + b) - y) / len(y)
        w, b = w - 20 * (x.T @ e + decay * w / len(y)), b - e.sum()
    got_w, got_b = quality_rules.regression(*quality_rules._features(pa.array(texts)), y)
    assert loss(got_w[names], got_b) < loss(w, b) + 0.02


def test_odd_documents(spark):
    docs, labels = odd.documents(spark), odd.labels(spark)
    n = docs.count()
    for run in (quality_net.classify, quality_rules.judge):
        got = run(docs, labels).collect()
        assert len(got) == n
        assert all(r["probability"] is not None and 0 <= r["probability"] <= 1 for r in got)
        prior = {round(r["probability"], 6) for r in got if r["doc_id"] in (5, 6)}
        assert len(prior) == 1  # null and empty texts get the share of good labels
        assert len({r["probability"] for r in got if r["doc_id"] in (1, 2)}) == 1
    kept = quality_net.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {(r["doc_id"], r["keep"]) for r in quality_net.classify(docs, labels).collect()}
    assert {(r["doc_id"], True) for r in kept.collect()} == {w for w in want if w[1]}


@pytest.mark.parametrize("run", [quality_net.classify, quality_rules.judge])
def test_empty_tables_and_missing_labels(spark, run):
    labels = odd.labels(spark)
    assert run(odd.empty(spark), labels).count() == 0
    docs = odd.documents(spark)
    assert {r["probability"] for r in run(docs, labels.limit(0)).collect()} == {1.0}
    assert {r["probability"] for r in run(docs, labels.where("quality = 0 and doc_id is not null")).collect()} == {0.0}


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(0, 1000, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    one = labelled.sample(docs, labels, 50)
    many = docs.where("doc_id < 20").crossJoin(spark.range(300).toDF("n")).select("doc_id", F.concat("text", "n").alias("text"))
    assert labelled.sample(many, labels, 5).count() == 5
    assert one.count() == 50 and rows_of(one) == rows_of(labelled.sample(docs.repartition(5), labels, 50))
