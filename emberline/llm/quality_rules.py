"""Quality rules learned from labels: hashed n-grams of words and characters, logistic regression, fixed thresholds.

The features are n-grams of one and two tokens, capitals kept, and of three to five bytes, hashed to ``2**BITS`` weights. Each kind
counts by its share in the document, so a score is a sum of mean weights, and scoring reads a weight per n-gram
of an Arrow batch without building any vector. The regression runs in one task over a bounded sample of
labelled documents; a sigmoid fitted to held-out labels calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import labelled
from emberline.llm import textkit as K

BITS = 18
WORD_NGRAMS = (1, 2)
BYTE_NGRAMS = (3, 4, 5)
#: at most so many labelled documents are used for training
MAX_TRAIN = 3_000
STEPS = 80
REJECT_BELOW = 0.5
KEEP_FROM = 0.8
_KINDS = len(WORD_NGRAMS) + len(BYTE_NGRAMS)


def _hashes(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed features in order of the text, and where each document's begin and end."""
    tk = K.tokens(buf, off, marks=True, fold=False)
    n = len(off) - 1
    at = K.doc_ranges(tk.doc, n)
    for g in WORD_NGRAMS:
        m = max(0, len(tk.hash) - g + 1)
        h = np.zeros(m, np.uint64)
        for j in range(g):
            h = h * K.GRAM_BASE + tk.hash[j : j + m]
        h = (K.mix(h + np.uint64(g)) >> np.uint64(64 - BITS)).astype(np.int32)
        lo = np.minimum(at[:-1], m)
        yield h, lo, np.maximum(np.minimum(at[1:] - g + 1, m), lo)
    x = buf.astype(np.uint32) + np.uint32(1)
    for g in BYTE_NGRAMS:
        m = max(0, len(buf) - g + 1)
        h = np.zeros(m, np.uint32)
        for j in range(g):
            h *= np.uint32(0x01000193)
            h ^= x[j : j + m]
        h ^= np.uint32(g * 0x9E3779B9 & 0xFFFFFFFF)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        lo = np.minimum(off[:-1], m)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), lo, np.maximum(np.minimum(off[1:] - g + 1, m), lo)


def scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Logits of texts; kinds of n-grams that a text doesn't have add nothing."""
    buf, off = K.string_buffers(column)
    out = np.full(len(off) - 1, bias)
    for lo, hi in K.slices(off):
        for h, a, b in _hashes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
            total = np.zeros(len(h) + 1)
            np.cumsum(weights[h], out=total[1:])
            out[lo:hi] += (total[b] - total[a]) / np.maximum(b - a, 1)
    return out


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of texts: start of each row, features, values."""
    buf, off = K.string_buffers(column)
    starts, index, value, many = [], [], [], 0
    for lo, hi in K.slices(off):
        per_kind = list(_hashes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
        for d in range(hi - lo):
            starts.append(many)
            got, val = [], []
            for h, a, b in per_kind:
                u, c = np.unique(h[a[d] : b[d]], return_counts=True)
                got.append(u)
                val.append(c / max(1, b[d] - a[d]))
            u = np.concatenate(got).astype(np.int32)
            index.append(u)
            value.append(np.concatenate(val).astype(np.float32))
            many += len(u)
    starts.append(many)
    return np.array(starts, np.int64), np.concatenate(index) if index else np.zeros(0, np.int32), np.concatenate(value) if value else np.zeros(0, np.float32)


def regression(start: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by whole-batch Adam."""
    n, size = len(y), 1 << BITS
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    row = np.repeat(np.arange(n), np.diff(start))
    for step in range(1, steps + 1):
        z = np.bincount(row, w[index] * value, n) + b
        e = (labelled.sigmoid(z) - y) / n
        g = np.bincount(index, value * e[row], size) + decay * w / n
        gb = float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        b -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
    return w, b


_MODEL_DDL = "weights binary, bias double, slope double, offset double, prior double"


@K.trimmed
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [b for b in batches if b.num_rows]
    w, bias, slope, offset, prior = np.zeros(1 << BITS), 0.0, 0.0, 0.0, 1.0
    if tables:
        table = pa.Table.from_batches(tables).sort_by("k")
        y = table["y"].to_numpy().astype(np.float64)
        prior = float(y.mean())
        held = labelled.folds(table["k"].to_numpy())
        if len(set(y[~held])) == 2:
            start, index, value = _features(table["t"])
            take = np.repeat(~held, np.diff(start))
            size = np.diff(start)[~held]
            w, bias = regression(np.r_[0, np.cumsum(size)], index[take], value[take], y[~held])
            row = np.repeat(np.arange(len(y)), np.diff(start))
            z = np.bincount(row, w[index] * value, len(y)) + bias
            slope, offset = labelled.platt(z[held], y[held])
            slope = max(slope, 1e-3)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), *(pa.array([x]) for x in (bias, slope, offset, prior))], names=["weights", "bias", "slope", "offset", "prior"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float, float, float, float]:
    """Weights, bias, slope and offset of the calibration (slope 0: no labels of both kinds), and the share of good labels."""
    one = labelled.sample(docs, labels, max_train).select("k", "t", "y").repartition(1).mapInArrow(_fit, _MODEL_DDL).first()
    if one is None:  # an empty table may have no task
        return np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0, 1.0
    return np.frombuffer(one["weights"], np.float32), one["bias"], one["slope"], one["offset"], one["prior"]


def judge(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW, keep_from: float = KEEP_FROM, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, probability, verdict, keep`` for each row of ``docs``, repeated ones too.

    The verdict is ``reject`` below ``reject_below``, ``keep`` from ``keep_from`` on and ``review`` between; what isn't rejected is kept.
    A null or empty text gets the share of good labels. Without labels of both kinds all rows get that share, and
    1 without any. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias, slope, offset, prior = shared.value
        for t in texts:
            if slope:
                p = labelled.sigmoid(scores(t, weights, bias) * slope + offset)
                _, off = K.string_buffers(t)
                p = np.where(np.diff(off) > 0, p, prior)
            else:
                p = np.full(len(t), prior)
            yield pa.array(np.round(p, 6), pa.float64())
        K.trim()

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.arrow_udf(score, "double")(F.col("text").cast("string")).alias("probability"))
    verdict = F.when(F.col("probability") < reject_below, "reject").when(F.col("probability") < keep_from, "review").otherwise("keep")
    return out.withColumn("verdict", verdict).withColumn("keep", F.col("probability") >= reject_below)
