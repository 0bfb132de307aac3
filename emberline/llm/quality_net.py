"""A document quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each token hashes to a slot. A slot has a sparse random index vector, and its word vector is the sum of the index vectors
of the tokens within two places of it, over the whole corpus, weighed to length one. Tasks sum up tables of fixed size, so
what goes to the driver does not grow with the corpus. A document is described by the mean and the spread of its
tokens' vectors, frequent tokens weighing less. The network is trained on a bounded sample of labelled
documents, and its probabilities are calibrated by a temperature fitted to held-out labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import labelled
from emberline.llm import textkit as K

SLOTS = 1 << 14
DIM = 32
NONZERO = 4
REACH = 2
#: at most so many labelled documents are used for training
MAX_TRAIN = 20_000
HIDDEN = 32
EPOCHS = 40
KEEP_FROM = 0.5
_UPPER, _NUMBER, _AGAIN = (np.uint64(x) for x in (0xA5A5A5A5DEADBEEF, 0x0123456789ABCDEF, 0x5EED5EED5EED5EED))
_IS_UPPER = np.zeros(256, np.int32)
_IS_UPPER[65:91] = 1
_IS_DIGIT = np.zeros(256, np.int32)
_IS_DIGIT[48:58] = 1


def _index() -> tuple[np.ndarray, np.ndarray]:
    x = K.mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(0xC0FFEE)).reshape(SLOTS, NONZERO)
    return (x % np.uint64(DIM)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def slots(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words and marks of a slice and their documents.

    Words in capitals, numbers, and tokens equal to the one before have a slot for their kind.
    """
    tk = K.tokens(buf, off, marks=True)
    if not len(tk.hash):
        return np.zeros(0, np.int64), tk.doc
    h = tk.hash.copy()
    again = np.r_[False, (h[1:] == h[:-1]) & (tk.doc[1:] == tk.doc[:-1])]
    size = tk.end - tk.start
    for kind, table, least in ((_UPPER, _IS_UPPER, 2), (_NUMBER, _IS_DIGIT, 1)):
        # tokens are apart by white space only, which is of neither kind
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=total[1:])
        h[(total[tk.end] - total[tk.start] == size) & (size >= least)] = kind
    h[again] = _AGAIN
    return (h % np.uint64(SLOTS)).astype(np.int64), tk.doc


_PARTS = 8
_PART_DDL = "part int, sums binary"
_PART = pa.schema([("part", pa.int32()), ("sums", pa.binary())])


@K.trimmed
def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of context vectors and counts of slots, cut into parts by slot."""
    at, sign = _index()
    table = np.zeros(SLOTS * DIM)
    seen = np.zeros(SLOTS)
    for batch in batches:
        buf, off = K.string_buffers(batch.column(0))
        for lo, hi in K.slices(off, 4 * K.SLICE_BYTES):
            s, doc = slots(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            seen += np.bincount(s, minlength=SLOTS)
            for far in range(1, REACH + 1):
                ok = np.flatnonzero(doc[:-far] == doc[far:])
                a, b = s[ok], s[ok + far]
                for x, y in ((a, b), (b, a)):
                    base = x * DIM
                    for j in range(NONZERO):
                        table += np.bincount(base + at[y, j], sign[y, j], SLOTS * DIM)
    both = np.c_[table.reshape(SLOTS, DIM), seen]
    rows = [np.ascontiguousarray(p).tobytes() for p in np.split(both, _PARTS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(rows, pa.binary())], schema=_PART)


@K.trimmed
def _add_parts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table["sums"])
    return pa.Table.from_arrays([table["part"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], schema=_PART)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A vector for each slot, from all texts; frequent slots have shorter ones."""
    parts = docs.select(F.col("text").cast("string").alias("t")).where("t is not null").mapInArrow(_context_sums, _PART_DDL).groupBy("part").applyInArrow(_add_parts, _PART_DDL).collect()
    both = np.zeros((SLOTS, DIM + 1))
    for r in parts:
        own = np.frombuffer(r["sums"], np.float64).reshape(-1, DIM + 1)
        both[r["part"] * len(own) : (r["part"] + 1) * len(own)] = own
    v, seen = both[:, :DIM], both[:, DIM]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    share = seen / max(1.0, seen.sum())
    return (v * (1e-2 / (1e-2 + share))[:, None]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and whether it has any token."""
    buf, off = K.string_buffers(column)
    n = len(off) - 1
    out = np.zeros((n, 2 * DIM + 1), np.float32)
    some = np.zeros(n, bool)
    for lo, hi in K.slices(off):
        s, doc = slots(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        if not len(s):
            continue
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[at, len(s)]).astype(np.float32)[:, None]
        v = vectors[s]
        rows = doc[at] + lo
        mean = np.add.reduceat(v, at) / count
        out[rows, :DIM] = mean
        out[rows, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / count - mean * mean, 0))
        out[rows, 2 * DIM] = np.log1p(count[:, 0])
        some[rows] = True
    return out, some


@dataclass
class Network:
    """Two layers over standardised features; ``prior`` is for texts without tokens."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        p = labelled.sigmoid(self.logits(x).astype(np.float64) / self.heat) if self.heat > 0 else np.full(len(x), self.prior)
        return np.where(some, p, self.prior)


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 7, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Fits the network to rows that aren't held out and the temperature to those that are.

    With labels of one kind or none, every probability is the share of good labels (1 without labels).
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    prior = float(y.mean()) if len(y) else 1.0
    shift, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    fit_y = y[~held]
    if len(fit_y) == 0 or fit_y.min() == fit_y.max():
        return Network(shift, scale, p[0], p[1], p[2], 0.0, -1.0, prior)
    z, t = ((x - shift) / scale)[~held], fit_y
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            a = z[part]
            pre = a @ p[0] + p[1]
            h = np.maximum(pre, 0)
            e = (labelled.sigmoid(h @ p[2] + p[3][0]) - t[part]) / len(part)
            back = np.outer(e, p[2]) * (pre > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0, prior)
    net.heat = labelled.temperature(net.logits(x[held]), y[held])
    return net


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` and a network from its labelled documents, ``max_train`` at most."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @K.trimmed
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = pooled(batch.column(1), shared.value)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(some), rows], names=["k", "y", "some", "x"])

    rows = labelled.sample(docs, labels, max_train).select("k", "t", "y").mapInArrow(features, "k long, y int, some boolean, x binary").where("some").drop("some").toPandas().sort_values("k", kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), 2 * DIM + 1)
    return vectors, train(x, rows["y"].to_numpy(dtype=np.int64), labelled.folds(rows["k"].to_numpy(dtype=np.int64)))


def probability(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN):
    """A function from a text column to the probability that the text is of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, net = shared.value
        for t in texts:
            yield pa.array(np.round(net.probability(*pooled(t, vectors)), 6), pa.float64())
        K.trim()

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, probability, keep`` for each row of ``docs``, repeated ones too.

    A null text, or one without a token, gets the share of good labels. Without labels of both kinds all rows get that share, and 1
    without any. A document is kept from a probability of ``keep_from`` on. Other columns play no part.
    """
    p = probability(docs, labels, max_train)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), p(F.col("text").cast("string")).alias("probability"))
    return out.withColumn("keep", F.col("probability") >= keep_from)


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns."""
    p = probability(docs, labels, max_train)
    return docs.where(p(F.col("text").cast("string")) >= keep_from)
