"""Bounded samples of labelled documents, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, most: int, label: str = "quality") -> DataFrame:
    """``k, t, y`` of at most ``most`` labelled documents, those whose ids have the least hashes.

    Labels without id or value don't count; a document labelled several times is good if most of its labels are. The
    ids are broadcast: ``most`` bounds them. Null texts are left out; of an id with several texts the one with the least hash counts, so
    that ``most`` bounds the rows, too.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("double").alias("v")).where("k is not null and v is not null").groupBy("k").agg((F.avg("v") >= 0.5).cast("int").alias("y"))
    chosen = y.join(docs.select(F.col("doc_id").cast("long").alias("k")).where("k is not null"), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("t")).where("t is not null")
    met = texts.join(F.broadcast(chosen), "k")
    return met.groupBy("k").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.length("t"))).alias("t"), F.first("y").alias("y"))


def folds(keys: np.ndarray) -> np.ndarray:
    """True for the fifth of the keys that is held out for calibration."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)) % np.uint64(5) == 0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(z) else 0.0


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least loss on held-out labels; 1 where there is nothing to fit."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0
    lo, hi = np.log(0.05), np.log(20.0)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if log_loss(z / np.exp(a), y) <= log_loss(z / np.exp(b), y):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logits with the least loss on held-out labels, their targets smoothed."""
    good = float(y.sum())
    bad = len(y) - good
    if good == 0 or bad == 0:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([np.sum((p - target) * z), np.sum(p - target)])
        w = p * (1 - p)
        h = np.array([[np.sum(w * z * z) + 1e-6, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, g)
        size = 1.0
        now = float(np.mean(np.logaddexp(0, a * z + b) - target * (a * z + b)))
        while size > 1e-4:
            na, nb = a - size * step[0], b - size * step[1]
            if float(np.mean(np.logaddexp(0, na * z + nb) - target * (na * z + nb))) <= now + 1e-12:
                break
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(step).max() * size < 1e-7:
            break
    return float(a), float(b)
