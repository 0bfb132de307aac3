from __future__ import annotations

import random
from collections import defaultdict

import brute
import odd
import pytest
import tiktoken
from pyspark.sql import functions as F

from emberline.llm import packing as P
from emberline.llm import token_counts as T


@pytest.mark.parametrize("capacity", [2, 7, 64, 300])
def test_the_rule_is_that_of_brute_force(capacity):
    r = random.Random(capacity)
    for _ in range(8):
        sizes = [r.choice([0, 1, 2, r.randrange(1, capacity), r.randrange(1, 3 * capacity)]) for _ in range(r.randrange(1, 150))]
        assert list(P.sum_of_squares(sizes, capacity)) == brute.pack(sizes, capacity)


def test_one_shard_of_a_table(spark):
    r = random.Random(5)
    docs = [(i, " ".join("w" * (1 + r.randrange(3)) for _ in range(r.randrange(0, 200)))) for i in range(150)]
    got = [(x["doc_id"], x["piece"], x["window_id"], x["window_offset"], x["n_tokens"]) for x in P.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64).collect()]
    want = brute.pack([brute.word_count(t) for _, t in docs], 64)
    none = [(d, 0, None, 0, 0) for d, t in docs if not t]
    assert sorted(got, key=str) == sorted([*want, *none], key=str)


def check_windows(rows, capacity, total):
    by = defaultdict(list)
    for r in rows:
        if r["window_id"] is not None:
            by[r["window_id"]].append((r["window_offset"], r["n_tokens"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    assert sum(r["n_tokens"] for r in rows) == total


def test_shards_fill_windows_without_gaps(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text"))
    rows = P.pack(docs, capacity=128, docs_per_shard=500).collect()
    check_windows(rows, 128, sum(i % 97 for i in range(3000)))
    assert len({r["window_id"] >> 40 for r in rows if r["window_id"] is not None}) == 6
    windows = len({r["window_id"] for r in rows} - {None})
    assert windows < 1.05 * sum(i % 97 for i in range(3000)) / 128 + 6


def test_odd_documents(spark):
    rows = P.pack(odd.documents(spark)).collect()
    check_windows(rows, P.CAPACITY, sum(brute.word_count(r[1]) for r in odd.rows()))
    assert sum(r["window_id"] is None for r in rows) == 4  # two null texts, one empty, one blank
    pieces = sorted((r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 11)
    assert sum(n for _, n in pieces) == odd.LONG_WORDS and pieces[0][0] == 0
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] is None) == 70
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 2) == 240  # both rows


def test_large_ids_beside_null_ones(spark):
    ids = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1]
    rows = P.pack(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted(ids, key=str)


def test_windows_of_tokens(spark):
    vocabulary = T.read_ranks(T.VOCABULARY)
    exact = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
    docs = [r[:2] for r in odd.rows() if r[0] != 11]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), tokens=T.n_tokens(spark, F.col("text"))).collect()
    check_windows(rows, P.CAPACITY, sum(len(exact.encode_ordinary(t)) for _, t in docs if t))


def test_empty_table_and_wrong_capacity(spark):
    assert P.pack(odd.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        P.pack(odd.empty(spark), capacity=1)
