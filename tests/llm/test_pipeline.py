"""The pipeline against plain versions of its stages, on a fixture small enough for them."""

from __future__ import annotations

import random

import brute
import corpus_pipeline as P
import odd
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_mixing import brute_mix

from emberline.llm import mixing, packing, quality_net, token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose and junk with labels, near copies, shared passages, and rows with nulls."""
    at = tmp_path_factory.mktemp("corpus")
    r = random.Random(8)
    passage = odd.prose(77, 90)
    rows, labels = [], []
    for i in range(220):
        good = i % 4 != 0
        text = odd.prose(i, r.randrange(60, 120)) if good else " ".join(r.choice(["BUY", "$$$", "click", "!!!", "777", "free"]) for _ in range(80))
        if good and i % 9 == 1:
            text += " " + passage + " " + odd.prose(i + 1000, 4)
        if good and i % 13 == 5 and rows:
            copied = next((x for x in reversed(rows) if "BUY" not in (x[1] or "BUY")), None)
            text = copied[1] + " and more"
        rows.append((i, text, r.choice(["en", "de", "fr", "es"]), f"src{r.randrange(6)}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), 0))
    rows += [(None, odd.prose(5000, 70), "en", "src1", 1), (900, None, "en", "src1", None), (901, "", None, None, 0), (3, rows[3][1], "en", "src2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def plain(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def brute_stage(name, docs, folder, spark):
    """Rows after a stage, from rows before it."""
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    if name == "quality classifier":
        vectors, net = quality_net.fit(df, spark.read.parquet(f"{folder}/labels.parquet"))
        p = [net.probability(*quality_net.pooled(pa.array([t], pa.string()), vectors))[0] for _, t, *_ in docs]
        return [r for r, x in zip(docs, p) if round(x, 6) >= quality_net.KEEP_FROM]
    if name == "n-gram Jaccard join":
        gone = brute.near_copies([r[:2] for r in docs])
        return [r for r in docs if r[0] not in gone]
    if name == "suffix-array dedup":
        unique = list({r[:2] for r in docs})
        assert len({u[0] for u in unique}) == len(unique)
        spans = {}
        for d, a, n, _, _ in brute.passages(unique):
            spans.setdefault(d, []).append((a, a + n))
        out = []
        for d, t, lang, source, n in docs:
            if d in spans:
                t = brute.without(t, spans[d])
                n = len(t)
            out.append((d, t, lang, source, n))
        return out
    if name == "mixing":
        read = brute_mix(df, 0.8, 1)
        left = list(docs)
        out = []
        for d, t, _ in read:
            i = next(i for i, r in enumerate(left) if r[:2] == (d, t))
            out.append(left.pop(i))
        return out
    raise KeyError(name)


def test_each_stage_is_that_of_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        want = brute_stage(name, [tuple(r[c] for c in COLUMNS) for r in docs.collect()], folder, spark)
        got = stage(spark, docs, folder)
        assert got.columns == COLUMNS and got.dtypes == docs.dtypes
        got.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert plain(docs) == sorted(want, key=str), name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4]
    last = P.STAGES[-1][1](spark, docs, folder).collect()
    rows = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["th"]))
    exact = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(token_counts.VOCABULARY), special_tokens={})
    sizes = [len(exact.encode_ordinary(r["text"] or "")) for r in rows]
    want = [(rows[i]["doc_id"], piece, w, at, n) for i, piece, w, at, n in brute.pack(sizes, packing.CAPACITY)]
    assert sorted(((r["doc_id"], r["piece"], r["window_id"], r["window_offset"], r["n_tokens"]) for r in last if r["window_id"] is not None), key=str) == sorted(want, key=str)
    assert sum(r["window_id"] is None for r in last) == sum(n == 0 for n in sizes)


def test_run_is_all_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_clean_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in P.quality(spark, docs, folder).collect()}
    good = {i for i in range(220) if i % 4}
    assert len(good - kept) <= 0.02 * len(good)
    assert len(kept & {i for i in range(220) if i % 4 == 0}) <= 3


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert mixing.mix(docs).columns == COLUMNS
