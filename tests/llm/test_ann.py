from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import ann
from emberline.llm.entries import QUERIES


def exact(x: np.ndarray, ids: np.ndarray, k: int, rows: np.ndarray | None = None) -> dict[int, list[int]]:
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rows = np.arange(len(x)) if rows is None else rows
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -np.inf
    return {int(ids[i]): [int(j) for j in ids[np.argsort(-own, kind="stable")[:k]]] for i, own in zip(rows, s)}


def recall(got, want) -> float:
    return sum(len(set(got.get(i, ())) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


def as_lists(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    return out


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    want = exact(np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows]), 10)
    got = as_lists(ann.neighbours(df))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9


def test_the_query_takes_every_hundredth_row_against_all(spark):
    at = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    want = exact(np.array([r["embedding"] for r in rows]), ids, 10, np.flatnonzero(ids % 100 == 0))
    got = as_lists(QUERIES["op6_nearest_neighbours"](spark, at))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9


def clustered(n: int, d: int, groups: int, spread: float) -> tuple[np.ndarray, pa.Table]:
    r = np.random.default_rng(1)
    x = (r.normal(size=(groups, d))[r.integers(0, groups, n)] + spread * r.normal(size=(n, d))).astype(np.float32)
    return x, pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), d).cast(pa.list_(pa.float32()))})


def test_default_parameters_on_many_vectors(spark):
    """Walks trees of some hundred leaves: few vectors are compared, and most true neighbours found."""
    n = 24_000
    x, table = clustered(n, 32, 400, 0.5)
    df = spark.createDataFrame(table).repartition(4)
    index = ann.fit(df)
    assert index.forest.leaves >= 4 * n / ann.LEAF
    assert index.probes * n * len(index.forest.roots) / index.forest.leaves < 0.2 * n
    asked = np.arange(0, n, 100)
    want = exact(x, np.arange(n), 10, asked)
    got = as_lists(ann.neighbours(df, queries=df.where("vec_id % 100 = 0")))
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_trees_go_on_inside_of_leaves(spark):
    """A sample of 400 gives leaves of about 300 vectors, in which trees go on to leaves of 20."""
    n = 6000
    x, table = clustered(n, 16, 60, 0.5)
    df = spark.createDataFrame(table).repartition(4)
    asked = df.where("vec_id % 20 = 0")
    want = exact(x, np.arange(n), 10, np.arange(0, n, 20))
    got = as_lists(ann.neighbours(df, queries=asked, leaf=20, max_sample=400))
    assert recall(got, want) >= 0.88
    assert as_lists(ann.neighbours(df, queries=asked, leaf=20, max_sample=400, waves=3)) == got


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_recall_with_small_leaves(spark, spread):
    """Leaves of 40, in tight and in loose clusters: the queue has to walk the trees."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(30, 24))[r.integers(0, 30, 1500)] + spread * r.normal(size=(1500, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = as_lists(ann.neighbours(df, leaf=40))
    assert recall(got, exact(x, np.arange(1500), 10)) >= 0.9


def test_a_search_of_all_leaves_is_exact_and_ranked(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, k=5, trees=2, leaf=20, probes=10_000)
    assert recall(as_lists(got), exact(x, np.arange(300), 5)) == 1.0
    for v in got.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "similarity"))).alias("x")).collect():
        assert [y["rank"] for y in v["x"]] == [1, 2, 3, 4, 5]
        s = [y["similarity"] for y in v["x"]]
        assert s == sorted(s, reverse=True)


def test_the_queue_takes_the_nearest_planes_first():
    r = np.random.default_rng(3)
    f = ann.build(r.normal(size=(500, 6)).astype(np.float32), 3, 20)
    q = r.normal(size=6).astype(np.float32)
    margins = (q @ f.normal.T - f.offset).tolist()
    order, keys = f.search(margins, f.leaves)
    assert keys == sorted(keys)
    assert sorted(order) == list(range(f.leaves))
    assert set(order[:3]) == {int(f.leaf_of(q[None], t)[0]) for t in f.roots}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("z") for c in ("id", "v", "leaf", "kind", "part", "q", "s", "rank", "label")})
    got = ann.neighbours(df, k=3)
    lists = as_lists(got)
    assert set(lists) == {1, 2, 3, 4, 11}
    assert lists[1] == [2, 3, 4] and lists[2] == [1, 3, 4]  # ties by the lesser id
    assert all(v not in n for v, n in lists.items())
    assert {r["similarity"] for r in got.where("vec_id = 4").collect()} == {0.0}
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id = 1")).count() == 0


def test_vectors_that_are_all_the_same(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5).cast("float")] * 8).alias("embedding"))
    got = as_lists(ann.neighbours(df, k=4, leaf=50))
    assert got[9] == [0, 1, 2, 3] and got[0] == [1, 2, 3, 4] and len(got) == 500
