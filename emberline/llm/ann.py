"""Approximate nearest neighbours by cosine, with a forest of random-projection trees.

A tree halves the vectors by the direction between two random ones of them, again and again, down to leaves of ``LEAF`` vectors. The top of
the forest is grown from a bounded sample of the vectors, so that it can be broadcast; where a leaf of the sample stands for more
than ``LEAF`` vectors, the tree goes on inside the leaf, among all of its vectors. Every vector is in one leaf of each tree.

A query walks all trees through one priority queue. The key of a node is the greatest of the query's signed distances from the planes on
the way, each taken positive where the way leaves the query's side; the queue gives nodes by least key, until ``probes`` leaves
are reached. The key of the last one also tells how far the query goes inside of leaves. There, it is compared exactly with all vectors,
and the best of all leaves are ranked.

How many leaves a query has to reach depends on the vectors: a few where they form clusters, a large share where they
are spread evenly in many dimensions. So ``probes`` is the least number with which a sample of queries, compared with all
vectors, finds the wanted share of its true neighbours. Where trees go on inside of leaves the share is measured again there, and the number raised until it is met.

Leaves lie in buckets of neighbouring leaves, which are the tasks: a vector goes to one bucket for each tree, a query once to each bucket
that has leaves for it. Very many queries go in waves, so that a task's part of them is bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.llm.common import pieces, spread

K_NEIGHBOURS = 10
TREES = 4
LEAF = 256
RECALL = 0.95
#: queries by which ``probes`` is found
TRIED = 256
#: vectors at most from which the top of the forest is grown; all vectors are indexed
MAX_SAMPLE = 1 << 18
#: vectors of the sample in a leaf at least
LEAST_SAMPLE = 16
ROWS_PER_BUCKET = 50_000
QUERIES_PER_WAVE = 500_000
FLUSH = 16_384
SEED = 5


@dataclass
class Forest:
    normal: np.ndarray  # (nodes, d)
    offset: np.ndarray
    child: np.ndarray  # (nodes, 2): a node, or ~leaf
    roots: list[int]  # likewise
    leaves: int

    def leaf_of(self, x: np.ndarray, root: int) -> np.ndarray:
        at = np.full(len(x), root, np.int64)
        while True:
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                return ~at
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.offset[node]
            at[inner] = self.child[node, side.astype(np.int64)]

    def search(self, margins: list[float], probes: int) -> tuple[list[int], list[float]]:
        """The leaves that a query reaches first, and their keys; ``margins`` are its signed distances from all nodes' planes."""
        heap = [(-np.inf, root) for root in self.roots]
        heapq.heapify(heap)
        child = self.children
        found: list[int] = []
        keys: list[float] = []
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(found) < probes:
            key, node = pop(heap)
            if node < 0:
                found.append(~node)
                keys.append(key)
                continue
            m = margins[node]
            left, right = child[node]
            push(heap, (max(key, m), left))
            push(heap, (max(key, -m), right))
        return found, keys

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.normal.T - self.offset if len(self.normal) else np.zeros((len(x), 0), np.float32)

    @property
    def children(self) -> list[list[int]]:
        if not hasattr(self, "_children"):
            self._children = self.child.tolist()
        return self._children


def halves(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A plane across the direction between two random ones of ``x``, at the median, and which lie beyond it; None if three tries don't tell them apart."""
    for _ in range(3):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        n = a - b
        size = float(np.linalg.norm(n))
        if size < 1e-9:
            continue
        n = n / size
        p = x @ n
        cut_at = float(np.median(p))
        right = p > cut_at
        if 0 < right.sum() < len(x):
            return n, cut_at, right
    return None


def build(sample: np.ndarray, trees: int, leaf: int, seed: int = SEED) -> Forest:
    """A forest whose leaves hold at most ``leaf`` vectors of the sample, unless those can't be told apart."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    normal, offset, child, roots = [], [], [], []
    leaves = 0
    for _ in range(trees):
        stack = [(np.arange(len(sample)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            split = halves(sample[rows], rng) if len(rows) > leaf else None
            if split is None:
                me = ~leaves
                leaves += 1
            else:
                me = len(normal)
                normal.append(split[0])
                offset.append(split[1])
                child.append([0, 0])
                stack.append((rows[~split[2]], me, 0))
                stack.append((rows[split[2]], me, 1))
            if parent < 0:
                roots.append(me)
            else:
                child[parent][side] = me
    return Forest(np.array(normal, np.float32).reshape(-1, d), np.array(offset, np.float32), np.array(child, np.int64).reshape(-1, 2), roots, leaves)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)


_DDL = "b int, leaf binary, ids binary, data binary, key binary, most binary"
_BLOB = pa.schema([("b", pa.int32()), *((c, pa.binary()) for c in ("leaf", "ids", "data", "key", "most"))])


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    return zip(sorted_[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_)])


def _blobs(bucket: np.ndarray, labels: np.ndarray, columns: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each bucket with its part of each column."""
    o = np.argsort(bucket, kind="stable")
    rows = [(int(labels[b]), *(b"" if c is None else np.ascontiguousarray(c[o[lo:hi]]).tobytes() for c in columns)) for b, lo, hi in _runs(bucket[o])]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)


def _flushes(batches: Iterator[pa.RecordBatch], d: int, most: int = FLUSH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors, about ``most`` at once."""
    held, many = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1), d)))
            many += batch.num_rows
        if many >= most:
            yield tuple(np.concatenate([h[i] for h in held]) for i in range(2))
            held, many = [], 0
    if many:
        yield tuple(np.concatenate([h[i] for h in held]) for i in range(2))


def _least_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows without those of the same vector as ``most`` others of lesser ids: they can't be among the nearest of anything."""
    _, same = np.unique(np.ascontiguousarray(x).view([("", np.void, x.shape[1] * 4)]).ravel(), return_inverse=True)
    o = np.lexsort((ids, same))
    once = np.r_[True, (same[o][1:] != same[o][:-1]) | (ids[o][1:] != ids[o][:-1])]
    o = o[once]
    place = np.arange(len(o)) - np.searchsorted(same[o], same[o])
    return o[place < most]


def _members(shared, labels: np.ndarray, d: int, k: int):
    """Vectors to the buckets of their leaves. Of equal vectors, those of the least ids go."""

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for ids, x in _flushes(batches, d):
            own = _least_copies(ids, x, k + 1)
            ids, x = ids[own], x[own]
            for root in forest.roots:
                leaf = forest.leaf_of(x, root)
                yield _blobs(leaf * len(labels) // forest.leaves, labels, [leaf.astype(np.int32), ids, x, None, None])

    return run


def _queries(shared, labels: np.ndarray, d: int, probes: int):
    """Queries to the buckets of the leaves that they reach: leaf and key of each visit with the query's place, then ids, vectors and last keys."""

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for ids, x in _flushes(batches, d, 2048):
            visits = [forest.search(m.tolist(), probes) for m in forest.margins(x)]
            row = np.repeat(np.arange(len(x)), [len(v) for v, _ in visits])
            leaf = np.array([y for v, _ in visits for y in v], np.int64)
            key = np.array([y for _, v in visits for y in v], np.float32)
            last = np.array([v[-1] for _, v in visits], np.float32)
            bucket = leaf * len(labels) // forest.leaves
            o = np.lexsort((row, bucket))
            rows = []
            for b, lo, hi in _runs(bucket[o]):
                p = o[lo:hi]
                who, at = np.unique(row[p], return_inverse=True)
                rows.append((int(labels[b]), np.stack([leaf[p], at], 1).astype(np.int32).tobytes(), ids[who].tobytes(), x[who].tobytes(), key[p].tobytes(), last[who].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)

    return run


_BEST_DDL = "part int, q binary, n binary, s binary"
_BEST = pa.schema([("part", pa.int32()), ("q", pa.binary()), ("n", pa.binary()), ("s", pa.binary())])


def _cat(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _visit(x: np.ndarray, q: np.ndarray, key: np.ndarray, most: np.ndarray, leaf: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets of vectors of a leaf and of queries to be compared: the tree goes on in the leaf, and queries where their keys allow."""
    stack = [(np.arange(len(x)), np.arange(len(q)), key, 1)]
    while stack:
        rows, who, key, node = stack.pop()
        # a node's plane is the same whatever queries come
        split = halves(x[rows], np.random.default_rng((seed, node))) if len(rows) > leaf else None
        if split is None:
            yield rows, who
            continue
        m = q[who] @ split[0] - np.float32(split[1])
        for n, (side, away) in enumerate(((~split[2], m), (split[2], -m))):
            k = np.maximum(key, away)
            go = np.flatnonzero(k <= most[who])
            if len(go):
                stack.append((rows[side], who[go], k[go], 2 * node + n))


def _rank(d: int, k: int, parts: int, leaf_size: int):
    """In a bucket of leaves: the best members for each query."""

    def rank(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _BEST.empty_table()
        m_leaf, m_ids, m = _cat(members, "leaf", np.int32), _cat(members, "ids", np.int64), _cat(members, "data", np.float32).reshape(-1, d)
        o = np.lexsort((m_ids, m_leaf))
        m_leaf, m_ids, m = m_leaf[o], m_ids[o], m[o]
        size = [len(x) // 8 for x in queries["ids"].to_pylist()]
        visits = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in queries["leaf"]]
        q_ids, q, most, key = _cat(queries, "ids", np.int64), _cat(queries, "data", np.float32).reshape(-1, d), _cat(queries, "most", np.float32), _cat(queries, "key", np.float32)
        v_leaf = np.concatenate([v[:, 0] for v in visits])
        v_row = np.concatenate([v[:, 1] + at for v, at in zip(visits, np.cumsum([0, *size[:-1]]))])
        o = np.argsort(v_leaf, kind="stable")
        v_leaf, v_row, key = v_leaf[o], v_row[o], key[o]
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        pending = 0
        for leaf, lo, hi in _runs(v_leaf):
            a, b = np.searchsorted(m_leaf, [leaf, leaf + 1])
            if a == b:
                continue
            x, x_ids = m[a:b], m_ids[a:b]
            who = v_row[lo:hi]
            own = np.sort(_least_copies(x_ids, x, k + 1))
            x, x_ids = x[own], x_ids[own]
            for rows, of in _visit(x, q[who], key[lo:hi], most[who], 2 * leaf_size, leaf):
                near, near_ids = x[rows], x_ids[rows]
                # an id with several vectors must not take the place of others
                take = min(k + 1, len(rows)) if len(np.unique(near_ids)) == len(rows) else len(rows)
                for at in range(0, len(of), 512):
                    w = who[of[at : at + 512]]
                    s = q[w] @ near.T
                    if take < len(rows):
                        top = np.argpartition(s, len(rows) - take, axis=1)[:, len(rows) - take :]
                        # where more are as near as the last of the best, the lesser ids go first
                        least = np.take_along_axis(s, top, 1).min(1, keepdims=True)
                        tied = np.flatnonzero((s >= least).sum(1) > take)
                        top[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :take]
                    else:
                        top = np.broadcast_to(np.arange(len(rows)), s.shape)
                    got.append((np.repeat(w, take), near_ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
                    pending += top.size
            if pending > 2_000_000:
                best, got, pending = _top(best, got, k + 1), [], 0
        row, n, s = _top(best, got, k + 1)
        qs = q_ids[row]
        ok = qs != n
        qs, n, s = qs[ok], n[ok], s[ok]
        to = (K.mix(qs.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts
        o = np.argsort(to, kind="stable")
        out = [(p, *(c[o[lo:hi]].tobytes() for c in (qs, n, s))) for p, lo, hi in _runs(to[o])]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_BEST)], schema=_BEST)

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        try:
            return rank(members, queries)
        finally:
            K.trim()

    return run


def _top(best: tuple[np.ndarray, ...], more: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` nearest for each query, each once."""
    q, n, s = (np.concatenate([b, *(m[i] for m in more)]) for i, b in enumerate(best))
    o = np.lexsort((-s, n, q))
    q, n, s = q[o], n[o], s[o]
    once = np.r_[True, (q[1:] != q[:-1]) | (n[1:] != n[:-1])] if len(q) else np.zeros(0, bool)
    q, n, s = q[once], n[once], s[once]
    o = np.lexsort((n, -s, q))
    q, n, s = q[o], n[o], s[o]
    top = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[top], n[top], s[top]


_OUT_DDL = "vec_id long, neighbor_id long, rank int, similarity double"
_OUT = pa.schema([("vec_id", pa.int64()), ("neighbor_id", pa.int64()), ("rank", pa.int32()), ("similarity", pa.float64())])


def _merge(k: int):
    @K.trimmed
    def run(table: pa.Table) -> pa.Table:
        s = np.round(_cat(table, "s", np.float32).astype(np.float64), 6)
        q, n, s = _top((_cat(table, "q", np.int64), _cat(table, "n", np.int64), s), [], k)
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        return pa.Table.from_arrays([pa.array(q), pa.array(n), pa.array(rank.astype(np.int32)), pa.array(s)], schema=_OUT)

    return run


def _truth(shared, d: int, k: int):
    """The best of a batch for each tried query, with their leaves in all trees."""

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, t_ids, t = shared.value
        for ids, x in _flushes(batches, d):
            s = t @ x.T
            s[t_ids[:, None] == ids[None, :]] = -np.inf
            take = min(k, len(x))
            best = np.argpartition(s, len(x) - take, axis=1)[:, len(x) - take :]
            rows, near = np.repeat(np.arange(len(t)), take), best.ravel()
            leaves = np.stack([forest.leaf_of(x[near], r) for r in forest.roots], 1)
            ok = np.isfinite(s[rows, near])
            yield pa.RecordBatch.from_arrays([pa.array(rows[ok].astype(np.int32)), pa.array(ids[near[ok]]), pa.array(s[rows, near][ok]), pa.array(leaves[ok].tolist(), pa.list_(pa.int32()))], names=["q", "n", "s", "leaves"])

    return run


def true_neighbours(plain: DataFrame, forest: Forest, tried: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
    """``(place of the tried query, neighbour, the neighbour's leaves)``: the ``k`` nearest by brute force."""
    spark, d = plain.sparkSession, tried.shape[1]
    shared = spark.sparkContext.broadcast((forest, ids, tried))
    found = plain.mapInArrow(_truth(shared, d, k), "q int, n long, s float, leaves array<int>").groupBy("q", "n").agg(F.max(F.struct("s", "leaves")).alias("x"))
    nearest = F.slice(F.sort_array(F.collect_list(F.struct(F.col("x.s").alias("s"), "n", F.col("x.leaves").alias("leaves"))), asc=False), 1, k)
    return [(r["q"], hit["n"], hit["leaves"]) for r in found.groupBy("q").agg(nearest.alias("x")).collect() for hit in r["x"]]


def probes_for(forest: Forest, tried: np.ndarray, true: list[tuple[int, int, list[int]]], recall: float) -> int:
    """The least number of leaves with which the tried queries reach ``recall`` of their true neighbours."""
    if not true:
        return forest.leaves
    margins, place, when = forest.margins(tried), {}, []
    for q, _, leaves in true:
        if q not in place:
            place = {q: np.empty(forest.leaves, np.int64)}
            place[q][forest.search(margins[q].tolist(), forest.leaves)[0]] = np.arange(forest.leaves)
        when.append(int(place[q][leaves].min()) + 1)
    return int(np.sort(when)[min(len(when) - 1, int(np.ceil(recall * len(when))) - 1)])


def _usable(vectors: DataFrame) -> DataFrame:
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return plain.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


@dataclass
class Index:
    """A forest over ``plain`` and the number of leaves that a query reaches."""

    plain: DataFrame
    forest: Forest
    probes: int
    d: int
    many: int
    leaf: int

    def search(self, queries: DataFrame, k: int, waves: int = 1) -> DataFrame:
        spark: SparkSession = self.plain.sparkSession
        shared = spark.sparkContext.broadcast(self.forest)
        labels = spread(spark, min(self.forest.leaves, pieces(self.many * len(self.forest.roots), ROWS_PER_BUCKET)))
        members = self.plain.mapInArrow(_members(shared, labels, self.d, k), _DDL)
        out = None
        for wave in range(waves):
            own = queries if waves == 1 else queries.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(waves)) == wave)
            visits = own.mapInArrow(_queries(shared, labels, self.d, self.probes), _DDL)
            parts = pieces(self.many, 100_000)
            met = members.groupBy("b").cogroup(visits.groupBy("b")).applyInArrow(_rank(self.d, k, parts, self.leaf), _BEST_DDL)
            got = met.groupBy("part").applyInArrow(_merge(k), _OUT_DDL)
            out = got if out is None else out.unionByName(got)
        return out


def fit(vectors: DataFrame, k: int = K_NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, probes: int | None = None, seed: int = SEED, max_sample: int = MAX_SAMPLE) -> Index | None:
    """The index of ``vectors``; None where there is none that can be used. Vectors of another length than most (the greatest of equally common ones) are left out."""
    plain = _usable(vectors)
    size = plain.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    d, many = size["d"], size["count"]
    plain = plain.where(F.size("v") == d)
    chosen = plain
    if many > max_sample:  # the limit only counts where one id repeats very often
        chosen = plain.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * max_sample / many)).limit(2 * max_sample)
    got = chosen.toArrow().sort_by("id")
    sample, ids = _matrix(got["v"].combine_chunks(), d), got["id"].to_numpy()
    if not len(sample):
        got = plain.limit(max_sample).toArrow().sort_by("id")
        sample, ids = _matrix(got["v"].combine_chunks(), d), got["id"].to_numpy()
    share = len(sample) / many
    each = leaf if share == 1 else max(min(leaf, LEAST_SAMPLE), round(leaf * share))
    index = Index(plain, build(sample, trees, each, seed), probes or 0, d, many, leaf)
    if probes is None:
        pick = np.random.default_rng(seed).permutation(len(sample))[:TRIED]
        tried, tried_ids = sample[pick], ids[pick]
        true = true_neighbours(plain, index.forest, tried, tried_ids, k)
        index.probes = probes_for(index.forest, tried, true, recall)
        while share < 1 and true and index.probes < index.forest.leaves:  # leaves may hold trees of their own: measure there
            rows = plain.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(tried_ids, tried)], plain.schema)
            found = {(r["vec_id"], r["neighbor_id"]) for r in index.search(rows, k).collect()}
            if sum((int(tried_ids[q]), n) in found for q, n, _ in true) >= recall * len(true):
                break
            index.probes = min(index.forest.leaves, -(-index.probes * 5 // 4))
    return index


def neighbours(vectors: DataFrame, k: int = K_NEIGHBOURS, queries: DataFrame | None = None, waves: int | None = None, **how) -> DataFrame:
    """``vec_id, neighbor_id, rank, similarity``: about the ``k`` nearest among ``vectors`` of each of ``queries``, itself left out.

    ``queries`` are rows like those of ``vectors``, which are all of them unless given. ``how`` goes to ``fit``, which finds ``probes`` for ``recall`` unless given. Ties go to the lesser
    ``neighbor_id``. Fewer than ``k`` come only where a query's leaves hold fewer. Left out are rows with a null ``vec_id``,
    a null or empty vector, null or non-finite elements, or another length than most. A zero vector has similarity 0 to all. Rows that
    repeat a ``vec_id`` are one neighbour, and as queries one, with what any of their vectors finds. Vectors may have any length that a row holds. Other columns play no part; an empty table
    gives no rows.
    """
    index = fit(vectors, k, **how)
    if index is None:
        return vectors.sparkSession.createDataFrame([], _OUT_DDL)
    asked = index.plain if queries is None else _usable(queries).where(F.size("v") == index.d)
    if waves is None:
        waves = pieces(index.many if queries is None else asked.count(), QUERIES_PER_WAVE)
    return index.search(asked, k, waves)
