from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from brute import jaccard_pairs, near_copies
from compare import rows_of
from pyspark.sql import functions as F

from emberline.llm import ngram_join as J
from emberline.llm.common import spread


def corpus(seed: int, n: int) -> list[tuple[int, str]]:
    """Families of near copies at all distances from the threshold."""
    r = random.Random(seed)
    out: list[tuple[int, str]] = []
    bases = [odd.prose(r.random(), r.randrange(1, 150), 500).split() for _ in range(n // 6)]
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = f"new{r.randrange(50)}"
        if r.random() < 0.3:
            w = w[: r.randrange(1, len(w) + 1)]
        out.append((i * 3, " ".join(w)))
    return out


def all_pairs(docs, **how):
    """All pairs of documents, from memberships and the pairs of representatives, which each come once."""
    member, pairs = J.representatives(docs, **how)
    held = defaultdict(list)
    for r in member.collect():
        held[r["rep"]].append(r["doc_id"])
    found = {(x, y): 1.0 for own in held.values() for x, y in itertools.combinations(sorted(own), 2)}
    rows = pairs.collect()
    assert len({(r["rep_a"], r["rep_b"]) for r in rows}) == len(rows)
    for r in rows:
        for x, y in itertools.product(held[r["rep_a"]], held[r["rep_b"]]):
            found[min(x, y), max(x, y)] = round(r["jaccard"], 9)
    return found


def classes_of(pairs):
    """What the links of brute force make of classes: {document: (class, links)}."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    links = Counter(itertools.chain.from_iterable(pairs))
    return {x: (find(x), links[x]) for x in links}


def as_classes(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}


@pytest.mark.parametrize(("seed", "heavy", "side"), [(1, 200, 2000), (2, 3, 2000), (3, 1, 2000), (4, 3, 7), (5, 1, 3), (6, 5, 2)])
def test_pairs_and_classes_are_those_of_brute_force(spark, seed, heavy, side):
    """``heavy`` of a few sends most sets to dense blocks, and a small ``side`` makes many of these."""
    docs = corpus(seed, 150)
    pairs = jaccard_pairs(docs)
    assert len(pairs) > 100
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert all_pairs(df, heavy=heavy, side=side) == {k: round(j, 9) for k, (_, j) in pairs.items()}
    assert as_classes(J.linked(df, heavy=heavy, side=side)) == classes_of(pairs)


def test_thousands_of_copies(spark):
    docs = [(i, "one two three four five six seven") for i in range(3000)] + [(i, "one two three four five six seven eight") for i in range(3000, 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_classes(J.linked(df)) == {i: (0, 3999) for i in range(4000)}
    assert [r["doc_id"] for r in J.drop_near_copies(df).collect()] == [0]


def test_a_group_of_many_near_copies(spark):
    """Three hundred different texts that are all near copies: their n-grams are heavy at the default bound."""
    r = random.Random(11)
    base = odd.prose(12, 60).split()
    docs = []
    for i in range(300):
        w = list(base)
        w[r.randrange(60)] = f"own{i}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, odd.prose(2000 + i, 60)) for i in range(50)]
    pairs = jaccard_pairs(docs)
    assert len(pairs) > 40_000
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert as_classes(J.linked(df)) == as_classes(J.linked(df, side=70)) == classes_of(pairs)


def test_odd_documents(spark):
    docs = odd.documents(spark)
    got = as_classes(J.linked(docs))
    assert got == classes_of(jaccard_pairs([r[:2] for r in odd.rows()]))
    assert got[1][0] == got[2][0] == 1 and got[9] == got[10] == (9, 1)


def test_a_document_with_several_texts_is_in_one_class(spark):
    a, b = odd.prose(1, 60), odd.prose(2, 60)
    docs = [(5, a), (1, b), (1, a), (7, b), (3, odd.prose(3, 60)), (3, odd.prose(4, 60))]
    assert as_classes(J.linked(spark.createDataFrame(docs, "doc_id long, text string"))) == {1: (1, 2), 5: (1, 1), 7: (1, 1)}


def test_empty_table(spark):
    assert J.linked(odd.empty(spark)).count() == 0
    kept = J.drop_near_copies(odd.empty(spark))
    assert kept.count() == 0 and kept.columns == odd.empty(spark).columns


def test_full_routes_give_numbers_to_the_next_free_ones():
    leader = np.r_[np.full(5000, 7, np.uint64), np.arange(3000, dtype=np.uint64)]
    keep = np.ones(len(leader), bool)
    keep[::10] = False
    number = J._numbers(leader, keep)[keep]
    assert len(np.unique(number)) == len(number) and number.max() < 1 << 31


def test_labels_spread_over_partitions(spark):
    labels = spread(spark, 12)
    parts = spark.createDataFrame([(int(x),) for x in labels], "b int").select(F.pmod(F.hash("b"), F.lit(4)).alias("p")).groupBy("p").count().collect()
    assert sorted(r["count"] for r in parts) == [3, 3, 3, 3] and len(set(labels.tolist())) == 12


def test_one_of_each_group_stays(spark):
    docs = corpus(4, 150)
    kept = J.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, _ in docs} - near_copies(docs))


def test_odd_rows_stay_with_their_columns(spark):
    docs = odd.documents(spark)
    kept = J.drop_near_copies(docs)
    gone = near_copies([r[:2] for r in odd.rows()])
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(docs.where("doc_id is null or doc_id not in (%s)" % ",".join(map(str, gone))))


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
