from __future__ import annotations

import random
from collections import Counter

import brute
import odd
import pytest
from pyspark.sql import functions as F

from emberline.llm import mixing as M


def brute_mix(docs, budget_share, max_epochs, domain=None):
    """(doc_id, text, epoch) by brute force; Spark gives only hashes and domains."""
    text = F.col("text")
    k, th = F.coalesce(F.col("doc_id"), F.lit(-1)), F.xxhash64("text")
    order = [F.shiftrightunsigned(F.xxhash64(F.lit(M.SEED), F.lit(e).cast("long"), k, th), 1).alias(f"h{e}") for e in range(max_epochs)]
    got = docs.select("doc_id", "text", (domain if domain is not None else M.default_domain()).alias("dom"), "lang", "source", k.alias("kk"), th.alias("tt"), *order).collect()
    rows = [{"domain": r["dom"] or "", "lang": r["lang"] or "", "source": r["source"] or "", "n": brute.word_count(r["text"]), "h": lambda e, r=r: (r[f"h{e}"], r["kk"], r["tt"])} for r in got]
    del text
    return sorted(((got[i]["doc_id"], got[i]["text"], e) for i, e in brute.mix(rows, budget_share, max_epochs)), key=str)


def chosen(docs, **how):
    name = "epoch" if "epoch" not in docs.columns else "_epoch"
    return sorted(((r["doc_id"], r["text"], r[name]) for r in M.mix(docs, with_plan=True, **how).collect()), key=str)


def corpus(spark, n=400):
    r = random.Random(1)
    rows = [(i, odd.prose(i, r.randrange(0, 60)), r.choice(["en", "de", "fr", "es", None]), f"src{min(r.randrange(9), r.randrange(9))}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 2), (0.2, 1), (1.5, 3), (5.0, 2), (0.0, 1)])
def test_selection_is_that_of_brute_force(spark, share, epochs):
    docs = corpus(spark)
    assert chosen(docs, budget_share=share, max_epochs=epochs) == brute_mix(docs, share, epochs)


def test_weights_are_met_where_tokens_suffice(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    got = Counter(r["source"] for r in M.mix(docs, budget_share=0.3).collect())
    total = sum(got.values())
    assert abs(total - 1800) <= 3
    assert all(abs(got[s] / total - w) < 0.01 for s, w in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2)))


def test_a_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["s0"] * 10 + ["s3"] * 200 + ["s1"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter(r["source"] for r in M.mix(docs, budget_share=0.5, max_epochs=1).collect())
    # web has 5 of 8 parts of 205 documents; s0 has only 10, so s3 gets the rest of web's
    assert got["s0"] == 10 and abs(got["s0"] + got["s3"] - 205 * 5 / 8) <= 2 and abs(got["s1"] - 205 * 3 / 8) <= 2


def test_water_fill_whole_shares():
    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 7)
        w, limits = [r.choice([0, 1.0, 2.5, 7.0]) for _ in range(n)], [r.randrange(0, 50) for _ in range(n)]
        budget = r.randrange(0, 200)
        got = M.water_fill(budget, w, limits)
        assert sum(got) == min(budget, sum(x for v, x in zip(w, limits) if v > 0))
        assert all(0 <= g <= x for g, x in zip(got, limits))
        assert all(abs(g - e) < 1 + 1e-6 * e for g, e in zip(got, brute.share(budget, w, limits)))


def test_odd_documents(spark):
    docs = odd.documents(spark)
    assert chosen(docs, budget_share=0.7, max_epochs=2) == brute_mix(docs, 0.7, 2)
    got = M.mix(docs, budget_share=0.7)
    assert got.columns == docs.columns and got.schema == docs.schema
    all_of_it = M.mix(docs, budget_share=1.0, max_epochs=1)
    assert sorted(map(str, all_of_it.select("doc_id", "text").where("trim(text) <> ''").collect())) == sorted(map(str, docs.select("doc_id", "text").where("trim(text) <> ''").collect()))


def test_empty_table(spark):
    assert M.mix(odd.empty(spark)).count() == 0


def test_the_same_seed_draws_the_same(spark):
    docs = corpus(spark, 200)
    assert chosen(docs, seed=9) == chosen(docs.repartition(7), seed=9)
    assert chosen(docs, seed=9) != chosen(docs, seed=10)
