"""Selecting documents so that sources come near their target weights.

Sources hang in a tree: domain, language, source. A budget of tokens flows from the root to the leaves in proportion to
weights. What a child cannot use, because it holds fewer tokens, goes to its siblings in proportion to their
weights, and only what all siblings together cannot use comes up to the parent's siblings: a parent's limit is
the sum of its children's. Each leaf reads its documents in epochs, each epoch in an order of its own
drawn from the seed: whole epochs first, then the prefix of the next that the rest of its budget covers.

Levels are shared out by Spark, a task per parent. A prefix is found from token sums over slices of the order, so
that only one slice of a leaf is ever sorted, and it is kept as a bound on the order: documents are
selected by comparing with it, without a shuffle of their texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut, fresh
from emberline.llm.packing import word_count

SEED = 20240501
BUDGET_SHARE = 0.6
MAX_EPOCHS = 2
DOMAINS = ("web", "books", "forums")
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "forums": 2.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
SLICE_BITS = 10
BROADCAST_LEAVES = 200_000


def default_domain() -> Column:
    """A source's domain: its number, or else a hash of its name, taken modulo the number of domains."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    number = F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).cast("long")
    at = F.pmod(F.coalesce(number, F.xxhash64(source)), F.lit(len(DOMAINS)))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (at + 1).cast("int"))


def water_fill(budget: int, weights: Sequence[float], limits: Sequence[int]) -> list[int]:
    """Whole shares of ``budget`` in proportion to ``weights`` within ``limits``; what a limit leaves over goes to the others.

    Fractions of tokens go to the largest remainders, the first of equals first.
    """
    out = [0] * len(weights)
    left = min(int(budget), sum(x for w, x in zip(weights, limits) if w > 0))
    live = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    while live and left > 0:
        total = sum(weights[i] for i in live)
        full = [i for i in live if limits[i] <= left * weights[i] / total]
        if full:
            for i in full:
                out[i] = limits[i]
            left -= sum(limits[i] for i in full)
            live = [i for i in live if i not in set(full)]
            continue
        exact = {i: left * weights[i] / total for i in live}
        for i in live:
            out[i] = int(exact[i])
        rest = left - sum(out[i] for i in live)
        for i in sorted(live, key=lambda i: (int(exact[i]) - exact[i], i)):
            if rest > 0 and out[i] < limits[i]:
                out[i] += 1
                rest -= 1
        break
    return out


def _share(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", kind="stable")
    pdf["budget"] = water_fill(int(pdf["parent_budget"].iloc[0]), pdf["weight"].tolist(), pdf["cap"].tolist())
    return pdf[["parent", "node", "budget"]]


def _weight(of: Column, weights: Mapping[str, float] | None) -> Column:
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        out = F.when(of == F.lit(name), F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int, domain_weights, lang_weights, source_weights) -> DataFrame:
    """``leaves`` (``d, l, s, tokens``) with the ``budget`` of each."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("d", "l").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("d").agg(F.sum("cap").alias("cap"))
    root = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_share).cast("long").alias("parent_budget"))

    def level(children: DataFrame) -> DataFrame:
        return children.groupBy("parent").applyInPandas(_share, "parent string, node string, budget long")

    top = level(domains.crossJoin(root).select(F.lit("").alias("parent"), F.col("d").alias("node"), "cap", _weight(F.col("d"), domain_weights).alias("weight"), "parent_budget"))
    mid_in = langs.join(top.select(F.col("node").alias("d"), F.col("budget").alias("parent_budget")), "d")
    mid = level(mid_in.select(F.col("d").alias("parent"), F.col("l").alias("node"), "cap", _weight(F.col("l"), lang_weights).alias("weight"), "parent_budget"))
    key = F.to_json(F.struct("d", "l"))
    low_in = leaves.join(mid.select(F.col("parent").alias("d"), F.col("node").alias("l"), F.col("budget").alias("parent_budget")), ["d", "l"])
    low = level(low_in.select(key.alias("parent"), F.col("s").alias("node"), "cap", _weight(F.col("s"), source_weights).alias("weight"), "parent_budget"))
    return leaves.withColumn("parent", key).join(low.withColumnRenamed("node", "s"), ["parent", "s"]).select("d", "l", "s", "tokens", "budget")


def _plan(docs: DataFrame, domain: Column, seed: int, budget_share: float, max_epochs: int, weights) -> tuple[DataFrame, Column, Column, Column]:
    text = F.col("text").cast("string")
    d, l, s = (F.coalesce(c.cast("string"), F.lit("")) for c in (domain, F.col("lang"), F.col("source")))
    narrow = cut(docs.select(d.alias("d"), l.alias("l"), s.alias("s"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64(text).alias("th"), word_count(text).alias("n")))
    leaf = ["d", "l", "s"]
    share = cut(budgets(narrow.groupBy(*leaf).agg(F.sum("n").alias("tokens")), budget_share, max_epochs, *weights))
    # whole epochs, and tokens of the next; a leaf without tokens reads nothing beyond whole epochs
    share = share.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("full"), F.col("k"), F.col("th")), 1)
    placed = narrow.join(_small(share.select(*leaf, "full", "rest")), leaf).withColumn("h", order).withColumn("part", F.shiftrightunsigned("h", 63 - SLICE_BITS))
    by_leaf = Window.partitionBy(*leaf)
    parts = placed.groupBy(*leaf, "rest", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by_leaf.orderBy("part")))
    edge = parts.where("upto > rest").groupBy(*leaf).agg(F.min("part").alias("part"), F.min_by(F.col("upto") - F.col("n"), "part").alias("before"))
    inside = placed.join(edge, [*leaf, "part"]).withColumn("run", F.col("before") + F.sum("n").over(by_leaf.orderBy("h", "k", "th").rowsBetween(Window.unboundedPreceding, 0)))
    bound = inside.where("run <= rest").groupBy(*leaf).agg(F.max(F.struct("h", "k", "th")).alias("bound"))
    plan = cut(share.join(edge.select(*leaf, F.col("part").alias("edge")), leaf, "left").join(bound, leaf, "left").select(*leaf, "full", "rest", "edge", "bound"))
    return plan, d, l, s


def _small(leaves: DataFrame) -> DataFrame:
    """Broadcast if the leaves are few; a plain join otherwise."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def mix(
    docs: DataFrame,
    domain: Column | None = None,
    seed: int = SEED,
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    domain_weights: Mapping[str, float] | None = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, float] | None = LANG_WEIGHTS,
    source_weights: Mapping[str, float] | None = None,
    with_plan: bool = False,
) -> DataFrame:
    """The documents to train on: rows of ``docs``, once per epoch in which they are read.

    The budget is ``budget_share`` of all words, and a leaf reads ``max_epochs`` epochs at most. Siblings without a given
    weight have weight 1. A prefix ends before the first document that would exceed the budget.

    Defined results: a null domain, language or source is a node of its own. A null text has no words and costs
    nothing; a null ``doc_id`` takes part like any other. Equal rows are drawn as one where their place in the order is equal,
    all or none, when a prefix ends beside them; otherwise each counts. An empty table gives no rows. ``with_plan`` adds ``domain``,
    ``epoch`` and ``n_words`` under names that the table doesn't have yet.
    """
    weights = (domain_weights, lang_weights, source_weights)
    plan, d, l, s = _plan(docs, domain if domain is not None else default_domain(), seed, budget_share, max_epochs, weights)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = F.col("text").cast("string")
    wide = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), d.alias("d"), l.alias("l"), s.alias("s"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64(text).alias("th"), *([word_count(text).alias("n")] if with_plan else []))
    wide = wide.join(_small(plan), ["d", "l", "s"])
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("full"), F.col("k"), F.col("th")), 1)
    part = F.shiftrightunsigned(h, 63 - SLICE_BITS)
    inside = F.col("edge").isNull() | (part < F.col("edge")) | ((part == F.col("edge")) & F.coalesce(F.struct(h.alias("h"), F.col("k"), F.col("th")) <= F.col("bound"), F.lit(False)))
    reads = F.col("full") + F.when((F.col("rest") > 0) & inside, 1).otherwise(0)
    reads = F.least(reads, F.lit(max_epochs))
    out = wide.withColumn("reads", reads.cast("int")).where("reads > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("reads") - 1)))
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    if with_plan:
        taken = docs
        for name, c in (("domain", "d"), ("epoch", "epoch"), ("n_words", "n")):
            name = fresh(taken, name)
            taken = taken.withColumn(name, F.lit(None))
            back.append(F.col(c).alias(name))
    return out.select(*back)
