"""Metrics of rules and runs, and their text formats."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_metrics(matches: DataFrame) -> DataFrame:
    """For each rule: matches, entities, first and last time, matches per minute of event time (null for one moment)."""
    span = (F.max("ts") - F.min("ts")) / F.lit(60e9)
    return matches.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.count_distinct("key").alias("n_entities"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.try_divide(F.count(F.lit(1)), span).alias("per_minute"),
    )


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, sum, mean, peak and the percentiles of a measure, exact to a thousandth of the ranks."""
    p = F.percentile_approx(value, [0.5, 0.9, 0.95, 0.99], 1000)
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("peak"), p.alias("p"))
    return out.select(*keys, "n", "total", "mean", "peak", *(F.col("p")[i].alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))))


def exact_percentiles(df: DataFrame, value: str, *keys: str, slices: int = 64) -> DataFrame:
    """The values at ranks ``n * p // 100`` of the sorted measure, for p50, p90 and p99. Nulls don't count; a key may be null.

    Approximate percentiles cut each group into slices. Counts of the slices tell which ones hold the ranks, and only those are
    looked into, equal values counted before they are shuffled. So no task sorts a group, not even where one value makes up most of it.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    known = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value).alias("__v"))

    def meet(rows: DataFrame, few: DataFrame, on: list[str], more: Column | None = None) -> DataFrame:
        """``rows`` with the columns of ``few`` where ``on`` (nulls, too) are equal; without ``on``, ``few`` is a row or three."""
        right = few.toDF(*(f"{c}_" if c in on else c for c in few.columns))
        tests = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in on] + ([more] if more is not None else [])
        met = rows.join(right if on else F.broadcast(right), tests or F.lit(True))
        return met.drop(*(f"{n}_" for n in on))

    cuts = known.groupBy(*names).agg(F.percentile_approx("__v", [i / slices for i in range(1, slices)], 100 * slices).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    # the slice of a value: how many cuts are less
    place = F.aggregate("__cuts", F.lit(0), lambda n, c: n + F.when(c < F.col("__v"), 1).otherwise(0))
    placed = meet(known, cuts, names).select(*names, "__v", "__n", place.alias("__s"))
    upto = F.sum("__c").over(Window.partitionBy(*names).orderBy("__s"))
    sizes = placed.groupBy(*names, "__s", "__n").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", upto - F.col("__c"))
    ranks = sizes.select("*", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"__n * {p} div 100").alias("rank")) for p in (50, 90, 99)))).alias("__r"))
    held = ranks.where("__r.rank >= __before and __r.rank < __before + __c").select(*names, "__s", F.col("__r.rank").alias("__rank"), F.col("__r.p").alias("__p"), "__before")
    inner = meet(placed, held.select(*names, "__s", "__before").distinct(), [*names, "__s"])
    counted = inner.groupBy(*names, "__s", "__before", "__v").agg(F.count(F.lit(1)).alias("__c"))
    run = F.col("__before") + F.sum("__c").over(Window.partitionBy(*names, "__s").orderBy("__v"))
    found = meet(counted.withColumn("__upto", run), held.drop("__before"), [*names, "__s"], (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__c")))
    return found.groupBy(*(F.col(n).alias(k) for n, k in zip(names, keys))).agg(*(F.max(F.when(F.col("__p") == p, F.col("__v"))).alias(f"p{p}") for p in (50, 90, 99)))


def sequence_metrics(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Events that each rule's key saw and matches it completed: ``key, n_events, n_matches``."""
    seen = events.groupBy("key").agg(F.count(F.lit(1)).alias("n_events"))
    done = matches.groupBy("key").agg(F.count(F.lit(1)).alias("n_matches"))
    return seen.join(done, "key", "left").select("key", "n_events", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def to_prometheus(rows: list[Mapping], prefix: str = "emberline", labels: tuple[str, ...] = ("rule_id",)) -> str:
    """Metric rows in the text format that Prometheus reads."""
    names = sorted({k for r in rows for k, v in r.items() if k not in labels and isinstance(v, (int, float)) and not isinstance(v, bool)})
    out = []
    for n in names:
        out.append(f"# TYPE {prefix}_{n} gauge")
        for r in rows:
            if r.get(n) is not None:
                own = ",".join(f'{k}="{str(r[k]).translate({92: chr(92) * 2, 34: chr(92) + chr(34), 10: chr(92) + "n"})}"' for k in labels if k in r)
                out.append(f"{prefix}_{n}{{{own}}} {r[n]}")
    return "\n".join(out) + "\n"


def to_json(rows: list[Mapping]) -> str:
    return json.dumps([dict(r) for r in rows], sort_keys=True, default=str)
