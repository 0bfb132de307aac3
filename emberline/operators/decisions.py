"""From alerts to decisions: what should be done, never doing it.

Times are event times, so a rerun decides alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.schema import SEVERITIES

ACTIONS = {"critical": "kill", "high": "block", "medium": "alert", "low": "alert", "informational": "allow"}
CACHE_NS = 60_000_000_000
PER_SECOND = 100
MODES = ("inline", "detect", "offline")


def severity_rank(severity: Column) -> Column:
    """0 for informational up to 4 for critical; null for anything else."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(F.lower(severity) == s, i).otherwise(out)
    return out


def action_of(severity: Column) -> Column:
    """The action that a severity asks for; anything unknown is allowed."""
    out = F.lit("allow")
    for s, a in ACTIONS.items():
        out = F.when(F.lower(severity) == s, a).otherwise(out)
    return out


def worst_rule(alerts: DataFrame, keys: Iterable[str]) -> DataFrame:
    """For each event (or other ``keys``) the highest severity of its alerts, low at least, and the first rule that has it.

    Severities that are low or less leave the rule unknown.
    """
    rank = severity_rank(F.col("severity"))
    floor = SEVERITIES.index("low")
    best = F.min_by("rule_id", F.struct(-F.col("rank"), "rule_id"))
    out = alerts.withColumn("rank", F.coalesce(rank, F.lit(0))).groupBy(*keys).agg(F.max("rank").alias("top"), best.alias("best"), F.count(F.lit(1)).alias("n_alerts"))
    names = F.array(*map(F.lit, SEVERITIES))
    severity = F.element_at(names, F.greatest("top", F.lit(floor)) + 1)
    return out.select(*keys, severity.alias("severity"), F.when(F.col("top") > floor, F.col("best")).otherwise("unknown").alias("rule_id"), action_of(severity).alias("action"), "n_alerts")


def with_cache(decisions: DataFrame, entity: str = "entity_key", ts: str = "ts", ttl_ns: int = CACHE_NS, carry: Iterable[str] = ()) -> DataFrame:
    """``decisions`` with ``cached``: whether an earlier decision on the entity still stands.

    A decision stands for ``ttl_ns`` from when it was made; one that is taken from the cache doesn't renew it, so the order decides: the decisions
    are sorted by entity and time and folded in batches, and no more than the last fresh one is held. A
    decision without a time is fresh. Where an earlier one stands, the columns ``carry`` become those of the earlier.
    """
    names, carry = decisions.columns, list(carry)
    at_entity, at_ts = names.index(entity), names.index(ts)
    places = [names.index(c) for c in carry]
    rows = decisions.repartition(entity).sortWithinPartitions(entity, ts, *(c for c in ("alert_id", "event_id") if c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, kept = None, None, []
        for b in batches:
            cached, held = [], [b.column(i).to_pylist() for i in places]
            for row, (e, t) in enumerate(zip(b.column(at_entity).to_pylist(), b.column(at_ts).to_pylist())):
                if e != key:
                    key, made = e, None
                stands = made is not None and t is not None and t - made < ttl_ns
                cached.append(stands)
                if stands:
                    for c, v in zip(held, kept):
                        c[row] = v
                elif t is not None:
                    made, kept = t, [c[row] for c in held]
            columns = list(b.columns)
            for i, c in zip(places, held):
                columns[i] = pa.array(c, columns[i].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cached, pa.bool_())], names=[*names, "cached"])

    return rows.mapInArrow(run, T.StructType([*decisions.schema.fields, T.StructField("cached", T.BooleanType())]))


def decide(alerts: DataFrame, blockable: Iterable[str] = (), mode: str = "detect", per_second: int = PER_SECOND, ttl_ns: int = CACHE_NS) -> DataFrame:
    """The whole way from alerts to decisions: ``entity_key, ts, event_id, severity, rule_id, action, n_alerts, cached, outcome``.

    The alerts that end with one event make one decision, by the worst rule. Of each second the first ``per_second`` are taken, by time and
    event. A decision on the entity that still stands is given again; then it is routed by ``mode``. Alerts without entity, event or time make none.
    """
    rows = alerts.withColumn("event_id", F.element_at("event_ids", -1)).where("entity_key is not null and event_id is not null and ts is not null")
    worst = worst_rule(rows, ["entity_key", "ts", "event_id"])
    taken = rate_limited(worst, F.expr("ts div 1000000000"), per_second)
    out = with_cache(taken, "entity_key", "ts", ttl_ns, carry=("severity", "rule_id", "action"))
    blockable = list(blockable)
    can = F.col("rule_id").isin(blockable) if blockable else F.lit(False)
    return out.withColumn("outcome", outcome(F.col("action"), F.lit(mode), can))


def rate_limited(decisions: DataFrame, second: Column, per_second: int = PER_SECOND, order: Iterable[str] = ("ts", "event_id")) -> DataFrame:
    """The first ``per_second`` decisions of each second."""
    w = Window.partitionBy("__second").orderBy(*order)
    return decisions.withColumn("__second", second).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_second).drop("__second", "__n")


def capable(action: Column, capabilities: Column) -> Column:
    """Whether a target that supports ``capabilities`` (an array of action names) can take the action: what can block can kill and quarantine, too."""
    can = lambda name: F.array_contains(capabilities, F.lit(name))
    return F.when(action.isin("kill", "quarantine"), F.array_contains(capabilities, action) | can("block")).when(action == "block", can("block")).otherwise(F.lit(True))


def outcome(action: Column, mode: Column, blockable: Column) -> Column:
    """What becomes of a decision: done where it applies (which nobody does here), simulated offline, noted otherwise."""
    return (
        F.when(mode == "offline", "simulated")
        .when((mode == "inline") & blockable & action.isin("kill", "block", "quarantine"), "enforce")
        .when((mode == "inline") & action.isin("kill", "block", "quarantine"), "rejected")
        .otherwise("noted")
    )


def should_block(decisions: DataFrame) -> DataFrame:
    """The latest decision on each entity, and whether it blocks."""
    last = decisions.groupBy("entity_key").agg(F.max_by(F.struct("ts", "action", "rule_id"), F.struct("ts", "rule_id")).alias("x"))
    return last.select("entity_key", "x.ts", "x.rule_id", "x.action", F.col("x.action").isin("block", "kill", "quarantine").alias("blocked"))


def audit(decisions: DataFrame, most: int = 10_000, entity: str | None = None, rule_id: str | None = None) -> DataFrame:
    """The ``most`` latest decisions, latest first; of an entity or a rule if given."""
    if entity is not None:
        decisions = decisions.where(F.col("entity_key") == entity)
    if rule_id is not None:
        decisions = decisions.where(F.col("rule_id") == rule_id)
    return decisions.orderBy(F.desc("ts"), "alert_id").limit(most)
