"""Event rules: a filter and a projection each, all over one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.predicates import Compiler
from emberline.plans import ir
from emberline.plans.typing import resolve
from emberline.schema import Schema


def filter_events(events: DataFrame, rule: ir.Rule, schema: Schema, missing: str = "null", type_col: str = "event_type") -> DataFrame:
    """The events that an event rule matches, whole. The type test stands alone, so that it reaches the scan."""
    rule = resolve(rule, schema)
    (step,) = rule.steps
    out = events.where(F.col(type_col) == step.event_type)
    return out if step.where == ir.TRUE else out.where(Compiler(schema, missing).filter(step.where))


def match_events(events: DataFrame, rules: Sequence[ir.Rule], schema: Schema, missing: str = "null", ts_col: str = "ts_mono_ns", id_col: str = "event_id", type_col: str = "event_type", entity_col: str = "entity_key") -> DataFrame:
    """``rule_id, key, ts, event_id, captures``: a row for each rule that an event matches; the scan is shared. No rules give no rows."""
    rules = [resolve(r, schema) for r in rules]
    compiler = Compiler(schema, missing)
    by_type: dict[str, list] = {}
    for r in rules:
        (step,) = r.steps
        caps = F.create_map(*(x for c in r.captures for x in (F.lit(c.name), compiler.field(c.path).cast("string")))) if r.captures else F.lit(None).cast("map<string,string>")
        hit = F.struct(F.lit(r.rule_id).alias("rule_id"), caps.alias("captures"))
        by_type.setdefault(step.event_type, []).append(hit if step.where == ir.TRUE else F.when(compiler.condition(step.where), hit))
    if not by_type:
        return events.sparkSession.createDataFrame([], "rule_id string, key string, ts long, event_id long, captures map<string,string>")
    # an event is tested against the rules of its own type only
    hits = F.lit(None).cast("array<struct<rule_id:string,captures:map<string,string>>>")
    for kind, own in by_type.items():
        hits = F.when(F.col(type_col) == kind, F.array_compact(F.array(*own))).otherwise(hits)
    return (
        events.where(F.col(type_col).isin(sorted(by_type)))
        .select(F.col(entity_col).cast("string").alias("key"), F.col(ts_col).cast("long").alias("ts"), F.col(id_col).cast("long").alias("event_id"), F.explode(hits).alias("hit"))
        .select("hit.rule_id", "key", "ts", "event_id", "hit.captures")
    )
