"""Sequence rules over a batch of events.

All rules that group by one field share a scan and a shuffle. The JVM tells for each event which steps it matches, drops events that
match none, and sorts the rest by key and time; one pass over the sorted rows then runs the transition. A key
needs no more memory than its partial matches, however many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.predicates import Compiler
from emberline.operators.transition import MAX_KINDS, UNTIL, advance
from emberline.plans import ir
from emberline.plans.errors import InvalidRule
from emberline.plans.typing import resolve
from emberline.schema import Schema

MATCH_DDL = "rule_id string, key string, first_ts long, ts long, event_ids array<long>, captured array<array<string>>"
_MATCH = pa.schema(
    [
        ("rule_id", pa.string()),
        ("key", pa.string()),
        ("first_ts", pa.int64()),
        ("ts", pa.int64()),
        ("event_ids", pa.list_(pa.int64())),
        ("captured", pa.list_(pa.list_(pa.string()))),
    ]
)
MAX_RULES = 1000


def bits_of(rule: ir.Rule) -> tuple[int, ...]:
    """The bit of each event that a match needs; steps that say the same share one."""
    kinds: dict[tuple, int] = {}
    bits = [kinds.setdefault((s.event_type, s.where), 1 << len(kinds)) for s in rule.steps]
    if len(kinds) > MAX_KINDS:
        raise InvalidRule(f"at most {MAX_KINDS} different steps")
    return tuple(b for b, s in zip(bits, rule.steps) for _ in range(s.count))


def mask_of(rule: ir.Rule, compiler: Compiler, type_col: str = "event_type") -> Column:
    """Which kinds of step of the rule an event matches, as bits."""
    bits = bits_of(rule)
    starts = [sum(s.count for s in rule.steps[:i]) for i in range(len(rule.steps))]
    kinds = {bits[at]: s for at, s in zip(starts, rule.steps)}
    out = F.lit(0).cast("long")
    for bit, step in [*kinds.items(), *([(UNTIL, rule.until)] if rule.until else [])]:
        hit = F.coalesce(F.col(type_col) == step.event_type, F.lit(False)) & compiler.condition(step.where)
        out = out + F.when(hit, F.lit(bit).cast("long")).otherwise(0)
    return out


Spec = tuple[str, tuple[int, ...], int | None]


def fold(rules: Sequence[Spec], sticky: bool, most: int | None = None):
    """Runs the transition over rows ``key, ts, event_id, masks, caps`` sorted by the first three; of a key, only the first ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, seen, last = None, [None] * len(rules), 0, -1
        width = len(rules)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_MATCH)], schema=_MATCH)
            out.clear()
            return b

        for rows in batches:
            keys, times, ids = (rows.column(i).to_pylist() for i in range(3))
            # one flat list of masks, ``width`` to a row; what is 0 is never looked at
            flat = rows.column(3).flatten().to_numpy(zero_copy_only=False)
            caps = None if rows.column(4).null_count == len(keys) else rows.column(4).to_pylist()
            hits = flat.nonzero()[0]
            last = -1
            for at, mask in zip(hits.tolist(), flat[hits].tolist()):
                row, i = divmod(at, width)
                k = keys[row]
                if k != key:
                    key, live, seen, last = k, [None] * width, 0, -1
                if most is not None:  # every row matches something, so all rows of a key come by here
                    seen += row != last
                    last = row
                    if seen > most:
                        continue
                p = live[i]
                rule_id, bits, span = rules[i]
                if p is not None and not mask & (bits[p.at] | UNTIL):
                    continue
                ts = times[row]
                live[i], done = advance(p, bits, span, mask, ts, (ids[row], ts, caps[row][i] if caps and caps[row] else None), sticky)
                if done:
                    out.append((rule_id, k, done[0][1], ts, [e[0] for e in done], [e[2] or [] for e in done]))
            if len(out) > 5000:
                yield batch()
        yield batch()

    return run


def match_sequences(
    events: DataFrame,
    rules: Sequence[ir.Rule],
    schema: Schema,
    missing: str = "null",
    sticky: bool = False,
    ts_col: str = "ts_mono_ns",
    id_col: str = "event_id",
    type_col: str = "event_type",
    entity_col: str = "entity_key",
    max_events_per_key: int | None = None,
) -> DataFrame:
    """``rule_id, key, first_ts, ts, event_ids, captures`` for every match of the sequence rules.

    A rule without ``by`` groups by ``entity_col``. Events with a null key, time or type match nothing. ``captures`` maps names to values as strings; a capture
    of a step reads the last of the step's events, one without step the last event. Rules that need one event are filters, without a shuffle. No rules give no rows.

    ``max_events_per_key``, a quota that is off unless given, lets only the first so many events of a key (of those that any rule with that ``by`` looks at) take part.
    """
    if len(rules) > MAX_RULES:
        raise InvalidRule(f"at most {MAX_RULES} sequences")
    one = [r for r in rules if sum(s.count for s in r.steps) == 1] if max_events_per_key is None else []
    parts = []
    if one:
        parts.append(_single_steps(events, one, schema, missing, ts_col, id_col, type_col, entity_col))
    for own, rows in _prepared(events, [r for r in rules if r not in one], schema, missing, ts_col, id_col, type_col, entity_col):
        parts.append(rows.mapInArrow(fold(_spec(own), sticky, max_events_per_key), MATCH_DDL))
    if not parts:
        parts = [events.sparkSession.createDataFrame([], MATCH_DDL)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_captures(out, rules)


def _single_steps(events: DataFrame, rules: Sequence[ir.Rule], schema: Schema, missing: str, ts_col: str, id_col: str, type_col: str, entity_col: str) -> DataFrame:
    """Matches of sequences of one event: the end condition goes first, and nothing else is remembered."""
    compiler = Compiler(schema, missing)
    rules = [resolve(r, schema) for r in rules]
    ts, event_id = F.col(ts_col).cast("long"), F.col(id_col).cast("long")
    hits = []
    for r in rules:
        key = (F.col(entity_col) if (r.by or "entity_key") == "entity_key" else compiler.field(r.by)).cast("string")
        caps = F.array(*(compiler.field(c.path).cast("string") for c in r.captures)) if r.captures else F.array().cast("array<string>")
        row = F.struct(F.lit(r.rule_id).alias("rule_id"), key.alias("key"), ts.alias("first_ts"), ts.alias("ts"), F.array(event_id).alias("event_ids"), F.array(caps).alias("captured"))
        hits.append(F.when((mask_of(r, compiler, type_col) == bits_of(r)[0]) & key.isNotNull(), row))
    types = sorted({r.steps[0].event_type for r in rules})
    return events.where(F.col(type_col).isin(types) & ts.isNotNull()).select(F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.*")


def _spec(rules: Sequence[ir.Rule]) -> list[Spec]:
    return [(r.rule_id, bits_of(r), None if r.maxspan_ms is None else r.maxspan_ms * 1_000_000) for r in rules]


def _prepared(events: DataFrame, rules: Sequence[ir.Rule], schema: Schema, missing: str, ts_col: str, id_col: str, type_col: str, entity_col: str) -> Iterator[tuple[list[ir.Rule], DataFrame]]:
    """The rules that group by one field, and the rows for their fold, for each such field."""
    if len(rules) > MAX_RULES:
        raise InvalidRule(f"at most {MAX_RULES} sequences")
    compiler = Compiler(schema, missing)
    groups: dict[str, list[ir.Rule]] = {}
    for r in rules:
        groups.setdefault(r.by or "entity_key", []).append(resolve(r, schema))
    for by, own in groups.items():
        key = F.col(entity_col) if by == "entity_key" else compiler.field(by)
        types = sorted(set().union(*(r.event_types() for r in own)))
        rows = events.where(F.col(type_col).isin(types)).select(key.cast("string").alias("key"), F.col(ts_col).cast("long").alias("ts"), F.col(id_col).cast("long").alias("event_id"), *events_columns(own, compiler, type_col))
        rows = rows.where("key is not null and ts is not null").where(F.exists("masks", lambda m: m != 0))
        yield own, rows.repartition("key").sortWithinPartitions("key", "ts", "event_id")


STATISTICS_DDL = "rule_id string, key string, n_events long, started long, completed long, expired long, ended long, live long"
_STATISTICS = pa.schema([(x.split()[0], pa.string() if x.split()[1] == "string" else pa.int64()) for x in STATISTICS_DDL.split(", ")])


def count_up(rules: Sequence[Spec]):
    """What became of the partial matches of each rule and key, over rows as ``fold`` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, live, counts = None, [None] * len(rules), [[0] * 5 for _ in rules]
        out: list[tuple] = []

        def close() -> None:
            out.extend((rules[i][0], key, *c, int(live[i] is not None)) for i, c in enumerate(counts) if c[0])

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_STATISTICS)], schema=_STATISTICS)
            out.clear()
            return b

        for rows in batches:
            for k, ts, event_id, masks in zip(*(c.to_pylist() for c in rows.columns[:4])):
                if k != key:
                    close()
                    key, live, counts = k, [None] * len(rules), [[0] * 5 for _ in rules]
                for i, mask in enumerate(masks):
                    if mask:
                        _, bits, span = rules[i]
                        was = live[i]
                        live[i], done = advance(was, bits, span, mask, ts, (event_id, ts))
                        c = counts[i]
                        c[0] += 1
                        c[1] += was is None and (live[i] is not None or done is not None)
                        c[2] += done is not None
                        gone = was is not None and live[i] is None and done is None
                        c[3] += gone and not mask & UNTIL
                        c[4] += gone and bool(mask & UNTIL)
            if len(out) > 5000:
                yield batch()
        close()
        yield batch()

    return run


def sequence_statistics(events: DataFrame, rules: Sequence[ir.Rule], schema: Schema, missing: str = "null", ts_col: str = "ts_mono_ns", id_col: str = "event_id", type_col: str = "event_type", entity_col: str = "entity_key") -> DataFrame:
    """For each rule and key: the events that match a step, and how many partial matches were ``started``, ``completed``, ``expired`` by the span, ``ended`` by the end condition, and are ``live`` at the end."""
    out = None
    for own, rows in _prepared(events, rules, schema, missing, ts_col, id_col, type_col, entity_col):
        part = rows.mapInArrow(count_up(_spec(own)), STATISTICS_DDL)
        out = part if out is None else out.unionByName(part)
    return out


def events_columns(rules: Sequence[ir.Rule], compiler: Compiler, type_col: str) -> list[Column]:
    masks = F.array(*(mask_of(r, compiler, type_col) for r in rules)).alias("masks")
    if not any(r.captures for r in rules):
        return [masks, F.lit(None).cast("array<array<string>>").alias("caps")]
    caps = [F.array(*(compiler.field(c.path).cast("string") for c in r.captures)) if r.captures else F.array().cast("array<string>") for r in rules]
    return [masks, F.array(*caps).alias("caps")]


def with_captures(matches: DataFrame, rules: Sequence[ir.Rule]) -> DataFrame:
    """Puts names to captured values."""
    named = F.lit(None).cast("map<string,string>")
    for r in rules:
        if r.captures:
            pairs = []
            for i, c in enumerate(r.captures):
                at = F.size("captured") if c.step is None else F.lit(sum(s.count for s in r.steps[: c.step + 1]))
                pairs += [F.lit(c.name), F.element_at(F.element_at("captured", at), i + 1)]
            named = F.when(F.col("rule_id") == r.rule_id, F.create_map(*pairs)).otherwise(named)
    return matches.withColumn("captures", named).drop("captured")
