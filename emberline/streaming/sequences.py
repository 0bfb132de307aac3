"""Sequence rules over a stream.

Events of a key wait in state until the watermark has passed them and run through the transition in order of time and id, so a
stream gives the matches that a batch over the same events does. Events that come after the watermark has passed their
time are dropped. The state of a key is its waiting events and its partial matches, and goes when both are gone; a
partial match is dropped at the end of its span.

A call of Python costs milliseconds whatever it does, so keys share state by hash: a micro-batch makes at most ``BUCKETS`` calls for each field that rules group
by, however many keys it has. No key is left out or cut short.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions.predicates import Compiler
from emberline.operators.sequence import Spec, _spec, events_columns, with_captures
from emberline.operators.transition import UNTIL, Partial, advance
from emberline.plans import ir
from emberline.plans.typing import resolve
from emberline.schema import Schema

_OUT = "rule_id string, key string, first_ts long, ts long, event_ids array<long>, captured array<array<string>>"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


#: states of a field that rules group by; more of them make a state smaller, and so what a micro-batch writes again for keys without events
BUCKETS = 4096

#: numbers of an event before its masks: time, id (0 for null), whether it has an id
_TS, _ID, _HAS_ID, _MASKS = range(4)


def _processor(specs: Sequence[Sequence[Spec]], sticky: bool):
    """``specs``: the rules of each field that rules group by; a state is that of the field's number and a bucket of its values."""

    def run(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spec = specs[at[0]]
        # waiting events: keys, numbers (a row each), captured values if any rule has some
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        live: dict[tuple[str, int], Partial] = {}
        if state.exists:
            names, codes, numbers, caps, live = pickle.loads(state.get[0])
            parts.append((names[codes], numbers, caps))
        for pdf in frames:
            if len(pdf):
                numbers = np.concatenate(pdf["numbers"].to_numpy()).astype(np.int64, copy=False).reshape(len(pdf), -1)
                caps = None
                if "caps" in pdf:
                    caps = np.empty(len(pdf), object)
                    caps[:] = [None if cap is None else [list(c) for c in cap] for cap in pdf["caps"]]
                parts.append((pdf["key"].to_numpy(object), numbers, caps))
        keys, numbers, caps = (None if p[0] is None else p[0] if len(p) == 1 else np.concatenate(p) for p in zip(*parts))
        codes, names = pd.factorize(keys)
        mark_ns = state.getCurrentWatermarkMs() * 1_000_000
        wait = numbers[:, _TS] > mark_ns
        ready = np.flatnonzero(~wait)
        ready = ready[np.lexsort((*numbers[ready][:, [_ID, _HAS_ID, _TS]].T, codes[ready]))]
        masks = numbers[ready, _MASKS:].ravel()
        hits = masks.nonzero()[0]
        out = []
        for hit, mask in zip(hits.tolist(), masks[hits].tolist()):
            row, i = divmod(hit, len(spec))
            row = ready[row]
            key = keys[row]
            p = live.get((key, i))
            rule_id, bits, span = spec[i]
            if p is not None and not mask & (bits[p.at] | UNTIL):
                continue
            ts, event_id, has_id = numbers[row, :_MASKS].tolist()
            cap = caps[row] if caps is not None else None
            now, done = advance(p, bits, span, mask, ts, (event_id if has_id else None, ts, cap[i] if cap else None), sticky)
            if now is not None:
                live[key, i] = now
            elif p is not None:
                del live[key, i]
            if done:
                out.append((rule_id, key, done[0][1], ts, [e[0] for e in done], [e[2] or [] for e in done]))
        # all events up to the watermark are in: what is left can't be in time
        live = {k: p for k, p in live.items() if spec[k[1]][2] is None or p.began + spec[k[1]][2] >= mark_ns}
        ends = [p.began + spec[i][2] for (_, i), p in live.items() if spec[i][2] is not None]
        if wait.any():
            ends.append(int(numbers[wait, _TS].min()))
        if live or wait.any():
            codes, names = pd.factorize(keys[wait])
            state.update((pickle.dumps((names, codes.astype(np.int32), numbers[wait], None if caps is None else caps[wait], live)),))
            if ends:
                state.setTimeoutTimestamp(max(min(ends) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def stream_sequences(
    events: DataFrame,
    rules: Sequence[ir.Rule],
    schema: Schema,
    time: Column,
    delay: str = "10 seconds",
    missing: str = "null",
    sticky: bool = False,
    ts_col: str = "ts_mono_ns",
    id_col: str = "event_id",
    type_col: str = "event_type",
    entity_col: str = "entity_key",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``rule_id, key, first_ts, ts, event_ids, captures`` as matches complete. ``time`` is ``ts_col`` as a timestamp. Rules that group by one field share
    states, of which there are at most ``buckets`` for each field."""
    rules = [resolve(r, schema) for r in rules]
    groups: dict[str, list[ir.Rule]] = {}
    for r in rules:
        groups.setdefault(r.by or "entity_key", []).append(r)
    if not groups:
        raise ValueError("no rules")
    compiler = Compiler(schema, missing)
    seen = []
    for g, (by, own) in enumerate(groups.items()):
        key = F.col(entity_col) if by == "entity_key" else compiler.field(by)
        seen.append(F.struct(F.lit(g).alias("g"), key.cast("string").alias("key"), *events_columns(own, compiler, type_col)))
    types = sorted(set().union(*(r.event_types() for r in rules)))
    rows = events.where(F.col(type_col).isin(types)).select(time.alias("time"), F.col(ts_col).cast("long").alias("ts"), F.col(id_col).cast("long").alias("event_id"), F.explode(F.array(*seen)).alias("x")).select("time", "ts", "event_id", "x.*")
    rows = rows.where("key is not null and ts is not null").where(F.exists("masks", lambda m: m != 0)).withWatermark("time", delay)
    event = F.array(F.col("ts"), F.coalesce("event_id", F.lit(0).cast("long")), F.col("event_id").isNotNull().cast("long"))
    caps = ["caps"] if any(r.captures for r in rules) else []
    rows = rows.select("time", "g", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", F.concat(event, "masks").alias("numbers"), *caps)
    specs = [_spec(own) for own in groups.values()]
    found = rows.groupBy("g", "bucket").applyInPandasWithState(_processor(specs, sticky), _OUT, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    return with_captures(found, rules)


def windowed_counts(events: DataFrame, time: str = "time", window: str = "1 minute", slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """Events by type in tumbling (or sliding) windows, each given once it is complete."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), "event_type").count().select("w.start", "w.end", "event_type", F.col("count").alias("n_events"))


def sessions(events: DataFrame, time: str = "time", gap: str = "30 minutes", key: str = "entity_key", delay: str = "10 seconds") -> DataFrame:
    """Sessions of each key: events that are less than ``gap`` apart."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).count().select("w.start", "w.end", key, F.col("count").alias("n_events"))


def first_decisions(decisions: DataFrame, keys: list[str], time: str = "time", ttl: str = "60 seconds") -> DataFrame:
    """The first decision on each key within the time that one stands."""
    return decisions.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)
