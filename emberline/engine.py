"""The engine: rules in, alerts and decisions out."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import interpreter
from emberline.functions.predicates import Compiler
from emberline.operators import alerts as A
from emberline.operators import decisions as D
from emberline.operators.events import match_events
from emberline.operators.metrics import rule_metrics
from emberline.operators.sequence import match_sequences
from emberline.plans import ir
from emberline.plans.analyzer import Analysis, analyze
from emberline.plans.parser import parse
from emberline.plans.typing import resolve
from emberline.schema import Schema
from emberline.sources import rules as R
from emberline.sources.normalize import interesting
from emberline.streaming.sequences import BUCKETS, stream_sequences


@dataclass(frozen=True)
class Columns:
    """Where an event DataFrame has its own columns; ``ts`` is in nanoseconds."""

    ts: str = "ts_mono_ns"
    id: str = "event_id"
    type: str = "event_type"
    entity: str = "entity_key"


@lru_cache(maxsize=4096)
def _parsed(text: str) -> ir.Rule:
    return parse(text)


class Engine:
    """Holds a schema and rules; runs them over DataFrames, in batch or as streams.

    ``mode`` is ``inline``, ``detect`` or ``offline``; it tells what decisions would come to. Nothing is ever done to a host.
    """

    def __init__(self, schema: Schema, columns: Columns = Columns(), mode: str = "detect", missing: str = "null", sticky: bool = False):
        if mode not in D.MODES:
            raise ValueError(f"no mode {mode}")
        self.schema, self.columns, self.mode, self.missing, self.sticky = schema, columns, mode, missing, sticky
        self.rules: dict[str, ir.Rule] = {}
        self.scripts: dict[str, tuple[Callable[[pd.DataFrame], pd.Series], ir.Rule]] = {}
        self.version = 0

    # rules

    def add(self, rule: ir.Rule | str, rule_id: str | None = None, **more) -> ir.Rule:
        """Adds a rule, or its text; raises if it is wrong or its id is taken."""
        if isinstance(rule, str):
            rule = _parsed(rule)
        if rule_id is not None or more:
            rule = replace(rule.named(rule_id or rule.rule_id), **more)
        resolve(rule, self.schema)
        if rule.rule_id in self.rules:
            raise ValueError(f"there is a rule {rule.rule_id} already")
        self.rules[rule.rule_id] = rule
        return rule

    def remove(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def load(self, folder: str | Path) -> dict[str, str]:
        """Adds all rules below a folder and gives what failed, with reasons."""
        loaded = R.load_all(folder)
        failed = dict(loaded.failed)
        for rule in loaded.rules:
            try:
                self.add(rule)
            except ValueError as e:
                failed[rule.rule_id] = str(e)
        return failed

    def reload(self, folder: str | Path) -> dict[str, str]:
        """Replaces the rules by those of a folder, at once; if any fails the old ones stay. ``version`` counts the times that they changed."""
        old, self.rules = self.rules, {}
        failed = self.load(folder)
        if failed:
            self.rules = old
        else:
            self.version += 1
        return failed

    def add_script(self, rule_id: str, predicate: Callable[[pd.DataFrame], pd.Series], severity: str = "medium") -> None:
        """Adds a scripted predicate: a function from a batch of events to booleans. Where it raises it is asked again event by event, and those for which it raises don't match."""
        if rule_id in self.rules or rule_id in self.scripts:
            raise ValueError(f"there is a rule {rule_id} already")
        self.scripts[rule_id] = (predicate, ir.Rule((ir.Step("*"),)).named(rule_id, severity=severity))

    @property
    def event_rules(self) -> list[ir.Rule]:
        return [r for r in self.rules.values() if not r.is_sequence]

    @property
    def sequences(self) -> list[ir.Rule]:
        return [r for r in self.rules.values() if r.is_sequence]

    def explain(self) -> list[Analysis]:
        return [analyze(r) for r in self.rules.values()]

    def condition(self, text: str) -> Column:
        """A condition's text as a column."""
        from emberline.plans.parser import parse_expression

        return Compiler(self.schema, self.missing).condition(parse_expression(text))

    # runs

    def matches(self, events: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Matches of the event rules, and of the sequences; None where there are no such rules."""
        c = self.columns
        own = {"ts_col": c.ts, "id_col": c.id, "type_col": c.type, "entity_col": c.entity}
        single = match_events(events, self.event_rules, self.schema, self.missing, **own) if self.event_rules else None
        many = match_sequences(events, self.sequences, self.schema, self.missing, self.sticky, **own) if self.sequences else None
        return single, many

    def run_scripts(self, events: DataFrame, rule_id: str) -> DataFrame:
        """The events that a scripted predicate matches."""
        predicate, _ = self.scripts[rule_id]

        def run(frames):
            for pdf in frames:
                hit, _ = _asked(predicate, pdf)
                yield pdf[hit]

        return events.mapInPandas(run, events.schema)

    def script_errors(self, events: DataFrame, rule_id: str) -> DataFrame:
        """The events for which a scripted predicate raises: ``event_id, error``."""
        predicate, _ = self.scripts[rule_id]
        name = self.columns.id

        def run(frames):
            for pdf in frames:
                _, errors = _asked(predicate, pdf)
                yield pd.DataFrame([(pdf[name].iloc[i], e) for i, e in errors], columns=["event_id", "error"])

        return events.mapInPandas(run, "event_id long, error string")

    def script_matches(self, events: DataFrame) -> DataFrame | None:
        """Matches of all scripted predicates, in the form of event rules' matches."""
        c, out = self.columns, None
        for rule_id in self.scripts:
            hits = self.run_scripts(events, rule_id)
            part = hits.select(F.lit(rule_id).alias("rule_id"), F.col(c.entity).cast("string").alias("key"), F.col(c.ts).cast("long").alias("ts"), F.col(c.id).cast("long").alias("event_id"), F.lit(None).cast("map<string,string>").alias("captures"))
            out = part if out is None else out.unionByName(part)
        return out

    def alerts(self, events: DataFrame) -> DataFrame:
        """Alerts of all rules and scripts."""
        single, many = self.matches(events)
        parts = []
        if single is not None:
            parts.append(A.event_alerts(single, self.event_rules))
        if many is not None:
            parts.append(A.sequence_alerts(many, self.sequences))
        if self.scripts:
            parts.append(A.event_alerts(self.script_matches(events), [r for _, r in self.scripts.values()]))
        if not parts:
            raise ValueError("the engine has no rules")
        return reduce(DataFrame.unionByName, parts)

    def decide(self, events: DataFrame, per_second: int = D.PER_SECOND, ttl_ns: int = D.CACHE_NS) -> DataFrame:
        """One decision for each event that ends alerts: worst rule, rate limit, cache and routing, as ``decisions.decide`` says."""
        return D.decide(self.alerts(events), [r.rule_id for r in self.rules.values() if r.blockable], self.mode, per_second, ttl_ns)

    def decisions(self, events: DataFrame) -> DataFrame:
        """An action for each alert by itself, and what it would come to."""
        blockable = [r.rule_id for r in self.rules.values() if r.blockable]
        can = F.col("rule_id").isin(blockable) if blockable else F.lit(False)
        out = self.alerts(events).withColumn("action", D.action_of(F.col("severity")))
        return out.withColumn("outcome", D.outcome(F.col("action"), F.lit(self.mode), can))

    def metrics(self, events: DataFrame) -> DataFrame:
        single, many = self.matches(events)
        parts = [p.select("rule_id", "key", "ts") for p in (single, many) if p is not None]
        return rule_metrics(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def stream(self, events: DataFrame, time: Column, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
        """Alerts over a stream: of event rules at once, of sequences as the watermark passes their last event; ``buckets`` as ``stream_sequences`` says."""
        c = self.columns
        parts = []
        if self.event_rules:
            parts.append(A.event_alerts(match_events(events, self.event_rules, self.schema, self.missing, c.ts, c.id, c.type, c.entity), self.event_rules))
        if self.sequences:
            found = stream_sequences(events, self.sequences, self.schema, time, delay, self.missing, self.sticky, c.ts, c.id, c.type, c.entity, buckets)
            parts.append(A.sequence_alerts(found, self.sequences))
        if not parts:
            raise ValueError("the engine has no rules")
        return reduce(DataFrame.unionByName, parts)

    def prefilter(self, events: DataFrame) -> DataFrame:
        """The events that can matter to any rule."""
        return interesting(events, [resolve(r, self.schema) for r in self.rules.values()], self.schema, self.columns.type)


def _asked(predicate: Callable[[pd.DataFrame], pd.Series], pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Which rows match, and the errors by row."""

    def ask(rows: pd.DataFrame) -> np.ndarray:
        return pd.Series(predicate(rows)).fillna(False).astype(bool).to_numpy()

    try:
        return ask(pdf), []
    except Exception:  # a script may raise anything; ask for each row, so that others aren't lost
        hit, errors = np.zeros(len(pdf), bool), []
        for i in range(len(pdf)):
            try:
                hit[i] = ask(pdf.iloc[i : i + 1])[0]
            except Exception as e:
                errors.append((i, f"{type(e).__name__}: {e}"))
        return hit, errors


class RuleWatch:
    """Reloads an engine's rules when the files below a folder change: ``poll`` between batches, or ``start`` for a thread that does."""

    def __init__(self, engine: Engine, folder: str | Path):
        self.engine, self.folder = engine, Path(folder)
        self.seen = ""
        self.failed: dict[str, str] = {}
        self._stop = threading.Event()

    def contents(self) -> str:
        """A hash of the names and contents of all files."""
        h = hashlib.sha256()
        for path in sorted(p for p in self.folder.rglob("*") if p.is_file()):
            h.update(f"{path.relative_to(self.folder)}\0{path.stat().st_size}\0".encode())
            h.update(path.read_bytes())
        return h.hexdigest()

    def poll(self) -> bool:
        """Reloads if something changed since the last time, and tells whether the rules are new ones. What failed is in ``failed``; the old rules stay then."""
        now = self.contents()
        if now == self.seen:
            return False
        self.seen = now
        self.failed = self.engine.reload(self.folder)
        return not self.failed

    def start(self, seconds: float = 5.0, changed: Callable[[int], None] | None = None) -> threading.Thread:
        """Polls in a thread until ``stop``; ``changed`` is told each new version."""

        def run() -> None:
            while not self._stop.wait(seconds):
                if self.poll() and changed is not None:
                    changed(self.engine.version)

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self._stop.set()


def inconsistencies(events: DataFrame, rules: Iterable[ir.Rule], schema: Schema, id_col: str = "event_id") -> DataFrame:
    """Events for which a rule's column and the interpreter disagree: ``rule_id, event_id, column, interpreter``."""
    compiler = Compiler(schema)
    rules = [resolve(r, schema) for r in rules]
    flagged = events.withColumns({f"__{i}": compiler.condition(r.steps[0].where) for i, r in enumerate(rules)})

    def run(frames):
        for pdf in frames:
            rows = []
            for rec in pdf.to_dict("records"):
                plain = {k: (None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v) for k, v in rec.items()}
                for i, r in enumerate(rules):
                    want = interpreter.condition(r.steps[0].where, plain)
                    if bool(rec[f"__{i}"]) != want:
                        rows.append((r.rule_id, rec[id_col], bool(rec[f"__{i}"]), want))
            yield pd.DataFrame(rows, columns=["rule_id", "event_id", "column", "interpreter"])

    return flagged.mapInPandas(run, "rule_id string, event_id long, column boolean, interpreter boolean")
