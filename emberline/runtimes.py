"""Who compiles and who runs a rule: registries of compilers and of predicate runtimes.

A compiler turns a record into a rule; the registry asks them in the order in which they came and keeps what they made by the record's
contents, so that a changed record is compiled anew. A runtime says whether an event matches a rule's condition; the manager
takes the one of the highest priority that can run the rule.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import interpreter
from emberline.functions.predicates import Compiler
from emberline.plans import ir
from emberline.plans.errors import InvalidRule, RuleError
from emberline.plans.parser import parse
from emberline.plans.typing import resolve
from emberline.schema import Schema


@dataclass(frozen=True)
class RuleCompiler:
    """``accepts`` tells whether a record is of the compiler's kind, ``compile`` makes the rule or raises."""

    name: str
    accepts: Callable[[dict], bool]
    compile: Callable[[dict], ir.Rule]


def _text(record: dict) -> ir.Rule:
    return parse(record["query"]).named(str(record.get("id", "rule")))


def _condition(record: dict) -> ir.Rule:
    return ir.Rule((ir.Step(str(record.get("event_type", "")), ir.from_condition(record["condition"])),)).named(str(record.get("id", "rule"))).validate()


@dataclass
class Compilers:
    """Compilers by name; the two of the library are there from the start."""

    known: dict[str, RuleCompiler] = field(default_factory=lambda: {c.name: c for c in (RuleCompiler("text", lambda r: "query" in r, _text), RuleCompiler("condition", lambda r: "condition" in r, _condition))})
    made: dict[str, tuple[str, ir.Rule]] = field(default_factory=dict)

    def register(self, compiler: RuleCompiler) -> None:
        if compiler.name in self.known:
            raise ValueError(f"there is a compiler {compiler.name} already")
        self.known[compiler.name] = compiler

    def compiler_of(self, record: dict) -> RuleCompiler:
        for c in self.known.values():
            if c.accepts(record):
                return c
        raise InvalidRule("no compiler takes this record")

    def compile(self, record: dict) -> ir.Rule:
        """The record's rule; made once as long as its contents stay."""
        rule_id = str(record.get("id", "rule"))
        now = hashlib.sha256(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest()
        kept = self.made.get(rule_id)
        if kept is None or kept[0] != now:
            kept = self.made[rule_id] = (now, self.compiler_of(record).compile(record))
        return kept[1]

    def problems(self, record: dict, schema: Schema | None = None) -> list[str]:
        """What is wrong with a record; nothing if it compiles (and, with a schema, its names and types are right)."""
        try:
            rule = self.compiler_of(record).compile(record)
            if schema is not None:
                resolve(rule, schema)
        except (RuleError, KeyError, TypeError) as e:
            return [str(e)]
        return []

    def forget(self, rule_id: str | None = None) -> None:
        if rule_id is None:
            self.made.clear()
        else:
            self.made.pop(rule_id, None)


@dataclass(frozen=True)
class Runtime:
    """``condition(rule, schema)`` gives a boolean column; ``can`` names what it supports. The highest ``priority`` goes first."""

    name: str
    priority: int
    can: frozenset[str]
    condition: Callable[[ir.Rule, Schema], Column]


def needs(rule: ir.Rule) -> frozenset[str]:
    """What a runtime has to support for the rule's first step: expressions, regexes, globs, quantifiers, captures."""
    out = {"expressions"}
    for e in rule.steps[0].where.walk():
        if isinstance(e, ir.Quantifier):
            out.add("quantifiers")
        elif isinstance(e, ir.Call) and e.name in ("regex", "wildcard"):
            out.add("regexes" if e.name == "regex" else "globs")
    return frozenset(out | ({"captures"} if rule.captures else set()))


ALL = frozenset(("expressions", "regexes", "globs", "quantifiers", "captures"))


def _native(rule: ir.Rule, schema: Schema) -> Column:
    return Compiler(schema).condition(rule.steps[0].where)


def _plain(rule: ir.Rule, schema: Schema) -> Column:
    """The interpreter in Python, over the fields that the rule reads, in Arrow batches."""
    where = rule.steps[0].where
    paths = sorted(ir.required_fields(where))
    compiler = Compiler(schema)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in frames:
            yield pd.Series([interpreter.condition(where, json.loads(x)) for x in rows], dtype=bool)

    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    row = F.to_json(F.struct(*(compiler.field(p).alias(p) for p in paths), F.lit(1).alias("__")))
    return F.pandas_udf(run, "boolean")(row)


class Runtimes:
    """Runtimes and the rules that are loaded for them."""

    def __init__(self, schema: Schema):
        self.schema = schema
        self.known: dict[str, Runtime] = {}
        self.rules: dict[str, ir.Rule] = {}
        self.register(Runtime("native", 100, ALL, _native))
        self.register(Runtime("interpreter", 10, ALL - {"captures"}, _plain))

    def register(self, runtime: Runtime) -> None:
        if runtime.name in self.known:
            raise ValueError(f"there is a runtime {runtime.name} already")
        self.known[runtime.name] = runtime

    def unregister(self, name: str) -> bool:
        return self.known.pop(name, None) is not None

    def load(self, rule: ir.Rule) -> None:
        resolved = resolve(rule, self.schema)
        if resolved.is_sequence:
            raise InvalidRule("a runtime runs event rules")
        self.rules[rule.rule_id] = resolved

    def unload(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def runtime_of(self, rule: ir.Rule) -> Runtime:
        able = [r for r in self.known.values() if needs(rule) <= r.can]
        if not able:
            raise InvalidRule(f"no runtime supports {', '.join(sorted(needs(rule)))}")
        return max(able, key=lambda r: (r.priority, r.name))

    def evaluate(self, events: DataFrame, rule_id: str, runtime: str | None = None, type_col: str = "event_type") -> DataFrame:
        """The events that a loaded rule matches, by the best runtime or the one named."""
        rule = self.rules[rule_id]
        chosen = self.known[runtime] if runtime else self.runtime_of(rule)
        return events.where(F.col(type_col) == rule.steps[0].event_type).where(chosen.condition(rule, self.schema))

    def evaluate_once(self, events: DataFrame, rule: ir.Rule | str) -> DataFrame:
        """The events that a rule matches which isn't loaded."""
        rule = resolve(parse(rule) if isinstance(rule, str) else rule, self.schema)
        return events.where(F.col("event_type") == rule.steps[0].event_type).where(self.runtime_of(rule).condition(rule, self.schema))


def described(runtimes: Runtimes) -> list[dict[str, Any]]:
    """Names, priorities and capabilities, best first."""
    return [{"name": r.name, "priority": r.priority, "can": sorted(r.can)} for r in sorted(runtimes.known.values(), key=lambda r: -r.priority)]
