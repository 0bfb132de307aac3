"""Many string patterns at once over text columns: equality, substring, prefix and suffix.

Every pattern is reported on its own, overlapping ones too, with where it is first found. A few patterns are expressions in the JVM, behind
one alternation, so that a text without any of them costs one scan. Many go into an automaton, which is broadcast and reads each text
once however many patterns there are, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.plans import ir
from emberline.plans.errors import InvalidRule

MAX_PATTERNS = 10_000
MAX_BYTES = 4096
#: patterns of a field at most that are expressions in the JVM
EXPRESSIONS = 50
KINDS = ("equals", "contains", "starts_with", "ends_with")
_CALLS = {"contains": "contains", "startswith": "starts_with", "endswith": "ends_with"}


@dataclass(frozen=True)
class Pattern:
    pattern_id: int
    text: str
    kind: str
    field: str


def check(patterns: Sequence[Pattern]) -> Sequence[Pattern]:
    if not patterns:
        raise InvalidRule("no patterns")
    if len(patterns) > MAX_PATTERNS:
        raise InvalidRule(f"more than {MAX_PATTERNS} patterns")
    for p in patterns:
        if not p.text:
            raise InvalidRule("an empty pattern")
        if len(p.text.encode()) > MAX_BYTES:
            raise InvalidRule(f"a pattern of more than {MAX_BYTES} bytes")
        if p.kind not in KINDS:
            raise InvalidRule(f"no kind {p.kind}")
    return patterns


def extract(*exprs: ir.Expr) -> list[Pattern]:
    """The literal patterns in expressions, numbered in order; those too long are left out."""
    found: list[tuple[str, str, str]] = []

    def visit(e: ir.Expr) -> None:
        if isinstance(e, ir.Compare) and e.op in ("==", "!="):
            for x, y in ((e.left, e.right), (e.right, e.left)):
                if isinstance(x, ir.Field) and isinstance(y, ir.Literal) and isinstance(y.value, str):
                    found.append((y.value, "equals", x.path))
        elif isinstance(e, ir.Call) and e.name in _CALLS:
            for x, y in (e.args, e.args[::-1]):
                if isinstance(x, ir.Field) and isinstance(y, ir.Literal) and isinstance(y.value, str):
                    found.append((y.value, _CALLS[e.name], x.path))
        elif isinstance(e, ir.Membership) and isinstance(e.value, ir.Field):
            found.extend((o.value, "equals", e.value.path) for o in e.options if isinstance(o.value, str))
        elif isinstance(e, (ir.Logic, ir.Not, ir.Negate)):
            for c in e.children():
                visit(c)

    for e in exprs:
        visit(e)
    good = [f for f in found if f[0] and len(f[0].encode()) <= MAX_BYTES]
    return [Pattern(i, *f) for i, f in enumerate(good)]


def any_of(column: Column, patterns: Iterable[Pattern], ignore_case: bool = False) -> Column:
    """Whether the text has any of the patterns: one regular expression for all of them, and a set for equality."""
    alternatives, equal = [], []
    for p in patterns:
        body = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", p.text.lower() if ignore_case else p.text)
        if p.kind == "equals":
            equal.append(p.text.lower() if ignore_case else p.text)
        else:
            alternatives.append({"contains": body, "starts_with": rf"\A{body}", "ends_with": rf"{body}\z"}[p.kind])
    c = F.lower(column) if ignore_case else column
    out = F.lit(False)
    if equal:
        out = out | c.isin(equal)
    if alternatives:
        out = out | c.rlike("|".join(alternatives))
    return F.coalesce(out, F.lit(False))


HIT_DDL = "array<struct<pattern_id:int,start_pos:int,end_pos:int>>"
_HIT = pa.list_(pa.struct([("pattern_id", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))


class Automaton:
    """Finds patterns of one field in texts, all of them in one pass."""

    def __init__(self, patterns: Sequence[Pattern], ignore_case: bool = False):
        import ahocorasick

        self.fold = ignore_case
        self.exact: dict[str, list[int]] = {}
        inner: dict[str, list[tuple[int, str]]] = {}
        for p in patterns:
            text = p.text.lower() if ignore_case else p.text
            if p.kind == "equals":
                self.exact.setdefault(text, []).append(p.pattern_id)
            else:
                inner.setdefault(text, []).append((p.pattern_id, p.kind))
        self.inner = None
        if inner:
            self.inner = ahocorasick.Automaton()
            for text, own in inner.items():
                self.inner.add_word(text, (len(text), own))
            self.inner.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """``pattern_id, start, end`` of each pattern, where it comes first, in order of numbers."""
        if text is None:
            return []
        if self.fold:
            text = text.lower()
        n = len(text)
        found = {i: (0, n) for i in self.exact.get(text, ())}
        if self.inner is not None:
            for last, (size, own) in self.inner.iter(text):
                start = last + 1 - size
                for i, kind in own:
                    if i not in found and (kind == "contains" or (kind == "starts_with" and start == 0) or (kind == "ends_with" and last + 1 == n)):
                        found[i] = (start, last + 1)
        return [(i, *found[i]) for i in sorted(found)]


def _by_automaton(df: DataFrame, column: Column, patterns: Sequence[Pattern], ignore_case: bool) -> Column:
    shared = df.sparkSession.sparkContext.broadcast((tuple(patterns), ignore_case))

    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(*shared.value)
        for part in texts:
            yield pa.array([[dict(zip(("pattern_id", "start_pos", "end_pos"), h)) for h in automaton.find(t)] for t in part.to_pylist()], _HIT)

    find.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, HIT_DDL)(column.cast("string"))


def _by_expressions(c: Column, patterns: Sequence[Pattern], ignore_case: bool) -> Column:
    c = F.lower(c) if ignore_case else c
    one = []
    for p in patterns:
        text = p.text.lower() if ignore_case else p.text
        n = len(text)
        test, start = {
            "equals": (c == text, F.lit(0)),
            "contains": (F.contains(c, F.lit(text)), F.instr(c, text) - 1),
            "starts_with": (F.startswith(c, F.lit(text)), F.lit(0)),
            "ends_with": (F.endswith(c, F.lit(text)), F.length(c) - n),
        }[p.kind]
        one.append(F.when(test, F.struct(F.lit(p.pattern_id).alias("pattern_id"), start.cast("int").alias("start_pos"), (start + n).cast("int").alias("end_pos"))))
    return F.when(any_of(c, patterns, ignore_case), F.array_compact(F.array(*one))).otherwise(F.array().cast(HIT_DDL))


def match_patterns(df: DataFrame, patterns: Sequence[Pattern], columns: dict[str, str] | None = None, ignore_case: bool = False, expressions: int = EXPRESSIONS) -> DataFrame:
    """Rows of ``df`` with ``pattern_id, start_pos, end_pos`` (characters, from 0) for each pattern that the text of its field has.

    ``columns`` gives a field's column, its name unless given. Fields with more than ``expressions`` patterns are read by an automaton; the rows are
    the same.
    """
    check(patterns)
    by_field: dict[str, list[Pattern]] = {}
    for p in patterns:
        by_field.setdefault(p.field, []).append(p)
    hits = []
    for name, own in by_field.items():
        c = F.col((columns or {}).get(name, name))
        hits.append(_by_expressions(c, own, ignore_case) if len(own) <= expressions else _by_automaton(df, c, own, ignore_case))
    return df.withColumn("__hit", F.explode(F.concat(*hits))).select(*df.columns, "__hit.*")
