"""Typed rules: expressions, event rules and sequences, and helpers that build them without text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from emberline.plans.errors import InvalidRule

COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
ARITHMETIC = ("+", "-", "*", "/", "%")
FUNCTIONS = {"contains": 2, "startswith": 2, "endswith": 2, "stringequalsci": 2, "regex": 2, "wildcard": 2}


@dataclass(frozen=True)
class Expr:
    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Literal(Expr):
    value: bool | int | float | str | None


@dataclass(frozen=True)
class Field(Expr):
    path: str


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class Logic(Expr):
    op: str  # and, or
    parts: tuple[Expr, ...]

    def children(self):
        return self.parts


@dataclass(frozen=True)
class Not(Expr):
    part: Expr

    def children(self):
        return (self.part,)


@dataclass(frozen=True)
class Negate(Expr):
    part: Expr

    def children(self):
        return (self.part,)


@dataclass(frozen=True)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class Membership(Expr):
    value: Expr
    options: tuple[Literal, ...]

    def children(self):
        return (self.value, *self.options)


@dataclass(frozen=True)
class Call(Expr):
    name: str  # lower case
    args: tuple[Expr, ...]

    def children(self):
        return self.args


@dataclass(frozen=True)
class Quantifier(Expr):
    """``any`` or ``all`` elements of an array field compare with ``right``."""

    kind: str
    array: Field
    op: str
    right: Expr

    def children(self):
        return (self.array, self.right)


TRUE = Literal(True)


@dataclass(frozen=True)
class Capture:
    """A field to report: from the step of that index, or the last event of a match if it is None."""

    path: str
    alias: str = ""
    step: int | None = None

    @property
    def name(self) -> str:
        return self.alias or self.path.rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Step:
    """``count`` events of a type and condition, others between them passed over."""

    event_type: str
    where: Expr = TRUE
    count: int = 1


@dataclass(frozen=True)
class Rule:
    """An event rule if it has one step and ``by`` is None and it isn't marked as a sequence."""

    steps: tuple[Step, ...]
    is_sequence: bool = False
    by: str | None = None
    maxspan_ms: int | None = None
    until: Step | None = None
    captures: tuple[Capture, ...] = ()
    rule_id: str = "rule"
    name: str = ""
    severity: str = "medium"
    tags: tuple[str, ...] = ()
    description: str = ""
    blockable: bool = False
    text: str = ""
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def named(self, rule_id: str, **more) -> Rule:
        return replace(self, rule_id=rule_id, name=more.pop("name", "") or rule_id, **more)

    def predicates(self) -> list[Expr]:
        return [s.where for s in self.steps] + ([self.until.where] if self.until else [])

    def event_types(self) -> set[str]:
        return {s.event_type for s in self.steps} | ({self.until.event_type} if self.until else set())

    def validate(self) -> Rule:
        if not self.steps:
            raise InvalidRule("a rule needs a step")
        if not self.is_sequence and (len(self.steps) > 1 or self.until or self.maxspan_ms is not None):
            raise InvalidRule("an event rule has one step and neither span nor end")
        names = [c.name for c in self.captures]
        if len(set(names)) < len(names):
            raise InvalidRule("two captures have one name")
        if any(not c.path or (c.step is not None and not 0 <= c.step < len(self.steps)) for c in self.captures):
            raise InvalidRule("a capture names no field or no step")
        if any(s.count < 1 for s in self.steps) or (self.until and self.until.count != 1) or (not self.is_sequence and self.steps[0].count != 1):
            raise InvalidRule("only a step of a sequence can be counted, and at least once")
        if self.maxspan_ms is not None and self.maxspan_ms < 0:
            raise InvalidRule("a span can't be negative")
        return self


def required_fields(*exprs: Expr) -> set[str]:
    """Paths that the expressions read, those in quantifiers too."""
    return {e.path for x in exprs for e in x.walk() if isinstance(e, Field)}


def _patterns(name: str, exprs: Sequence[Expr]) -> set[str]:
    found = set()
    for x in exprs:
        for e in x.walk():
            if isinstance(e, Call) and e.name == name:
                found |= {a.value for a in e.args if isinstance(a, Literal) and isinstance(a.value, str)}
    return found


def required_regexes(*exprs: Expr) -> set[str]:
    return _patterns("regex", exprs)


def required_globs(*exprs: Expr) -> set[str]:
    return _patterns("wildcard", exprs)


# builders


def lit(value) -> Literal:
    return Literal(value)


def equals(path: str, value) -> Expr:
    return Compare("==", Field(path), Literal(value))


def contains(path: str, text: str) -> Expr:
    return Call("contains", (Field(path), Literal(text)))


def both(*parts: Expr) -> Expr:
    return Logic("and", parts)


def either(*parts: Expr) -> Expr:
    return Logic("or", parts)


def from_condition(node: dict) -> Expr:
    """An expression from a JSON rule's condition: always, field_eq, field_contains, field_regex, and, or, not."""
    kind = str(node.get("type", "")).lower()
    if kind == "always":
        return TRUE
    if kind == "field_eq":
        return equals(node["field"], node["value"])
    if kind == "field_contains":
        return contains(node["field"], node["value"])
    if kind == "field_regex":
        return Call("regex", (Literal(node.get("pattern", node.get("value"))), Field(node["field"])))
    if kind in ("and", "or"):
        return Logic(kind, tuple(from_condition(c) for c in node["conditions"]))
    if kind == "not":
        return Not(from_condition(node["condition"]))
    raise InvalidRule(f"no condition {kind!r}")
