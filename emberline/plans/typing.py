"""Types of expressions, and rules whose names have been looked up."""

from __future__ import annotations

from dataclasses import replace

from emberline.plans import ir
from emberline.plans.errors import TypeMismatch, UnknownField
from emberline.schema import Schema

#: bool, number, string, bytes, array, null, and any (a field that the schema leaves open)
_NUMBERS = {"i64", "u64", "f64"}


def _of_field(path: str, schema: Schema) -> tuple[str, str]:
    """The type of a field, and of its elements if it is an array."""
    f = schema.lookup(path)
    if f is None:
        return "any", "any"
    kind = "number" if f.kind in _NUMBERS else f.kind
    return ("array", kind) if f.is_array else (kind, kind)


def _fits(a: str, b: str) -> bool:
    return a == b or "null" in (a, b) or "any" in (a, b)


def _compare(op: str, a: str, b: str, where: str) -> str:
    if not _fits(a, b):
        raise TypeMismatch(f"{where}: can't compare {a} with {b}")
    if op not in ("==", "!=") and ("bool" in (a, b) or "array" in (a, b)):
        raise TypeMismatch(f"{where}: no order among {a}")
    return "bool"


def type_of(e: ir.Expr, schema: Schema) -> str:
    """The type of ``e``; raises if its parts don't fit."""
    if isinstance(e, ir.Literal):
        if e.value is None:
            return "null"
        if isinstance(e.value, bool):
            return "bool"
        return "string" if isinstance(e.value, str) else "number"
    if isinstance(e, ir.Field):
        return _of_field(e.path, schema)[0]
    if isinstance(e, ir.Compare):
        return _compare(e.op, type_of(e.left, schema), type_of(e.right, schema), e.op)
    if isinstance(e, ir.Logic):
        for p in e.parts:
            if type_of(p, schema) not in ("bool", "any"):
                raise TypeMismatch(f"{e.op} joins conditions, not {type_of(p, schema)}")
        return "bool"
    if isinstance(e, ir.Not):
        if type_of(e.part, schema) not in ("bool", "any"):
            raise TypeMismatch("not takes a condition")
        return "bool"
    if isinstance(e, (ir.Arithmetic, ir.Negate)):
        for p in e.children():
            if type_of(p, schema) not in ("number", "any", "null"):
                raise TypeMismatch("arithmetic takes numbers")
        return "number"
    if isinstance(e, ir.Membership):
        kind = type_of(e.value, schema)
        for o in e.options:
            if not _fits(kind, type_of(o, schema)):
                raise TypeMismatch(f"in: {kind} and {type_of(o, schema)}")
        return "bool"
    if isinstance(e, ir.Call):
        if len(e.args) != ir.FUNCTIONS[e.name]:
            raise TypeMismatch(f"{e.name} takes {ir.FUNCTIONS[e.name]} arguments")
        for a in e.args:
            words = isinstance(a, ir.Field) and _of_field(a.path, schema) == ("array", "string")
            if not words and type_of(a, schema) not in ("string", "any", "null"):
                raise TypeMismatch(f"{e.name} takes strings")
        return "bool"
    if isinstance(e, ir.Quantifier):
        outer, inner = _of_field(e.array.path, schema)
        if outer not in ("array", "any"):
            raise TypeMismatch(f"{e.array.path} is no array")
        return _compare(e.op, inner, type_of(e.right, schema), e.kind)
    raise TypeError(e)


def resolve(rule: ir.Rule, schema: Schema) -> ir.Rule:
    """``rule`` with the schema's names for event types; raises for unknown names, wrong types and parts that don't fit."""
    rule.validate()

    def step(s: ir.Step) -> ir.Step:
        if type_of(s.where, schema) not in ("bool", "any"):
            raise TypeMismatch("where takes a condition")
        return replace(s, event_type=schema.event_type(s.event_type))

    for c in rule.captures:
        schema.lookup(c.path)
    if rule.by is not None and rule.by not in ("entity_key",) and schema.lookup(rule.by) is None:
        raise UnknownField(f"no field {rule.by}")
    return replace(rule, steps=tuple(map(step, rule.steps)), until=step(rule.until) if rule.until else None)
