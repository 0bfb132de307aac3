"""Rule expressions over plain Python events: what the columns are tested against, and the way scripted rules run."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping

from emberline.functions.predicates import glob_to_regex, pattern_and_subject
from emberline.plans import ir

_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_LIMIT = 1 << 63


def field(event: Mapping, path: str):
    at = event
    if path in event:
        return event[path]
    for part in path.split("."):
        at = at.get(part) if isinstance(at, Mapping) else None
        if at is None:
            return None
    return at


def _number(x):
    return None if isinstance(x, int) and not -_LIMIT <= x < _LIMIT else x


def value(e: ir.Expr, event: Mapping):
    if isinstance(e, ir.Literal):
        return e.value
    if isinstance(e, ir.Field):
        return field(event, e.path)
    if isinstance(e, ir.Negate):
        x = value(e.part, event)
        return None if x is None else _number(-x)
    if isinstance(e, ir.Arithmetic):
        a, b = value(e.left, event), value(e.right, event)
        if a is None or b is None or e.op in "/%" and b == 0:
            return None
        if e.op == "/":
            if isinstance(a, int) and isinstance(b, int):
                return _number(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
            return a / b
        if e.op == "%":
            return abs(a) % abs(b) * (-1 if a < 0 else 1)
        return _number({"+": a + b, "-": a - b, "*": a * b}[e.op])
    return condition(e, event)


def text(e: ir.Expr, event: Mapping):
    """The value for a string function; the words of a list, with blanks between."""
    x = value(e, event)
    return " ".join(w for w in x if w is not None) if isinstance(x, (list, tuple)) else x


def _compare(op: str, a, b) -> bool:
    if a is None or b is None:
        return False
    return _OPS[op](a, b)


def condition(e: ir.Expr, event: Mapping) -> bool:
    if isinstance(e, ir.Logic):
        return (all if e.op == "and" else any)(condition(p, event) for p in e.parts)
    if isinstance(e, ir.Not):
        return not condition(e.part, event)
    if isinstance(e, ir.Compare):
        for x, other in ((e.left, e.right), (e.right, e.left)):
            if isinstance(x, ir.Literal) and x.value is None:
                return e.op in ("==", "!=") and (value(other, event) is None) == (e.op == "==")
        return _compare(e.op, value(e.left, event), value(e.right, event))
    if isinstance(e, ir.Membership):
        x = value(e.value, event)
        return any(o.value == x and type(o.value) in (type(x), int, float) for o in e.options)
    if isinstance(e, ir.Quantifier):
        array = field(event, e.array.path)
        if array is None:
            return False
        right = value(e.right, event)
        return (any if e.kind == "any" else all)(_compare(e.op, x, right) for x in array)
    if isinstance(e, ir.Call):
        if e.name in ("regex", "wildcard"):
            pattern, subject = pattern_and_subject(e)
            x = text(subject, event)
            return x is not None and re.search(pattern if e.name == "regex" else glob_to_regex(pattern), x) is not None
        a, b = (text(x, event) for x in e.args)
        if a is None or b is None:
            return False
        if e.name == "stringequalsci":
            return a.lower() == b.lower()
        return {"contains": a.__contains__, "startswith": a.startswith, "endswith": a.endswith}[e.name](b)
    return bool(value(e, event))
