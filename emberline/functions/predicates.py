"""Rule expressions as Spark columns.

Logic has two values: a comparison with a missing value is false before ``not`` applies, and ``== null`` asks whether a value
is missing. With ``missing="defaults"`` missing numbers, strings and conditions count as 0, "" and false
instead. Arithmetic never aborts a job: overflow and division by zero give a missing value.
"""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.plans import ir
from emberline.plans.errors import InvalidRule
from emberline.plans.typing import type_of
from emberline.schema import Schema

_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_DEFAULTS = {"number": 0, "string": "", "bool": False}


def glob_to_regex(glob: str) -> str:
    """The anchored regular expression of a glob: ``*`` and ``?`` match slashes too; ``[a-z]``, ``[!a-z]``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            mark = "^" if body[0] in "!^" else ""
            out.append("[" + mark + re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if mark else body) + "]")
            i = end
        else:
            out.append("\\" + c if c in ".\\+()|^${}[]" else c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def check_regex(pattern: str) -> str:
    """``pattern``, unless it has what a linear-time engine can't do: look-around or back references."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", pattern):
        raise InvalidRule(f"look-around and back references aren't supported: {pattern}")
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "x", pattern))
    except re.error as e:
        raise InvalidRule(f"no regular expression: {pattern}: {e}") from e
    return pattern


def pattern_and_subject(e: ir.Call) -> tuple[str, ir.Expr]:
    """A pattern function's literal and the text it is for. ``regex`` has the pattern first; the literal tells if only one argument is one."""
    a, b = e.args
    first = isinstance(a, ir.Literal) and isinstance(a.value, str)
    second = isinstance(b, ir.Literal) and isinstance(b.value, str)
    if first:
        return a.value, b
    if second:
        return b.value, a
    raise InvalidRule(f"{e.name} needs a literal pattern")


class Compiler:
    """Compiles expressions against a schema; ``missing`` is ``"null"`` or ``"defaults"``."""

    def __init__(self, schema: Schema, missing: str = "null"):
        if missing not in ("null", "defaults"):
            raise ValueError(missing)
        self.schema, self.missing = schema, missing

    def field(self, path: str) -> Column:
        f = self.schema.lookup(path)
        if f is None:
            return F.lit(None)
        name = f.column or f.path
        return F.col(".".join(f"`{p}`" for p in name.split(".")))

    def value(self, e: ir.Expr) -> Column:
        """The value of ``e``, null where it is missing."""
        if isinstance(e, ir.Literal):
            return F.lit(e.value)
        if isinstance(e, ir.Field):
            c = self.field(e.path)
            kind = type_of(e, self.schema)
            if self.missing == "defaults" and kind in _DEFAULTS:
                c = F.coalesce(c, F.lit(_DEFAULTS[kind]))
            return c
        if isinstance(e, ir.Negate):
            return F.try_subtract(F.lit(0), self.value(e.part))
        if isinstance(e, ir.Arithmetic):
            a, b = self.value(e.left), self.value(e.right)
            if e.op == "+":
                return F.try_add(a, b)
            if e.op == "-":
                return F.try_subtract(a, b)
            if e.op == "*":
                return F.try_multiply(a, b)
            b = F.nullif(b, F.lit(0))
            if e.op == "%":
                return F.try_mod(a, b)
            whole = self.whole(e.left) and self.whole(e.right)
            return F.call_function("div", a, b) if whole else F.try_divide(a, b)
        return self.condition(e)

    def text(self, e: ir.Expr) -> Column:
        """The value of ``e`` for a string function; the words of an array of strings, with blanks between."""
        if isinstance(e, ir.Field):
            f = self.schema.lookup(e.path)
            if f is not None and f.is_array:
                return F.array_join(self.field(e.path), " ")
        return self.value(e)

    def whole(self, e: ir.Expr) -> bool:
        """Whether a number is an integer for sure."""
        if isinstance(e, ir.Literal):
            return isinstance(e.value, int)
        if isinstance(e, ir.Field):
            f = self.schema.lookup(e.path)
            return f is not None and f.kind in ("i64", "u64")
        return all(self.whole(c) for c in e.children())

    def condition(self, e: ir.Expr) -> Column:
        """``e`` as true or false, never null."""
        if isinstance(e, ir.Logic):
            parts = [self.condition(p) for p in e.parts]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if e.op == "and" else (out | p)
            return out
        if isinstance(e, ir.Not):
            return ~self.condition(e.part)
        if isinstance(e, ir.Literal):
            return F.lit(bool(e.value))
        return F.coalesce(self.leaf(e).cast("boolean"), F.lit(False))

    def filter(self, e: ir.Expr) -> Column:
        """``e`` for a ``where``, which takes null for false: comparisons stay bare, so that they reach the scan."""
        if isinstance(e, ir.Logic):
            parts = [self.filter(p) for p in e.parts]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if e.op == "and" else (out | p)
            return out
        return self.condition(e) if isinstance(e, (ir.Not, ir.Literal)) else self.leaf(e).cast("boolean")

    def compare(self, op: str, a: Column, b: Column) -> Column:
        return _OPS[op](a, b)

    def leaf(self, e: ir.Expr) -> Column:
        if isinstance(e, ir.Compare):
            for x, other in ((e.left, e.right), (e.right, e.left)):
                if isinstance(x, ir.Literal) and x.value is None:
                    if e.op not in ("==", "!="):
                        return F.lit(False)
                    other = self.field(other.path) if isinstance(other, ir.Field) else self.value(other)
                    return other.isNull() if e.op == "==" else other.isNotNull()
            return self.compare(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, ir.Membership):
            plain = [o.value for o in e.options if o.value is not None]
            found = F.coalesce(self.value(e.value).isin(plain), F.lit(False)) if plain else F.lit(False)
            return found | self.value(e.value).isNull() if len(plain) < len(e.options) else found
        if isinstance(e, ir.Quantifier):
            right = self.value(e.right)
            test = lambda x: F.coalesce(self.compare(e.op, x, right), F.lit(False))
            return (F.exists if e.kind == "any" else F.forall)(self.field(e.array.path), test)
        if isinstance(e, ir.Call):
            if e.name in ("regex", "wildcard"):
                pattern, subject = pattern_and_subject(e)
                return self.text(subject).rlike(check_regex(pattern) if e.name == "regex" else glob_to_regex(pattern))
            a, b = map(self.text, e.args)
            if e.name == "stringequalsci":
                return F.lower(a) == F.lower(b)
            return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[e.name](a, b)
        return self.value(e)
