from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.plans import ir
from emberline.plans.errors import InvalidRule, RuleError, SyntaxProblem, TypeMismatch, UnknownEventType, UnknownField, UnknownFunction
from emberline.plans.parser import duration_ms, parse, parse_expression
from emberline.plans.typing import resolve
from emberline.schema import Schema, host_schema

F, L = ir.Field, ir.Literal


@pytest.mark.parametrize(
    ("text", "expr"),
    [
        ("process.pid == 1000", ir.Compare("==", F("process.pid"), L(1000))),
        ('executable == "/bin/bash" and pid > 1000', ir.Logic("and", (ir.Compare("==", F("executable"), L("/bin/bash")), ir.Compare(">", F("pid"), L(1000))))),
        ("a == 1 or b == 2 and not c == 3", ir.Logic("or", (ir.Compare("==", F("a"), L(1)), ir.Logic("and", (ir.Compare("==", F("b"), L(2)), ir.Not(ir.Compare("==", F("c"), L(3)))))))),
        ("1 + 2 * 3", ir.Arithmetic("*", ir.Arithmetic("+", L(1), L(2)), L(3))),
        ("pid + 100 > 2000", ir.Compare(">", ir.Arithmetic("+", F("pid"), L(100)), L(2000))),
        ('shell in ("bash", "sh", "zsh")', ir.Membership(F("shell"), (L("bash"), L("sh"), L("zsh")))),
        ("flag == true", ir.Compare("==", F("flag"), L(True))),
        ("x == null", ir.Compare("==", F("x"), L(None))),
        ("a.b.c == 1", ir.Compare("==", F("a.b.c"), L(1))),
        ('any(process.args == "-v")', ir.Quantifier("any", F("process.args"), "==", L("-v"))),
        ("all(file.permissions > 0)", ir.Quantifier("all", F("file.permissions"), ">", L(0))),
        ('wildcard("*.exe", name)', ir.Call("wildcard", (L("*.exe"), F("name")))),
        ('name contains "x"', ir.Call("contains", (F("name"), L("x")))),
        ('name regex~ "x+"', ir.Call("regex", (L("x+"), F("name")))),
        (r'name == "a\"b\\c"', ir.Compare("==", F("name"), L('a"b\\c'))),
        ("!(a == 1) && b == 2 || c == 3", ir.Logic("or", (ir.Logic("and", (ir.Not(ir.Compare("==", F("a"), L(1))), ir.Compare("==", F("b"), L(2)))), ir.Compare("==", F("c"), L(3))))),
        ("-x < -1", ir.Compare("<", ir.Negate(F("x")), ir.Negate(L(1)))),
    ],
)
def test_expressions(text, expr):
    assert parse_expression(text) == expr


@pytest.mark.parametrize("op", ir.COMPARISONS)
def test_all_comparisons(op):
    assert parse_expression(f"pid {op} 1").op == op


@pytest.mark.parametrize(("text", "ms"), [("5ms", 5), ("10s", 10_000), ("2m", 120_000), ("1h", 3_600_000)])
def test_durations(text, ms):
    assert duration_ms(text) == ms
    assert parse(f"sequence by x [a] [b] with maxspan={text}").maxspan_ms == ms


@pytest.mark.parametrize("text", ["a where x = 1", "a where", "where x == 1", "a where (x == 1", "sequence by x", "sequence by x [a", "a where x == 1 == 2", "a where x in (y)", 'a where "open', "a where x @ 1", "sequence by x [a] with maxspan=5", "a b", ""])
def test_what_is_no_rule(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_sequences():
    r = parse("sequence by process.pid [a where x == 1] [b] with maxspan=5s until [c where y > 2]")
    assert r.is_sequence and r.by == "process.pid" and r.maxspan_ms == 5000 and r.until.event_type == "c"
    assert [s.event_type for s in r.steps] == ["a", "b"] and r.steps[1].where == ir.TRUE
    early = parse("sequence with maxspan=5s [1] [2] // a comment\n -- another")
    assert early.by is None and early.maxspan_ms == 5000 and [s.event_type for s in early.steps] == ["1", "2"]


def test_what_a_rule_reads():
    r = parse('a where contains(x.y, "z") and any(q == 1) and regex("a+", w) and wildcard("*b", v)')
    assert ir.required_fields(*r.predicates()) == {"x.y", "q", "w", "v"}
    assert ir.required_regexes(*r.predicates()) == {"a+"} and ir.required_globs(*r.predicates()) == {"*b"}


def schema() -> Schema:
    return Schema().add_type("a", aliases=("1",)).add_field("n", "i64", aliases=("7",)).add_field("s", "string").add_field("b", "bool").add_field("arr", "i64", is_array=True)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("zzz", UnknownEventType),
        ("a where nope == 1", UnknownField),
        ('a where n == "x"', TypeMismatch),
        ("a where b < true", TypeMismatch),
        ("a where n", TypeMismatch),
        ("a where s + 1 == 2", TypeMismatch),
        ("a where contains(n, s)", TypeMismatch),
        ("a where any(n == 1)", TypeMismatch),
        ("a where n in (1, \"x\")", TypeMismatch),
        ("sequence by nope [a] [a]", UnknownField),
    ],
)
def test_names_and_types(text, error):
    with pytest.raises(error):
        resolve(parse(text), schema())


def test_functions_that_do_not_exist():
    with pytest.raises(UnknownFunction):
        parse("a where nope(x)")
    with pytest.raises(TypeMismatch):
        resolve(parse("a where contains(s)"), schema())


def test_aliases():
    assert resolve(parse("1 where n == 1"), schema()).steps[0].event_type == "a"
    assert host_schema().event_type("exec") == "process_exec" and host_schema().lookup("20").path == "file.path"


def test_rules_that_can_not_be():
    with pytest.raises(InvalidRule):
        ir.Rule(()).validate()
    with pytest.raises(InvalidRule):
        ir.Rule((ir.Step("a"), ir.Step("b"))).validate()
    with pytest.raises(InvalidRule):
        ir.Rule((ir.Step("a"),), captures=(ir.Capture("x"), ir.Capture("y.x"))).validate()
    with pytest.raises(InvalidRule):
        ir.from_condition({"type": "sometimes"})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab1.="()[]<>&|!+-*/% \n\twherandotsqucbyi,', max_size=40))
def test_any_text_is_a_rule_or_an_error(text):
    try:
        parse(text)
    except RuleError:
        pass
