from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from emberline.engine import Engine, inconsistencies
from emberline.functions import interpreter
from emberline.functions.predicates import Compiler, check_regex, glob_to_regex
from emberline.plans.errors import InvalidRule
from emberline.plans.parser import parse, parse_expression
from emberline.schema import Schema

SCHEMA = Schema().add_type("e").add_field("a", "i64").add_field("b", "i64").add_field("f", "f64").add_field("s", "string").add_field("t", "string").add_field("ok", "bool").add_field("arr", "i64", is_array=True)
DDL = "a long, b long, f double, s string, t string, ok boolean, arr array<long>"
ROWS = [
    (1, 2, 0.5, "Bash", "bash", True, [1, 2]),
    (None, 2, None, None, "x", None, None),
    (5, 0, -1.0, "a/b.TXT", "", False, []),
    (2**62, 2**62, 1e300, "line\nbreak", "line", True, [None, 3]),
    (-7, 3, 2.0, "ab", "b", None, [-1]),
]
TEXTS = [
    "a == 1", "a != 1", "not a == 1", "a == null", "a != null", "not a != null", "a < b", "a <= b or ok == true", "a + b > 2", "a * b > 0", "a / b == 2", "a / b == 0", "a % b == 1", "a - b - 1 == 4",
    "f > 0", "f / 2 == 1", "-a == 7", "a in (1, 5)", "not a in (1, 5)", 's in ("ab", "Bash")', "ok == true", "ok == false", "ok != true", 'contains(s, "a")', 'startsWith(s, t)', "endsWith(s, t)",
    "stringEqualsCi(s, t)", 'regex("^[aB].*", s)', 'wildcard("a*.TXT", s)', 'wildcard("*break", s)', 'wildcard("[!a]*", s)', 'wildcard("?b", s)', 'not contains(s, "a")', "any(arr == 1)", "all(arr > 0)", "any(arr < 0)",
    "not any(arr == 1)", "a + b * 2 > 10", "(a == 1 or b == 2) and not ok == false", "a == b", "s == t", 's > "a"',
]


def test_columns_agree_with_the_interpreter(spark):
    df = spark.createDataFrame(ROWS, DDL)
    exprs = [parse_expression(t) for t in TEXTS]
    compiler = Compiler(SCHEMA)
    got = df.select(*(compiler.condition(e).alias(f"c{i}") for i, e in enumerate(exprs))).collect()
    names = [x.split()[0] for x in DDL.split(", ")]
    kept = [df.where(compiler.filter(e)).count() for e in exprs]
    assert kept == [sum(r[i] for r in got) for i in range(len(exprs))]
    for row, values in zip(got, ROWS):
        record = dict(zip(names, values))
        for i, e in enumerate(exprs):
            assert row[i] == interpreter.condition(e, record), (TEXTS[i], values)
            assert row[i] is not None


def test_missing_values(spark):
    df = spark.createDataFrame([(None, None)], "a long, s string")
    schema = Schema().add_type("e").add_field("a", "i64").add_field("s", "string")
    for text, null, default in (("a < 5", False, True), ('s == ""', False, True), ("not a > 5", True, True), ("a == null", True, True)):
        assert df.select(Compiler(schema).condition(parse_expression(text))).first()[0] is null
        assert df.select(Compiler(schema, "defaults").condition(parse_expression(text))).first()[0] is default


def test_overflow_and_division_by_zero_abort_nothing(spark):
    df = spark.createDataFrame([(2**63 - 1, 0)], "a long, b long")
    for text in ("a + 1 > 0", "a * 2 > 0", "a / b == 1", "a % b == 1", "0 - a - 5 < 0"):
        assert df.select(Compiler(SCHEMA).condition(parse_expression(text))).first()[0] is False


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("*.exe", ["a.exe", "/b/c.exe", "x\ny.exe"], ["a.exe2", "aexe"]), ("a?c", ["abc", "a/c"], ["ac", "abbc"]), ("[a-c]x", ["ax", "cx"], ["dx"]), ("[!a]x", ["bx"], ["ax"]), ("a+b(c)", ["a+b(c)"], ["aab(c)"]), ("", [""], ["a"])],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "s string")
    assert [r[0] for r in df.select(F.col("s").rlike(glob_to_regex(glob))).collect()] == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("pattern", ["(?=x)", r"(a)\1", "(", "(?<!x)y"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(InvalidRule):
        check_regex(pattern)


def test_filters_reach_the_scan(spark, sf_dir):
    from emberline.operators.events import filter_events
    from emberline.queries import event_schema, table

    df = table(spark, sf_dir, "events").withColumn("ts_mono_ns", F.lit(0))
    schema = Schema().add_type("purchase").add_field("value", "f64")
    plan = filter_events(df, parse("purchase where value > 90"), schema).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "GreaterThan(value,90" in plan
    assert "props" not in plan.split("ReadSchema")[1] and event_schema().types
    assert "ArrowEval" not in plan and "Python" not in plan


def test_both_evaluations_of_an_engine_agree(spark, sf_dir):
    from emberline.queries import event_schema, events

    rules = [parse(t).named(t) for t in ("click where k > 5 and not value < 3", 'view where contains(props, "7") or k in (1, 2)', "error where k / 2 == 3 or value == null")]
    df = events(spark, sf_dir).select("event_id", "event_type", "k", "value", "props")
    assert inconsistencies(df, rules, event_schema()).count() == 0


def test_a_script_that_fails_matches_nothing(spark):
    e = Engine(SCHEMA)
    df = spark.createDataFrame(ROWS, DDL)
    e.add_script("big", lambda pdf: pdf["a"] > 3)
    e.add_script("broken", lambda pdf: pdf["nope"] > 3)
    assert sorted(r["a"] for r in e.run_scripts(df, "big").collect()) == [5, 2**62]
    assert e.run_scripts(df, "broken").count() == 0


def test_truth_tables(spark):
    df = spark.createDataFrame(list(itertools.product([1, 2, None], [1, 2, None])), "a long, b long")
    c = Compiler(SCHEMA)
    rows = df.select("a", "b", c.condition(parse_expression("a == 1 and not b == 1")).alias("x"), c.condition(parse_expression("not (a == 1 or b == 1)")).alias("y")).collect()
    for r in rows:
        assert r["x"] == (r["a"] == 1 and r["b"] != 1) and r["y"] == (r["a"] != 1 and r["b"] != 1)
