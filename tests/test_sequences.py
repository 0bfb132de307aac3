from __future__ import annotations

import os
import random
from dataclasses import replace
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.operators.sequence import match_sequences
from emberline.operators.transition import UNTIL, advance
from emberline.plans import ir
from emberline.plans.errors import InvalidRule, RuleError
from emberline.plans.parser import parse
from emberline.schema import Schema
from emberline.streaming.sequences import first_decisions, sessions, stream_sequences, windowed_counts

MS = 1_000_000
DDL = "event_id long, event_type string, ts_mono_ns long, entity_key string, exe string, pid long"


def schema() -> Schema:
    s = Schema().add_field("exe", "string").add_field("pid", "i64")
    for t in [*"ABCDEU", *map(str, range(1, 8))]:
        s.add_type(t)
    return s


def frame(spark, rows):
    """rows: (type, ms, entity) or (type, ms, entity, exe, pid)."""
    full = [(i + 1, r[0], None if r[1] is None else r[1] * MS, r[2], *(r[3:] or (None, None))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DDL)


def run(spark, text, rows, **how):
    m = match_sequences(frame(spark, rows), [parse(text)], schema(), **how)
    return sorted((r["key"], r["ts"] // MS, list(r["event_ids"])) for r in m.collect())


CASES = {
    "three steps": ("sequence [A] [B] [C] with maxspan=10s", [("A", 0, "1"), ("B", 500, "1"), ("C", 1000, "1")], [("1", 1000, [1, 2, 3])]),
    "five of a type": ("sequence [A] [A] [A] [A] [A] with maxspan=60s", [("A", 5000 * i, "1") for i in range(5)], [("1", 20000, [1, 2, 3, 4, 5])]),
    "too late": ("sequence [A] [B] with maxspan=5s", [("A", 0, "1"), ("B", 10_000, "1")], []),
    "just in time": ("sequence [A] [B] with maxspan=5s", [("A", 0, "1"), ("B", 5000, "1")], [("1", 5000, [1, 2])]),
    "a millisecond late": ("sequence [A] [B] with maxspan=100ms", [("A", 0, "1"), ("B", 101, "1")], []),
    "entities apart": ("sequence [A] [B] with maxspan=10s", [("A", 0, "1"), ("A", 1, "2"), ("B", 2, "1"), ("B", 3, "2")], [("1", 2, [1, 3]), ("2", 3, [2, 4])]),
    "no span": ("sequence [A] [B]", [("A", 0, "1"), ("B", 10**9, "1")], [("1", 10**9, [1, 2])]),
    "one step": ("sequence [A]", [("A", i, str(i)) for i in range(5)], [(str(i), i, [i + 1]) for i in range(5)]),
    "strangers between": ("sequence [A] [B]", [("A", 0, "1"), ("C", 1, "1"), ("D", 2, "1"), ("B", 3, "1")], [("1", 3, [1, 4])]),
    "a first step again keeps the first": ("sequence [A] [B]", [("A", 0, "1"), ("A", 5, "1"), ("B", 9, "1")], [("1", 9, [1, 3])]),
    "until ends it": ("sequence [A] [B] until [U]", [("A", 0, "1"), ("U", 1, "1"), ("B", 2, "1")], []),
    "until then again": ("sequence [A] [B] until [U]", [("A", 0, "1"), ("U", 1, "1"), ("A", 2, "1"), ("B", 3, "1")], [("1", 3, [3, 4])]),
    "until goes before a step": ("sequence [A] [B] until [B]", [("A", 0, "1"), ("B", 1, "1")], []),
    "twice": ("sequence [A] [B]", [("A", 0, "1"), ("B", 1, "1"), ("A", 2, "1"), ("B", 3, "1"), ("B", 4, "1")], [("1", 1, [1, 2]), ("1", 3, [3, 4])]),
    "what comes late starts nothing": ("sequence [A] [A] with maxspan=5ms", [("A", 0, "1"), ("A", 10, "1"), ("A", 12, "1")], []),
    "out of order": ("sequence [A] [B]", [("B", 5, "1"), ("A", 0, "1")], [("1", 5, [2, 1])]),
    "equal times by id": ("sequence [A] [B]", [("A", 5, "1"), ("B", 5, "1")], [("1", 5, [1, 2])]),
    "null key and null time": ("sequence [A] [B]", [("A", 0, None), ("B", 1, None), ("A", None, "1"), ("B", 1, "1")], []),
    "null type": ("sequence [A] [B]", [("A", 0, "1"), (None, 1, "1"), ("B", 2, "1")], [("1", 2, [1, 3])]),
    "conditions": ('sequence [A where exe == "x"] [B where pid > 5]', [("A", 0, "1", "y", 1), ("A", 1, "1", "x", 1), ("B", 2, "1", None, 5), ("B", 3, "1", None, 6)], [("1", 3, [2, 4])]),
    "missing under not": ('sequence [A where not exe == "x"] [B]', [("A", 0, "1", None, 1), ("B", 1, "1", None, 1)], [("1", 1, [1, 2])]),
    "by a field": ("sequence by pid [A] [B]", [("A", 0, "1", None, 7), ("B", 1, "2", None, 7), ("B", 2, "1", None, 8)], [("7", 1, [1, 2])]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    text, rows, want = CASES[name]
    assert run(spark, text, rows) == want


def test_sticky_completes_again(spark):
    rows = [("A", 0, "1"), ("B", 1, "1"), ("B", 2, "1")]
    assert run(spark, "sequence [A] [B]", rows, sticky=True) == [("1", 1, [1, 2]), ("1", 2, [1, 3])]


def test_captures(spark):
    rule = replace(parse("sequence [1] [2] with maxspan=5s"), captures=(ir.Capture("exe", "program", 0), ir.Capture("pid", step=1), ir.Capture("exe", "last")))
    m = match_sequences(frame(spark, [("1", 0, "k", "/bin/a", 1), ("2", 1, "k", "/bin/b", 2)]), [rule], schema()).collect()
    assert [r["captures"] for r in m] == [{"program": "/bin/a", "pid": "2", "last": "/bin/b"}]


def test_many_rules_interleaved(spark):
    rules = [parse("sequence [1] [2] with maxspan=5s").named("x"), parse("sequence [3] [4] with maxspan=5s").named("y")]
    m = match_sequences(frame(spark, [("1", 0, "k"), ("3", 1, "k"), ("2", 2, "k"), ("4", 3, "k")]), rules, schema())
    assert sorted((r["rule_id"], r["ts"] // MS) for r in m.collect()) == [("x", 2), ("y", 3)]


def test_limits(spark):
    with pytest.raises(InvalidRule):
        match_sequences(frame(spark, []), [parse("sequence " + " ".join(f"[A where pid == {i}]" for i in range(63)))], schema())
    with pytest.raises(InvalidRule):
        match_sequences(frame(spark, []), [parse("sequence [A]").named(str(i)) for i in range(1001)], schema())
    assert run(spark, "sequence [A] [B]", []) == []
    assert match_sequences(frame(spark, []), [], schema()).columns == ["rule_id", "key", "first_ts", "ts", "event_ids", "captures"]


def test_counted_steps(spark):
    rows = [("A", i, "1") for i in range(4)] + [("B", 9, "1")] + [("A", i, "2") for i in range(3)] + [("B", 9, "2")]
    assert run(spark, "sequence [A] with count > 3 [B]", rows) == [("1", 9, [1, 2, 3, 4, 5])]
    assert run(spark, "sequence [A] with count >= 3 [B] with maxspan=20ms", rows) == [("1", 9, [1, 2, 3, 5]), ("2", 9, [6, 7, 8, 9])]
    assert run(spark, "sequence [A] [A] with count >= 2", rows) == [("1", 2, [1, 2, 3]), ("2", 2, [6, 7, 8])]
    assert run(spark, "sequence [A] with count > 39", [("A", i, "1") for i in range(100)]) == [("1", 39, list(range(1, 41))), ("1", 79, list(range(41, 81)))]
    rule = replace(parse("sequence [A] with count > 2 [B]"), captures=(ir.Capture("pid", "a", 0), ir.Capture("pid", "b", 1)))
    m = match_sequences(frame(spark, [("A", i, "1", "x", 10 + i) for i in range(3)] + [("B", 9, "1", "x", 99)]), [rule], schema()).first()
    assert m["captures"] == {"a": "12", "b": "99"}
    for wrong in ("sequence [A] with count", "sequence [A] with count > x", "sequence [A] with count >= 0", "sequence [A] until [B] with count > 2", "A with count > 3"):
        with pytest.raises(RuleError):
            parse(wrong)


def test_a_quota_of_events(spark):
    rows = [("A", 0, "1"), ("B", 1, "1"), ("A", 2, "1"), ("B", 3, "1"), ("C", 1, "2"), ("A", 2, "2"), ("C", 3, "2"), ("B", 4, "2")]
    assert run(spark, "sequence [A] [B]", rows, max_events_per_key=3) == [("1", 1, [1, 2]), ("2", 4, [6, 8])]
    assert run(spark, "sequence [A] [B]", rows, max_events_per_key=1) == []
    assert run(spark, "sequence [A]", rows, max_events_per_key=1) == [("1", 0, [1]), ("2", 2, [6])]


def test_one_step_is_a_filter(spark):
    rules = [parse("sequence [A where pid > 1]").named("a"), replace(parse("sequence by exe [B] until [B where pid == 5]").named("b"), captures=(ir.Capture("pid"),))]
    rows = [("A", 0, "1", "x", 1), ("A", 1, "1", "x", 2), ("A", 2, None, "x", 2), ("B", 3, "1", "x", 4), ("B", 4, "1", "x", 5), ("B", 5, "1", None, 4), ("A", None, "1", "x", 2)]
    m = match_sequences(frame(spark, rows), rules, schema())
    assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["rule_id"], r["key"], r["ts"] // MS, list(r["event_ids"]), r["captures"]) for r in m.collect()) == [("a", "1", 1, [2], None), ("b", "x", 3, [4], {"pid": "4"})]


def by_hand(rows, steps, span, until):
    """Matches of one key, event by event, from the words of the rule."""
    out, live = [], None
    for ts, i, kinds in sorted(rows):
        if until and until in kinds:
            live = None
        elif live is None:
            if steps[0] in kinds:
                live = [(ts, i)]
                if len(steps) == 1:
                    out.append([i])
                    live = None
        elif steps[len(live)] in kinds:
            if span is not None and ts - live[0][0] > span:
                live = None
            else:
                live.append((ts, i))
                if len(live) == len(steps):
                    out.append([x for _, x in live])
                    live = None
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("AB"), min_size=1, max_size=4), st.lists(st.tuples(st.integers(0, 30), st.sets(st.sampled_from("ABU"))), max_size=25), st.one_of(st.none(), st.integers(0, 20)))
def test_the_transition_is_the_rule(steps, events, span):
    rows = [(ts, i, kinds) for i, (ts, kinds) in enumerate(events)]
    live, got = None, []
    for ts, i, kinds in sorted(rows):
        mask = sum(1 << n for n, s in enumerate(steps) if s in kinds) | (UNTIL if "U" in kinds else 0)
        live, done = advance(live, tuple(1 << n for n in range(len(steps))), span, mask, ts, (i,))
        if done:
            got.append([e[0] for e in done])
    assert got == by_hand(rows, steps, span, "U")


def test_a_batch_is_one_scan_and_one_shuffle(spark, sf_dir):
    from emberline.queries import event_schema, events

    rules = [parse("sequence by user_id [signup] [purchase]").named("a"), parse("sequence by user_id [view] [click] [error]").named("b")]
    plan = match_sequences(events(spark, sf_dir), rules, event_schema())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def write_stream(spark, df, path):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def source(spark, rows, path):
    """Rows as a stream of several files, one to a batch; the last row, which moves the watermark past all others, comes last."""
    df = frame(spark, rows)
    last = df.where(F.col("event_id") == len(rows))
    for i, part in enumerate([*df.where(F.col("event_id") < len(rows)).randomSplit([1.0] * 4, seed=1), last]):
        part.coalesce(1).write.parquet(f"{path}/{i}")
        for file in Path(path, str(i)).glob("*.parquet"):  # a file source reads files in the order of their times
            os.utime(file, (1_700_000_000 + 10 * i,) * 2)
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    return raw.withColumn("time", F.timestamp_micros(F.expr("ts_mono_ns div 1000")))


def test_a_stream_in_any_order_gives_the_matches_of_a_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice("ABCU"), r.randrange(0, 60_000), str(r.randrange(4))) for _ in range(400)]
    rules = [parse("sequence [A] [B] [C] with maxspan=5s until [U]").named("x"), parse("sequence [B] [B]").named("y")]
    rows.append(("A", 10_000_000, "end"))  # moves the watermark past all others
    found = stream_sequences(source(spark, rows, f"{tmp_path}/in"), rules, schema(), F.col("time"), delay="2 hours")
    want = match_sequences(frame(spark, rows), rules, schema())
    as_set = lambda df: sorted((x["rule_id"], x["key"], x["first_ts"], x["ts"], tuple(x["event_ids"])) for x in df.collect())
    assert as_set(write_stream(spark, found, tmp_path)) == as_set(want)
    assert want.count() > 30


def test_a_stream_of_several_keys(spark, tmp_path):
    rows = [("A", 1, "1", "x", 1), ("A", 2, "2", "y", 1), ("B", 3, "2", "x", 1), ("A", 10_000_000, "end", "end", 1)]
    rules = [parse("sequence [A] [B]").named("a"), parse("sequence by exe [A] [B]").named("b")]
    found = stream_sequences(source(spark, rows, f"{tmp_path}/in"), rules, schema(), F.col("time"), delay="2 hours")
    assert sorted((r["rule_id"], r["key"], list(r["event_ids"])) for r in write_stream(spark, found, tmp_path).collect()) == [("a", "2", [2, 3]), ("b", "x", [1, 3])]


def test_keys_of_a_stream_share_states(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ABU"), r.randrange(0, 60_000), f"e{r.randrange(300)}", f"x{r.randrange(200)}", r.randrange(9)) for _ in range(3000)]
    rows.append(("A", 10_000_000, "end", "end", 1))
    rules = [
        replace(parse("sequence [A] [B] with maxspan=20s until [U where pid > 3]").named("a"), captures=(ir.Capture("exe", "first", 0), ir.Capture("pid", "last"))),
        parse("sequence [B] [A] [A]").named("b"),
        parse("sequence by exe [A] [B] with maxspan=30s").named("c"),
    ]
    odd = F.when(F.col("event_id") % 50 != 0, F.col("event_id") + (1 << 60))  # beyond what a double holds, and some null
    found = stream_sequences(source(spark, rows, f"{tmp_path}/in").withColumn("event_id", odd), rules, schema(), F.col("time"), delay="2 hours", buckets=8)
    q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert 2 < max(states) <= 2 * 8
    want = match_sequences(frame(spark, rows).withColumn("event_id", odd), rules, schema())
    as_set = lambda df: sorted((x["rule_id"], x["key"], x["first_ts"], x["ts"], str(x["event_ids"]), str(x["captures"])) for x in df.collect())
    got = as_set(spark.read.schema(found.schema).parquet(f"{tmp_path}/out"))
    assert got == as_set(want)
    assert {x[0] for x in got} == {"a", "b", "c"} and any("None" in x[4] for x in got)


def test_windows_sessions_and_first_decisions_of_streams(spark, tmp_path):
    rows = [("A", t, "1") for t in (0, 1000, 61_000, 200_000)] + [("A", 10_000_000, "end")]
    counts = write_stream(spark, windowed_counts(source(spark, rows, f"{tmp_path}/a"), delay="1 hour"), f"{tmp_path}/aa")
    assert sorted(r["n_events"] for r in counts.where("start < timestamp '1970-01-01 01:00:00'").collect()) == [1, 1, 2]
    found = write_stream(spark, sessions(source(spark, rows, f"{tmp_path}/b"), gap="100 seconds", delay="1 hour"), f"{tmp_path}/bb")
    assert sorted(r["n_events"] for r in found.where("entity_key = '1'").collect()) == [1, 3]
    first = write_stream(spark, first_decisions(source(spark, rows, f"{tmp_path}/c"), ["entity_key"], ttl="3 hours"), f"{tmp_path}/cc")
    assert sorted(r["entity_key"] for r in first.collect()) == ["1", "end"]
