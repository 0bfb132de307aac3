"""Queries over the driver's tables, one or more for each operator, and DuckDB SQL that must give the same rows.

``events`` are the event stream: the entity is ``user_id``, the time ``ts`` in nanoseconds, and ``k`` comes from ``props``. For the
behavioural detectors the same rows are dressed up as host events, by CASE expressions that both engines read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import packs
from emberline.engine import Engine
from emberline.functions.predicates import Compiler
from emberline.operators import alerts as A
from emberline.operators import behaviors as B
from emberline.operators import decisions as D
from emberline.operators import metrics as M
from emberline.operators.events import filter_events, match_events
from emberline.operators.patterns import Pattern, match_patterns
from emberline.operators.sequence import match_sequences, sequence_statistics
from emberline.plans import analyzer, ir
from emberline.plans.parser import parse, parse_expression
from emberline.schema import Schema, schema_of
from emberline.sources import generate, normalize, replay
from emberline.streaming.sequences import sessions, stream_sequences, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with canonical columns beside their own."""
    ns = F.expr("unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone())) * 1000")
    return table(spark, sf_dir, "events").select("event_id", "event_type", ns.alias("ts_mono_ns"), F.col("user_id").cast("string").alias("entity_key"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


E_SQL = """e AS (SELECT event_id, event_type, epoch_us(ts) * 1000 AS ts, user_id, value, props,
             CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def event_schema(open_fields: bool = False) -> Schema:
    s = Schema(open_fields=open_fields)
    for t in TYPES:
        s.add_type(t)
    return s.add_field("user_id", "i64").add_field("value", "f64").add_field("k", "i64").add_field("props", "string").add_field("entity_key", "string")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# event rules


def event_query(name: str, text: str, sql_where: str, columns: tuple[str, ...] = ("event_id", "event_type", "user_id", "value")) -> None:
    rule = parse(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filter_events(events(spark, sf_dir), rule, event_schema()).select(*columns)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {E_SQL} SELECT {', '.join(columns)} FROM e WHERE {sql_where}"


event_query("event_filter", "purchase where value > 100", "event_type = 'purchase' AND value > 100")
event_query("event_type_only", "signup", "event_type = 'signup'")
event_query("event_filter_eq", "click where k == 7", "event_type = 'click' AND k = 7")
event_query("event_cmp_all", "view where k >= 10 and k <= 90 and value > 5 and value < 80 and k != 50 and user_id == 42 or k == 3", "event_type = 'view' AND ((k >= 10 AND k <= 90 AND value > 5 AND value < 80 AND k <> 50 AND user_id = 42) OR k = 3)")
event_query("event_and_or_not", "error where not (k > 20 && value < 50) || user_id < 10", "event_type = 'error' AND (NOT coalesce(k > 20 AND value < 50, false) OR user_id < 10)")
event_query("event_in_list", "purchase where k in (1, 2, 3, 5, 8, 13, 21)", "event_type = 'purchase' AND k IN (1, 2, 3, 5, 8, 13, 21)")
event_query("event_arith_flat", "click where k + 2 * 3 > 150 and k - 1 / 2 < 60", "event_type = 'click' AND (k + 2) * 3 > 150 AND (k - 1) // 2 < 60")
event_query("event_mod", "view where user_id % 7 == 3", "event_type = 'view' AND user_id % 7 = 3")
event_query("event_div_zero", "view where user_id / (k - k) == 1 or k == 4", "event_type = 'view' AND k = 4")
event_query("event_negative", "click where -k < -90", "event_type = 'click' AND -k < -90")
event_query("event_null_eq", "purchase where value == null or k == 11", "event_type = 'purchase' AND (value IS NULL OR k = 11)")
event_query("event_null_ne", "purchase where value != null and not value < 50", "event_type = 'purchase' AND value IS NOT NULL AND value >= 50")
event_query("fn_contains", 'click where contains(props, "7")', "event_type = 'click' AND contains(props, '7')")
event_query("fn_contains_infix", 'click where props contains "42"', "event_type = 'click' AND contains(props, '42')")
event_query("fn_startswith", 'view where startsWith(entity_key, "12")', "event_type = 'view' AND starts_with(CAST(user_id AS VARCHAR), '12')")
event_query("fn_endswith", 'view where endsWith(entity_key, "5")', "event_type = 'view' AND ends_with(CAST(user_id AS VARCHAR), '5')")
event_query("fn_equals_ci", 'error where stringEqualsCi(props, "{\\"K\\": 5}")', "event_type = 'error' AND lower(props) = '{\"k\": 5}'")
event_query("fn_regex", 'error where regex("[13579]}$", props)', "event_type = 'error' AND regexp_matches(props, '[13579]}$')")
event_query("fn_regex_infix", 'error where props regex~ ": *[1-3][0-9]}"', "event_type = 'error' AND regexp_matches(props, ': *[1-3][0-9]}')")
event_query("fn_wildcard", 'purchase where wildcard("*[0-4]}", props)', "event_type = 'purchase' AND props GLOB '*[0-4]}'")


@query("missing_defaults", f"WITH {E_SQL} SELECT event_id FROM e WHERE event_type = 'view' AND coalesce(CASE WHEN k > 50 THEN k END, 0) < 60")
def _defaults(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("k", F.when(F.col("k") > 50, F.col("k")))
    return filter_events(df, parse("view where k < 60"), event_schema(), missing="defaults").select("event_id")


@query("unknown_field_open", f"WITH {E_SQL} SELECT event_id FROM e WHERE event_type = 'signup'")
def _open(spark, sf_dir):
    return filter_events(events(spark, sf_dir), parse("signup where not_there == null"), event_schema(True)).select("event_id")


@query("capture_projection", f"WITH {E_SQL} SELECT event_id, CAST(user_id AS VARCHAR) AS who, CAST(k AS VARCHAR) AS k FROM e WHERE event_type = 'purchase' AND k > 50")
def _captures(spark, sf_dir):
    rule = replace(parse("purchase where k > 50"), captures=(ir.Capture("user_id", "who"), ir.Capture("k")))
    m = match_events(events(spark, sf_dir), [rule], event_schema())
    return m.select("event_id", F.col("captures")["who"].alias("who"), F.col("captures")["k"].alias("k"))


@query("condition_json", f"WITH {E_SQL} SELECT event_id FROM e WHERE event_type = 'click' AND (k = 9 OR regexp_matches(props, '1}}$')) AND NOT contains(props, '21')")
def _condition(spark, sf_dir):
    cond = ir.from_condition(
        {
            "type": "and",
            "conditions": [
                {"type": "or", "conditions": [{"type": "field_eq", "field": "k", "value": 9}, {"type": "field_regex", "field": "props", "pattern": "1}$"}]},
                {"type": "not", "condition": {"type": "field_contains", "field": "props", "value": "21"}},
            ],
        }
    )
    return filter_events(events(spark, sf_dir), ir.Rule((ir.Step("click", cond),)), event_schema()).select("event_id")


_SINGLE = {
    "big_purchase": ("purchase where value > 80", "critical", "event_type = 'purchase' AND value > 80"),
    "any_purchase": ("purchase", "low", "event_type = 'purchase'"),
    "odd_error": ("error where k % 2 == 1", "high", "event_type = 'error' AND k % 2 = 1"),
    "small_k": ("click where k < 5", "medium", "event_type = 'click' AND k < 5"),
}


def _single_rules() -> list[ir.Rule]:
    return [parse(t).named(n, severity=s) for n, (t, s, _) in _SINGLE.items()]


_SINGLE_SQL = "m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, '{s}' AS severity, event_id, user_id, ts FROM e WHERE {w}" for n, (_, s, w) in _SINGLE.items()) + ")"


@query("event_multi_rule", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT rule_id, event_id, CAST(user_id AS VARCHAR) AS key, ts FROM m")
def _multi(spark, sf_dir):
    return match_events(events(spark, sf_dir), _single_rules(), event_schema()).select("rule_id", "event_id", "key", "ts")


_MANY_RULES = [(f"r{i}", f"{TYPES[i % 5]} where k == {i // 5 * 3} and value > {i % 7 * 10}", f"event_type = '{TYPES[i % 5]}' AND k = {i // 5 * 3} AND value > {i % 7 * 10}") for i in range(200)]


@query("event_200_rules", f"WITH {E_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, event_id FROM e WHERE {w}" for n, _, w in _MANY_RULES))
def _many_rules(spark, sf_dir):
    return match_events(events(spark, sf_dir), [parse(t).named(n) for n, t, _ in _MANY_RULES], event_schema()).select("rule_id", "event_id")


@query("type_union", f"WITH {E_SQL} SELECT event_id, event_type FROM e WHERE event_type = 'signup' UNION ALL SELECT event_id, event_type FROM e WHERE event_type = 'error' AND k > 80")
def _union(spark, sf_dir):
    rules = [parse("signup").named("a"), parse("error where k > 80").named("b")]
    df = events(spark, sf_dir)
    return filter_events(df, rules[0], event_schema()).select("event_id", "event_type").unionByName(filter_events(df, rules[1], event_schema()).select("event_id", "event_type"))


@query("interest_prefilter", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT DISTINCT event_id FROM m")
def _prefilter(spark, sf_dir):
    return normalize.interesting(events(spark, sf_dir), _single_rules(), event_schema()).select("event_id")


# arrays


@query("quant_any", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: w = 'the')) > 0 OR len(list_filter(string_split(text, ' '), lambda w: w = 'der')) > 0")
def _any(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    e = parse_expression('any(words == "the") or any(words == "der")')
    return df.where(Compiler(schema_of(df, ())).condition(e)).select("doc_id")


@query("quant_all", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) < 0.3)) = len(embedding)")
def _all(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rule = ir.Quantifier("all", ir.Field("embedding"), "<", ir.Literal(0.3))
    return df.where(Compiler(schema_of(df, ())).condition(rule)).select("vec_id")


# patterns

_PATTERNS = (Pattern(0, "tion", "contains", "text"), Pattern(1, "The", "starts_with", "text"), Pattern(2, "e.", "ends_with", "text"), Pattern(3, "src3", "equals", "source"), Pattern(4, "%%%", "contains", "text"), Pattern(5, "de la", "contains", "text"), Pattern(6, "ti", "contains", "text"))
_PATTERN_SQL = {
    "contains": ("contains({f}, '{t}')", "strpos({f}, '{t}') - 1"),
    "starts_with": ("starts_with({f}, '{t}')", "0"),
    "ends_with": ("ends_with({f}, '{t}')", "length({f}) - {n}"),
    "equals": ("{f} = '{t}'", "0"),
}


@query(
    "pattern_multi_match",
    " UNION ALL ".join(
        "SELECT doc_id, {i} AS pattern_id, CAST({start} AS INTEGER) AS start_pos, CAST({start} + {n} AS INTEGER) AS end_pos FROM documents WHERE {test}".format(
            i=p.pattern_id, n=len(p.text), test=_PATTERN_SQL[p.kind][0].format(f=p.field, t=p.text, n=len(p.text)), start=_PATTERN_SQL[p.kind][1].format(f=p.field, t=p.text, n=len(p.text))
        )
        for p in _PATTERNS
    ),
)
def _patterns(spark, sf_dir):
    return match_patterns(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _PATTERNS).select("doc_id", "pattern_id", "start_pos", "end_pos")


_SYLLABLES = ("tion", "er", "the", "an", "ha", "st", "ou", "in", "re", "ble")
_MANY_PATTERNS = tuple(Pattern(i, "".join(_SYLLABLES[int(d)] for d in f"{i:03d}"), ("contains", "starts_with", "ends_with")[i % 3], "text") for i in range(1000))


@query(
    "pattern_1000",
    "WITH p AS (SELECT i AS pattern_id, list_aggregate(list_transform([i // 100, i // 10 % 10, i % 10], lambda d: " + str(list(_SYLLABLES)) + "[d + 1]), 'string_agg', '') AS t, i % 3 AS kind FROM range(1000) r(i)) "
    "SELECT doc_id, CAST(pattern_id AS INTEGER) AS pattern_id, CAST(CASE kind WHEN 0 THEN strpos(text, t) - 1 WHEN 1 THEN 0 ELSE length(text) - length(t) END AS INTEGER) AS start_pos FROM documents, p "
    "WHERE CASE kind WHEN 0 THEN contains(text, t) WHEN 1 THEN starts_with(text, t) ELSE ends_with(text, t) END",
)
def _thousand(spark, sf_dir):
    return match_patterns(table(spark, sf_dir, "documents").select("doc_id", "text"), _MANY_PATTERNS).select("doc_id", "pattern_id", "start_pos")


# sequences


def _sequence_sql(rule_id: str, steps: list[str], span_ms: int | None = None, until: str | None = None, by: str = "user_id", sticky: bool = False, source: str = "e", most: int | None = None) -> tuple[str, str]:
    """CTEs that run the transition row by row, and a SELECT of its matches."""
    n = len(steps)
    bits = " + ".join([f"CASE WHEN {s} THEN {1 << i} ELSE 0 END" for i, s in enumerate(steps)] + ([f"CASE WHEN {until} THEN {1 << 30} ELSE 0 END"] if until else []))
    late = f"r.ts - s.t0 > {span_ms * 1_000_000}" if span_ms is not None else "FALSE"
    hit = "((r.m // CAST(pow(2, s.st) AS BIGINT)) % 2 = 1)"
    stop = f"r.m >= {1 << 30}"
    q = rule_id
    start = f"s.st = 0 AND r.m % 2 = 1 AND NOT {stop}"
    done = f"NOT ({stop}) AND ((s.st = 0 AND {n} = 1 AND r.m % 2 = 1) OR (s.st = {n - 1} AND s.st > 0 AND {hit} AND NOT ({late})))"
    after = f"{n - 1}" if sticky and n > 1 else "0"
    ctes = f"""{q}_r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM
            (SELECT CAST({by} AS VARCHAR) AS key, ts, event_id, {bits} AS m FROM {source} WHERE {by} IS NOT NULL) WHERE m > 0),
        {q}_s AS (SELECT key, CAST(0 AS BIGINT) AS n, 0 AS st, CAST(0 AS BIGINT) AS t0, '' AS ids, CAST(NULL AS VARCHAR) AS found, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS b
            FROM (SELECT DISTINCT key FROM {q}_r)
            UNION ALL SELECT r.key, r.n,
                CASE WHEN {stop} THEN 0 WHEN {start} THEN {0 if n == 1 else 1} WHEN s.st = 0 THEN 0 WHEN NOT {hit} THEN s.st
                     WHEN {late} THEN 0 WHEN s.st = {n - 1} THEN {after} ELSE s.st + 1 END,
                CASE WHEN {start} THEN r.ts ELSE s.t0 END,
                CASE WHEN {start} THEN CAST(r.event_id AS VARCHAR) WHEN s.st > 0 AND s.st < {n - 1} AND {hit} THEN s.ids || ',' || r.event_id ELSE s.ids END,
                CASE WHEN {done} THEN CASE WHEN s.st = 0 THEN CAST(r.event_id AS VARCHAR) ELSE s.ids || ',' || r.event_id END END,
                r.ts, CASE WHEN {start} THEN r.ts ELSE s.t0 END
            FROM {q}_s s JOIN {q}_r r ON r.key = s.key AND r.n = s.n + 1{f" AND r.n <= {most}" if most else ""})"""
    return ctes, f"SELECT '{q}' AS rule_id, key, b AS first_ts, ts, found AS event_ids FROM {q}_s WHERE found IS NOT NULL"


def _flat(m: DataFrame) -> DataFrame:
    return m.select("rule_id", "key", "first_ts", "ts", F.concat_ws(",", "event_ids").alias("event_ids"))


def _t(name: str, more: str = "") -> str:
    return f"event_type = '{name}'" + (f" AND {more}" if more else "")


_SEQUENCES: dict[str, tuple[str, dict]] = {
    "seq_two_step": ("sequence by user_id [signup] [purchase] with maxspan=24h", {"steps": [_t("signup"), _t("purchase")], "span_ms": 86_400_000}),
    "seq_three_step": ("sequence by user_id [view] [click where k > 20] [purchase where value > 10] with maxspan=48h", {"steps": [_t("view"), _t("click", "k > 20"), _t("purchase", "value > 10")], "span_ms": 172_800_000}),
    "seq_same_type_x5": ("sequence by user_id [view] [view] [view] [view] [view] with maxspan=100h", {"steps": [_t("view")] * 5, "span_ms": 360_000_000}),
    "seq_no_span": ("sequence by user_id [error] [purchase]", {"steps": [_t("error"), _t("purchase")]}),
    "seq_until": ("sequence by user_id [view] [purchase] with maxspan=72h until [error where k < 60]", {"steps": [_t("view"), _t("purchase")], "span_ms": 259_200_000, "until": _t("error", "k < 60")}),
    "seq_until_of_step_type": ("sequence by user_id [click] [purchase] until [purchase where k > 50]", {"steps": [_t("click"), _t("purchase")], "until": _t("purchase", "k > 50")}),
    "seq_single_step": ("sequence by user_id [signup where k > 30]", {"steps": [_t("signup", "k > 30")]}),
    "seq_other_key": ("sequence by k [signup] [purchase] with maxspan=12h", {"steps": [_t("signup"), _t("purchase")], "span_ms": 43_200_000, "by": "k"}),
}


def _sequence_query(name: str) -> None:
    text, spec = _SEQUENCES[name]
    rule = parse(text).named(name)
    ctes, select = _sequence_sql(name, **spec)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(match_sequences(events(spark, sf_dir), [rule], event_schema()))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH RECURSIVE {E_SQL}, {ctes} {select}"


for _name in _SEQUENCES:
    _sequence_query(_name)


@query("seq_multi_rule", "WITH RECURSIVE " + E_SQL + ", " + ", ".join(_sequence_sql(n, **_SEQUENCES[n][1])[0] for n in _SEQUENCES) + " " + " UNION ALL ".join(_sequence_sql(n, **_SEQUENCES[n][1])[1] for n in _SEQUENCES))
def _all_sequences(spark, sf_dir):
    return _flat(match_sequences(events(spark, sf_dir), [parse(t).named(n) for n, (t, _) in _SEQUENCES.items()], event_schema()))


_STICKY = _sequence_sql("seq_sticky", **_SEQUENCES["seq_two_step"][1], sticky=True)


@query("seq_sticky", f"WITH RECURSIVE {E_SQL}, {_STICKY[0]} {_STICKY[1]}")
def _sticky(spark, sf_dir):
    return _flat(match_sequences(events(spark, sf_dir), [parse(_SEQUENCES["seq_two_step"][0]).named("seq_sticky")], event_schema(), sticky=True))


_COUNTED = _sequence_sql("seq_counted", [_t("error", "k > 30")] * 4 + [_t("purchase")], 2_592_000_000)


@query("seq_counted", f"WITH RECURSIVE {E_SQL}, {_COUNTED[0]} {_COUNTED[1]}")
def _counted(spark, sf_dir):
    rule = parse("sequence by user_id [error where k > 30] with count > 3 [purchase] with maxspan=720h").named("seq_counted")
    return _flat(match_sequences(events(spark, sf_dir), [rule], event_schema()))


_QUOTA = _sequence_sql("seq_quota", **_SEQUENCES["seq_two_step"][1], most=5)


@query("seq_quota", f"WITH RECURSIVE {E_SQL}, {_QUOTA[0]} {_QUOTA[1]}")
def _quota(spark, sf_dir):
    return _flat(match_sequences(events(spark, sf_dir), [parse(_SEQUENCES["seq_two_step"][0]).named("seq_quota")], event_schema(), max_events_per_key=5))


_CAPTURED = _sequence_sql("seq_captures", **_SEQUENCES["seq_three_step"][1])


@query(
    "seq_captures",
    f"""WITH RECURSIVE {E_SQL}, {_CAPTURED[0]}, f AS ({_CAPTURED[1]})
        SELECT f.key, f.ts, CAST(a.k AS VARCHAR) AS first_k, CAST(b.k AS VARCHAR) AS click_k, CAST(c.k AS VARCHAR) AS k FROM f
        JOIN e a ON a.event_id = CAST(split_part(f.event_ids, ',', 1) AS BIGINT) JOIN e b ON b.event_id = CAST(split_part(f.event_ids, ',', 2) AS BIGINT)
        JOIN e c ON c.event_id = CAST(split_part(f.event_ids, ',', 3) AS BIGINT)""",
)
def _seq_captures(spark, sf_dir):
    rule = replace(parse(_SEQUENCES["seq_three_step"][0]).named("seq_captures"), captures=(ir.Capture("k", "first_k", 0), ir.Capture("k", "click_k", 1), ir.Capture("k")))
    m = match_sequences(events(spark, sf_dir), [rule], event_schema())
    return m.select("key", "ts", *(F.col("captures")[c].alias(c) for c in ("first_k", "click_k", "k")))


#: what a stream over the given table has seen when it ends: the watermark, ten seconds behind the last event, in whole milliseconds
_MARK = "(SELECT max(ts) // 1000000 * 1000000 - 10000000000 FROM e{where})"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream, with the columns of ``events`` and ``time``."""
    folder = f"{sf_dir}/events.parquet"
    whole = _is_folder(spark, folder)
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet" if whole else "events.parquet").parquet(folder if whole else sf_dir)
    ns = F.expr("unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone())) * 1000")
    time = F.expr("from_utc_timestamp(cast(ts as timestamp), current_timezone())")
    return raw.select("event_id", "event_type", ns.alias("ts_mono_ns"), time.alias("time"), F.col("user_id").cast("string").alias("entity_key"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


def stream_folder(spark: SparkSession) -> str:
    """Where a stream keeps state and output: under ``spark.checkpoint.dir``; a temporary folder serves only a session on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="emberline-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_stream(found: DataFrame) -> DataFrame:
    """What a stream gives until its sources end."""
    at = stream_folder(found.sparkSession)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{at}/out")


_STREAMED = _sequence_sql("seq_two_step", **_SEQUENCES["seq_two_step"][1])


@query("stream_sequence", f"WITH RECURSIVE {E_SQL}, {_STREAMED[0]}, f AS ({_STREAMED[1]}) SELECT * FROM f WHERE ts <= " + _MARK.format(where=" WHERE event_type IN ('signup', 'purchase')"))
def _stream(spark, sf_dir):
    """The two-step sequence over the event files as a stream, run to their end; its rows are the batch's, but for events that the watermark hasn't passed yet."""
    return run_stream(_flat(stream_sequences(event_stream(spark, sf_dir), [parse(_SEQUENCES["seq_two_step"][0]).named("seq_two_step")], event_schema(), F.col("time"))))


_STREAM_KEYS = {n: _SEQUENCES[n] for n in ("seq_until", "seq_other_key")}


@query(
    "stream_several_keys",
    "WITH RECURSIVE " + E_SQL + ", " + ", ".join(_sequence_sql(n, **x)[0] for n, (_, x) in _STREAM_KEYS.items()) + ", f AS (" + " UNION ALL ".join(_sequence_sql(n, **x)[1] for n, (_, x) in _STREAM_KEYS.items()) + ") SELECT * FROM f WHERE ts <= " + _MARK.format(where=" WHERE event_type IN ('view', 'signup', 'purchase') OR event_type = 'error' AND k < 60"),
)
def _stream_keys(spark, sf_dir):
    rules = [parse(t).named(n) for n, (t, _) in _STREAM_KEYS.items()]
    return run_stream(_flat(stream_sequences(event_stream(spark, sf_dir), rules, event_schema(), F.col("time"))))


@query("stream_events", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT rule_id || '-' || ts AS alert_id, rule_id, severity, ts FROM m")
def _stream_events(spark, sf_dir):
    engine = Engine(event_schema())
    for rule in _single_rules():
        engine.add(rule)
    return run_stream(engine.stream(event_stream(spark, sf_dir), F.col("time")).select("alert_id", "rule_id", "severity", "ts"))


@query("stream_windows", f"WITH {E_SQL}, w AS (SELECT ts // 3600000000000 * 3600000000 AS start_us, event_type, count(*) AS n_events FROM e GROUP BY ALL) SELECT * FROM w WHERE (start_us + 3600000000) * 1000 <= " + _MARK.format(where=""))
def _stream_windows(spark, sf_dir):
    found = windowed_counts(event_stream(spark, sf_dir), window="1 hour")
    return run_stream(found.select(F.unix_micros("start").alias("start_us"), "event_type", "n_events"))


@query(
    "stream_sessions",
    f"""WITH {E_SQL}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000000 THEN 1 ELSE 0 END AS cut FROM e), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s),
        x AS (SELECT CAST(user_id AS VARCHAR) AS entity_key, min(ts) // 1000 AS start_us, max(ts) + 21600000000000 AS stop, count(*) AS n_events FROM g GROUP BY user_id, n)
        SELECT entity_key, start_us, n_events FROM x WHERE stop <= """ + _MARK.format(where=""),
)
def _stream_sessions(spark, sf_dir):
    found = sessions(event_stream(spark, sf_dir), gap="6 hours")
    return run_stream(found.select("entity_key", F.unix_micros("start").alias("start_us"), "n_events"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# windows of the scripted detectors, in general form


@query("roll_count_threshold", f"WITH {E_SQL}, c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS n FROM e WHERE event_type = 'click') SELECT event_id, user_id, n AS n_recent FROM c WHERE n >= 3")
def _rolling(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts_mono_ns").rangeBetween(-86_400_000_000_000, 0)
    clicks = events(spark, sf_dir).where("event_type = 'click'")
    return clicks.withColumn("n_recent", F.count(F.lit(1)).over(w)).where("n_recent >= 3").select("event_id", "user_id", "n_recent")


@query("cumulative_threshold", f"WITH {E_SQL}, c AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e) SELECT event_id, user_id, CAST(n AS BIGINT) AS n_errors FROM c WHERE n >= 5")
def _cumulative(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts_mono_ns", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("event_type") == "error").cast("long")).over(w)
    return events(spark, sf_dir).withColumn("n_errors", n).where("n_errors >= 5").select("event_id", "user_id", "n_errors")


@query("asof_last_event", f"WITH {E_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id FROM e WHERE event_type = 'view') SELECT p.event_id, v.event_id AS view_id FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.ts - v.ts <= 36000000000000")
def _asof(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts_mono_ns", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "view", F.struct("ts_mono_ns", "event_id")), ignorenulls=True).over(w)
    out = rows.withColumn("v", last).where("event_type = 'purchase' and ts_mono_ns - v.ts_mono_ns <= 36000000000000")
    return out.select("event_id", F.col("v.event_id").alias("view_id"))


# host events

HOST = {
    "event_type": "CASE event_id % 11 WHEN 0 THEN 'process_exec' WHEN 1 THEN 'file_write' WHEN 2 THEN 'file_rename' WHEN 3 THEN 'file_read' WHEN 4 THEN 'network_connect' WHEN 5 THEN 'service_start' WHEN 6 THEN 'authentication' WHEN 7 THEN 'file_create' WHEN 8 THEN 'process_exec' WHEN 9 THEN 'network_send' ELSE 'file_rename' END",
    "ppid": "1 + event_id % 40",
    "exe": "CASE (event_id * 7 + k) % 13 WHEN 0 THEN '/usr/bin/tar' WHEN 1 THEN '/usr/bin/mysqldump' WHEN 2 THEN '/usr/bin/curl' WHEN 3 THEN '/bin/bash' WHEN 4 THEN '/usr/bin/ssh' WHEN 5 THEN '/usr/bin/sudo' WHEN 6 THEN '/opt/john' WHEN 7 THEN '/usr/bin/LOGKEYS' WHEN 8 THEN '/usr/bin/ls' WHEN 9 THEN '/usr/bin/nmap' WHEN 10 THEN '/usr/bin/python3' WHEN 11 THEN '/bin/su' END",
    "args": "CASE k % 9 WHEN 0 THEN '-czf /tmp/Backup.tgz /home' WHEN 1 THEN 'bash -i' WHEN 2 THEN '-L 8080' WHEN 3 THEN '-e /etc/hosts' WHEN 4 THEN '-u#-1' WHEN 5 THEN '-la' WHEN 6 THEN 'ncat -e /bin/x' WHEN 7 THEN '-o ForwardAgent' END",
    "path": "CASE (event_id + k) % 12 WHEN 0 THEN '/home/a/report.docx' WHEN 1 THEN '/etc/shadow' WHEN 2 THEN '/proc/12/mem' WHEN 3 THEN '/dev/input/event3' WHEN 4 THEN '/home/a/.ssh/id_rsa' WHEN 5 THEN '/etc/sudoers.d/x' WHEN 6 THEN '/tmp/x.txt' WHEN 7 THEN '/dev/tcp/1.2.3.4/80' WHEN 8 THEN '/home/a/pic.PNG' WHEN 9 THEN '/var/log/syslog' WHEN 10 THEN '/etc/gshadow' END",
    "new_path": "CASE k % 3 WHEN 0 THEN '/home/a/report.docx.locked' WHEN 1 THEN '/tmp/y.ENC' ELSE '/tmp/z.txt' END",
    "port": "CASE k % 6 WHEN 0 THEN 23 WHEN 1 THEN 445 WHEN 2 THEN 443 WHEN 3 THEN 4444 WHEN 4 THEN 22 ELSE 80 END",
    "host": "CASE k % 5 WHEN 0 THEN 'www.DropBox.com' WHEN 1 THEN 'example.org' WHEN 3 THEN 's3.eu.example.org' WHEN 4 THEN 'mega.nz' END",
    "service": "CASE k % 2 WHEN 0 THEN 'SSHD' ELSE 'cron' END",
    "result": "CASE k % 3 WHEN 0 THEN 'success' ELSE 'failure' END",
    "ip": "CASE k % 4 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '172.20.1.1' END",
    "uid": "k % 3",
    "euid": "k % 2",
}
#: a month of events in about a minute, so that short windows hold several
_QUICKER = 50_000


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {k: F.expr(v) for k, v in HOST.items()}
    return events(spark, sf_dir).select(
        "event_id",
        e["event_type"].alias("event_type"),
        F.expr(f"ts_mono_ns div {_QUICKER}").alias("ts_mono_ns"),
        "entity_key",
        F.struct(F.col("user_id").alias("pid"), e["ppid"].alias("ppid"), e["exe"].alias("executable"), e["args"].alias("command_line"), e["uid"].alias("uid"), e["euid"].alias("euid")).alias("process"),
        F.struct(e["path"].alias("path"), e["new_path"].alias("new_path")).alias("file"),
        F.struct(e["port"].alias("dest_port"), e["host"].alias("dest_host"), F.lit("10.0.0.1").alias("dest_ip")).alias("network"),
        F.struct(e["service"].alias("name")).alias("service"),
        F.struct(e["result"].alias("result"), e["ip"].alias("src_ip")).alias("auth"),
    )


H_SQL = f"{E_SQL}, h AS (SELECT event_id, user_id AS pid, ts // {_QUICKER} AS ts, " + ", ".join(f"{v} AS {k}" for k, v in HOST.items()) + " FROM e)"
_SO_FAR = "OVER (PARTITION BY pid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    "behavior_ransomware",
    f"""WITH {H_SQL},
        f AS (SELECT *, CASE WHEN event_type = 'file_rename' AND regexp_matches(lower(new_path), '\\.(locked|enc)$') THEN 1 ELSE 0 END AS bad FROM h WHERE event_type IN ('file_create', 'file_rename', 'file_write')),
        g AS (SELECT *, CASE WHEN (bad = 1 OR event_type = 'file_write') AND regexp_matches(lower(path), '\\.(docx|txt|png)$') THEN 1 ELSE 0 END AS good FROM f),
        w AS (SELECT a.pid, a.ts, a.event_id, sum(b.bad) AS recent, count(*) AS ops FROM g a JOIN g b ON a.pid = b.pid AND b.ts >= a.ts - 5000000000 AND (b.ts, b.event_id) <= (a.ts, a.event_id) GROUP BY ALL),
        c AS (SELECT pid, event_id, sum(good) {_SO_FAR} AS valued FROM g)
        SELECT pid, ts, event_id, CASE WHEN recent >= 3 THEN 'mass_rename' ELSE 'mass_access' END AS reason FROM w JOIN c USING (pid, event_id)
        WHERE recent >= 3 OR (valued >= 4 AND ops >= 2)""",
)
def _ransomware(spark, sf_dir):
    return B.ransomware(host_events(spark, sf_dir), renames=3, touched=4, operations=2)


@query(
    "behavior_reverse_shell",
    f"""WITH {H_SQL},
        d AS (SELECT *, regexp_matches(coalesce(exe, '') || ' ' || coalesce(args, ''), '(bash|sh)\\s+-i|(nc|ncat)\\s+-e\\s+') AS direct FROM h)
        SELECT pid, ts, event_id, 'command_line' AS reason FROM d WHERE event_type = 'process_exec' AND direct
        UNION ALL SELECT pid, ts, event_id, 'dev_tcp_write' FROM d WHERE event_type = 'file_write' AND contains(path, '/dev/tcp/')
        UNION ALL SELECT pid, ts, event_id, 'shell_of_network_parent' FROM d a WHERE event_type = 'process_exec' AND NOT direct AND exe = '/bin/bash'
            AND EXISTS (SELECT 1 FROM d b WHERE b.pid = a.ppid AND b.event_type IN ('network_connect', 'network_send') AND (b.ts, b.event_id) < (a.ts, a.event_id) AND a.ts - b.ts <= 10000000000)""",
)
def _reverse_shell(spark, sf_dir):
    return B.reverse_shell(host_events(spark, sf_dir))


@query(
    "behavior_exfiltration",
    f"""WITH {H_SQL},
        f AS (SELECT *, event_type = 'process_exec' AND coalesce(exe = '/usr/bin/tar', false) AS ar, event_type = 'process_exec' AND coalesce(exe = '/usr/bin/mysqldump', false) AS du,
              event_type = 'process_exec' AND coalesce(exe = '/usr/bin/curl', false) AS up, event_type = 'network_connect' AND coalesce(regexp_matches(lower(host), 'dropbox\\.com|s3\\.|mega\\.nz'), false) AS cl FROM h),
        l AS (SELECT *, max(CASE WHEN ar THEN ts END) {_SO_FAR} AS at_, max(CASE WHEN du THEN ts END) {_SO_FAR} AS dt_ FROM f),
        r AS (SELECT *, CASE WHEN event_type = 'network_connect' AND port = 4444 AND (at_ IS NOT NULL OR dt_ IS NOT NULL) THEN 'upload_to_odd_port'
              WHEN cl AND (at_ IS NOT NULL OR dt_ IS NOT NULL) THEN 'data_to_cloud' WHEN up AND ts - dt_ <= 2000000000 THEN 'dump_then_upload' WHEN up AND ts - at_ <= 2000000000 THEN 'archive_then_upload'
              WHEN du THEN 'database_dump' WHEN ar AND contains(lower(args), 'backup') THEN 'archive_of_secrets' END AS reason FROM l),
        c AS (SELECT *, max(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) {_SO_FAR} AS any_r, max(CASE WHEN ar THEN 1 ELSE 0 END) {_SO_FAR} AS any_a, max(CASE WHEN cl THEN 1 ELSE 0 END) {_SO_FAR} AS any_c FROM r)
        SELECT pid, ts, event_id, reason FROM c WHERE any_r = 1 OR (any_a = 1 AND any_c = 1)""",
)
def _exfiltration(spark, sf_dir):
    return B.exfiltration(host_events(spark, sf_dir), window_ns=2_000_000_000)


@query(
    "behavior_lateral_movement",
    f"""WITH {H_SQL},
        f AS (SELECT *, event_type = 'process_exec' AND coalesce(exe = '/usr/bin/ssh', false) AS tool,
              event_type = 'process_exec' AND coalesce(contains(lower(exe), 'ssh'), false) AND coalesce(regexp_matches(args, '-[LRD]\\s+[0-9]+|-A|-o\\s+ForwardAgent'), false) AS trick,
              event_type = 'network_connect' AND port IN (23, 445) AS adm, event_type = 'service_start' AND lower(service) = 'sshd' AS srv,
              event_type = 'authentication' AND result = 'success' AND coalesce(ip = '8.8.8.8', false) AS login, event_type = 'authentication' AND result = 'failure' AS bad FROM h),
        g AS (SELECT *, sum(bad::INT) {_SO_FAR} AS bads, sum(tool::INT + trick::INT + adm::INT + srv::INT + login::INT) {_SO_FAR} AS pts FROM f),
        r AS (SELECT *, CASE WHEN bad AND bads >= 5 THEN 'repeated_failures' WHEN login THEN 'outside_login' WHEN srv THEN 'remote_service' WHEN adm AND port = 23 THEN 'telnet' WHEN adm THEN 'admin_port'
              WHEN trick THEN 'ssh_options' WHEN tool THEN 'remote_tool' END AS reason FROM g)
        SELECT pid, ts, event_id, reason FROM r WHERE pts >= 6 OR reason IN ('telnet', 'repeated_failures')""",
)
def _lateral(spark, sf_dir):
    return B.lateral_movement(host_events(spark, sf_dir), threshold=6)


@query(
    "behavior_privilege_escalation",
    f"""WITH {H_SQL},
        f AS (SELECT *, event_type = 'process_exec' AS run, event_type IN ('file_create', 'file_rename', 'file_write') AS ch, exe = '/usr/bin/sudo' AND args IS NOT NULL AS sudo FROM h),
        r AS (SELECT *, CASE WHEN ch AND contains(path, '/etc/shadow') THEN 'shadow_access' WHEN ch AND contains(path, '/etc/sudoers') THEN 'sudoers_modify' WHEN ch AND contains(path, '/etc/gshadow') THEN 'gshadow_access'
              WHEN run AND uid <> euid AND euid = 0 THEN 'root_as_effective_user' WHEN run AND sudo AND contains(args, '-e') THEN 'sudo_editor' WHEN run AND sudo AND contains(args, '-u#-1') THEN 'sudo_bypass'
              WHEN run AND exe IN ('/bin/bash', '/usr/bin/ssh') THEN 'shell_suid' WHEN run AND exe = '/usr/bin/nmap' THEN 'unusual_suid' END AS reason FROM f),
        c AS (SELECT *, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) {_SO_FAR} AS pts FROM r)
        SELECT pid, ts, event_id, reason FROM c WHERE pts >= 8 OR reason IN ('shadow_access', 'sudo_bypass', 'shell_suid')""",
)
def _privilege(spark, sf_dir):
    return B.privilege_escalation(host_events(spark, sf_dir), threshold=8)


@query(
    "behavior_credential_access",
    f"""WITH {H_SQL},
        f AS (SELECT *, event_type IN ('file_create', 'file_rename', 'file_write', 'file_read') AS t FROM h),
        r AS (SELECT *, CASE WHEN t AND contains(path, '/dev/input/event') THEN 'input_device' WHEN t AND path = '/proc/12/mem' THEN 'process_memory' WHEN t AND contains(path, '/etc/shadow') THEN 'system_shadow'
              WHEN t AND contains(path, '.ssh/id_rsa') THEN 'credential_file' WHEN event_type = 'process_exec' AND exe = '/usr/bin/LOGKEYS' THEN 'keylogger' WHEN event_type = 'process_exec' AND exe = '/opt/john' THEN 'credential_tool' END AS reason FROM f),
        c AS (SELECT *, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) {_SO_FAR} AS pts FROM r)
        SELECT pid, ts, event_id, reason FROM c WHERE pts >= 10 OR reason IN ('system_shadow', 'keylogger', 'process_memory')""",
)
def _credentials(spark, sf_dir):
    return B.credential_access(host_events(spark, sf_dir), threshold=10)


def pack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host events with broad types and what the packs read besides; a process is a user."""
    h = packs.broad_types(host_events(spark, sf_dir))
    exe = F.expr("CASE event_id % 7 WHEN 0 THEN 'tar' WHEN 1 THEN '/usr/bin/ssh' WHEN 2 THEN '/usr/bin/sudo' WHEN 3 THEN '/bin/bash' WHEN 4 THEN 'john' ELSE 'ls' END")
    return h.withColumns(
        {
            "process": F.struct(F.col("entity_key").alias("entity_id"), exe.alias("executable"), F.expr("CASE event_id % 4 WHEN 0 THEN array('-czf', 'all.sql') WHEN 1 THEN array('me@host') ELSE array('-l', null) END").alias("args")),
            "file": F.struct(F.col("file.path").alias("path"), F.expr("CASE event_id % 3 WHEN 0 THEN 'x.locked' WHEN 1 THEN 'x.txt' END").alias("name")),
            "network": F.struct(F.expr("CASE event_id % 2 WHEN 0 THEN 'outbound' ELSE 'inbound' END").alias("direction"), F.col("network.dest_port").alias("dest_port"), F.col("network.dest_host").alias("dest_host")),
        }
    )


_BROAD_SQL = f"""{H_SQL}, b AS (SELECT event_id, pid, ts, path, port, host, CASE WHEN event_type LIKE 'process%' THEN 'process' WHEN event_type LIKE 'file%' THEN 'file' WHEN event_type LIKE 'network%' THEN 'network' ELSE event_type END AS event_type,
        CASE event_id % 7 WHEN 0 THEN 'tar' WHEN 1 THEN '/usr/bin/ssh' WHEN 2 THEN '/usr/bin/sudo' WHEN 3 THEN '/bin/bash' WHEN 4 THEN 'john' ELSE 'ls' END AS exe,
        CASE event_id % 4 WHEN 0 THEN '-czf all.sql' WHEN 1 THEN 'me@host' ELSE '-l' END AS args, CASE event_id % 3 WHEN 0 THEN 'x.locked' WHEN 1 THEN 'x.txt' END AS name,
        CASE event_id % 2 WHEN 0 THEN 'outbound' ELSE 'inbound' END AS direction FROM h)"""
_PACK_SQL = {
    "ransomware": ([_t("file", r"regexp_matches(path, '\.(docx|doc|png|pdf)$')"), _t("file", r"regexp_matches(name, '\.locked$')")], 5_000),
    "data_exfiltration": ([_t("process", "exe = 'tar' AND contains(args, '.sql')"), _t("network", "direction = 'outbound' AND (port IN (80, 443) OR regexp_matches(coalesce(host, ''), 'dropbox'))")], 300_000),
    "lateral_movement": ([_t("process", "exe = '/usr/bin/ssh' AND contains(args, '@')"), _t("network", "port = 22")], 60_000),
    "privilege_escalation": ([_t("process", "exe = '/usr/bin/sudo'"), _t("file", "path = '/etc/shadow'")], 30_000),
    "reverse_shell": ([_t("network", "direction = 'outbound' AND port = 4444"), _t("process", "exe = '/bin/bash'")], 10_000),
}
_PACK_CTES = {n: _sequence_sql(n, steps, span, by="pid", source="b") for n, (steps, span) in _PACK_SQL.items()}


@query("packs_sequences", f"WITH RECURSIVE {_BROAD_SQL}, " + ", ".join(c for c, _ in _PACK_CTES.values()) + " " + " UNION ALL ".join(q for _, q in _PACK_CTES.values()))
def _packs(spark, sf_dir):
    return _flat(match_sequences(pack_events(spark, sf_dir), [r for r in packs.all_packs() if r.is_sequence], packs.pack_schema()))


@query("packs_credential_access", f"WITH {_BROAD_SQL} SELECT event_id FROM b WHERE event_type = 'process' AND (exe = 'john' OR path = '/etc/shadow' OR contains(path, '.ssh/'))")
def _pack_credentials(spark, sf_dir):
    return filter_events(pack_events(spark, sf_dir), packs.credential_access(), packs.pack_schema()).select("event_id")


# alerts and decisions


@query(
    "alerts_union",
    f"""WITH RECURSIVE {E_SQL}, {_SINGLE_SQL}, {_sequence_sql("seq_two_step", **_SEQUENCES["seq_two_step"][1])[0]}, q AS ({_sequence_sql("seq_two_step", **_SEQUENCES["seq_two_step"][1])[1]})
        SELECT rule_id || '-' || ts AS alert_id, rule_id, severity, ts, CAST(user_id AS VARCHAR) AS entity_key, CAST(event_id AS VARCHAR) AS event_ids FROM m
        UNION ALL SELECT rule_id || '-' || key || '-' || ts, rule_id, 'high', ts, key, event_ids FROM q""",
)
def _alerts(spark, sf_dir):
    return _alert_rows(spark, sf_dir).select("alert_id", "rule_id", "severity", "ts", "entity_key", F.concat_ws(",", "event_ids").alias("event_ids"))


def _alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, single = events(spark, sf_dir), _single_rules()
    many = [parse(_SEQUENCES["seq_two_step"][0]).named("seq_two_step", severity="high")]
    return A.event_alerts(match_events(df, single, event_schema()), single).unionByName(A.sequence_alerts(match_sequences(df, many, event_schema()), many))


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_ACTION = "CASE severity WHEN 'critical' THEN 'kill' WHEN 'high' THEN 'block' WHEN 'medium' THEN 'alert' WHEN 'low' THEN 'alert' ELSE 'allow' END"


@query(
    "decision_worst_rule",
    f"""WITH {E_SQL}, {_SINGLE_SQL}, r AS (SELECT *, {_RANK} AS rank FROM m),
        g AS (SELECT event_id, max(rank) AS top, count(*) AS n_alerts FROM r GROUP BY event_id),
        w AS (SELECT g.event_id, top, n_alerts, (SELECT min(rule_id) FROM r WHERE r.event_id = g.event_id AND r.rank = g.top) AS best FROM g),
        s AS (SELECT *, CASE greatest(top, 1) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM w)
        SELECT event_id, severity, CASE WHEN top > 1 THEN best ELSE 'unknown' END AS rule_id, {_ACTION} AS action, n_alerts FROM s""",
)
def _worst(spark, sf_dir):
    return D.worst_rule(A.event_alerts(match_events(events(spark, sf_dir), _single_rules(), event_schema()), _single_rules()).withColumn("event_id", F.col("event_ids")[0]), ["event_id"])


@query("decision_action", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT event_id, rule_id, {_ACTION} AS action, CASE WHEN severity IN ('critical', 'high') THEN CASE WHEN rule_id = 'big_purchase' THEN 'enforce' ELSE 'rejected' END ELSE 'noted' END AS outcome FROM m")
def _actions(spark, sf_dir):
    a = A.event_alerts(match_events(events(spark, sf_dir), _single_rules(), event_schema()), _single_rules()).withColumn("action", D.action_of(F.col("severity")))
    return a.select(F.col("event_ids")[0].alias("event_id"), "rule_id", "action", D.outcome(F.col("action"), F.lit("inline"), F.col("rule_id") == "big_purchase").alias("outcome"))


_TTL = 172_800_000_000_000


@query(
    "decision_cache_ttl",
    f"""WITH RECURSIVE {E_SQL}, p AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e WHERE event_type = 'purchase'),
        c AS (SELECT event_id, user_id, ts, n, ts AS made, false AS cached FROM p WHERE n = 1
              UNION ALL SELECT p.event_id, p.user_id, p.ts, p.n, CASE WHEN p.ts - c.made >= {_TTL} THEN p.ts ELSE c.made END, p.ts - c.made < {_TTL} FROM c JOIN p ON p.user_id = c.user_id AND p.n = c.n + 1)
        SELECT event_id, cached FROM c""",
)
def _cache(spark, sf_dir):
    df = events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.col("event_id").alias("alert_id"), "user_id", F.col("ts_mono_ns").alias("ts"))
    return D.with_cache(df, "user_id", "ts", _TTL).select("event_id", "cached")


@query(
    "decision_composed",
    f"""WITH RECURSIVE {E_SQL}, {_SINGLE_SQL}, r AS (SELECT *, {_RANK} AS rank FROM m),
        g AS (SELECT event_id, user_id, ts, max(rank) AS top, count(*) AS n_alerts FROM r GROUP BY ALL),
        w AS (SELECT g.*, CASE WHEN top > 1 THEN (SELECT min(rule_id) FROM r WHERE r.event_id = g.event_id AND r.rank = g.top) ELSE 'unknown' END AS rule_id,
              CASE greatest(top, 1) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM g),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts // 1000000000 ORDER BY ts, event_id) AS i FROM w) WHERE i <= 1),
        p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM l),
        c AS (SELECT event_id, user_id, ts, n, n_alerts, ts AS made, rule_id, severity, false AS cached FROM p WHERE n = 1
              UNION ALL SELECT p.event_id, p.user_id, p.ts, p.n, p.n_alerts, CASE WHEN p.ts - c.made >= {_TTL} THEN p.ts ELSE c.made END, CASE WHEN p.ts - c.made >= {_TTL} THEN p.rule_id ELSE c.rule_id END,
                     CASE WHEN p.ts - c.made >= {_TTL} THEN p.severity ELSE c.severity END, p.ts - c.made < {_TTL} FROM c JOIN p ON p.user_id = c.user_id AND p.n = c.n + 1)
        SELECT event_id, rule_id, {_ACTION} AS action, n_alerts, cached, CASE WHEN severity IN ('critical', 'high') THEN CASE WHEN rule_id = 'big_purchase' THEN 'enforce' ELSE 'rejected' END ELSE 'noted' END AS outcome FROM c""",
)
def _composed(spark, sf_dir):
    engine = Engine(event_schema(), mode="inline")
    for rule in _single_rules():
        engine.add(replace(rule, blockable=rule.rule_id == "big_purchase"))
    return engine.decide(events(spark, sf_dir), per_second=1, ttl_ns=_TTL).select("event_id", "rule_id", "action", "n_alerts", "cached", "outcome")


@query("script_alerts", f"WITH {E_SQL} SELECT 'odd_total' AS rule_id, 'high' AS severity, event_id FROM e WHERE event_type = 'purchase' AND (user_id + k) % 9 = 4 UNION ALL SELECT 'small', 'low', event_id FROM e WHERE event_type = 'click' AND k < 3")
def _scripts(spark, sf_dir):
    """A scripted predicate beside a rule."""
    engine = Engine(event_schema())
    engine.add("click where k < 3", "small", severity="low")
    engine.add_script("odd_total", lambda pdf: (pdf["event_type"] == "purchase") & ((pdf["user_id"] + pdf["k"]) % 9 == 4), "high")
    return engine.alerts(events(spark, sf_dir)).select("rule_id", "severity", F.col("event_ids")[0].alias("event_id"))


@query("rate_limit_per_sec", f"WITH {E_SQL}, c AS (SELECT event_id, row_number() OVER (PARTITION BY ts // 3600000000000 ORDER BY ts, event_id) AS n FROM e) SELECT event_id FROM c WHERE n <= 5")
def _rate(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.col("ts_mono_ns").alias("ts"))
    return D.rate_limited(df, F.expr("ts div 3600000000000"), 5).select("event_id")


@query("should_block", f"WITH {E_SQL}, {_SINGLE_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rule_id DESC) AS n FROM m) SELECT CAST(user_id AS VARCHAR) AS entity_key, ts, rule_id, {_ACTION} AS action, severity IN ('critical', 'high') AS blocked FROM l WHERE n = 1")
def _block(spark, sf_dir):
    a = A.event_alerts(match_events(events(spark, sf_dir), _single_rules(), event_schema()), _single_rules())
    return D.should_block(a.withColumn("action", D.action_of(F.col("severity"))))


@query("audit_by_entity", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT CAST(user_id AS VARCHAR) AS entity_key, rule_id, ts FROM m WHERE user_id = 42")
def _audit(spark, sf_dir):
    a = A.event_alerts(match_events(events(spark, sf_dir), _single_rules(), event_schema()), _single_rules())
    return D.audit(a, entity="42").select("entity_key", "rule_id", "ts")


@query("audit_latest", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT rule_id || '-' || ts AS alert_id, ts FROM m ORDER BY ts DESC, alert_id LIMIT 100")
def _latest(spark, sf_dir):
    a = A.event_alerts(match_events(events(spark, sf_dir), _single_rules(), event_schema()), _single_rules())
    return D.audit(a, most=100).select("alert_id", "ts")


# metrics and analysis


@query("rule_metrics", f"WITH {E_SQL}, {_SINGLE_SQL} SELECT rule_id, count(*) AS n_matches, count(DISTINCT user_id) AS n_entities, min(ts) AS first_ts, max(ts) AS last_ts, round(count(*) / ((max(ts) - min(ts)) / 60e9), 9) AS per_minute FROM m GROUP BY rule_id")
def _metrics(spark, sf_dir):
    m = M.rule_metrics(match_events(events(spark, sf_dir), _single_rules(), event_schema()))
    return m.withColumn("per_minute", F.round("per_minute", 9))


@query("exact_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(CASE WHEN i = n * 50 // 100 THEN value END) AS p50, max(CASE WHEN i = n * 90 // 100 THEN value END) AS p90, max(CASE WHEN i = n * 99 // 100 THEN value END) AS p99 FROM r GROUP BY event_type")
def _percentiles(spark, sf_dir):
    return M.exact_percentiles(table(spark, sf_dir, "events"), "value", "event_type")


@query("sequence_metrics", f"WITH RECURSIVE {E_SQL}, {_sequence_sql('q', **_SEQUENCES['seq_two_step'][1])[0]}, f AS ({_sequence_sql('q', **_SEQUENCES['seq_two_step'][1])[1]}) SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n_events, (SELECT count(*) FROM f WHERE f.key = CAST(e.user_id AS VARCHAR)) AS n_matches FROM e GROUP BY user_id")
def _sequence_metrics(spark, sf_dir):
    df = events(spark, sf_dir)
    return M.sequence_metrics(df.withColumn("key", F.col("entity_key")), match_sequences(df, [parse(_SEQUENCES["seq_two_step"][0])], event_schema()))


_UNTIL = _SEQUENCES["seq_until"]


@query(
    "sequence_statistics",
    f"""WITH RECURSIVE {E_SQL}, {_sequence_sql("q", **_UNTIL[1])[0]},
        s AS (SELECT q_s.*, lag(st) OVER (PARTITION BY key ORDER BY n) AS was, q_r.m FROM q_s LEFT JOIN q_r USING (key, n))
        SELECT 'seq_until' AS rule_id, key, count(m) AS n_events, count(*) FILTER (was = 0 AND st > 0) AS started, count(found) AS completed,
               count(*) FILTER (was > 0 AND st = 0 AND found IS NULL AND m < {1 << 30}) AS expired,
               count(*) FILTER (was > 0 AND st = 0 AND found IS NULL AND m >= {1 << 30}) AS ended, CAST(arg_max(st, n) > 0 AS BIGINT) AS live
        FROM s GROUP BY key""",
)
def _sequence_statistics(spark, sf_dir):
    return sequence_statistics(events(spark, sf_dir), [parse(_UNTIL[0]).named("seq_until")], event_schema())


#: rule, steps of a sequence, string functions but patterns, end, string literals in comparisons and arguments; counted by hand
_COMPLEXITY = {"seq_two_step": (2, 0), "seq_three_step": (3, 0), "seq_same_type_x5": (5, 0), "seq_no_span": (2, 0), "seq_until": (2, 1), "seq_until_of_step_type": (2, 1), "seq_single_step": (1, 0), "seq_other_key": (2, 0), **dict.fromkeys(_SINGLE, (0, 0))}


@query(
    "complexity_analysis",
    "WITH r AS (SELECT *, least(100, 10 * steps + 25 * ends) AS score FROM (VALUES " + ", ".join(f"('{n}', {steps}, {ends})" for n, (steps, ends) in _COMPLEXITY.items()) + ") v(rule_id, steps, ends)), "
    "s AS (SELECT *, score < 40 AND ends = 0 AS simple FROM r) "
    "SELECT rule_id, CAST(score AS INTEGER) AS score, CAST(steps AS INTEGER) AS steps, CAST(0 AS INTEGER) AS literals, simple, CASE WHEN simple AND steps > 0 THEN 'fold' ELSE 'general' END AS strategy, CAST(CASE WHEN simple AND steps > 0 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS confidence FROM s",
)
def _complexity(spark, sf_dir):
    rules = [parse(t).named(n) for n, (t, _) in _SEQUENCES.items()] + _single_rules()
    rows = [(a.rule_id, a.score, a.steps, a.literals, a.simple, a.strategy, a.confidence) for a in analyzer.analyze_all(rules)]
    return spark.createDataFrame(rows, "rule_id string, score int, steps int, literals int, simple boolean, strategy string, confidence double")


@query("hot_spots", f"WITH {E_SQL}, g AS (SELECT CAST(user_id AS VARCHAR) AS rule_id, count(*) AS evaluations, sum(CASE WHEN k > 10 THEN 1 ELSE 0 END) AS matches, 0.01 AS minutes FROM e GROUP BY user_id) SELECT rule_id, evaluations, CAST(matches AS BIGINT) AS matches FROM g WHERE evaluations >= 20 AND matches / evaluations >= 0.8 AND matches / 0.01 >= 1000")
def _hot(spark, sf_dir):
    m = events(spark, sf_dir).groupBy(F.col("entity_key").alias("rule_id")).agg(F.count(F.lit(1)).alias("evaluations"), F.sum((F.col("k") > 10).cast("long")).alias("matches"), F.lit(0.01).alias("minutes"))
    return analyzer.hot_spots(m, min_evaluations=20).select("rule_id", "evaluations", "matches")


# replay, generation, normalisation


@query("replay_order", f"WITH {E_SQL} SELECT CASE WHEN event_id = 0 THEN row_number() OVER (ORDER BY ts, event_id) ELSE event_id END AS event_id, row_number() OVER (ORDER BY ts, event_id) AS replay_no FROM e")
def _replay(spark, sf_dir):
    return replay.replay_order(events(spark, sf_dir), rows_per_slice=2000).select("event_id", "replay_no")


@query("normalize_event", f"WITH {E_SQL} SELECT CASE event_id % 9 WHEN 1 THEN 'process_exec' WHEN 2 THEN 'process_exit' WHEN 3 THEN 'file_create' WHEN 4 THEN 'file_rename' WHEN 5 THEN 'file_unlink' WHEN 6 THEN 'network_connect' WHEN 7 THEN 'network_send' END AS event_type, ts, CASE WHEN event_id % 9 = 1 THEN event_type END AS name, CASE WHEN event_id % 9 IN (3, 4, 5) THEN props END AS path FROM e WHERE event_id % 9 BETWEEN 1 AND 7")
def _normalize(spark, sf_dir):
    df = events(spark, sf_dir)
    zero = F.lit("\0junk")
    raw = df.select(
        (F.col("event_id") % 9).alias("kind"), "ts_mono_ns", F.col("ts_mono_ns").alias("ts_wall_ns"), "entity_key", F.col("user_id").alias("pid"), F.lit(1).alias("ppid"), F.lit(0).alias("uid"), F.lit(0).alias("gid"),
        F.concat("event_type", zero).alias("comm"), F.lit("\0").alias("exe"), F.lit("").alias("cmdline"), F.lit(0).alias("exit_code"), F.concat("props", zero).alias("path"), F.lit(None).cast("string").alias("new_path"),
    )
    good, _ = normalize.normalize(raw)
    return good.select("event_type", F.col("ts_mono_ns").alias("ts"), F.col("process.name").alias("name"), F.col("file.path").alias("path"))


@query("partition_assign", f"WITH {E_SQL} SELECT event_id, CAST(user_id % 4 AS INTEGER) AS bus_partition FROM e")
def _partitions(spark, sf_dir):
    return generate.placed(events(spark, sf_dir), 4).select("event_id", "bus_partition")


@query("generated_events", "SELECT i + 1 AS event_id, CAST(i % 4 + 1 AS VARCHAR) AS event_type, 1000000000 + i * 1000 AS ts_mono_ns, CAST(i % 100 AS VARCHAR) AS entity_key FROM range(10000) t(i)")
def _generated(spark, sf_dir):
    return generate.test_events(spark, 10_000).select("event_id", "event_type", "ts_mono_ns", "entity_key")


@query("tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def _tumbling(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.expr("from_utc_timestamp(cast(ts as timestamp), current_timezone())").alias("time"), "event_type")
    return df.groupBy(F.window("time", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n_events")


@query("session_counts", f"WITH {E_SQL}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000000 THEN 1 ELSE 0 END AS cut FROM e), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s) SELECT user_id, min(ts) AS start_ns, count(*) AS n_events FROM g GROUP BY user_id, n")
def _sessions(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("time", F.timestamp_micros(F.expr("ts_mono_ns div 1000")))
    return df.groupBy(F.session_window("time", "6 hours"), "user_id").agg(F.min("ts_mono_ns").alias("start_ns"), F.count(F.lit(1)).alias("n_events")).select("user_id", "start_ns", "n_events")
