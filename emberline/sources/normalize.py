"""Raw telemetry records to canonical events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.predicates import Compiler
from emberline.plans import ir
from emberline.schema import Schema

TYPES = {1: "process_exec", 2: "process_exit", 3: "file_create", 4: "file_rename", 5: "file_unlink", 6: "network_connect", 7: "network_send"}


def c_string(raw: Column) -> Column:
    """A zero-terminated byte string as text; an empty one is missing."""
    text = raw.cast("string")
    end = F.instr(text, "\0")
    return F.nullif(F.when(end > 0, F.substring(text, F.lit(1), end - 1)).otherwise(text), F.lit(""))


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical events of raw records ``kind, ts_mono_ns, ts_wall_ns, entity_key, pid, ppid, uid, gid, comm, exe, cmdline, exit_code, path, new_path``, and the records of unknown kind.

    Programs' fields come with their start, exit codes with their end, paths with files; connections tell the process only. An event's id is
    drawn from what its record says, so that it is the same however the records are partitioned; records that are equal have one id.
    """
    kind = F.lit(None).cast("string")
    for n, name in TYPES.items():
        kind = F.when(F.col("kind") == n, name).otherwise(kind)
    df = raw.withColumn("event_type", kind)
    start, end, file = F.col("kind") == 1, F.col("kind") == 2, F.col("kind").isin(3, 4, 5)
    process = F.struct(
        F.col("pid").cast("long").alias("pid"),
        F.when(start, F.col("ppid").cast("long")).alias("ppid"),
        F.when(start, F.col("uid").cast("long")).alias("uid"),
        F.when(start, F.col("gid").cast("long")).alias("gid"),
        F.when(start, c_string(F.col("comm"))).alias("name"),
        F.when(start, c_string(F.col("exe"))).alias("executable"),
        F.when(start, c_string(F.col("cmdline"))).alias("command_line"),
        F.when(end, F.col("exit_code").cast("long")).alias("exit_code"),
    )
    files = F.struct(F.when(file, c_string(F.col("path"))).alias("path"), F.when(F.col("kind") == 4, c_string(F.col("new_path"))).alias("new_path"))
    good = df.where("event_type is not null").select(F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{c}`") for c in raw.columns)), 1).alias("event_id"), "event_type", "ts_mono_ns", "ts_wall_ns", "entity_key", process.alias("process"), files.alias("file"))
    return good, df.where("event_type is null").drop("event_type")


def interest(rules: Iterable[ir.Rule], schema: Schema) -> dict[str, set[str]]:
    """Event types that the rules need, and the fields of each."""
    out: dict[str, set[str]] = {}
    for r in rules:
        for s in [*r.steps, *([r.until] if r.until else [])]:
            own = out.setdefault(schema.event_type(s.event_type), set())
            own |= ir.required_fields(s.where) | {c.path for c in r.captures}
            if r.by and r.by != "entity_key":
                own.add(r.by)
    return out


def interesting(events: DataFrame, rules: Iterable[ir.Rule], schema: Schema, type_col: str = "event_type", predicates: bool = True) -> DataFrame:
    """The events that some rule's type, and condition if ``predicates``, lets through; the types reach the scan."""
    rules = list(rules)
    types = sorted(interest(rules, schema))
    out = events.where(F.col(type_col).isin(types))
    if predicates:
        compiler = Compiler(schema)
        test = F.lit(False)
        for r in rules:
            for s in [*r.steps, *([r.until] if r.until else [])]:
                test = test | ((F.col(type_col) == schema.event_type(s.event_type)) & compiler.filter(s.where))
        out = out.where(test)
    return out
