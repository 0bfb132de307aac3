"""The replay log: one JSON header line, then one JSON event per line; and deterministic replay.

Logs are read and written by Spark. A log is a file or a folder: a folder has the header in ``header.json`` and the events in
``events/``, so that writing is parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = "EMBR"
VERSION = 1
SCHEMA_VERSION = 1


class LogError(ValueError):
    """The log has no header that this version understands."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_log(events: DataFrame, path: str, rule_pack: str = "", build: str = "") -> dict:
    """Writes the events as a log folder, in time order within its files, and gives the header. An empty log has counts of 0 and no times."""
    spark = events.sparkSession
    s = events.agg(F.count(F.lit(1)).alias("n"), F.min("ts_mono_ns").alias("lo"), F.max("ts_mono_ns").alias("hi")).first()
    head = {"magic": MAGIC, "version": VERSION, "schema_version": SCHEMA_VERSION, "build": build, "rule_pack": rule_pack, "event_count": s["n"], "start_ts": s["lo"], "end_ts": s["hi"]}
    events.repartitionByRange("ts_mono_ns", "event_id").sortWithinPartitions("ts_mono_ns", "event_id").write.mode("overwrite").json(f"{path}/events")
    p, fs = _fs(spark, f"{path}/header.json")
    out = fs.create(p, True)
    try:
        out.write(bytearray((json.dumps(head, sort_keys=True) + "\n").encode()))
    finally:
        out.close()
    return head


def read_header(spark: SparkSession, path: str) -> dict:
    p, fs = _fs(spark, f"{path}/header.json")
    first = spark.read.text(f"{path}/header.json" if fs.exists(p) else path).limit(1).collect()
    try:
        head = json.loads(first[0][0])
    except (IndexError, ValueError) as e:
        raise LogError("the first line is no header") from e
    if not isinstance(head, dict) or head.get("magic") != MAGIC:
        raise LogError("this is no replay log")
    if head.get("version", 0) > VERSION:
        raise LogError(f"version {head['version']} is newer than {VERSION}")
    return head


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The events of a log, ids and sources as written; blank lines are passed over, lines that aren't JSON give nulls only."""
    read_header(spark, path)
    p, fs = _fs(spark, f"{path}/events")
    lines = spark.read.text(f"{path}/events" if fs.exists(p) else path).where(F.trim("value") != "")
    parsed = lines.where(~F.col("value").startswith('{"') | F.get_json_object("value", "$.magic").isNull()).select(F.from_json("value", schema).alias("e"))
    return parsed.select("e.*")


def replay_order(events: DataFrame, rows_per_slice: int = 500_000) -> DataFrame:
    """``events`` with ``replay_no`` from 1 on, in order of time, then id; events without an id (null or 0) get that number for one.

    Slices of time are numbered one by one and offset by the counts before them, so no task sees all events. Events without a time come first.
    """
    s = events.agg(F.count(F.lit(1)).alias("n"), F.min("ts_mono_ns").alias("lo"), F.max("ts_mono_ns").alias("hi")).first()
    parts = -(-s["n"] // rows_per_slice) or 1
    width = ((s["hi"] or 0) - (s["lo"] or 0)) // parts + 1
    sliced = events.withColumn("__slice", F.coalesce(F.expr(f"(ts_mono_ns - {s['lo'] or 0}L) div {width}L"), F.lit(-1)))
    upto = F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    before = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("n")).select("__slice", F.coalesce(upto, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slice").orderBy("ts_mono_ns", "event_id"))
    out = sliced.withColumn("__no", own).join(before, "__slice").withColumn("replay_no", F.col("__no") + F.col("__before")).drop("__slice", "__no", "__before")
    return out.withColumn("event_id", F.when(F.coalesce("event_id", F.lit(0)) == 0, F.col("replay_no")).otherwise(F.col("event_id")))


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free hash of them."""
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)]
    h = F.xxhash64(*cols)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return r["n"], str(r["s"] or 0)


def is_deterministic(plan: Callable[[], DataFrame], runs: int = 3) -> bool:
    """Whether a plan, made and run anew each time, gives the same rows."""
    return len({fingerprint(plan()) for _ in range(runs)}) == 1
