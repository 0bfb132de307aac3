"""Alerts from matches of event and sequence rules, as one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberline.plans import ir

ALERT_COLUMNS = ("alert_id", "rule_id", "rule_name", "severity", "ts", "entity_key", "title", "description", "event_ids", "captures", "context")


def _rules_table(df: DataFrame, rules: Sequence[ir.Rule]) -> DataFrame:
    """Names, severities and texts of the rules, a bounded number of rows."""
    rows = [(r.rule_id, r.name or r.rule_id, r.severity, r.description or None, r.blockable, len(r.steps)) for r in rules]
    return df.sparkSession.createDataFrame(rows, "rule_id string, rule_name string, severity string, description string, blockable boolean, steps int")


def event_alerts(matches: DataFrame, rules: Sequence[ir.Rule]) -> DataFrame:
    """An alert per match of an event rule."""
    return matches.join(F.broadcast(_rules_table(matches, rules)), "rule_id").select(
        F.concat_ws("-", "rule_id", "ts").alias("alert_id"),
        "rule_id",
        "rule_name",
        "severity",
        "ts",
        F.col("key").alias("entity_key"),
        F.concat(F.lit("Event matched: "), "rule_name").alias("title"),
        "description",
        F.array("event_id").alias("event_ids"),
        "captures",
        F.to_json(F.struct(F.lit("single_event").alias("rule_type"))).alias("context"),
    )


def sequence_alerts(matches: DataFrame, rules: Sequence[ir.Rule]) -> DataFrame:
    """An alert per match of a sequence; its time is that of the last event."""
    return matches.join(F.broadcast(_rules_table(matches, rules)), "rule_id").select(
        F.concat_ws("-", "rule_id", "key", "ts").alias("alert_id"),
        "rule_id",
        "rule_name",
        "severity",
        "ts",
        F.col("key").alias("entity_key"),
        F.concat(F.lit("Sequence matched: "), "rule_name").alias("title"),
        "description",
        "event_ids",
        "captures",
        F.to_json(F.struct(F.lit("sequence").alias("rule_type"), F.col("rule_id").alias("sequence_id"), F.col("key").alias("entity_key"), "captures")).alias("context"),
    )


def write_json(alerts: DataFrame, path: str) -> None:
    """Appends alerts as JSON lines."""
    alerts.write.mode("append").json(path)


def stream_json(alerts: DataFrame, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer that appends a stream's alerts as JSON lines, each once; ``start`` it, or set a trigger first."""
    return alerts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).options(**options)


def stream_console(alerts: DataFrame, rows: int = 100) -> DataStreamWriter:
    """A writer that prints a stream's alerts."""
    return alerts.writeStream.format("console").option("numRows", rows).option("truncate", False)


def stream_each(alerts: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives each batch of alerts and its number to ``take``. After a fault a batch may come again under its number."""
    return alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
