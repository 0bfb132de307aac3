"""Synthetic events, the same for the same arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def test_events(spark: SparkSession, n: int, entities: int = 100, types: int = 4, base_ns: int = 1_000_000_000, step_ns: int = 1000) -> DataFrame:
    """``n`` events, one every ``step_ns``, their types and entities in turn."""
    i = F.col("id")
    return spark.range(n).select(
        (i + 1).alias("event_id"),
        (i % types + 1).cast("string").alias("event_type"),
        (base_ns + i * step_ns).alias("ts_mono_ns"),
        (base_ns + i * step_ns).alias("ts_wall_ns"),
        (i % entities).cast("string").alias("entity_key"),
        F.concat(F.lit("/bin/test_"), i.cast("string")).alias("path"),
        i.alias("number"),
        (i % 2 == 0).alias("flag"),
    )


def matching_events(spark: SparkSession, n: int, value: str) -> DataFrame:
    """Events whose path is ``value``."""
    return test_events(spark, n).withColumn("path", F.lit(value))


def unmatching_events(spark: SparkSession, n: int, value: str) -> DataFrame:
    """Events whose path is never ``value``."""
    return test_events(spark, n).withColumn("path", F.concat(F.lit(value), F.lit("/other_"), F.col("number").cast("string")))


def sequence_events(spark: SparkSession, n: int, entity: str = "1") -> DataFrame:
    """One entity's events of one type, a second apart."""
    return test_events(spark, n, types=1, step_ns=1_000_000_000).withColumn("entity_key", F.lit(entity))


def placed(events: DataFrame, partitions: int, strategy: str = "entity") -> DataFrame:
    """``events`` with the ``bus_partition`` that a bus of so many partitions gives them: by entity, event type, both, or a stable hash of the entity."""
    entity = F.col("entity_key")
    number = F.coalesce(entity.try_cast("long"), F.crc32(entity.cast("string")))
    keys = {
        "entity": number,
        "event_type": F.crc32("event_type"),
        "combined": F.crc32(F.concat_ws("/", "event_type", "entity_key")),
        "hash": F.crc32(entity.cast("string")),
    }
    if strategy not in keys:
        raise ValueError(f"no strategy {strategy}")
    return events.withColumn("bus_partition", F.pmod(keys[strategy], F.lit(partitions)).cast("int"))
