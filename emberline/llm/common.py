"""Lineage cuts, scratch tables and small helpers."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for tables written between jobs: under ``spark.checkpoint.dir``, which all machines share.

    Where that is unset a temporary folder is used, but only if the session runs on one machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if base:
            path = f"{base.rstrip('/')}/emberline-{app}"
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            path = "file://" + tempfile.mkdtemp(prefix="emberline-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
        _OWN[app] = path
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, from a table written to the scratch folder: lost executors cost no recomputation."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the table behind a ``cut`` frame that is no longer needed."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "emberline-" in path and path.rsplit("/", 1)[0].split(":")[-1].lstrip("/") == root.split(":")[-1].lstrip("/"):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def pieces(n: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` rows ``n`` rows make."""
    return max(least, math.ceil(n / each))


def spread(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` numbers that Spark's hash partitioning deals evenly to the session's shuffle partitions.

    They stand for buckets of about one size, so that no task gets several by chance. Only balance hangs on them: with another number of
    partitions, or beyond 4096 buckets, where chance spreads them well enough, they are as good as any.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > 4096:
        return np.arange(n, dtype=np.int32)
    x = np.arange(max(64, 4 * (n + parts)) * 4, dtype=np.uint32)
    k = x * np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593) ^ np.uint32(42)
    h = (k << np.uint32(13) | k >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    part = (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % parts
    o = np.argsort(part, kind="stable")
    turn = np.empty(len(x), np.int64)  # how many numbers of the same partition come before
    turn[o] = np.arange(len(x)) - np.searchsorted(part[o], part[o])
    return np.lexsort((part, turn))[:n].astype(np.int32)


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that text searches need, as ``k`` and ``t``; rows where either is null are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("t")).where("k is not null and t is not null")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
