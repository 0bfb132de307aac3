"""Documents with everything that can be odd about them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: names that the operators use inside, too
CLASHING = ("k", "t", "th", "n", "d", "l", "s", "h", "b", "a", "c", "y", "kind", "part", "full", "rest", "found", "x", "c0", "shard", "window_id", "probability", "keep", "label", "node", "epoch", "domain", "__gone")
LONG_WORDS = 60_000


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


def rows() -> list[tuple]:
    same = prose(1, 120)
    long = prose(2, LONG_WORDS)
    return [
        (1, same, "en", "src1"),
        (2, same, "en", "src1"),
        (2, same, "en", "src1"),
        (3, prose(3, 80), None, "src2"),
        (4, prose(4, 80), "de", None),
        (5, None, "en", "src1"),
        (None, prose(5, 70), "en", "src1"),
        (None, None, None, None),
        (6, "", "fr", "src3"),
        (7, " \n\t ", "fr", "src3"),
        (8, "!!! ... ???", "fr", "src3"),
        (9, "one", "es", "src4"),
        (10, "one", "es", "src4"),
        (11, long, "en", "src5"),
        (12, "x" * 300_000, "en", "src5"),
        (13, "Ünïcode WÖRTER \U0001f600 東京 " * 30, "de", "src6"),
        (14, "again again " * 5000, "de", "src6"),
        (15, same + " " + prose(6, 5), "en", "src1"),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession) -> DataFrame:
    """The rows with extra columns whose names clash."""
    full = [(*r, None if r[1] is None else len(r[1]), *(f"{c}-{i}" for c in CLASHING)) for i, r in enumerate(rows())]
    return spark.createDataFrame(full, SCHEMA + ", " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA + ", " + ", ".join(f"{c} string" for c in CLASHING))


def labels(spark: SparkSession) -> DataFrame:
    """Labels with nulls, repeats, ids that don't exist, and names that clash."""
    return spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 0, "b"), (3, 0, 0, "c"), (4, 0, 1, "d"), (11, 1, 0, "e"), (14, 0, 0, "f"), (None, 1, 0, "g"), (13, None, None, "h"), (999, 1, 0, "i"), (9, 1, 0, "j"), (10, 0, 0, "k")], "doc_id long, quality int, toxic int, k string")
