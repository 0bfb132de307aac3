"""The corpus pipeline: documents to packed training windows, each stage reading what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import mixing, ngram_join, packing, quality_net, suffix_dedup, token_counts
from emberline.llm.common import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality_net.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 50 words or more that occur before."""
    return suffix_dedup.remove_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents by the weights of their sources; no document is read twice."""
    return mixing.mix(docs, budget_share=0.8, max_epochs=1)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of tokens."""
    return packing.pack(docs, tokens=token_counts.n_tokens(spark, F.col("text")))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", passages),
    ("mixing", mixture),
    ("packing", windows),
]

#: the network, the draw of epochs and the online packing can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: pieces of documents and the windows that they are in, as ``packing.pack`` gives them.

    Each stage's output is written to the scratch folder and read again. Defined results: a row with a null ``doc_id`` passes the searches for copies and
    passages untouched; a null or empty text is judged by the share of good labels, has no copy and no passage, costs the mixture nothing, and comes out with a
    null ``window_id``. Texts are processed whole, however long. Of equal rows the copies go where their ``doc_id`` differs; rows that repeat a ``doc_id`` stay or go
    together. The mixture reads one epoch, so that no document is in two windows unless it is longer than one. Columns beyond those of ``documents`` are carried
    to the last stage, whatever their names. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
