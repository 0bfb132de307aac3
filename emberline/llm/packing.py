"""Packing documents into training windows by the sum-of-squares rule.

Documents arrive one by one. ``N[h]`` counts the open windows filled to level ``h``; a document goes to the
level (or to a new window) for which the sum of all ``N[h]**2`` is least afterwards. Only the level array
and a stack of windows per level are kept, so a document costs one pass over ``capacity`` numbers.

The stream is dealt to shards by a hash of the document, each packed on its own; shards hold about
``docs_per_shard`` documents whatever the size of the table, and only ids and token counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.llm.common import pieces

CAPACITY = 2048
DOCS_PER_SHARD = 50_000
_NONE = -(2**60)


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def sum_of_squares(sizes: Iterable[int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``item, piece, window, offset, tokens`` for each piece; an item beyond ``capacity`` fills windows of its own first.

    Of equally good places the fullest level comes first and a new window last; of the windows of a level,
    the one that reached it last. Items without tokens get no piece.
    """
    m = np.ones(capacity + 1, np.int64)  # 2 N[h] + 1; 0 for a full window
    m[capacity] = 0
    is_open = np.full(capacity + 1, _NONE, np.int64)  # the same where N[h] > 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    window = 0
    for item, s in enumerate(sizes):
        piece = 0
        while s >= capacity:
            yield item, piece, window, 0, capacity
            window, piece, s = window + 1, piece + 1, s - capacity
        if s <= 0:
            continue
        change = m[1 + s :] - is_open[1 : capacity - s + 1]
        h = capacity - s - int(change[::-1].argmin())
        if change[h - 1] + 2 <= m[s]:
            w = stacks[h].pop()
            m[h] -= 2
            is_open[h] = m[h] if m[h] > 1 else _NONE
        else:
            h, w = 0, window
            window += 1
        level = h + s
        if level < capacity:
            stacks[level].append(w)
            m[level] += 2
            is_open[level] = m[level]
        yield item, piece, w, h, s


_DDL = "window_id long, doc_id long, piece long, first_token long, n_tokens long, window_offset long"
_OUT = pa.schema([(x.split()[0], pa.int64()) for x in _DDL.split(", ")])


def _pack(capacity: int):
    @K.trimmed
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("th", "ascending"), ("n", "ascending")])  # null ids come last
        sizes = table["n"].to_numpy()
        rows = np.array(list(sum_of_squares(sizes.tolist(), capacity)), np.int64).reshape(-1, 5)
        item, piece, window, offset, n = rows.T
        base = table["shard"][0].as_py() << 40
        none = np.flatnonzero(sizes <= 0)
        keys = table["k"].combine_chunks().take(pa.array(np.r_[item, none]))
        zero = np.zeros(len(none), np.int64)
        windows = pa.array(np.r_[window + base, zero], mask=np.r_[np.zeros(len(item), bool), np.ones(len(none), bool)])
        return pa.Table.from_arrays([windows, keys, *(pa.array(np.r_[x, zero]) for x in (piece, piece * capacity, n, offset))], schema=_OUT)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, docs_per_shard: int = DOCS_PER_SHARD, tokens: Column | None = None) -> DataFrame:
    """A row for each piece of a document: ``window_id, doc_id, piece, first_token, n_tokens, window_offset``.

    ``tokens`` counts a document's tokens, words unless given. In a shard, documents come in order of ``doc_id``, then of a
    hash of the text; a null ``doc_id`` comes last. Every row is packed, rows that repeat others too.
    Documents without tokens, null texts among them, get one row with a null ``window_id``. A text of more than ``capacity`` tokens, however
    long, fills windows of its own and shares the last. Other columns play no part. An empty table gives no rows.
    """
    if capacity < 2:
        raise ValueError("capacity must be 2 at least")
    shards = pieces(docs.count(), docs_per_shard)
    n = F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else word_count(F.col("text").cast("string"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64(F.col("text").cast("string")).alias("th"), n.alias("n"))
    return narrow.withColumn("shard", F.pmod(F.xxhash64("k", "th"), F.lit(shards))).groupBy("shard").applyInArrow(_pack(capacity), _DDL)
