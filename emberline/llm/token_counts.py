"""Token counts of documents under a byte-level BPE vocabulary, with a whole-token shortcut.

Before any document is read, every string of the vocabulary is encoded by merging its bytes: the strings that
come out as one token are proved to, and so is any pre-token equal to one of them. Workers count those
pre-tokens by a set lookup and merge only the others, remembering what they merged lately.

The vocabulary file is read by the driver and broadcast (its size is fixed), so that only the driver needs the path.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import textkit as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: splits text into pre-tokens: English clitics, letters, digits and marks with the blank before them, white space
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens ``piece`` encodes to: its bytes, merged pair by pair in order of rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts)


def whole_tokens(ranks: dict[bytes, int], pattern: str = PATTERN) -> frozenset[str]:
    """The vocabulary's strings that are a pre-token and encode alone as one token."""
    split = regex.compile(pattern)
    proved = set()
    for token in ranks:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if split.fullmatch(text) and merged_length(token, ranks) == 1:
            proved.add(text)
    return frozenset(proved)


class Counter:
    """Counts the tokens of texts; what it has merged it remembers up to a bound."""

    def __init__(self, ranks: dict[bytes, int], whole: frozenset[str], pattern: str = PATTERN):
        self.split = regex.compile(pattern).findall
        self.whole = whole
        core = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.merge = core.encode_single_piece
        self.known: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens, and the pre-tokens that the shortcut settled."""
        found = self.split(text)
        whole, known = self.whole, self.known
        rest = [x for x in found if x not in whole]
        n = len(found) - len(rest)
        for x in rest:
            c = known.get(x)
            if c is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                # a lone surrogate can't come from Arrow, whose strings are valid UTF-8
                c = known[x] = len(self.merge(x.encode()))
            n += c
        return n, len(found), len(found) - len(rest)


@functools.lru_cache(maxsize=4)
def _proved(vocabulary: str, changed: int, pattern: str) -> tuple[dict[bytes, int], frozenset[str]]:
    ranks = read_ranks(vocabulary)
    return ranks, whole_tokens(ranks, pattern)


def _share(spark: SparkSession, vocabulary: str, pattern: str):
    """Vocabulary and proofs as a broadcast; a vocabulary is proved once in a process, unless its file changes."""
    return spark.sparkContext.broadcast((*_proved(vocabulary, os.stat(vocabulary).st_mtime_ns, pattern), pattern))


def n_tokens(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The number of tokens of ``text`` as a column; null for a null text, 0 for an empty one."""
    shared = _share(spark, vocabulary, pattern)

    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(*shared.value)
        for part in texts:
            yield pa.array([None if t is None else counter.count(t)[0] for t in (x.as_py() for x in part)], pa.int64())
        K.trim()

    count.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "long")(text.cast("string"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("n_whole", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens, n_whole`` for each row of ``docs``: one row each, repeated ones too.

    An empty text has no tokens; a null text has null counts; texts of any length are counted whole. ``doc_id`` may be null. Other columns play no part. Strings that look
    like special tokens are ordinary text.
    """
    shared = _share(docs.sparkSession, vocabulary, pattern)

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            rows = [(None, None, None) if t is None else counter.count(t) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_whole long")
