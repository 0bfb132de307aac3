"""Vectorised text kernels shared by the training-data operators.

Everything works on the byte buffer of an Arrow string column, a slice of about a megabyte at a
time, so that neither batch size nor document length decides how much memory a worker takes.

A *word* is a maximal run of ASCII letters, digits, underscores and non-ASCII characters, lower-cased
(ASCII and Latin-1 letters); a *mark* is a maximal run of other visible ASCII characters.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[:33] = _SPACE
_CLASS[127] = _SPACE
_CLASS[128:] = _WORD
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _CLASS[_c] = _WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK64 = (1 << 64) - 1
GRAM_BASE = np.uint64(0xD1342543DE82EF95)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers below ``n``."""
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_POW = powers(_BASE, 1 << 12)


def trim() -> None:
    """Gives the machine back what this worker has freed: Spark keeps idle workers, and their unused memory counts."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def trimmed(f: Callable) -> Callable:
    """``f`` of a batch iterator or a table, with a ``trim`` when it ends."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            try:
                yield from f(batches)
            finally:
                trim()

    else:

        @functools.wraps(f)
        def run(table):
            try:
                return f(table)
            finally:
                trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and n+1 offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together hold about ``most`` bytes (one document at least)."""
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    low = _LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    if len(after):
        b = buf[after]
        up = after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        low[up] += 32
    return low


class Tokens:
    """Tokens of a slice: ``hash`` (64 bits), ``doc`` (row in the slice), ``start``/``end`` (bytes)."""

    __slots__ = ("doc", "end", "hash", "is_word", "start")

    def __init__(self, hash_, doc, start, end, is_word):
        self.hash, self.doc, self.start, self.end, self.is_word = hash_, doc, start, end, is_word


def tokens(buf: np.ndarray, off: np.ndarray, marks: bool = False, fold: bool = True) -> Tokens:
    """Words of a slice of documents, in order, or words and marks."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n == 0:
        return Tokens(np.zeros(0, np.uint64), none, none, none, np.zeros(0, bool))
    kind = _CLASS[buf]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    inner = off[1:-1]
    cut[inner[inner < n]] = True
    start = np.flatnonzero(cut)
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:]
    end[-1] = n
    k = kind[start]
    take = (k == _WORD) if not marks else (k != _SPACE)
    low = (lower_bytes(buf) if fold else buf).astype(np.uint64)
    low += np.uint64(1)
    size = end - start
    longest = int(size.max())
    power = _POW if longest <= len(_POW) else powers(_BASE, longest)
    place = np.arange(n, dtype=np.int32)
    place -= np.repeat(start.astype(np.int32), size)
    low *= power[place]
    del place
    h = np.add.reduceat(low, start)[take]
    start, end, k = start[take], end[take], k[take]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    doc = np.searchsorted(off, start, side="right") - 1
    return Tokens(h, doc, start, end, k == _WORD)


def doc_ranges(doc: np.ndarray, n: int) -> np.ndarray:
    """n+1 offsets into an array sorted by document."""
    return np.searchsorted(doc, np.arange(n + 1))


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each document and the document of each.

    A document of fewer than ``n`` words, but one at least, has one gram: all of its words.
    """
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(words), np.uint64)
    m = len(words) - n + 1
    if m > 0:
        full = np.zeros(m, np.uint64)
        for j in range(n):
            full = full * GRAM_BASE + words[j : j + m]
        h[:m] = mix(full)
        ok = np.zeros(len(words), bool)
        ok[:m] = doc[:m] == doc[n - 1 :]
    else:
        ok = np.zeros(len(words), bool)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(words)])
    for at, c in zip(first[count < n].tolist(), count[count < n].tolist()):
        v = 0
        for w in words[at : at + c].tolist():
            v = (v * int(GRAM_BASE) + w) & _MASK64
        h[at] = mix(np.array([v ^ (c * 0x5851F42D4C957F2D & _MASK64)], np.uint64))[0]
        ok[at] = True
    at = np.flatnonzero(ok)
    return h[at], doc[at]
