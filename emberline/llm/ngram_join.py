"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

The document-by-n-gram incidence matrix is multiplied with its transpose in blocks:

1. ``_emit`` makes the n-gram set of every document and sends the incidence to buckets of the n-gram
   space. Documents with equal sets share one signature from here on, so exact copies cost one row; who holds
   which set is a table of its own, which Spark aggregates before it shuffles, so a set that a third of all documents hold is no burden.
2. ``_shared`` keeps, in each bucket, the n-grams that two sets hold at least.
3. ``_rows`` puts the rows of the matrix together again and drops the sets that hold too few shared
   n-grams for any partner: an overlap of ``ceil(t * size)`` is needed whatever the partner's size.
4. ``_product`` multiplies the n-grams that at most ``heavy`` sets hold, bucket by bucket, discards pairs whose sizes alone rule
   them out, and Spark sums the overlap over the buckets. A pair's bound counts its other n-grams as if all were common; for the pairs left they are compared.
5. Sets that hold so many n-grams of more than ``heavy`` sets that they may match by these alone meet by them: in dense blocks of
   at most ``2 * SIDE`` sets, whole rows of the matrix, however many sets there are (``_dense``). A pair is judged in one block only, and a block gives
   sums of links and who hangs together, not pairs: a large group of near copies is counted but never written out.

The result is exact but for collisions of hashes (of at least 20 bits more than it takes to number
all n-grams). Similar sets are linked, and what is linked is one class (``linked``): pairs are never written out for documents, only for
different sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.llm.common import cut, forget, id_text, pieces, spread

NGRAM = 5
THRESHOLD = 0.4
HEAVY = 200
#: sets of a side of a dense block
SIDE = 2000
DOCS_PER_BUCKET = 4000
FLUSH_GRAMS = 2_500_000

_HOLD = [("b", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
_BLOBS = pa.schema(_HOLD)
_DDL = "b int, kind int, a binary, c binary, d binary"
#: kinds of rows: 0 members (doc, signature, size), in any bucket; 1 incidence
_MEMBERS, _INCIDENCE = 0, 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_HOLD)], schema=_BLOBS)


def _u(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of a sorted array."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return zip(values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)])


def required(n_a, n_b, t: float):
    """The least overlap of sets of these sizes whose Jaccard similarity is at least ``t``."""
    return np.ceil(t * (n_a + n_b) / (1 + t) - 1e-9).astype(np.int64)


def document_sets(words: np.ndarray, doc: np.ndarray, n: int):
    """Distinct n-grams sorted by document, their documents, and for each document that has any its row, size and signature."""
    g, d = K.grams(words, doc, n)
    o = np.lexsort((g, d))
    g, d = g[o], d[o]
    if len(g):
        first = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
        g, d = g[first], d[first]
    at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(d)])
    sig = K.mix(np.add.reduceat(K.mix(g ^ np.uint64(0x5DEECE66D)), at) + size.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    return g, d, d[at], size, sig


def _emit(n: int, labels: np.ndarray, key_bits: int):
    buckets = len(labels)

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        grams = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, sigs, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            rows = [(int(labels[int(sigs[0]) % buckets]), _MEMBERS, ids.tobytes(), sigs.tobytes(), sizes.astype(np.int32).tobytes())]
            # one incidence row per distinct set
            g = np.concatenate([h[3] for h in held])
            row = np.repeat(np.arange(len(sigs)), sizes)
            new = np.array([s not in seen and not seen.add(s) for s in sigs.tolist()], bool)
            pick = new[row]
            g, row = g[pick], row[pick]
            rank = np.cumsum(new) - 1
            sigs = sigs[new]
            o = np.argsort(g)
            g, row = g[o], rank[row[o]]
            bucket = (g % np.uint64(buckets)).astype(np.int64)
            key = (g // np.uint64(buckets)) & np.uint64((1 << key_bits) - 1)
            o = np.argsort(bucket.astype(np.int32), kind="stable")
            key, row, bucket = key[o], row[o], bucket[o]
            wide = (key_bits + 7) // 8
            packed = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
            for b, lo, hi in _runs(bucket):
                used, local = np.unique(row[lo:hi], return_inverse=True)
                local = local.astype(np.uint16 if len(used) <= 65536 else np.uint32)
                rows.append((int(labels[b]), _INCIDENCE, packed[lo:hi].tobytes(), local.tobytes(), sigs[used].tobytes()))
                if len(rows) >= 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            held.clear()

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = K.string_buffers(batch.column(1))
            for lo, hi in K.slices(off):
                tk = K.tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                g, d, rows, size, sig = document_sets(tk.hash, tk.doc, n)
                held.append((ids[lo:hi][rows].astype(np.int64), sig, size, g))
                grams += len(g)
                if grams >= FLUSH_GRAMS:
                    yield from flush()
                    grams = 0
                    seen = set()
        yield from flush()

    return run


def _incidence(table: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and signatures of the incidence rows of a bucket."""
    keys, sigs = [], []
    for a, c, d in zip(table["a"].to_pylist(), table["c"].to_pylist(), table["d"].to_pylist()):
        own = _u(d, np.uint64)
        raw = _u(a, np.uint8).reshape(-1, wide)
        k = np.zeros((len(raw), 8), np.uint8)
        k[:, :wide] = raw
        keys.append(k.view("<u8").ravel())
        local = _u(c, np.uint16 if len(own) <= 65536 else np.uint32)
        sigs.append(own[local])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(keys), np.concatenate(sigs)


#: an n-gram's number in its bucket has 31 bits: its route and its place there
_ROUTE_BITS = 20
_ROUTES = 1 << _ROUTE_BITS
_PLACES = 1 << (31 - _ROUTE_BITS)


def _numbers(leader: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Numbers below 2**31 for the n-grams to keep, their upper bits, the route, drawn from the first set that holds the n-gram.

    N-grams that the same sets hold mostly have one leader, and the product is blocked by routes, so
    that the overlap of a pair comes together in few blocks. A full route gives its n-grams to the next free numbers.
    """
    out = np.zeros(len(leader), np.uint32)
    at = np.flatnonzero(keep)
    route = (K.mix(leader[at]) >> np.uint64(64 - _ROUTE_BITS)).astype(np.int64)
    o = np.argsort(route, kind="stable")
    r = route[o]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    number = r * _PLACES + place
    over = np.flatnonzero(place >= _PLACES)
    if len(over):
        used = np.sort(number[place < _PLACES])
        gap = np.diff(np.r_[-1, used, 1 << 31]) - 1  # free numbers before each used one and after the last
        before = np.cumsum(gap)
        nth = np.arange(len(over))
        g = np.searchsorted(before, nth, side="right")
        number[over] = np.r_[-1, used][g] + 1 + nth - (before[g] - gap[g])
    out[at[o]] = number.astype(np.uint32)
    return out


def _shared(labels: np.ndarray, key_bits: int, heavy: int):
    """For a bucket of n-grams: those in two sets at least, sent to the buckets of their sets."""
    wide, buckets = (key_bits + 7) // 8, len(labels)

    @K.trimmed
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return _BLOBS.empty_table()
        kind = table["kind"].to_numpy()
        bucket = table["b"][0].as_py()
        out = [tuple(r.values()) for r in table.filter(pa.array(kind == _MEMBERS)).to_pylist()]
        table = table.filter(pa.array(kind == _INCIDENCE))
        key, sig = _incidence(table, wide)
        del table
        if len(key):
            o = np.argsort(key, kind="stable")
            key, sig = key[o], sig[o]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            several = np.repeat(count > 1, count)
            key, sig = key[several], sig[several]
        if len(key):
            o = np.lexsort((sig, key))
            key, sig = key[o], sig[o]
            first = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]
            key, sig = key[first], sig[first]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            keep = count > 1
            rank = _numbers(sig[start], keep)
            # the top bit marks a heavy n-gram
            code = np.repeat(rank | ((count > heavy).astype(np.uint32) << np.uint32(31)), count)
            take = np.repeat(keep, count)
            code, sig = code[take], sig[take]
            o = np.lexsort((sig, sig.view(np.int64) % buckets))
            code, sig = code[o], sig[o]
            at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
            size = np.diff(np.r_[at, len(sig)])
            own = sig[at]
            to = own.view(np.int64) % buckets
            head = np.array([bucket], np.uint64).tobytes()
            for b, x, y in _runs(to):
                lo, hi = at[x], at[y - 1] + size[y - 1]
                out.append((int(labels[b]), _INCIDENCE, head + code[lo:hi].tobytes(), size[x:y].astype(np.uint32).tobytes(), own[x:y].tobytes()))
        return pa.Table.from_batches([_batch(out)]) if out else _BLOBS.empty_table()

    return run


_MEMBER_DDL = "k long, sig long, n int"
_MEMBER = pa.schema([("k", pa.int64()), ("sig", pa.int64()), ("n", pa.int32())])


@K.trimmed
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and its set."""
    for batch in batches:
        for a, c, d in zip(*(batch.column(i) for i in range(3))):
            yield pa.RecordBatch.from_arrays([pa.array(_u(x.as_buffer(), f.type.to_pandas_dtype())) for x, f in zip((a, c, d), _MEMBER)], schema=_MEMBER)


_ROW_DDL = "sig long, n int, h int, light binary, heavy array<long>, copies long"
_ROW = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("h", pa.int32()), ("light", pa.binary()), ("heavy", pa.list_(pa.int64())), ("copies", pa.int64())])


def _rows(t: float):
    """Rows of the matrix: sets with enough shared n-grams for a partner. ``incidence`` and the sizes of sets are of one bucket."""

    def run(incidence: pa.Table, sets: pa.Table) -> pa.Table:
        try:
            return rows(incidence, sets)
        finally:
            K.trim()

    def rows(incidence: pa.Table, sets: pa.Table) -> pa.Table:
        codes, owner = [], []
        for a, c, d in zip(*(incidence[x].to_pylist() for x in ("a", "c", "d"))):
            bucket = int(_u(a[:8], np.uint64)[0])
            code = _u(a[8:], np.uint32).astype(np.int64)
            # bit 62: heavy; then the bucket and the n-gram's number in it
            codes.append(((code >> 31) << 62) | (bucket << 31) | (code & 0x7FFFFFFF))
            owner.append(np.repeat(_u(d, np.int64), _u(c, np.uint32)))
        if not codes or not sets.num_rows:
            return _ROW.empty_table()
        own, n, copies = sets["sig"].to_numpy(), sets["n"].to_numpy(), sets["copies"].to_numpy()
        code, who = np.concatenate(codes), np.concatenate(owner)
        o = np.lexsort((code, who))
        code, who = code[o], who[o]
        lo, hi = np.searchsorted(who, own), np.searchsorted(who, own, side="right")
        need = np.ceil(t * n - 1e-9).astype(np.int64)
        cols: list[list] = [[] for _ in _ROW]
        for i in np.flatnonzero(hi - lo >= np.maximum(need, 1)).tolist():
            mine = code[lo[i] : hi[i]]
            first_heavy = int(np.searchsorted(mine, 1 << 62))
            heavy = mine[first_heavy:] & ((1 << 62) - 1)
            for col, v in zip(cols, (int(own[i]), int(n[i]), len(heavy), mine[:first_heavy].tobytes(), heavy.tolist(), int(copies[i]))):
                col.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW)], schema=_ROW)

    return run


_ENTRY_DDL = "b int, code binary, sig binary, n binary, h binary"
_ENTRY = pa.schema([("b", pa.int32()), ("code", pa.binary()), ("sig", pa.binary()), ("n", pa.binary()), ("h", pa.binary())])


def _entries(labels: np.ndarray):
    """Incidence for the product: the light n-grams of all rows."""

    def flush(code, sig, n, h):
        code, sig, n, h = map(np.concatenate, (code, sig, n, h))
        b = ((code >> (31 - _ROUTE_BITS)) & (_ROUTES - 1)) * len(labels) >> _ROUTE_BITS
        o = np.argsort(b, kind="stable")
        rows = []
        for i, lo, hi in _runs(b[o]):
            p = o[lo:hi]
            rows.append((int(labels[i]), code[p].tobytes(), sig[p].tobytes(), n[p].tobytes(), h[p].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ENTRY)], schema=_ENTRY)

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        many = 0
        for batch in batches:
            for sig, n, h, light in zip(*(batch.column(i).to_pylist() for i in range(4))):
                code = _u(light, np.int64)
                if len(code):
                    for x, v in zip(held, (code, np.full(len(code), sig, np.int64), np.full(len(code), n, np.int32), np.full(len(code), h, np.int32))):
                        x.append(v)
                    many += len(code)
                if many >= 1_000_000:
                    yield flush(*held)
                    held, many = ([], [], [], []), 0
        if many:
            yield flush(*held)

    return run


_PAIR_DDL = "a long, b long, n_a int, n_b int, h_a int, h_b int, light long"
_PAIR = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.int32()) for x in _PAIR_DDL.split(", ")])


def _pairs_of(lists: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each posting list, in pieces; ``lists`` is sorted within a list."""
    for c in np.unique(count).tolist():
        at = start[count == c]
        if c * c // 2 > most:  # long lists a strip at a time
            for s in at.tolist():
                x = lists[s : s + c]
                step = max(1, most // c)
                for i in range(0, c, step):
                    left = np.arange(i, min(i + step, c))
                    l, r = np.nonzero(left[:, None] < np.arange(c)[None, :])
                    yield x[left[l]], x[r]
            continue
        i, j = np.triu_indices(c, 1)
        step = max(1, most // len(i))
        for s in range(0, len(at), step):
            block = lists[at[s : s + step, None] + np.arange(c)]
            yield block[:, i].ravel(), block[:, j].ravel()


def _product(t: float):
    """The product over a bucket of light n-grams: overlaps of all pairs of rows whose sizes allow them."""

    def merge(keys: np.ndarray, hits: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.unique(np.concatenate(waiting), return_counts=True)
        if not len(keys):
            return k, c
        k2, inv = np.unique(np.r_[keys, k], return_inverse=True)
        return k2, np.bincount(inv, np.r_[hits, c], len(k2)).astype(np.int64)

    @K.trimmed
    def run(table: pa.Table) -> pa.Table:
        code, sig, n, h = (np.concatenate([_u(x, k) for x in table[c].to_pylist()] or [np.zeros(0, k)]) for c, k in (("code", np.int64), ("sig", np.int64), ("n", np.int32), ("h", np.int32)))
        if not len(code):
            return _PAIR.empty_table()
        own, first, row = np.unique(sig, return_index=True, return_inverse=True)
        n, h = n[first].astype(np.int64), h[first]
        o = np.lexsort((row, code))
        code, row = code[o], row[o]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        count = np.diff(np.r_[start, len(code)])
        several = count > 1
        keys, hits, waiting, pending = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for l, r in _pairs_of(row, start[several], count[several]):
            fits = np.minimum(n[l], n[r]) >= t * np.maximum(n[l], n[r]) - 1e-9
            waiting.append(l[fits] * len(own) + r[fits])
            pending += int(fits.sum())
            if pending > 4_000_000:
                keys, hits = merge(keys, hits, waiting)
                waiting, pending = [], 0
        if waiting:
            keys, hits = merge(keys, hits, waiting)
        a, b = keys // len(own), keys % len(own)
        cols = [own[a], own[b], n[a], n[b], h[a], h[b], hits]
        return pa.Table.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _PAIR)], schema=_PAIR)

    return run


_LINK_DDL = "a long, b long, n_a int, n_b int, overlap long, more long"
_LINK = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.int32()) for x in _LINK_DDL.split(", ")])


def _incidence_matrix(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), np.float32)
    out[row, column] = 1
    return out


def _components_of(hits: np.ndarray) -> np.ndarray:
    """The least place of each row's component of a symmetric matrix."""
    label = np.arange(len(hits))
    while True:
        new = label.copy()
        for a in range(0, len(hits), 256):
            near = np.where(hits[a : a + 256], label[None, :], len(hits)).min(1, initial=len(hits))
            new[a : a + 256] = np.minimum(label[a : a + 256], near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dense(t: float, wide: bool):
    """A dense block: the sets of one route, two of its parts against each other, or one within itself (``i`` = ``j``).

    Gives, for each set with a link here, the copies that its partners have (``more``), and the least set that hangs together with it (``b``); or all pairs, if ``wide``.
    Pairs that have a lesser route in common belong to that one.
    """

    @K.trimmed
    def run(table: pa.Table) -> pa.Table:
        route, i, j = (table[c][0].as_py() for c in ("route", "i", "j"))
        table = table.sort_by("sig")
        sig, n, part, copies = (table[c].to_numpy() for c in ("sig", "n", "part", "copies"))
        n = n.astype(np.int64)
        codes = [np.concatenate([_u(x, np.int64), np.array(y, np.int64) | (1 << 62)]) for x, y in zip(table["light"].to_pylist(), table["heavy"].to_pylist())]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(left) or not len(right):
            return _LINK.empty_table()
        side = np.zeros(len(sig), np.int64)
        side[left], at_right = np.arange(len(left)), np.zeros(len(sig), np.int64)
        at_right[right] = np.arange(len(right))
        row = np.repeat(np.arange(len(sig)), [len(c) for c in codes])
        code, column, held = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        keep = held[column] > 1
        row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
        o = np.lexsort((row, column))
        row, column = row[o], column[o]
        is_left, is_right = part == i, part == j
        overlap = np.zeros((len(left), len(right)), np.float32)
        # a thousand columns at a time: what a block's sets have in common
        last = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, last, 1024):
            a, b = np.searchsorted(column, [lo, lo + 1024])
            r, c = row[a:b], column[a:b] - lo
            l_ok, r_ok = is_left[r], is_right[r]
            x = _incidence_matrix(side[r[l_ok]], c[l_ok], len(left), 1024)
            y = x if i == j else _incidence_matrix(at_right[r[r_ok]], c[r_ok], len(right), 1024)
            overlap += x @ y.T
        need = required(n[left][:, None], n[right][None, :], t)
        hits = overlap >= need
        # pairs that meet by a lesser route, too
        routes = [[x for x in own if x < route] for own in table["routes"].to_pylist()]
        flat = np.array([x for own in routes for x in own], np.int64)
        if len(flat):
            names, at = np.unique(flat, return_inverse=True)
            r = np.repeat(np.arange(len(sig)), [len(own) for own in routes])
            for lo in range(0, len(names), 1024):
                ok = (at >= lo) & (at < lo + 1024)
                l_ok, r_ok = ok & is_left[r], ok & is_right[r]
                x = _incidence_matrix(side[r[l_ok]], at[l_ok] - lo, len(left), 1024)
                y = _incidence_matrix(at_right[r[r_ok]], at[r_ok] - lo, len(right), 1024)
                hits &= x @ y.T == 0
        if i == j:
            np.fill_diagonal(hits, False)
        if wide:
            a, b = np.nonzero(np.triu(hits) if i == j else hits)
            a, b = left[a], right[b]
            lesser = sig[a] < sig[b]
            a, b, both = np.where(lesser, a, b), np.where(lesser, b, a), overlap[np.nonzero(np.triu(hits) if i == j else hits)]
            cols = [sig[a], sig[b], n[a], n[b], both, np.zeros(len(a))]
        else:
            more = np.zeros(len(sig), np.int64)
            more[left] += (hits @ copies[right].astype(np.float64)).astype(np.int64)
            if i != j:
                more[right] += (copies[left].astype(np.float64) @ hits).astype(np.int64)
                both = np.zeros((len(sig), len(sig)), bool)
                both[np.ix_(left, right)] = hits
                both |= both.T
            else:
                both = hits
            label = _components_of(both)
            a = np.flatnonzero(more > 0)
            cols = [sig[a], sig[label[a]], n[a], n[label[a]], np.zeros(len(a)), more[a]]
        return pa.Table.from_arrays([pa.array(np.asarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _LINK)], schema=_LINK)

    return run


class Sets(NamedTuple):
    """Distinct n-gram sets: who holds which, their sizes, and which are similar."""

    #: k, sig: documents and their sets, each once
    members: DataFrame
    #: sig, n, rep, copies: size of a set, the least document that holds it, and how many do
    classes: DataFrame
    #: a < b, n_a, n_b, overlap: similar sets, but for those that met in dense blocks
    pairs: DataFrame
    #: of dense blocks: a, b, more, see ``_dense``; or pairs like the others
    dense: DataFrame


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, heavy: int = HEAVY, side: int = SIDE, wide: bool = False) -> Sets:
    """The n-gram sets of ``docs``. Documents without any word have none. ``wide`` asks for the pairs of dense blocks, too."""
    spark = docs.sparkSession
    many = docs.count()
    labels = spread(spark, pieces(many, DOCS_PER_BUCKET, 4))
    buckets = len(labels)
    key_bits = min(56, max(24, math.ceil(math.log2(max(2, many) * 600 / buckets)) + 20))
    shared = cut(id_text(docs).mapInArrow(_emit(n, labels, key_bits), _DDL).groupBy("b").applyInArrow(_shared(labels, key_bits, heavy), _DDL))
    members = cut(shared.where(F.col("kind") == _MEMBERS).select("a", "c", "d").mapInArrow(_members, _MEMBER_DDL).distinct())
    classes = cut(members.groupBy("sig").agg(F.first("n").alias("n"), F.min("k").alias("rep"), F.count("*").alias("copies")))
    place = F.pmod("sig", F.lit(buckets)).cast("int")
    bucket_of = place if buckets > 4096 else F.element_at(F.lit(labels.tolist()), place + 1)
    sizes = classes.select(bucket_of.alias("b"), "sig", "n", "copies")
    incidence = shared.where(F.col("kind") == _INCIDENCE)
    rows = cut(incidence.groupBy("b").cogroup(sizes.groupBy("b")).applyInArrow(_rows(threshold), _ROW_DDL))

    # by light n-grams
    counts = rows.mapInArrow(_entries(labels[:_ROUTES]), _ENTRY_DDL).groupBy("b").applyInArrow(_product(threshold), _PAIR_DDL)
    need = F.ceil((F.col("n_a") + F.col("n_b")) * threshold / (1 + threshold) - 1e-9)
    alone = lambda h, n: F.col(h) >= F.greatest(F.ceil(F.col(n) * threshold - 1e-9), F.lit(1))
    summed = counts.groupBy("a", "b", "n_a", "n_b", "h_a", "h_b").agg(F.sum("light").alias("light")).where(F.col("light") + F.least("h_a", "h_b") >= need)
    summed = cut(summed)
    plain = F.least("h_a", "h_b") == 0
    hard = rows.where("h > 0").select("sig", "heavy")
    open_ = (
        summed.where(~plain)
        .join(hard.select(F.col("sig").alias("a"), F.col("heavy").alias("x")), "a")
        .join(hard.select(F.col("sig").alias("b"), F.col("heavy").alias("y")), "b")
        .withColumn("both", F.size(F.array_intersect("x", "y")))
        # what may match by heavy n-grams alone and has one in common meets in a dense block
        .where(~(alone("h_a", "n_a") & alone("h_b", "n_b") & (F.col("both") > 0)))
    )
    done = summed.where(plain).select("a", "b", "n_a", "n_b", F.col("light").alias("overlap"))
    pairs = cut(done.unionByName(open_.select("a", "b", "n_a", "n_b", (F.col("light") + F.col("both")).cast("long").alias("overlap"))).where(F.col("overlap") >= need))

    # by heavy ones: each route's sets in parts, each part with each other one; there are 2 ** _ROUTE_BITS routes at most
    route = lambda c: F.shiftright(c, 31 - _ROUTE_BITS).bitwiseAND(F.lit(_ROUTES - 1)).cast("int")
    routed = rows.where(alone("h", "n")).withColumn("routes", F.array_distinct(F.transform("heavy", route)))
    crowds = routed.select(F.explode("routes").alias("route")).groupBy("route").agg(F.count("*").alias("m")).where("m > 1").select("route", F.ceil(F.col("m") / side).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    met = routed.withColumn("route", F.explode("routes")).join(F.broadcast(crowds), "route").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = met.select("route", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sig", "n", "copies", "light", "heavy", "routes")
    dense = cut(blocks.groupBy("route", "i", "j").applyInArrow(_dense(threshold, wide), _LINK_DDL))
    for done_with in (shared, rows, summed):
        forget(done_with)
    return Sets(members.select("k", "sig"), classes, pairs, dense)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``a, b``): ``node, label``, the label being the least node.

    Labels go to neighbours and then jump along themselves until none changes, so the rounds grow with
    the logarithm of a component's diameter in practice. Each round's labels are written to the scratch folder, and the last round's go.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    old = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        labels = old.select("node", "label")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.alias("s").join(labels.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("label") == F.col("at"), "left")
        new = cut(jump.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        forget(old)
        if new.where("label <> old").isEmpty():
            forget(both)
            return new.select("node", "label")
        old = new


def representatives(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, heavy: int = HEAVY, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """Membership (``doc_id, rep``: the least document with the same n-gram set) and pairs of representatives (``rep_a, rep_b, overlap, jaccard``).

    Together these are all pairs of similar documents: two documents are similar where they have one representative (then the similarity is
    1) or where theirs are a pair. A group of very many near copies, no two of which are equal, makes as many rows as it has pairs; ``linked`` doesn't. Odd input is taken as there.
    """
    s = similar_sets(docs, n, threshold, heavy, side, wide=True)
    rep = s.classes.select("sig", "rep")
    both = s.pairs.unionByName(s.dense.drop("more")).join(rep.select(F.col("sig").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("sig").alias("b"), F.col("rep").alias("y")), "b")
    pairs = both.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "overlap", (F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("jaccard"))
    return s.members.join(rep, "sig").select(F.col("k").alias("doc_id"), "rep"), pairs


def linked(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, heavy: int = HEAVY, side: int = SIDE) -> DataFrame:
    """``doc_id, class_id, n_links`` for each document that is similar to another, ``threshold`` or more.

    ``n_links`` is the number of documents that it is similar to, copies counted one by one. A class is what links connect, and
    ``class_id`` the least ``doc_id`` in it. Documents without a link are left out.

    Defined results: rows with a null ``doc_id`` or ``text`` take no part; nor do texts without a word. A text of fewer than
    ``n`` words has one n-gram, all of its words; texts may be as long as a cell holds. Rows that repeat ``doc_id`` and n-grams are one. A ``doc_id`` with several
    texts is in one class with what any of them is similar to, and its links, those between its own texts too, add up. Other columns play no part; an
    empty table gives no rows.
    """
    s = similar_sets(docs, n, threshold, heavy, side)
    # a document with several sets holds them together
    own = s.members.groupBy("k").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a <> z").select("k", "a")
    several = s.members.join(own, "k").where("sig <> a").select("a", F.col("sig").alias("b"))
    parts = components(s.pairs.select("a", "b").unionByName(several).unionByName(s.dense.select("a", "b")))
    least = parts.join(s.classes.select(F.col("sig").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    copies = s.classes.select(F.col("sig").alias("b"), "copies")
    each = s.pairs.select("a", "b").unionByName(s.pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies, "b").select("a", F.col("copies").alias("more"))
    each = each.unionByName(s.dense.select("a", "more")).groupBy(F.col("a").alias("sig")).agg(F.sum("more").alias("more"))
    info = s.classes.join(parts.select(F.col("node").alias("sig"), "label"), "sig", "left").where("copies > 1 or label is not null").join(least, "label", "left").join(each, "sig", "left")
    info = cut(info.select("sig", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    # a set that very many documents hold is a skewed key here; the join is split by AQE, and only its rows are ever in a task
    return s.members.join(info, "sig").groupBy(F.col("k").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links")).where("n_links > 0")


def drop_near_copies(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """``docs`` with one document of each class of ``linked``: the one with the least ``doc_id``.

    Columns and other rows stay as they are, rows with a null ``doc_id`` or ``text`` among them; of rows that repeat a
    ``doc_id``, all stay or all go. An empty table stays empty.
    """
    gone = linked(docs, n, threshold, heavy).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
