"""Suffix and LCP arrays by induced sorting in external memory.

The suffixes that start a rising run right after a falling one (S*) are sorted first: by induction over
their substrings, which gives them names, and by recursion over the names. Two sweeps then induce
all other suffixes. Both sweeps work through a priority queue whose keys are first symbols: a sweep takes the
tuples (suffix, common prefix with the tuple before it, symbols ahead of it) off the queue in order of symbols, and puts the
tuple of the preceding suffix back in. As tuples of one symbol leave in the order they came, the
queue is a file with a region per symbol; pushes and pops move whole blocks. The common prefix of a pushed
tuple is one more than the least common prefix met since the last push to its symbol, so LCP values
come along with the suffixes on every level. The symbols ahead tell where a tuple goes next; only where they have run out, once in several
pushes, a block's tuples look them up in the text, in order of place.

Everything that is as long as the text (queues, digits, types, runs, S* suffixes, names, their order, and the result) lives in files from
``memory`` entries on, which are mapped and worked through in blocks; in memory there are blocks and a few numbers per symbol.

Symbols of a large alphabet are written as two digits, to bound the number of regions. A string of
names that is short, or that fits in ``memory`` and no longer shrinks (a word repeated many times names itself again), is ordered by prefix
doubling in memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 14
SHORT = 30_000
ALPHABET = 700
_FAR = np.int32(2**31 - 1)


class Store:
    """Gives arrays in memory, or in files of ``folder`` from ``memory`` entries on."""

    def __init__(self, folder: str | None = None, memory: int = 1 << 23):
        self.memory = memory
        self._dir = tempfile.TemporaryDirectory(prefix="induced-", dir=folder or None)
        self.files = 0

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, kind)
        self.files += 1
        path = os.path.join(self._dir.name, f"{self.files}.bin")
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)  # the space goes with the array
        return out

    def close(self) -> None:
        self._dir.cleanup()


class Column:
    """An array that grows at its end, in a file of the store from ``memory`` entries on."""

    def __init__(self, store: Store, kind):
        self.store, self.kind = store, np.dtype(kind)
        self.n = 0
        self.held: list[np.ndarray] = []
        self.file = None

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        self.held.append(np.ascontiguousarray(x, self.kind))
        if self.n > self.store.memory:
            if self.file is None:
                self.store.files += 1
                self.file = open(os.path.join(self.store._dir.name, f"{self.store.files}.bin"), "w+b")
            for part in self.held:
                part.tofile(self.file)
            self.held.clear()

    def array(self) -> np.ndarray:
        """All of it; nothing is added afterwards."""
        if self.file is None:
            return np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        with self.file as f:
            f.flush()
            out = np.memmap(f, self.kind, "r+", shape=(self.n,))
        os.unlink(f.name)
        return out


class Ahead:
    """The symbols ahead of suffixes, several to a number, the nearest in the lowest bits; 0 where none are left."""

    def __init__(self, text: np.ndarray, size: int):
        self.text = text
        self.bits = max(1, int(size - 1).bit_length())
        self.many = max(1, 62 // self.bits)
        self.mask = (1 << self.bits) - 1

    def filled(self, pos: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """``ahead``, looked up where it has run out. The end of the text, whose symbol is 0, is ahead of nothing."""
        out = np.flatnonzero((ahead == 0) & (pos > 0))
        if len(out):
            ahead = ahead.copy()
            p = pos[out]
            o = np.argsort(p)
            p, out = p[o], out[o]
            got = np.zeros(len(p), np.int64)
            for i in range(self.many):
                there = p > i
                got[there] |= self.text[p[there] - 1 - i].astype(np.int64) << (i * self.bits)
            ahead[out] = got
        return ahead


class BucketQueue:
    """A monotone priority queue of (suffix, common prefix, symbols ahead) tuples with one region per first symbol."""

    def __init__(self, counts: np.ndarray, store: Store):
        ends = np.cumsum(counts)
        self.start = ends - counts
        self.head, self.tail = self.start.copy(), self.start.copy()
        n = int(ends[-1]) if len(ends) else 0
        self.pos, self.lcp, self.ahead = store.array(n, np.int64), store.array(n, np.int32), store.array(n, np.int64)
        #: the least common prefix met since the last push to each symbol; -1: there was none
        self.low = np.full(len(counts), -1, np.int32)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        a, b = int(self.head[symbol]), int(self.tail[symbol])
        if a == b:
            return None
        b = min(b, a + BLOCK)
        self.head[symbol] = b
        return np.asarray(self.pos[a:b]), np.asarray(self.lcp[a:b]), np.asarray(self.ahead[a:b])

    def follow(self, symbols: Ahead, pos: np.ndarray, lcp: np.ndarray, ahead: np.ndarray, takes) -> None:
        """Pushes the preceding suffixes of a popped block, where ``takes`` says that they are of this sweep's type."""
        lcp = lcp.astype(np.int32, copy=False)
        ahead = symbols.filled(pos, ahead)
        before = ahead & symbols.mask
        src = np.flatnonzero((pos > 0) & takes(before))
        if not len(src):
            np.minimum(self.low, lcp.min(), out=self.low)
            return
        symbol = before[src]
        o = np.argsort(symbol, kind="stable")
        symbol, src = symbol[o], src[o]
        first = np.empty(len(src), bool)
        first[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=first[1:])
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(src)))
        own = symbol[at]
        prefix = np.minimum.accumulate(lcp)
        value = np.empty(len(src), np.int32)
        value[first] = np.minimum(self.low[own], prefix[src[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = _range_min(lcp, src[rest - 1] + 1, src[rest])
        slot = np.repeat(self.tail[own] - at, count) + np.arange(len(src))
        self.pos[slot] = pos[src] - 1
        self.lcp[slot] = value + 1
        self.ahead[slot] = ahead[src] >> symbols.bits
        self.tail[own] += count
        np.minimum(self.low, prefix[-1], out=self.low)
        suffix = np.append(np.minimum.accumulate(lcp[::-1])[::-1], _FAR)
        self.low[own] = suffix[src[at + count - 1] + 1]


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of v[lo..hi], both inclusive."""
    size = hi - lo + 1
    out = np.empty(len(lo), v.dtype)
    level, table, width = 0, v, 1
    rank = np.frexp(size.astype(np.float64))[1] - 1
    top = int(rank.max())
    while True:
        m = np.flatnonzero(rank == level)
        if len(m):
            out[m] = np.minimum(table[lo[m]], table[hi[m] - width + 1])
        if level == top:
            return out
        table = np.minimum(table[:-width], table[width:])
        level, width = level + 1, width * 2


def _common(text: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many symbols the suffixes at ``p`` and ``q`` have in common, ``most`` at most."""
    n = len(text)
    out = np.zeros(len(p), np.int64)
    room = n - np.maximum(p, q)
    if most is not None:
        room = np.minimum(room, most)
    live = np.flatnonzero(room > 0)
    step = 0
    while len(live):
        same = text[p[live] + step] == text[q[live] + step]
        step += 1
        live = live[same]
        out[live] = step
        live = live[room[live] > step]
    return out


def _blocks(n: int, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + most)) for a in range(0, n, most))


def _sweep(text: np.ndarray, size: int, seeds: np.ndarray, seed_lcp: np.ndarray | None, is_s: np.ndarray, run: np.ndarray, store: Store):
    """Both sweeps: suffix and LCP array of ``text`` from its S* suffixes, sorted by first symbol at least. Without ``seed_lcp`` they have nothing in common."""
    n = len(text)
    n_l, n_s, of_seeds = (np.zeros(size, np.int64) for _ in range(3))
    for a, b in _blocks(n):
        n_l += np.bincount(text[a:b][~is_s[a:b]], minlength=size)
        n_s += np.bincount(text[a:b][is_s[a:b]], minlength=size)
    for a, b in _blocks(len(seeds)):
        of_seeds += np.bincount(text[seeds[a:b]], minlength=size)
    seed_at = np.r_[0, np.cumsum(of_seeds)]
    symbols = Ahead(text, size)
    up = BucketQueue(n_l, store)
    for c in range(size):
        last = -1
        while (block := up.pop(c)) is not None:
            up.follow(symbols, *block, lambda before, c=c: before >= c)
            last = int(block[0][-1])
        for a in range(seed_at[c], seed_at[c + 1], BLOCK):
            b = min(a + BLOCK, seed_at[c + 1])
            pos = np.asarray(seeds[a:b])
            lcp = np.zeros(b - a, np.int32) if seed_lcp is None else seed_lcp[a:b].astype(np.int32)
            if a == seed_at[c]:
                lcp[0] = min(int(run[last]), int(run[pos[0]])) if last >= 0 else 0
            up.follow(symbols, pos, lcp, np.zeros(b - a, np.int64), lambda before, c=c: before > c)
    down = BucketQueue(n_s, store)
    # the end of the text has nothing behind it that could induce it
    down.pos[0], down.lcp[0] = n - 1, 0
    down.tail[0] += 1
    sa, out = store.array(n, np.int64), store.array(n, np.int32)
    ends = np.cumsum(n_l + n_s)
    for c in range(size - 1, -1, -1):
        last, after = -1, 0
        while (block := down.pop(c)) is not None:
            down.follow(symbols, *block, lambda before, c=c: before <= c)
            last = int(block[0][-1])
        l_lo, l_hi = int(up.start[c]), int(up.tail[c])
        for b in range(l_hi, l_lo, -BLOCK):
            a = max(l_lo, b - BLOCK)
            pos = np.asarray(up.pos[a:b])[::-1]
            near = np.empty(b - a, np.int32)
            near[1:] = np.asarray(up.lcp[a + 1 : b])[::-1]
            near[0] = after if b < l_hi else (min(int(run[last]), int(run[pos[0]])) if last >= 0 else 0)
            after = int(up.lcp[a])
            down.follow(symbols, pos, near, np.asarray(up.ahead[a:b])[::-1], lambda before, c=c: before < c)
        # this symbol's part of the result: falling suffixes, then rising ones
        s_lo, s_hi = int(down.start[c]), int(down.tail[c])
        lo = int(ends[c]) - (s_hi - s_lo) - (l_hi - l_lo)
        mid = lo + l_hi - l_lo
        for a, b in _blocks(mid - lo):
            sa[lo + a : lo + b], out[lo + a : lo + b] = up.pos[l_lo + a : l_lo + b], up.lcp[l_lo + a : l_lo + b]
        if s_hi > s_lo:
            for a, b in _blocks(s_hi - s_lo):
                sa[mid + a : mid + b] = down.pos[s_hi - b : s_hi - a][::-1]
            for a, b in _blocks(s_hi - s_lo - 1):
                out[mid + 1 + a : mid + 1 + b] = down.lcp[s_hi - b : s_hi - a][::-1]
            out[mid] = min(int(run[sa[mid - 1]]), int(run[sa[mid]])) if mid > lo else 0
        if mid > lo:
            out[lo] = 0
    return sa, out


def _by_doubling(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    ranks = []
    key = text.astype(np.int64)
    k = 1
    while True:
        o = np.argsort(key, kind="stable")
        s = key[o]
        new = np.r_[0, np.cumsum(s[1:] != s[:-1])]
        rank = np.empty(n, np.int64)
        rank[o] = new
        ranks.append(rank.astype(np.int32))
        if new[-1] == n - 1:
            break
        far = np.zeros(n, np.int64)
        if k < n:
            far[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + far
        k *= 2
    lcp = np.zeros(n, np.int32)
    p, q = o[:-1].copy(), o[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        ok = np.flatnonzero((p + width <= n) & (q + width <= n))
        r = ranks[level]
        ok = ok[r[p[ok] % n] == r[q[ok] % n]]
        ok = ok[np.maximum(p[ok], q[ok]) < n]
        got[ok] += width
        p[ok] += width
        q[ok] += width
    lcp[1:] = got
    return o, lcp


def _types(text: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each suffix is less than the next, how long the run of its first symbol is, and where S* suffixes begin; from the end, by blocks."""
    n = len(text)
    is_s, run = store.array(n, bool), store.array(n, np.int32)
    is_s[n - 1], run[n - 1] = True, 1
    turn, rising = n - 1, False  # the last place looked at where the next symbol differs, and how
    for a, b in reversed(list(_blocks(n - 1))):
        part = text[a : b + 1].astype(np.int64)
        step = np.sign(part[1:] - part[:-1])
        at = np.where(step != 0, np.arange(a, b), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        far = at == n
        is_s[a:b] = np.where(far, rising, step[np.where(far, 0, at - a)] > 0)
        run[a:b] = np.where(far, turn, at) - np.arange(a, b) + 1
        if not far[0]:
            turn, rising = int(at[0]), bool(step[at[0] - a] > 0)
    star = Column(store, np.int64)
    for a, b in _blocks(n - 1):
        star.add(np.flatnonzero(is_s[a + 1 : b + 1] & ~is_s[a:b]) + a + 1)
    star = star.array()
    return is_s, run, star if len(star) else np.array([n - 1])


def _by_first_symbol(text: np.ndarray, star: np.ndarray, size: int, store: Store) -> np.ndarray:
    """The S* suffixes by first symbol, block by block."""
    count = np.zeros(size, np.int64)
    for a, b in _blocks(len(star)):
        count += np.bincount(text[star[a:b]], minlength=size)
    free = np.cumsum(count) - count
    out = store.array(len(star), np.int64)
    for a, b in _blocks(len(star)):
        own = np.asarray(star[a:b])
        first = text[own]
        o = np.argsort(first, kind="stable")
        first = first[o]
        at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        many = np.diff(np.r_[at, len(first)])
        out[np.repeat(free[first[at]] - at, many) + np.arange(len(o))] = own[o]
        free[first[at]] += many
    return out


def _induce(text: np.ndarray, size: int, units: int, store: Store, depth: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    is_s, run, star = _types(text, store)
    many = len(star)
    # sort the S* substrings by induction and name them
    sa, _ = _sweep(text, size, _by_first_symbol(text, star, size, store), None, is_s, run, store)
    number = store.array(n, np.int64)
    for a, b in _blocks(many):
        number[star[a:b]] = np.arange(a, b) + 1
    order = Column(store, np.int64)
    for a, b in _blocks(n):
        x = number[sa[a:b]]
        order.add(x[x > 0] - 1)
    del sa, number
    order = order.array()

    def length(i: np.ndarray) -> np.ndarray:
        return np.where(i + 1 < many, star[np.minimum(i + 1, many - 1)] - star[i] + 1, 1)

    name = store.array(many, np.int64)
    top, before = 0, None
    for a, b in _blocks(many):
        q = np.asarray(order[a:b])
        p = np.r_[q[0] if before is None else before, q[:-1]]
        l_p, l_q = length(p), length(q)
        same = (l_p == l_q) & (_common(text, star[p], star[q], np.maximum(l_p, l_q)) >= l_p)
        if before is None:
            same[0] = True
        names = top + np.cumsum(~same)
        name[q] = names
        top, before = int(names[-1]), q[-1]
    lcp = store.array(many, np.int32)
    if top < many - 1:
        del order
        order, found = suffix_array(name, store, depth + 1, units)
    else:
        found = None
    seeds = store.array(many, np.int64)
    before = None
    for a, b in _blocks(many):
        q = np.asarray(order[a:b])
        seeds[a:b] = star[q]
        p = np.r_[q[0] if before is None else before, q[:-1]]
        if found is None:
            lcp[a:b] = _common(text, star[p], star[q])
        else:
            m = found[a:b].astype(np.int64)
            if before is None:
                m[0] = 0
            lcp[a:b] = star[p + m] - star[p] + _common(text, star[p + m], star[q + m])
        if before is None:
            lcp[0] = 0
        before = q[-1]
    return _sweep(text, size, seeds, lcp, is_s, run, store)


def suffix_array(text: np.ndarray, store: Store, depth: int = 0, parent: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` and the common prefix of each suffix with the one before it.

    ``text`` holds integers from 0 on; its last one is 0 and 0 is nowhere else.
    """
    n = len(text)
    if n <= 2 or depth and (n <= SHORT or n <= store.memory and (depth > 12 or parent is not None and n > 0.8 * parent)):
        return _by_doubling(np.asarray(text))
    most = max(int(text[a:b].max()) for a, b in _blocks(n)) + 1
    if most <= ALPHABET:
        t = store.array(n, np.int32)
        for a, b in _blocks(n):
            t[a:b] = text[a:b]
        return _induce(t, most, n, store, depth)
    base = 2
    while base * (base - 1) < most - 1:
        base += 1
    digits = store.array(2 * n - 1, np.int32)
    for a, b in _blocks(n - 1):
        t = text[a:b].astype(np.int64) - 1
        high, low = t // (base - 1) + 1, t % (base - 1) + 1
        low += low >= high  # the digits of one symbol differ
        digits[2 * a : 2 * b : 2], digits[2 * a + 1 : 2 * b : 2] = high, low
    digits[2 * n - 2] = 0
    sa, lcp = _induce(digits, base + 1, n, store, depth)
    out, common = Column(store, np.int64), Column(store, np.int32)
    least = _FAR  # since the last suffix that begins with a whole symbol
    for a, b in _blocks(2 * n - 1):
        part, own = np.asarray(sa[a:b]), np.asarray(lcp[a:b])
        even = np.flatnonzero(part % 2 == 0)
        out.add(part[even] // 2)
        if not len(even):
            least = min(least, own.min())
            continue
        value = np.minimum.reduceat(own[: even[-1] + 1], np.r_[0, even[:-1] + 1])
        value[0] = min(least, value[0])
        common.add(value // 2)
        least = own[even[-1] + 1 :].min() if even[-1] + 1 < len(own) else _FAR
    common = common.array()
    common[0] = 0
    return out.array(), common
