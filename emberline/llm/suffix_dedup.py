"""Passages of at least ``K`` words that occur again in the corpus, found with suffix arrays.

A passage repeats exactly where each of its windows of ``K`` words occurs twice, so windows are what is
compared; they come together in shards by content:

1. Each window is anchored at its least-hashed run of ``ANCHOR`` words. Equal windows have equal anchors,
   so only windows whose anchor occurs twice can repeat, and one shard holds all windows of an anchor.
2. The text around such anchors goes to the anchors' shards, as chunks of about 70 words. Equal chunks are collapsed before: a
   shard gets each kind with its least place, and the places of all go another way, so that a passage of a third of all documents is gathered nowhere.
3. An anchor with one kind of chunk is settled; the kinds of chunk of
   all other anchors of a shard are laid end to end, and their suffix array (``induced``) with its LCP
   values gives the groups of equal windows. In each group the occurrence with the least ``(doc_id, position)`` stays.
4. The places of chunks are joined with what was found for their kinds. What isn't the first occurrence is a
   duplicate; Spark merges them to spans of words.

Words are compared by 32 bits of their hashes, whole texts and all documents being searched.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm import induced
from emberline.llm import textkit as K
from emberline.llm.common import cut, id_text, pieces, spread

MIN_WORDS = 50
ANCHOR = 16
DOCS_PER_BUCKET = 16000
DOCS_PER_SHARD = 4000
MEMORY = 1 << 23


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])
    return out


def anchors(words: np.ndarray, doc: np.ndarray, k: int, anchor: int):
    """Runs of windows with one anchor: document, first window, number of windows, and the anchor's hash."""
    n = len(words) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    h = np.zeros(len(words) - anchor + 1, np.uint64)
    for j in range(anchor):
        h = h * K.GRAM_BASE + words[j : j + len(h)]
    h = K.mix(h)
    place = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    best = (_slide(place, k - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    good = np.flatnonzero(doc[:n] == doc[k - 1 :])
    if not len(good):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    best = best[good]
    at = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (good[1:] != good[:-1] + 1)])
    count = np.diff(np.r_[at, len(good)])
    return doc[good[at]], good[at], count, h[best[at]]


_DDL = "b int, a binary, c binary, d binary, e binary"
_BLOB = pa.schema([("b", pa.int32()), *((x, pa.binary()) for x in "acde")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)


def _split(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    o = np.argsort(to, kind="stable")
    s = to[o]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    for b, lo, hi in zip(s[at].tolist(), at.tolist(), [*at[1:].tolist(), len(s)]):
        yield b, o[lo:hi]


#: kinds of rows (``a``): anchors for the bucket of their hash; anchors that are known to repeat, in any bucket; marks of these for their bucket
_ASKED, _KNOWN, _MARK = b"\0", b"\1", b"\2"


def _emit_anchors(k: int, anchor: int, labels: np.ndarray):
    """Anchors with their documents. What repeats within a flush is known to: to the anchor's bucket goes only a mark, so a hot anchor is nowhere gathered."""
    buckets = np.uint64(len(labels))

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        many = 0

        def flush() -> pa.RecordBatch:
            h, ids, ths = (np.concatenate([x[i] for x in held]) for i in range(3))
            o = np.argsort(h, kind="stable")
            h, ids, ths = h[o], ids[o], ths[o]
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            several = again.copy()
            several[:-1] |= again[1:]
            own = np.flatnonzero(several)
            rows = []
            if len(own):
                rows.append((int(labels[int(h[own[0]] % buckets)]), _KNOWN, h[own].tobytes(), ids[own].tobytes(), ths[own].tobytes()))
            alone, first = np.flatnonzero(~several), np.flatnonzero(several & ~again)
            for which, kind in ((alone, _ASKED), (first, _MARK)):
                for b, o in _split((h[which] % buckets).astype(np.int64)):
                    o = which[o]
                    rows.append((int(labels[b]), kind, h[o].tobytes(), *((ids[o].tobytes(), ths[o].tobytes()) if kind == _ASKED else (b"", b""))))
            held.clear()
            return _batch(rows)

        for batch in batches:
            ids, th = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            buf, off = K.string_buffers(batch.column(2))
            for lo, hi in K.slices(off):
                tk = K.tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                doc, _, _, h = anchors(tk.hash, tk.doc, k, anchor)
                held.append((h, ids[lo:hi][doc], th[lo:hi][doc]))
                many += len(h)
                if many >= 1_000_000:
                    yield flush()
                    many = 0
        if many:
            yield flush()

    return run


def _cat(column: pa.ChunkedArray, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


_LIST = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("list", pa.binary())])


@K.trimmed
def _repeated(table: pa.Table) -> pa.Table:
    """The anchors of a bucket that occur twice at least, by document."""
    asked, known, marks = (table.filter(pc.equal(table["a"], pa.scalar(kind))) for kind in (_ASKED, _KNOWN, _MARK))
    h, ids, th = _cat(asked["c"], np.uint64), _cat(asked["d"], np.int64), _cat(asked["e"], np.int64)
    o = np.argsort(h, kind="stable")
    h, ids, th = h[o], ids[o], th[o]
    keep = np.isin(h, _cat(marks["c"], np.uint64))
    keep[1:] |= h[1:] == h[:-1]
    keep[:-1] |= h[1:] == h[:-1]
    h, ids, th = np.r_[h[keep], _cat(known["c"], np.uint64)], np.r_[ids[keep], _cat(known["d"], np.int64)], np.r_[th[keep], _cat(known["e"], np.int64)]
    if not len(h):
        return _LIST.empty_table()
    o = np.lexsort((h, th, ids))
    h, ids, th = h[o], ids[o], th[o]
    at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])])
    ends = np.r_[at[1:], len(h)]
    lists = pa.array([h[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist())], pa.binary())
    return pa.Table.from_arrays([pa.array(ids[at]), pa.array(th[at]), lists], schema=_LIST)


_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def chunk_hashes(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each of the chunks that ``words`` are laid end to end of: differences of running polynomials."""
    at = np.cumsum(size) - size
    out = np.empty((len(size), 2), np.int64)
    for i, base in enumerate(_BASES.tolist()):
        w = K.mix(words.astype(np.uint64) + np.uint64(base))
        place = np.arange(len(w)) - np.repeat(at, size)
        w = w * K.powers(base, int(size.max()))[place]
        out[:, i] = K.mix(np.add.reduceat(w, at) + size.astype(np.uint64)).view(np.int64)
    return out


#: what is told of a kind of chunk: anchor, hashes, least place (id, text hash, first word), words, occurrences
_KIND = 8
_PLACE_DDL = "g long, h long, k long, th long, at long"
_PLACE = pa.schema([(x.split()[0], pa.int64()) for x in _PLACE_DDL.split(", ")])


def _emit_chunks(k: int, anchor: int, labels: np.ndarray):
    """Chunks around the anchors that a document's list names. Each kind of chunk in a flush once, to the shard of its anchor
    (d: see _KIND, c: its words), and where it occurs (a, in any shard): hashes, id, text hash, first word."""

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        many = 0

        def flush() -> pa.RecordBatch:
            h, place, size = (np.concatenate([x[i] for x in held]) for i in range(3))
            words = np.concatenate([x[3] for x in held])
            held.clear()
            kind = chunk_hashes(words, size)
            at = np.cumsum(size) - size
            o = np.lexsort((place[:, 2], place[:, 1], place[:, 0], kind[:, 1], kind[:, 0]))
            first = np.flatnonzero(np.r_[True, (kind[o][1:] != kind[o][:-1]).any(1)])
            count = np.diff(np.r_[first, len(o)])
            one = o[first]
            meta = np.column_stack([h[one].view(np.int64), kind[one], place[one], size[one], count])
            rows = [(int(labels[0]), np.column_stack([kind, place]).tobytes(), b"", b"", b"")]
            for b, own in _split((h[one] // np.uint64(7) % np.uint64(len(labels))).astype(np.int64)):
                n = size[one[own]]
                pick = np.repeat(at[one[own]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                rows.append((int(labels[b]), b"", words[pick].tobytes(), np.ascontiguousarray(meta[own]).tobytes(), b""))
            return _batch(rows)

        for batch in batches:
            ids, th = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            lists = batch.column(3).to_pylist()
            buf, off = K.string_buffers(batch.column(2))
            for lo, hi in K.slices(off):
                tk = K.tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                doc, start, count, h = anchors(tk.hash, tk.doc, k, anchor)
                wanted = np.concatenate([np.frombuffer(x, np.uint64) for part in lists[lo:hi] for x in part] or [np.zeros(0, np.uint64)])
                take = np.flatnonzero(np.isin(h, wanted))
                if not len(take):
                    continue
                doc, start, count, h = doc[take], start[take], count[take], h[take]
                first = np.searchsorted(tk.doc, doc)
                size = count + k - 1
                pick = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                held.append((h, np.stack([ids[lo:hi][doc], th[lo:hi][doc], start - first], 1), size, tk.hash[pick].astype(np.uint32)))
                many += len(pick)
                if many >= 4_000_000:
                    yield flush()
                    many = 0
        if many:
            yield flush()

    return run


@K.trimmed
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each occurrence of a chunk."""
    for batch in batches:
        for a in batch.column(0):
            x = np.frombuffer(a.as_buffer(), np.int64).reshape(-1, 5)
            for at in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x[at : at + 100_000].T], schema=_PLACE)


#: a run of windows of a kind of chunk: its first and last, and where the first of them stays
_RUN_DDL = "g long, h long, lo long, hi long, fk long, fth long, fat long"
_RUN = pa.schema([(x.split()[0], pa.int64()) for x in _RUN_DDL.split(", ")])


def spill_folder() -> str | None:
    """Where this machine's executor keeps its own shuffle and spill files; they end with the task."""
    for name in ("SPARK_EXECUTOR_DIRS", "SPARK_LOCAL_DIRS", "LOCAL_DIRS"):
        for path in os.environ.get(name, "").replace(":", ",").split(","):
            if path and os.path.isdir(path):
                return path
    return None


def _best(words: np.ndarray, size: np.ndarray, lead: np.ndarray, anchor: np.ndarray, k: int, memory: int) -> np.ndarray:
    """Where each window of some kinds of chunk, laid end to end, occurs first: id, text hash, word. All kinds of an anchor are among them."""
    at = np.cumsum(size) - size
    o = np.argsort(anchor, kind="stable")
    start = np.flatnonzero(np.r_[True, anchor[o][1:] != anchor[o][:-1]])
    same = np.diff(np.r_[start, len(o)])
    mixed = np.zeros(len(size), bool)
    mixed[o] = np.repeat(same > 1, same)
    # group of each window of each kind
    wins = size - k + 1
    w_at = np.cumsum(wins) - wins
    total = int(wins.sum())
    group = np.arange(total)
    which = np.flatnonzero(mixed)
    if len(which):
        n = size[which] + 1  # and a separator
        lay = np.cumsum(n) - n
        length = int(n.sum())
        text = np.ones(length + 1, np.int64)
        body = np.repeat(lay - (np.cumsum(size[which]) - size[which]), size[which]) + np.arange(int(size[which].sum()))
        pick = np.repeat(at[which] - (np.cumsum(size[which]) - size[which]), size[which]) + np.arange(len(body))
        text[body] = np.unique(words[pick], return_inverse=True)[1] + 2
        text[-1] = 0
        store = induced.Store(spill_folder(), memory)
        try:
            sa, lcp = induced.suffix_array(text, store)
            number = np.cumsum(np.asarray(lcp) < k)
            of = np.empty(len(sa), np.int64)
            of[sa] = number
        finally:
            store.close()
        del sa, lcp, number, text
        n_w = wins[which]
        src = np.repeat(lay - (np.cumsum(n_w) - n_w), n_w) + np.arange(int(n_w.sum()))
        dst = np.repeat(w_at[which] - (np.cumsum(n_w) - n_w), n_w) + np.arange(len(src))
        group[dst] = total + of[src]
    # the first occurrence in each group: that of a kind is its least place
    owner = np.repeat(np.arange(len(size)), wins)
    offset = np.arange(total) - w_at[owner]
    o = np.lexsort((lead[owner, 2] + offset, lead[owner, 1], lead[owner, 0], group))
    new = np.r_[True, group[o][1:] != group[o][:-1]]
    best = np.empty(total, np.int64)
    best[o] = np.repeat(o[new], np.diff(np.r_[np.flatnonzero(new), total]))
    return np.stack([lead[owner[best], 0], lead[owner[best], 1], lead[owner[best], 2] + offset[best]], 1)


def _parts(size: np.ndarray, anchor: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Kinds of chunk by whole anchors, about ``most`` words at once."""
    o = np.argsort(anchor, kind="stable")
    start = np.flatnonzero(np.r_[True, anchor[o][1:] != anchor[o][:-1]])
    part = np.cumsum(np.add.reduceat(size[o], start)) // most
    at = start[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])].tolist()
    for a, b in zip(at, [*at[1:], len(o)]):
        yield np.sort(o[a:b])


def _windows(k: int, memory: int):
    """Where the windows of each kind of chunk of a shard occur first, in runs of neighbours.

    Chunks are read as they come. The words of each kind are kept once, and these, the least places and the
    windows' first places lie in files from ``memory`` entries on. Windows are compared in parts of whole anchors.
    """
    most, step, known = max(memory // 4, 1), max(memory // 128, 64), max(memory // 16, 16)

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = induced.Store(spill_folder(), memory)
        try:
            yield from search(batches, store)
        finally:
            store.close()

    def search(batches: Iterator[pa.RecordBatch], store: induced.Store) -> Iterator[pa.RecordBatch]:
        words, kinds, seen = (induced.Column(store, kind) for kind in (np.uint32, np.int64, np.int64))
        numbers: dict[bytes, int] = {}
        many = 0
        for batch in batches:
            for c, d in zip(batch.column(batch.schema.get_field_index("c")), batch.column(batch.schema.get_field_index("d"))):
                own, meta = np.frombuffer(c.as_buffer(), np.uint32), np.frombuffer(d.as_buffer(), np.int64).reshape(-1, _KIND)
                ends = np.cumsum(meta[:, 6])
                number, new = np.empty(len(meta), np.int64), []
                for i, key in enumerate(np.ascontiguousarray(meta[:, 1:3]).view("V16").ravel().tolist()):
                    number[i] = x = numbers.setdefault(key, many)
                    if x == many:
                        many += 1
                        new.append(i)
                if new:
                    n = meta[new, 6]
                    words.add(own[np.repeat(ends[new] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
                    kinds.add(meta[new][:, [0, 1, 2, 6]].ravel())
                seen.add(np.column_stack([number, meta[:, 3:6], meta[:, 7]]).ravel())
                if len(numbers) > known:  # a kind that comes again is another, which the suffix array finds equal
                    numbers.clear()
        numbers.clear()
        if not many:
            return
        words, kinds, seen = words.array(), kinds.array().reshape(-1, 4), seen.array().reshape(-1, 5)
        by_anchor, size = kinds[:, 0], kinds[:, 3]
        at = np.cumsum(size) - size
        wins = size - k + 1
        w_at = np.cumsum(wins) - wins
        # each kind's least place, and how often it occurs
        lead = store.array(3 * many, np.int64).reshape(-1, 3)
        lead[:] = np.iinfo(np.int64).max
        times = store.array(many, np.int64)
        for a in range(0, len(seen), step):
            s = seen[a : a + step]
            np.add.at(times, s[:, 0], s[:, 4])
            s = s[np.lexsort((s[:, 3], s[:, 2], s[:, 1], s[:, 0]))]
            s = s[np.r_[True, s[1:, 0] != s[:-1, 0]]]
            have = lead[s[:, 0]]
            x, y = s[:, 1:4], have
            less = (x[:, 0] < y[:, 0]) | (x[:, 0] == y[:, 0]) & ((x[:, 1] < y[:, 1]) | (x[:, 1] == y[:, 1]) & (x[:, 2] < y[:, 2]))
            lead[s[less, 0]] = x[less]
        best = store.array(3 * int(wins.sum()), np.int64).reshape(-1, 3)
        for part in _parts(size, by_anchor, most):
            pick = np.repeat(at[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(int(size[part].sum()))
            found = _best(words[pick], size[part], lead[part], by_anchor[part], k, memory)
            n = wins[part]
            best[np.repeat(w_at[part] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        each = max(1, step // 16)
        for a in range(0, many, each):
            n = wins[a : a + each]
            kind = np.repeat(np.arange(a, a + len(n)), n)
            place = np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n)
            b = best[w_at[a] : w_at[a] + len(kind)]
            fk, fth, fat = b[:, 0], b[:, 1], b[:, 2]
            own = (fk == lead[kind, 0]) & (fth == lead[kind, 1]) & (fat == lead[kind, 2] + place)
            cut_at = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (fk[1:] != fk[:-1]) | (fth[1:] != fth[:-1]) | (fat[1:] - place[1:] != fat[:-1] - place[:-1])])
            last = np.r_[cut_at[1:], len(kind)] - 1
            # a kind that occurs once has nothing to give up where it is the first itself
            go = ~own[cut_at] | (times[kind[cut_at]] > 1)
            cut_at, last = cut_at[go], last[go]
            if len(cut_at):
                cols = [kinds[kind[cut_at], 1], kinds[kind[cut_at], 2], place[cut_at], place[last], fk[cut_at], fth[cut_at], fat[cut_at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], schema=_RUN)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).select("k", F.xxhash64("t").alias("th"), "t")


def spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, memory: int = MEMORY) -> DataFrame:
    """Maximal duplicate spans by document and text: ``k, th, start, stop`` (words, ``stop`` exclusive), ``fk, fstart``: where its first window stays."""
    many = docs.count()
    anchor = min(anchor, min_words)
    spark = docs.sparkSession
    buckets, shards = spread(spark, pieces(many, DOCS_PER_BUCKET, 4)), spread(spark, pieces(many, DOCS_PER_SHARD, 4))
    keyed = _keyed(docs)
    lists = keyed.mapInArrow(_emit_anchors(min_words, anchor, buckets), _DDL).groupBy("b").applyInArrow(_repeated, "k long, th long, list binary").groupBy("k", "th").agg(F.collect_list("list").alias("lists"))
    chunks = keyed.join(lists, ["k", "th"]).select("k", "th", "t", "lists").mapInArrow(_emit_chunks(min_words, anchor, shards), _DDL)
    chunks = cut(chunks)
    firsts = chunks.where("length(a) = 0").groupBy("b").applyInArrow(_windows(min_words, memory), _RUN_DDL)
    # a passage that very many documents hold is a skewed key of this join, which AQE splits: no task gathers its places
    places = chunks.where("length(a) > 0").select("a").mapInArrow(_places, _PLACE_DDL)
    first = (F.col("k") == F.col("fk")) & (F.col("th") == F.col("fth")) & (F.col("at") + F.col("lo") == F.col("fat"))
    met = places.join(firsts, ["g", "h"]).where(~first)
    runs = met.select("k", "th", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + min_words).alias("stop"), "fk", F.col("fat").alias("fstart"))
    own = Window.partitionBy("k", "th")
    seen = F.max("stop").over(own.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("start") > F.coalesce("seen", F.lit(-1)), 1).otherwise(0)).over(own.orderBy("start", "stop"))
    return (
        runs.withColumn("seen", seen)
        .withColumn("isle", isle)
        .groupBy("k", "th", "isle")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(F.struct("fk", "fstart"), "start").alias("f"))
        .select("k", "th", "start", "stop", "f.fk", "f.fstart")
    )


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, memory: int = MEMORY) -> DataFrame:
    """Passages to remove: ``doc_id, start_word, n_words, first_doc_id, first_word``.

    A span covers the windows of ``min_words`` words (see ``textkit``) that occur before it, in a document of a
    lesser ``doc_id`` or earlier in the same; ``first_*`` tell where the first of its windows does. Spans that
    touch or overlap are one.

    Defined results: rows with a null ``doc_id`` or ``text`` take no part; texts of fewer words than
    ``min_words`` hold no passage. Rows that repeat ``doc_id`` and text are one document; rows that repeat a
    ``doc_id`` with another text are documents of their own. Other columns play no part; an empty table gives no rows.
    """
    s = spans(docs, min_words, anchor, memory)
    return s.select(F.col("k").alias("doc_id"), F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("fk").alias("first_doc_id"), F.col("fstart").alias("first_word"))


@K.trimmed
def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column 0: texts, 1: spans; gives the texts without the spans, ahead of the other columns."""
    for batch in batches:
        buf, off = K.string_buffers(batch.column(0))
        texts = batch.column(0).to_pylist()
        lists = batch.column(1).to_pylist()
        for i, found in enumerate(lists):
            if not found or texts[i] is None:
                continue
            own = buf[off[i] : off[i + 1]]
            tk = K.tokens(own, np.array([0, len(own)]))
            raw, out, at = own.tobytes(), [], 0
            for s, e in sorted((x["start"], x["stop"]) for x in found):
                out.append(raw[at : tk.start[s]])
                at = int(tk.end[e - 1])
            out.append(raw[at:])
            texts[i] = b"".join(out).decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], names=["t", *batch.schema.names[2:]])


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, memory: int = MEMORY) -> DataFrame:
    """``docs`` with all repeated passages but the first cut out of ``text``; rows and other columns stay.

    ``n_chars``, where there is one, counts the new text where that changed. A text that is all repeated becomes empty.
    """
    found = spans(docs, min_words, anchor, memory).groupBy("k", "th").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names)}
    text, key = at["text"], at["doc_id"]
    wide = plain.join(found, (F.col(key).cast("long") == F.col("k")) & (F.xxhash64(F.col(text).cast("string")) == F.col("th")), "left")
    held = wide.select(F.col(text).cast("string").alias("t"), "found", *names)
    kinds = T.StructType([T.StructField("t", T.StringType()), *(T.StructField(n, plain.schema[n].dataType) for n in names)])
    done = held.mapInArrow(_cut_spans, kinds)
    out = []
    for c, n in at.items():
        if c == "text":
            out.append(F.col("t").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(text).eqNullSafe(F.col("t")), F.col(n)).otherwise(F.length("t").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(n).alias(c))
    return done.select(*out)
