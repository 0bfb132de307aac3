"""Text of web pages without the templates of their sites.

Each element's subtree is hashed over its tags and texts. Spark counts, for each host, on how many different pages a
subtree is found; one that is on ``MIN_PAGES`` of them belongs to a template and is cut out of all of the host's pages,
however many those are: a site has many sections, each with a template of its own. What is left is written out as text.

Two things keep articles whole on hosts of any size. A page counts once however often it is copied: pages whose
``article`` and ``main`` elements (where there are none, whose whole contents) are equal are one page, so an
article printed in several sections is no template. And parts are never cut out by themselves of what they are parts of: words that are
marked up within running text (a bold word, a link), and an article's table cells and list items.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import textkit as K
from emberline.llm.common import cut

#: a template is on so many pages of its host at least; no share of them is asked for, as a section may be any part of a site
MIN_PAGES = 4
MIN_SHARE = 0.0
BROADCAST_TEMPLATES = 500_000
#: a quote opens a value after "=" only, and if it is closed anywhere; possessive, so that a page is read in one pass
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)""", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
_MAIN = frozenset(("article", "main"))
_FRAME = frozenset(("nav", "header", "footer", "aside"))
_PART = frozenset(("tr", "td", "th", "li", "dt", "dd"))
_WORD = re.compile(r"\w")
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: an opening tag closes these, if they are open and nothing of the second set is between
_CLOSES = {
    "p": ({"p"}, frozenset(("td", "th", "li", "div", "article", "section", "blockquote", "table"))),
    "li": ({"li", "p"}, frozenset(("ul", "ol"))),
    "td": ({"td", "th", "p"}, frozenset(("tr", "table"))),
    "th": ({"td", "th", "p"}, frozenset(("tr", "table"))),
    "tr": ({"tr"}, frozenset(("table",))),
    "dt": ({"dt", "dd"}, frozenset(("dl",))),
    "dd": ({"dt", "dd"}, frozenset(("dl",))),
    "option": ({"option"}, frozenset(("select",))),
    **{t: ({"p"}, frozenset(("td", "th", "li", "div", "article", "section", "blockquote"))) for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "nav", "header", "pre")},
}
_HASH = xxhash.xxh64_intdigest


def subtrees(page: str) -> tuple[list[str], list[tuple[int, int, int]], int]:
    """Pieces of text in order, ``(first piece, end, hash)`` of each element that may be a template, and the page's hash.

    Elements that hold text may be, but for inline ones in a block that has words beside them
    (unless that is in a ``nav``, ``header``, ``footer`` or ``aside``) and for cells and items in an ``article`` or ``main``. The page's hash is that of its
    outermost ``article`` and ``main`` elements, or of all where these hold no text.

    Scripts, styles and comments hold no text; a line break stands at the bounds of blocks. Tags left open end
    with their parents, and end tags without a beginning are passed over. Time grows with the page's length, however deep its tags go.
    """
    pieces: list[str] = []
    found: list[tuple[int, int, int]] = []
    tags: list[str] = [""]
    firsts: list[int] = [0]
    hashes: list[list[bytes]] = [[]]
    runs: list[bool] = [False]  # whether an element has words of its own
    inline: list[list[tuple[int, int, int]]] = [[]]  # what waits for the end of its block, which tells whether the text runs on
    inside: list[int] = [0]  # 1: an article, 2: a cell or an item in an article
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open
    frames = 0
    mains: list[bytes] = []
    at, n = 0, len(page)

    def text(raw: str) -> None:
        words = html.unescape(raw).split() if "&" in raw else raw.split()
        if words:
            plain = " ".join(words)
            lead = " " if raw[0].isspace() else ""
            pieces.append(lead + plain + (" " if raw[-1].isspace() else ""))
            hashes[-1].append(plain.encode("utf-8", "replace"))
            runs[-1] = runs[-1] or _WORD.search(plain) is not None
        elif raw:
            pieces.append(" ")

    def hand(own: list[tuple[int, int, int]], block: bool) -> None:
        """Puts elements among those found, or among those that wait in the element around; the longer list takes the shorter."""
        if block:
            found.extend(own)
        elif len(inline[-1]) < len(own):
            own.extend(inline[-1])
            inline[-1] = own
        else:
            inline[-1].extend(own)

    def close() -> None:
        nonlocal frames
        tag, first, parts, running, waiting, within = tags.pop(), firsts.pop(), hashes.pop(), runs.pop(), inline.pop(), inside.pop()
        places[tag].pop()
        block = tag in _BLOCK
        if waiting and not (running and not frames):
            hand(waiting, block)
        frames -= tag in _FRAME
        if block:
            pieces.append("\n")
        if parts:
            h = _HASH(tag.encode("utf-8", "replace") + b"\x00" + b"\x01".join(parts))
            if within < 2:
                hand([(first, len(pieces), h)], block)
            hashes[-1].append(h.to_bytes(8, "little"))
            if tag in _MAIN and not any(places[t] for t in _MAIN):
                mains.append(hashes[-1][-1])

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if places[tag]:
                for _ in range(len(tags) - places[tag][-1]):
                    close()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            i = max((places[t][-1] for t in ends if places[t]), default=0)
            if i > max((places[t][-1] for t in stops if places[t]), default=0):
                while len(tags) > i:
                    close()
        if tag in _BLOCK:
            pieces.append("\n")
        if tag in _VOID or m[3].endswith("/"):
            continue
        places[tag].append(len(tags))
        tags.append(tag)
        firsts.append(len(pieces))
        hashes.append([])
        runs.append(False)
        inline.append([])
        frames += tag in _FRAME
        inside.append(1 if tag in _MAIN else 2 if tag in _PART and inside[-1] else inside[-1])
    while len(tags) > 1:
        close()
    if not runs[0]:
        found.extend(inline[0])
    return pieces, found, _HASH(b"\x01".join(mains or hashes[0]))


def text_without(page: str, templates: frozenset[int] | set[int]) -> tuple[str, int]:
    """The page's text without the subtrees in ``templates``, and how many (outermost) subtrees went."""
    pieces, found, _ = subtrees(page)
    gone = sorted((a, -b) for a, b, h in found if h in templates)
    out, at, removed = [], 0, 0
    for a, b in gone:
        if a >= at:
            out.extend(pieces[at:a])
            out.append("\n")
            at = -b
            removed += 1
    out.extend(pieces[at:])
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), removed


def host_of(url):
    """A URL's host in lower case, without user and port; the empty string where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


_SEEN = pa.schema([("host", pa.string()), ("h", pa.int64()), ("root", pa.int64())])


@K.trimmed
def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, hs, roots = [], [], []
        for host, page in zip(batch.column(0), batch.column(1)):
            host = host.as_py()
            _, found, root = subtrees(page.as_py())
            own = {_signed(h) for _, _, h in found} - {0}
            hosts += [host] * (len(own) + 1)
            hs += [0, *own]  # 0 counts the page itself
            roots += [_signed(root)] * (len(own) + 1)
            if len(hosts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(hs, pa.int64()), pa.array(roots, pa.int64())], schema=_SEEN)
                hosts, hs, roots = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hs, pa.int64()), pa.array(roots, pa.int64())], schema=_SEEN)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, h``: subtrees found on at least ``min_pages`` pages and ``min_share`` of the pages of the host."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null and host <> ''")
    counts = cut(seen.mapInArrow(_emit, "host string, h long, root long").groupBy("host", "h").agg(F.count_distinct("root").alias("n")).where(f"h = 0 or n >= {int(min_pages)}"))
    whole = counts.where("h = 0").select("host", F.col("n").alias("pages"))
    return counts.where("h <> 0").join(whole, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "h")


_OWN = pa.schema([("host", pa.string()), ("page", pa.int64()), ("h", pa.int64())])


@K.trimmed
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, pages, hs = [], [], []
        for host, key, page in zip(*(batch.column(i) for i in range(3))):
            own = {_signed(h) for _, _, h in subtrees(page.as_py())[1]}
            hosts += [host.as_py()] * len(own)
            pages += [key.as_py()] * len(own)
            hs += own
            if len(hosts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(pages, pa.int64()), pa.array(hs, pa.int64())], schema=_OWN)
                hosts, pages, hs = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hs, pa.int64())], schema=_OWN)


_OUT_DDL = "page_id long, url string, text string, n_removed long"


def _extract(by_host=None):
    """Columns: page_id, url, html, and the host, whose templates ``by_host`` has, or the page's own templates."""

    @K.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}
        for batch in batches:
            rows = []
            for page, key in zip(batch.column(2), batch.column(3)):
                page, key = page.as_py(), key.as_py()
                if page is None:
                    rows.append((None, 0))
                    continue
                if by_host is None:
                    known = {x & 0xFFFFFFFFFFFFFFFF for x in key or ()}
                else:
                    known = sets.get(key)
                    if known is None:
                        known = sets[key] = frozenset(by_host.value[key].view(np.uint64).tolist()) if key in by_host.value else frozenset()
                rows.append(text_without(page, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["page_id", "url", "text", "n_removed"])

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_removed`` for each row of ``pages``, repeated ones too.

    Templates are broadcast while there are few in all. Otherwise they are joined to the elements of each page, so that a row
    never carries more than the templates on its page, however many its host has.

    Defined results: a null page has a null text; an empty one, or one without text, the empty text. A page whose URL is
    null or has no host is extracted whole and counts for no host. Pages of any length are parsed whole, broken ones as far as they make sense. Other columns play no part.
    """
    known = cut(templates(pages, min_pages, min_share))
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    if known.count() <= BROADCAST_TEMPLATES:
        table = known.toArrow()
        hosts = table["host"].combine_chunks().dictionary_encode()
        which, hs = hosts.indices.to_numpy(zero_copy_only=False), table["h"].to_numpy()
        o = np.argsort(which, kind="stable")
        parts = np.split(hs[o], np.cumsum(np.bincount(which, minlength=len(hosts.dictionary)))[:-1])
        by_host = pages.sparkSession.sparkContext.broadcast(dict(zip(hosts.dictionary.to_pylist(), parts)))
        return wide.select("page_id", "url", "html", "host").mapInArrow(_extract(by_host), _OUT_DDL)
    wide = wide.withColumn("page", F.xxhash64("html"))
    own = wide.where("html is not null and host <> ''").select("host", "page", "html").mapInArrow(_hashes, "host string, page long, h long")
    own = own.join(known, ["host", "h"]).groupBy("host", "page").agg(F.collect_set("h").alias("known"))
    return wide.join(own, ["host", "page"], "left").select("page_id", "url", "html", "known").mapInArrow(_extract(), _OUT_DDL)
