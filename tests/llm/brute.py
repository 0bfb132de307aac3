"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from emberline.llm import mixing

_WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}


def words(text: str) -> list[str]:
    return [w.translate(_LOWER) for w in _WORD.findall(text)]


def grams(text: str, n: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({("short", *w)} if w else set())


def jaccard_pairs(docs: list[tuple], threshold: float = 0.4, n: int = 5) -> dict[tuple[int, int], tuple[int, float]]:
    """docs: (id, text)."""
    sets = [(k, grams(t, n)) for k, t in docs if k is not None and t is not None]
    sets = [(k, g) for k, g in sets if g]
    out: dict[tuple[int, int], tuple[int, float]] = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        both = len(x & y)
        j = both / (len(x) + len(y) - both)
        if a != b and j >= threshold:
            key = (min(a, b), max(a, b))
            if key not in out or out[key][1] < j:
                out[key] = (both, j)
    return out


def near_copies(docs: list[tuple]) -> set[int]:
    """Ids that go."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in jaccard_pairs(docs):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x for x in parent if find(x) != x}


def passages(docs: list[tuple], k: int = 50) -> list[tuple[int, int, int, int, int]]:
    """(id, first word, words, where the first window occurs first: id, word); ids are unique."""
    first: dict[tuple, tuple[int, int]] = {}
    hits = defaultdict(list)
    for d, t in sorted((d, t) for d, t in docs if d is not None and t is not None):
        w = words(t)
        for i in range(len(w) - k + 1):
            at = first.setdefault(tuple(w[i : i + k]), (d, i))
            if at != (d, i):
                hits[d].append((i, at))
    out = []
    for d, found in hits.items():
        spans: list[list] = []
        for i, at in found:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + k
            else:
                spans.append([i, i + k, at])
        out += [(d, a, b - a, *at) for a, b, at in spans]
    return sorted(out)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    at = [m.span() for m in _WORD.finditer(text)]
    for a, b in sorted(spans, reverse=True):
        text = text[: at[a][0]] + text[at[b - 1][1] :]
    return text


def word_count(text: str | None) -> int:
    return len(re.findall(r"[^ \t\n\r]+", text or ""))


def share(budget: float, weights: list[float], limits: list[int]) -> list[float]:
    """Exact shares by the same rule, by bisection of the water level; whole numbers are off by less than one."""
    live = [w if c > 0 else 0.0 for w, c in zip(weights, limits)]
    budget = min(budget, sum(c for w, c in zip(live, limits) if w > 0))
    lo, hi = 0.0, max([c / w for w, c in zip(live, limits) if w > 0], default=0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, w * mid) for w, c in zip(live, limits)) < budget:
            lo = mid
        else:
            hi = mid
    return [min(c, w * hi) for w, c in zip(live, limits)]


def mix(rows: list[dict], budget_share: float, max_epochs: int) -> list[tuple[int, int]]:
    """(place in ``rows``, epoch) of what is read. rows: domain, lang, source, n, and h(epoch): the order."""
    fill = mixing.water_fill
    leaves = defaultdict(list)
    for i, r in enumerate(rows):
        leaves[r["domain"], r["lang"], r["source"]].append(i)
    tokens = {leaf: sum(rows[i]["n"] for i in m) for leaf, m in leaves.items()}
    cap = {leaf: n * max_epochs for leaf, n in tokens.items()}
    total = math.floor(sum(tokens.values()) * budget_share)

    def level(prefixes: dict[tuple, int], depth: int, weights: dict | None) -> dict[tuple, int]:
        out = {}
        for prefix, budget in prefixes.items():
            own = sorted({leaf[: depth + 1] for leaf in leaves if leaf[:depth] == prefix})
            limits = [sum(c for leaf, c in cap.items() if leaf[: depth + 1] == o) for o in own]
            w = [(weights or {}).get(o[depth], 1.0) for o in own]
            got = fill(budget, w, limits)
            for g, want in zip(got, share(budget, w, limits)):
                assert abs(g - want) < 1 + 1e-6 * want
            out.update(zip(own, got))
        return out

    budgets = level(level(level({(): total}, 0, mixing.DOMAIN_WEIGHTS), 1, mixing.LANG_WEIGHTS), 2, None)
    out = []
    for leaf, members in leaves.items():
        n = tokens[leaf]
        whole, rest = divmod(budgets[leaf], n) if n else (0, 0)
        out += [(i, e) for i in members for e in range(min(whole, max_epochs))]
        if rest and whole < max_epochs:
            used = 0
            for i in sorted(members, key=lambda i: rows[i]["h"](whole)):
                used += rows[i]["n"]
                if used > rest:
                    break
                out.append((i, whole))
    return sorted(out)


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The online rule by trying every level and summing all squares."""
    count: Counter = Counter()
    windows: dict[int, int] = {}  # window: level
    order: list[int] = []  # by when they last changed
    made = 0
    out = []

    def cost(changed: dict[int, int]) -> int:
        levels = set(count) | set(changed)
        return sum((count[h] + changed.get(h, 0)) ** 2 for h in levels)

    for item, s in enumerate(sizes):
        piece = 0
        while s >= capacity:
            out.append((item, piece, made, 0, capacity))
            made, piece, s = made + 1, piece + 1, s - capacity
        if s <= 0:
            continue
        best = None
        for h in [*sorted((h for h, c in count.items() if c and h + s <= capacity), reverse=True), 0]:
            change: Counter = Counter()
            if h:
                change[h] -= 1
            if h + s < capacity:
                change[h + s] += 1
            c = cost(change)
            if best is None or c < best[0]:
                best = (c, h)
        h = best[1]
        if h:
            w = next(w for w in reversed(order) if windows.get(w) == h)
            count[h] -= 1
            order.remove(w)
        else:
            w, made = made, made + 1
        if h + s < capacity:
            count[h + s] += 1
            windows[w] = h + s
            order.append(w)
        else:
            windows.pop(w, None)
        out.append((item, piece, w, h, s))
    return out


_BLOCKS = set("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = {"script", "style", "noscript", "template", "textarea", "iframe", "svg"}
_SCOPE = {"td", "th", "li", "div", "article", "section", "blockquote"}
_IMPLIED = {"p": ({"p"}, _SCOPE | {"table"}), "li": ({"li", "p"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_IMPLIED |= dict.fromkeys(("td", "th"), ({"td", "th", "p"}, {"tr", "table"}))
_IMPLIED |= dict.fromkeys("div ul ol table h1 h2 h3 h4 h5 h6 section article footer nav header pre".split(), ({"p"}, _SCOPE))


class Page(HTMLParser):
    """A page as a tree: an element is [tag, children], a text a string. Built with the standard library's parser, a walk up the open elements at each tag."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", []]
        self.open = [self.root]
        self.skip = None
        self.word = ""
        self.feed(page.replace("&", "\ue000"))  # text is unescaped piece by piece
        self.close()
        self.flush()

    def flush(self):
        if self.word:
            self.open[-1][1].append(html.unescape(self.word.replace("\ue000", "&")))
        self.word = ""

    def handle_data(self, data):
        if self.skip is None:
            self.word += data

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_starttag(self, tag, attrs):
        if self.skip is not None:
            return
        self.flush()
        if tag in _SILENT:
            self.skip = tag
            return
        ends, stops = _IMPLIED.get(tag, (set(), set()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in ends:
                del self.open[i:]
                break
            if self.open[i][0] in stops:
                break
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in _EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        del self.open[max(1, min(depth, len(self.open))) :]

    def handle_endtag(self, tag):
        if self.skip is not None:
            if tag == self.skip:
                self.skip = None
            return
        self.flush()
        if tag in [n[0] for n in self.open]:
            while self.open.pop()[0] != tag:
                pass


def _shape(node) -> tuple | None:
    """An element's tags and texts without the space between; None where there is no text."""
    if isinstance(node, str):
        return tuple(node.split()) or None
    inner = tuple(filter(None, map(_shape, node[1])))
    return (node[0], inner) if inner else None


def candidates(page: Page) -> list:
    """Elements that may be templates."""
    out = []

    def walk(node, path: list) -> None:
        for child in node[1]:
            if isinstance(child, str):
                continue
            way = [*path, child]
            if _shape(child) is not None and _may_go(way):
                out.append(child)
            walk(child, way)

    walk(page.root, [page.root])
    return out


def _own_words(node) -> bool:
    return any(isinstance(c, str) and re.search(r"\w", c) for c in node[1])


def _may_go(way: list) -> bool:
    tags = [n[0] for n in way]
    # cells and items of an article
    inside = 0
    for t in tags:
        inside = 1 if t in ("article", "main") else 2 if t in ("tr", "td", "th", "li", "dt", "dd") and inside else inside
    if inside == 2:
        return False
    if tags[-1] in _BLOCKS:
        return True
    # an inline element goes up to its block; words beside it on the way keep it, but in a frame of the page
    for i in range(len(way) - 2, -1, -1):
        framed = any(t in ("nav", "header", "footer", "aside") for t in tags[: i + 1])
        if _own_words(way[i]) and not framed:
            return False
        if tags[i] in _BLOCKS:
            return True
    return True


def identity(page: Page):
    """What a page is counted as: its outermost articles, or all of it."""
    found = []

    def walk(node) -> None:
        for c in node[1]:
            if not isinstance(c, str):
                if c[0] in ("article", "main"):
                    found.append(_shape(c))
                else:
                    walk(c)

    walk(page.root)
    found = [f for f in found if f is not None]
    return tuple(found) or tuple(filter(None, map(_shape, page.root[1])))


def page_text(page: Page, templates: set) -> tuple[str, int]:
    may = {id(n) for n in candidates(page)}
    removed = 0

    def write(node) -> str:
        nonlocal removed
        if isinstance(node, str):
            words = " ".join(node.split())
            return (" " if node[:1].isspace() else "") + words + (" " if node[-1:].isspace() else "") if words else " "
        if id(node) in may and _shape(node) in templates:
            removed += 1
            return "\n"
        inner = "".join(map(write, node[1]))
        return f"\n{inner}\n" if node[0] in _BLOCKS else inner

    text = write(page.root)
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x), removed


def extract(pages: list[tuple], least: int = 4) -> list[tuple[str | None, int]]:
    """(url, html) of each page to its text and the subtrees cut out, templates counted over the hosts' different pages."""
    trees = [Page(h) if h is not None else None for _, h in pages]
    hosts = [(re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", u or "") or [None, ""])[1].lower() for u, _ in pages]
    seen: dict = defaultdict(set)
    for host, tree in zip(hosts, trees):
        if host and tree is not None:
            for node in candidates(tree):
                seen[host, _shape(node)].add(identity(tree))
    return [(None, 0) if t is None else page_text(t, {s for (h, s), on in seen.items() if h == host and len(on) >= least} if host else set()) for host, t in zip(hosts, trees)]
