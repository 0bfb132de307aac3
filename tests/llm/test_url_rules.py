from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberline.llm import url_rules as U

RULES = [
    (1, "example.com", "allow"), (2, "bad.example.com", "block"), (3, "bad.example.com/ok", "allow"), (4, "bad.example.com/ok/not", "block"),
    (5, "EXAMPLE.org ", "review"), (6, "example.org", "block"), (7, "com", "review"), (8, "xexample.com", "block"), (9, "example.net/a?q=1", "block"),
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url or not url.partition("://")[2].partition("/")[0].rpartition("@")[2].partition(":")[0]:
        return None, default, 0
    rest = url.partition("://")[2].partition("#")[0]
    cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0], default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].partition(":")[0].lower(), rest[cut:]
    path = path if path.startswith("/") else "/" + path
    hits = []
    for number, pattern, action in rules:
        h, slash, p = pattern.strip().partition("/")
        h = h.lower()
        if slash:
            ok = host == h and path.startswith("/" + p)
        else:
            ok = host == h or host.endswith("." + h)
        if ok:
            prefix = ".".join(reversed(h.split("."))) + "." + slash + p
            hits.append((len(prefix), number, action))
    best = max(hits, default=(0, None, default))
    return best[1], best[2], len(hits)


def urls(n):
    r = random.Random(n)
    hosts = ["example.com", "www.example.com", "bad.example.com", "Very.Bad.Example.com", "xexample.com", "example.org", "a.example.org", "example.net", "other.test", "com"]
    return [(i, f"{r.choice(['http', 'https'])}://{r.choice(['', '', 'me@'])}{r.choice(hosts)}{r.choice(['', '', ':8080'])}{r.choice(['', '/', '/ok', '/ok/not/x', '/okay', '/a?q=1&r=2', '?q=1', '/ok#not', '/oké'])}") for i in range(n)]


def rows(df):
    return sorted(((r["page_id"], r["url"], r["rule_id"], r["action"], r["n_rules"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("per_range", [50_000, 13, 1])
def test_matches_are_those_of_brute_force(spark, monkeypatch, per_range):
    """Few rows to a range: rules span many ranges, and many URLs equal a bound."""
    monkeypatch.setattr(U, "ROWS_PER_RANGE", per_range)
    found = urls(60 if per_range == 1 else 400)
    got = U.match(spark.createDataFrame(found, "page_id long, url string"), spark.createDataFrame(RULES, "rule_id long, pattern string, action string"))
    assert rows(got) == sorted(((i, u, *brute(u, RULES)) for i, u in found), key=str)


def test_the_registered_rules_nest(spark):
    """Over a thousand rules, several deep, against brute force."""
    hosts = ["site7.example.net", "a.site8.example.org", "casino-win.example.com", "m.example.org", "example.net", "other.org", "x.test"]
    found = [(i, f"https://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("/", "/fr/7x", "/fr/", "/de/8", "/legal/x", "/es/1"))]
    got = U.match(spark.createDataFrame(found, "page_id long, url string"), U.default_rules(spark))
    want = [(i, u, *brute(u, U.RULES)) for i, u in found]
    assert rows(got) == sorted(want, key=str) and max(w[4] for w in want) >= 5 and len(U.RULES) > 3000


def test_prefixes_that_end_in_the_last_character(spark, monkeypatch):
    monkeypatch.setattr(U, "ROWS_PER_RANGE", 2)
    top = "\U0010ffff"
    rules = [(1, f"example.com/{top}", "block"), (2, f"example.com/a{top}{top}", "review"), (3, "example.com", "allow")]
    found = [(i, f"https://example.com/{p}") for i, p in enumerate([top, top + "x", f"a{top}", f"a{top}{top}", f"a{top}{top}b", "b", "", "zz"])]
    got = U.match(spark.createDataFrame(found, "page_id long, url string"), spark.createDataFrame(rules, "rule_id long, pattern string, action string"))
    assert rows(got) == sorted(((i, u, *brute(u, rules)) for i, u in found), key=str)
    assert U._after(["a", "b"], top) == 2


def test_odd_urls_and_rules(spark):
    found = [(1, None), (2, ""), (3, "no url"), (4, "https:///x"), (None, "https://example.com/"), (5, "https://example.com/" + "x" * 100_000), (6, "https://example.com/"), (6, "https://example.com/"), (7, "mailto:x@example.com")]
    rules = [*RULES, (None, "example.com", "block"), (50, None, "block"), (51, "example.com", None), (52, "", "block"), (53, "/x", "block"), (1, "example.com", "allow")]
    df = spark.createDataFrame(found, "page_id long, url string").withColumns({c: F.lit("z") for c in ("key", "range", "kind", "number", "at", "payload", "rule_id", "action")})
    got = U.match(df, spark.createDataFrame(rules, "rule_id long, pattern string, action string"))
    want = [(i, u, *brute(u, RULES)) for i, u in found]
    assert rows(got) == sorted(want, key=str)
    assert U.match(df.limit(0), spark.createDataFrame(rules, "rule_id long, pattern string, action string")).count() == 0
    none = U.match(df, spark.createDataFrame([], "rule_id long, pattern string, action string"))
    assert none.count() == len(found) and {r["action"] for r in none.collect()} == {"allow"}
