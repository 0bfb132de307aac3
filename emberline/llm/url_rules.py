"""URL filters by a sort-merge range join of URLs with prefix rules.

A URL's key is its host's labels in reverse, each followed by a dot, then its path: ``net.example.blog./en/8``. A rule for a domain
or a path is a prefix of keys, so an interval of the sorted keys, and two intervals are nested or apart. URLs and rules
are cut into ranges of keys at sampled bounds, a rule going to each range that its interval meets, and one sweep
over a sorted range keeps the rules around the present key on a stack. Neither side is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import pieces
from emberline.llm.html_text import host_of

SAMPLED = 20_000
ROWS_PER_RANGE = 50_000
_DOMAINS = ("example.com", "example.net", "example.org")
_UNWANTED = ("adult-x", "casino-win", "cheap-pills", "crypto-rush", "free-bets", "spam-farm", "warez-hub", "win-prizes")
_LANGS = ("de", "en", "es", "fr")


def _generated() -> Iterator[tuple[str, str]]:
    """Rules up to five deep: domains, languages of a domain's blogs, unwanted hosts with an exception each, and sections of a thousand sites."""
    for n, domain in enumerate(_DOMAINS):
        yield domain, ("allow", "allow", "review")[n]
        for host in _UNWANTED:
            yield f"{host}.{domain}", "block"
            yield f"{host}.{domain}/legal", "review"
        for prefix in ("www", "m", "blog"):
            yield f"{prefix}.{domain}", "allow"
            for lang in _LANGS:
                yield f"{prefix}.{domain}/{lang}/", "review" if lang == _LANGS[n] else "allow"
    yield from (("com", "allow"), ("net", "review"), ("org", "allow"))
    for i in range(1000):
        host = f"site{i}.{_DOMAINS[i % 3]}"
        yield host, ("allow", "review", "block")[i % 7 % 3]
        yield f"{host}/{_LANGS[i % 4]}/", "review"
        yield f"{host}/{_LANGS[i % 4]}/{i % 10}", "block"
    for i in range(10):  # article numbers on any of the domains, by their first digit
        for n, domain in enumerate(_DOMAINS):
            yield f"{domain}/{_LANGS[(i + n) % 4]}/{i}", "review"


#: number, pattern, action
RULES = tuple((n, pattern, action) for n, (pattern, action) in enumerate(_generated(), 1))


def path_of(url: Column) -> Column:
    """Path and query, without fragment; ``/`` where there is none."""
    path = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def url_key(url: Column) -> Column:
    """The sort key of a URL; null where it has no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."), path_of(url)))


def rule_prefix(pattern: Column) -> Column:
    """The prefix of keys that ``host`` (with all below it) or ``host/path`` stands for; null where it has no host."""
    host = F.lower(F.regexp_extract(F.trim(pattern.cast("string")), "^([^/]*)", 1))
    path = F.regexp_extract(F.trim(pattern.cast("string")), "^[^/]*(/.*)?$", 1)
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."), path))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule_id long, pattern string, action string")


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("rule_id", pa.int64()), ("action", pa.string()), ("n_rules", pa.int64())])


def sweep(rows) -> Iterator[tuple]:
    """``rows``: (range, key, kind, id, payload), sorted; kind 0 is a rule, whose payload is its action, 1 a URL."""
    stack: list[tuple[str, int, str]] = []
    at = None
    for part, key, kind, number, payload in rows:
        if part != at:
            at, stack = part, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            stack.append((key, number, payload))
        else:
            top = stack[-1] if stack else (None, None, None)
            yield number, payload, top[1], top[2], len(stack)


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

        for page, url, rule, action, n in sweep(rows()):
            out.append((page, url, rule, default if rule is None else action, n))
            if len(out) == 10_000:
                yield batch()
                out.clear()
        yield batch()

    return run


def _after(bounds: list[str], prefix: str) -> int:
    """How many of the bounds come before all that is greater than ``prefix`` and doesn't begin with it."""
    stem = prefix.rstrip("\U0010ffff")  # nothing comes after this character
    return bisect_left(bounds, stem[:-1] + chr(ord(stem[-1]) + 1)) if stem else len(bounds)


def match(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, url, rule_id, action, n_rules`` for each row of ``urls``, repeated ones too.

    ``rule_id`` is the innermost of the ``n_rules`` rules around the URL: the one with the longest prefix, of equal ones that with
    the greatest number. Where no rule applies it is null and the action is ``default``; so it is for a null URL and one
    without a host. Rules without number, host or action don't apply. Other columns play no part.
    """
    keyed = urls.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), url_key(F.col("url")).alias("key"))
    sites = keyed.where("key is not null")
    many = urls.count()
    ranges = pieces(many, ROWS_PER_RANGE)
    # keys that cut the URLs into parts of about equal size; a bad sample costs balance only
    share = min(1.0, SAMPLED / max(1, many))
    keys = sorted(r[0] for r in (sites.sample(share, 11) if share < 1 else sites).select("key").collect())
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def place(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in column:
            yield pa.array([None if k is None else list(range(bisect_left(bounds, k), bisect_right(bounds, k) + 1)) for k in x.to_pylist()], pa.list_(pa.int32()))

    def cover(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in column:
            yield pa.array([None if k is None else list(range(bisect_left(bounds, k), _after(bounds, k) + 1)) for k in x.to_pylist()], pa.list_(pa.int32()))

    for f in (place, cover):
        f.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # URLs equal to a bound may go to either side of it: their rows are spread over those ranges
    at = F.arrow_udf(place, "array<int>")(F.col("key"))
    spread = sites.withColumn("at", at).withColumn("range", F.element_at("at", (F.pmod(F.xxhash64("page_id", "url"), F.size("at")) + 1).cast("int")))
    left = spread.select("range", "key", F.lit(1).alias("kind"), F.col("page_id").alias("number"), F.col("url").alias("payload"))
    own = rules.select(rule_prefix(F.col("pattern")).alias("key"), F.col("rule_id").cast("long").alias("number"), F.col("action").cast("string").alias("payload")).where("key is not null and number is not null and payload is not null").distinct()
    right = own.withColumn("range", F.explode(F.arrow_udf(cover, "array<int>")(F.col("key")))).select("range", "key", F.lit(0).alias("kind"), "number", "payload")
    both = right.unionByName(left).repartition(ranges, "range").sortWithinPartitions("range", "key", "kind", "number", "payload")
    found = both.mapInArrow(_sweep(default), "page_id long, url string, rule_id long, action string, n_rules long")
    rest = keyed.where("key is null").select("page_id", "url", F.lit(None).cast("long").alias("rule_id"), F.lit(default).alias("action"), F.lit(0).cast("long").alias("n_rules"))
    return found.unionByName(rest)
