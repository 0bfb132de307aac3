from __future__ import annotations

import time
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from emberline.llm import html_text as H

NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/x>News &amp; more</a></ul></nav>"
FOOT = "<footer><p>Legal notice</p></footer>"


def page(i: int, host: str = "a.example.com", nav: str = NAV) -> tuple[int, str, str]:
    return (i, f"https://{host}/p/{i}", f"<html><head><title>Page {i}</title><script>var x = '<p>no</p>';</script></head><body>{nav}<article><h1>Title {i}</h1><p>Text number {i}<br>goes on.</p></article>{FOOT}</body></html>")


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_what_recurs_on_a_host_goes(spark):
    rows = [page(i) for i in range(10)] + [page(i, "b.example.com") for i in range(100, 102)]
    got = {r["page_id"]: r for r in H.extract(frame(spark, rows)).collect()}
    assert got[3]["text"] == "Page 3\nTitle 3\nText number 3\ngoes on." and got[3]["n_removed"] == 2
    # two pages are too few to tell
    assert got[100]["text"].startswith("Page 100\nHome\nNews & more\n") and got[100]["n_removed"] == 0


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "https://c.example.com/x", page(1)[2]) for i in range(20)]
    got = H.extract(frame(spark, rows)).collect()
    assert len(got) == 20 and all("Text number 1" in r["text"] and r["n_removed"] == 0 for r in got)


@pytest.mark.parametrize("sections", [12, 60])
@pytest.mark.parametrize("limit", [0, 10**9])
def test_section_templates_go_and_articles_stay_at_any_size(spark, monkeypatch, sections, limit):
    monkeypatch.setattr(H, "BROADCAST_TEMPLATES", limit)
    rows = []

    def add(section: int, article: str) -> int:
        nav = f"<nav><ul><li><a href=/{section}>Section {section}</a><li><a href=/s>Sub {section}</a></ul></nav>"
        rows.append((len(rows), "https://big.example.com/x", f"<body>{nav}<div class=ad>Buy {section}</div><article>{article}</article><footer>Desk {section}</footer></body>"))
        return len(rows) - 1

    want = {}
    for s in range(sections):
        for i in range(5):  # a share of 8 % of the small host, 1.6 % of the large one
            at = add(s, f"<h1>Title {s} {i}</h1><p>Story {s}/{i} is <b>very</b> <a href=/>long <i>indeed</i></a>.</p><table><tr><td>Age<td>{s}.{i}</table>")
            want[at] = f"Title {s} {i}\nStory {s}/{i} is very long indeed.\nAge\n{s}.{i}"
        want[add(s, "<h1>Agency</h1><p>Printed in each section.</p>")] = "Agency\nPrinted in each section."
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in H.extract(frame(spark, rows)).collect()}
    assert got == {i: (text, 3) for i, text in want.items()}


def test_pages_against_brute_force(spark):
    """Another parser, subtrees compared as they are instead of by hashes; two pages make a template, so that some of the given ones are found."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    want = brute.extract([(r["url"], r["html"]) for r in rows], least=2)
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in H.extract(pages, min_pages=2).collect()}
    assert got == {r["page_id"]: w for r, w in zip(rows, want)}
    assert sum(n > 0 for _, n in want) > 50


def test_templates_at_the_default_bound_against_brute_force(spark):
    rows = [page(i) for i in range(10)] + [page(i, "b.example.com", NAV.replace("Home", f"Home {i % 3}")) for i in range(100, 110)] + [page(i, "c.example.com") for i in range(200, 203)]
    want = brute.extract([r[1:] for r in rows])
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in H.extract(frame(spark, rows)).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want)}
    assert {n for _, n in want} == {0, 2}


LONG = ["<i>x" * 60_000 + "<h2>a</h2>" * 80_000, "<ul><li>" * 120_000 + "<p>a" * 20_000, "<article>" * 110_000, "<i>" * 160_000 + "x" + "</i>" * 160_000, '<a href="' * 110_001, "<nav>" + "<b>x</b>" * 120_000, "<table><tr><td>" * 40_000 + "<h1>x" * 80_000, "<p>" * 350_000, "<p class='" * 100_001, "<" * 1_000_000, "<div>a<i>b" * 100_000]


@pytest.mark.parametrize("html", LONG, ids=lambda h: h[:10])
def test_a_megabyte_of_open_tags_takes_seconds(html):
    """Twice the size must not take four times as long: a tenth of a page, and all of it."""
    times = []
    for part in (html[: len(html) // 8], html):
        began = time.process_time()
        H.text_without(part, set())
        times.append(time.process_time() - began)
    assert times[1] < max(2.0, 16 * times[0])


@pytest.mark.parametrize("limit", [0, 10**9])
def test_broadcast_and_plain_join_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_TEMPLATES", limit)
    got = Counter(r["n_removed"] for r in H.extract(frame(spark, [page(i) for i in range(10)])).collect())
    assert got == {2: 10}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\nb"),
        ("<b>a</b><i>b</i>", "ab"),
        ("a <b>b</b> c", "a b c"),
        ("<td>1<td>2", "1\n2"),
        ("</div></p>x", "x"),
        ("<!-- no --><!doctype html>x<!-- open", "x"),
        ("<script>no", ""),
        ("x &lt;y&gt; &nbsp; z", "x <y> z"),
        ("<img src='a'/>x<br/>y", "x\ny"),
        ("<p", ""),
        ("a < b", "a < b"),
        ('<a title="a > b" href=x>link</a>', "link"),
        ("<p class=it's>x</p>y's", "x\ny's"),
        ('<p title="open>x', "x"),
    ],
)
def test_broken_markup(html, text):
    assert H.text_without(html, set())[0] == text


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, "<p>no url</p>"), (2, "nonsense", "<p>no host</p>"), (3, "https://d.example.com/", None), (None, "https://d.example.com/", "<p>x</p>"), (5, "https://d.example.com/", ""), (6, "https://d.example.com/", "word " * 200_000), (7, "https://d.example.com/", deep), (7, "https://d.example.com/", deep)]
    df = frame(spark, rows).withColumns({c: F.lit("z") for c in ("host", "h", "known", "n", "text", "root")})
    got = {}
    for r in H.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == ["no url"] and got[2] == ["no host"] and got[3] == [None] and got[None] == ["x"] and got[5] == [""] and got[7] == ["deep", "deep"]
    assert len(got[6][0].split()) == 200_000
    assert H.extract(df.limit(0)).count() == 0
