import html
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from loomtrace.llm import html as h

PROSE = "It was the best of times and it was the worst of times, and all of the people in the town had to be on the road by one. " * 2


def test_article_page():
    page = (
        '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
        f'<!-- ad --><div class="ad">{PROSE}</div><article><h1>A &amp; B</h1><p><b>A &amp;amp; B<br><p>Short one.</p><p>{PROSE}\n x</p><aside>{PROSE}</aside>'
        f'<div class="comments"><p>{PROSE}</p></div><form><p>{PROSE}</p></form><ul><li>a point<li>another</ul></article><footer>&copy; me &middot; {PROSE}</footer></body></html>'
    )
    one = " ".join(PROSE.split())
    assert h.main_text(page) == f"A & B\nA &amp; B\nShort one.\n{one} x\na point\nanother"


def test_page_without_article():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h2>Title</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div>© 2020 all rights</div><div>Word list alpha beta gamma delta epsilon zeta eta theta iota kappa lambda</div>"
    one = " ".join(PROSE.split())
    assert h.main_text(page) == f"Title\n{one}\nShort.\n{one}"


def test_broken_markup():
    assert h.main_text(None) == h.main_text("") == h.main_text("<p") == ""
    assert h.main_text("<article><p>One <b>two</p><p>three &am") == "One two\nthree &am"
    assert h.main_text("<article><p>One</p></articl") == "One"
    assert h.main_text("<article>1 < 2 &lt; 3<p title='a>b'>x</p>") == "1 < 2 < 3\nx"
    assert h.main_text('<div class="ad"><article><p>in</p></article>') == "in"
    assert h.main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert h.main_text("<article><p>" + "w " * 200_000 + "</p>") == ("w " * 200_000).strip()


def article(page):
    """The blocks of the one marked article, by plain rules that know how these pages are written."""
    inner = re.sub(r"</?b>", "", re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1])
    parts = re.split(r"</?(?:p|h1|div|li|ul)[^>]*>", inner)
    return [x for x in (" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in parts) if x]


def test_the_two_passes_find_the_article_without_its_mark():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()["html"]
    hit = got_all = want_all = 0
    for page in pages:
        want = article(page)
        assert h.main_text(page).split("\n") == want
        got = h.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)).split("\n")
        hit += sum((Counter(got) & Counter(want)).values())
        got_all, want_all = got_all + len(got), want_all + len(want)
    assert 2 * hit / (got_all + want_all) >= 0.95


def test_attribute_values_of_any_length():
    for sign in "\"'":
        page = f"<article><p title={sign}" + "x" * 50_000 + f">tail{sign} data-x=don't>hello there</p><p title={sign}{sign}>more</p>"
        assert h.main_text(page) == "hello there\nmore"
    assert h.main_text("<article><p title='open>a</p><p>b</p>") == "a\nb"
    start = time.time()
    h.main_text("<a x='" * 20_000 + '<a x="' * 20_000)
    assert time.time() - start < 20


def test_kept_columns_must_not_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, text string, html string")
    with pytest.raises(ValueError):
        h.extract(pages, ["page_id", "text"])


def test_table(spark):
    rows = [(1, "u", None), (2, "u", "<article><p>é x</p></article>"), (2, "u", "<article><p>é x</p></article>"), (None, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in h.extract(pages, ["page_id", "url"]).collect())
    assert got == [("1", "", 0), ("2", "é x", 3), ("2", "é x", 3), ("None", "x", 1)]
    assert h.extract(pages.limit(0), ["page_id"]).count() == 0
