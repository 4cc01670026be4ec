"""Lines of pages, alignment, and main texts against what the fixtures' articles hold."""

from __future__ import annotations

import html
import random
import re

import pytest

from staycoder.llm.html_lines import ARTICLE, CHROME, OPEN, page_lines
from staycoder.llm.page_difference import DifferenceConfig, host_and_path, main_text, shared_places

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (None, []),
        ("", []),
        ("a &lt; b &amp;amp; c&nbsp;&#233;&copy", [(OPEN, "a < b &amp; c é©")]),
        ("<p>one<p>two<div>three</div>four", [(OPEN, "one"), (OPEN, "two"), (OPEN, "three"), (OPEN, "four")]),
        ("<article><p><b>x.<br><p>y <i>z</i>\n\t w</p></article><footer>f", [(ARTICLE, "x."), (ARTICLE, "y z w"), (CHROME, "f")]),
        ("<script>var a='</p><p>no';</script>t<style>p{}</STYLE >u", [(OPEN, "tu")]),
        ("<!-- <p>no</p> -->a<!---->b<!doctype x>c", [(OPEN, "abc")]),
        ("<main><header><h1>t</h1></header><nav>n</nav><p class='comment-list'>c</p>x<footer>y</footer></main>",
         [(ARTICLE, "t"), (CHROME, "n"), (CHROME, "c"), (ARTICLE, "x"), (CHROME, "y")]),
        ("<header>h</header><div class=\"ad\">a</div><div id=sidebarLeft>s</div><div class=loading>l</div>",
         [(CHROME, "h"), (CHROME, "a"), (CHROME, "s"), (OPEN, "l")]),
        ("<body class='has-sidebar'><a title='x > y' href=\"?a>b\">link</a> 1 < 2 </> <", [(OPEN, "link 1 < 2 <")]),
        ("a<div class='ad'>b<p>c</div>d<a href=\"open>e", [(OPEN, "a"), (CHROME, "b"), (CHROME, "c"), (OPEN, "de")]),
        ("<article class='post related-content'>a<article class='comment depth-2'>b</article>c<form>d</form><label>e</label></article>",
         [(ARTICLE, "a"), (CHROME, "b"), (ARTICLE, "c"), (CHROME, "d"), (CHROME, "e")]),
        ("&am<b>p;</b>", [(OPEN, "&amp;")]),
        ("x<p hidden>y</p><p aria-hidden=true>z</p><p role=navigation>n</p>", [(OPEN, "x"), (CHROME, "y"), (CHROME, "z"), (CHROME, "n")]),
    ],
)
def test_lines(page, lines):
    assert page_lines(page) == lines


def test_common_subsequences_have_full_length():
    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(3)
    for _ in range(1500):
        kinds = rng.choice([2, 3, 7])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(14))] for _ in range(2))
        for cells in (1 << 26, 8):
            places = shared_places(a, b, cells)
            rest = iter(b)
            assert len(set(places)) == len(places) == length(a, b)
            assert all(a[i] in rest for i in places)


def test_hosts_and_paths():
    assert host_and_path("http://A.example:80/x/y?q=1#top") == ("a.example", "/x/y?q=1")
    assert host_and_path(None) == ("", "") and host_and_path("not a url") == ("", "not a url")
    assert host_and_path("http://[x") == ("", "http://[x")


def test_differencing_decides_where_markup_does_not(spark):
    def page(*body, top="Site name", end="Imprint of the site"):
        return f"<body><div>{top}</div>" + "".join(f"<p>{b}</p>" for b in body) + f"<div>{end}</div></body>"

    texts = {i: [f"First paragraph of text number {i}.", f"Second one, about {i * 7} things."] for i in range(40)}
    rows = [(i, f"http://h.example/a/{i:03}", page(*texts[i]), "x") for i in texts]
    rows += [(100 + i, f"http://h.example/a/{3:03}?copy={i}", page(*texts[3]), "x") for i in range(300)]  # copies teach nothing
    rows += [(500, "http://other.example/", page("alone"), "x"), (501, None, None, None), (None, "http://h.example/a/003", page(*texts[3]), "x")]
    rows += [(502, "http://n.example/1", page("long " * 300), None), (503, "http://n.example/2", page("long " * 300 + "x"), None)]
    rows += [(504, "http://c.example/1", page("long " * 300, "y"), None), (505, "http://c.example/2", page("long " * 300, "z"), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = {r["page_id"]: r for r in main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in texts:
        assert got[i]["text"] == "\n".join(texts[i]), i
    for i in (100, 399, None):
        assert got[i]["text"] == "\n".join(texts[3])
    assert got[500]["text"] == "Site name\nalone\nImprint of the site"  # no other page to compare with
    assert (got[501]["text"], got[501]["n_chars"], got[501]["url"]) == ("", 0, None)
    assert got[502]["text"] == "long " * 299 + "long"
    assert "Site name" in got[504]["text"] and got[504]["n_shared"] == 0  # near copies say nothing
    strict = {r["page_id"]: r["text"] for r in main_text(pages, DifferenceConfig(near_copy=1.0)).collect()}
    assert strict[504] == "y"
    assert main_text(pages.where("page_id = -1")).count() == 0


def test_shared_article_lines_stay(spark):
    def page(i):
        return f"<nav>menu {i}</nav><div>top</div><article><p>Licence</p><p>own text {i}</p></article><div class=ad>buy {i}</div>"

    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(5)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in main_text(pages).collect()}
    assert got[2]["text"] == "Licence\nown text 2" and got[2]["n_shared"] == 2
    plain = {r["page_id"]: r["text"] for r in main_text(pages, DifferenceConfig(trust_markup=False)).collect()}
    assert plain[2] == "own text 2"


def test_differencing_settles_open_lines_beside_an_article(spark):
    def page(i):
        body = "".join(f"<p>text {i}, paragraph {k}</p>" for k in range(4))
        teaser = "<article class=teaser><p>Read on</p></article>"
        return f"<nav>menu {i}</nav><div>Site name</div><div>{body}</div>{teaser}<div>Imprint</div><div class=ad>buy {i}</div>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(5)] + [(9, "http://alone/", page(9))]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i]["text"] == "\n".join([*(f"text {i}, paragraph {k}" for k in range(4)), "Read on"])
        assert (got[i]["n_lines"], got[i]["n_shared"], got[i]["n_chars"]) == (7, 3, len(got[i]["text"]))
    assert got[9]["text"].split("\n") == ["Site name", *(f"text 9, paragraph {k}" for k in range(4)), "Read on", "Imprint"]  # no neighbour


def test_query_on_the_given_pages(spark):
    from staycoder.llm.queries import QUERIES

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for row in got:
        article = re.search("<article>(.*)</article>", pages[row["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|li|ul)>", article)]
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])
