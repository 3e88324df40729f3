"""Main text of pages: the given pages against a plain reading of their articles, planted templates, broken markup."""

import html
import random
import re

import pytest

from loomspark.llm import page_text, queries
from loomspark.llm.page_text import extract, main_text
from tests.conftest import DATA


def plain(page):
    """The article of a page of the given table, whose markup is regular: h1, then p, some of them not closed."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", " ", x))).strip() for x in re.split(r"</?(?:h1|p)>", inner))
    return "\n\n".join(filter(None, parts))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/{sf}/pages.parquet").collect()}
    found = queries.op11_page_text(spark, f"{DATA}/{sf}").collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(plain(pages[r.page_id].html)))
    assert sum(r.n_templates for r in found) > 0 or sf == "sf0.001"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def site():
    """Pages without article or main elements: what repeats is only known from other pages."""
    r = random.Random(4)
    menu = "<div><div><a href='/a'>Alpha</a> <a href='/b'>Beta</a></div><div>Phone us now</div></div>"
    box = "<div>Read our <b>weekly letter</b></div>"
    shared = f"<p>{words(r, 30)}</p>"  # quoted by few pages: stays
    pages, want = [], {}
    for i in range(20):
        a, b = words(r, 20), words(r, 25)
        quote = shared if i % 5 == 0 else ""
        pages.append((i, f"https://SITE.example/{i}", f"<html><body>{menu}<div><h2>T {i}</h2><p>{a}{quote}<p>{b}{box}</div><div>(c) all rights</div></body>"))
        want[i] = "\n\n".join([f"T {i}", a, *([shared[3:-4]] if quote else []), b])
    copies = [(100 + i, "https://site.example/copy", f"<body>{menu}<div><p>{words(random.Random(9), 40)}</p><p>end {'x' * (i % 2)}</p></div>") for i in range(30)]
    want |= {100 + i: f"{words(random.Random(9), 40)}\n\nend{' x' if i % 2 else ''}" for i in range(30)}
    return pages, copies, want


def test_templates_go_and_copies_stay(spark, site):
    pages, copies, want = site
    df = spark.createDataFrame(pages + copies, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in main_text(df).collect()}
    assert found == want
    # alone, a page keeps what no other page shows to be template
    alone = main_text(spark.createDataFrame(pages[:1], df.schema)).first()
    assert "Phone us now" in alone.text and alone.n_templates == 0


def test_boxes_inside_articles(spark):
    r = random.Random(5)
    texts = [words(r, 30) for _ in range(12)]
    df = spark.createDataFrame([(i, "http://h.example/", f"<article><h1>H{i}</h1><p>{t}</p><p>Follow this site daily</p></article>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in main_text(df).collect()} == {i: f"H{i}\n\n{t}" for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>", ""), ("<article></article><p>not this</p>", ""),
        ("<p>a<p>b<div>c", "a\n\nb\n\nc"), ("<p>a <b>b</b>c<br>d\n\t e</p>", "a bc d e"), ("a &lt;b&gt; &#233;&eacute;&nbsp;x", "a <b> éé x"),
        ("<title>t</title><body>x<script>if (a<b) '</p>'</script>y<style>p{}</style>z", "xyz"),
        ("<!-- <p>no --><p>yes<!-- a > b --></p>", "yes"), ("<p title='a>b' class=\"x\">q</p>", "q"),
        ("<main><nav>n</nav><h1>h</h1><p>p</p><div class='ad box'>buy</div><aside>s</aside><form>f<p>g</p></form></main>", "h\n\np"),
        ("<body class='has-sidebar ad'><div id='sidebar'>s</div><div class='wrap menu'><article>t</article></div></body>", "t"),
        ("<article>a<section class='comments'><article class='comment'>bad</article></section></article><article class='comment'>worse</article>", "a"),
        ("<form id=aspnet><article><p>in a form</p></article></form>", "in a form"), ("<p hidden>no</p><p style='display: none'>no</p><p style='overflow: hidden ;'>yes</p>", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\nc\n\n1\n\n2\n\n3"),
        ("<article><b>x</article></b>y", "x"), ("<p>a < b and c</ p> d", "a < b and c</ p> d"), ("<article>a</div></p></b> b</article>", "a\n\nb"), ("<p>open <a href=\"x>rest", 'open "x>rest'),
    ],
)
def test_markup(page, text):
    assert extract(page) == text


def test_long_and_deep_pages():
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert len(extract("<p>word</p>" * 50_000).split("\n\n")) == 50_000
    page_text.subtrees("<div>" * 20_000 + "deep" + "<p>x" * 1000)


def test_odd_rows(spark):
    rows = [(None, None, None, "h"), (1, None, "<p>x</p>", "h"), (1, None, "<p>x</p>", "h"), (2, "no scheme", "", None), (3, "http://", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert sorted(((r.page_id, r.url, r.text) for r in main_text(df).collect()), key=str) == sorted([(None, None, ""), (1, None, "x"), (1, None, "x"), (2, "no scheme", ""), (3, "http://", "")], key=str)
    assert main_text(df.limit(0)).count() == 0
