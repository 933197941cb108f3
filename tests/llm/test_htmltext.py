"""Main text of pages: by hand, and on the synthetic pages."""

import html
import re

import pytest

from plumbline.llm import htmltext as H
from plumbline.llm.queries import op7_main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) { x = "</p>"; }</script></head><body>
<header class="top"><a href="/">Home</a> The site</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for everyone who comes to read it.</p></div>
<main><article><header><h1>A&nbsp;title &amp; more</h1></header><p>First   paragraph with <b>bold</b> and <a href="x">a link</a>&hellip;
 over lines.<p>Short.<aside>Read also this other long story that is about something else entirely, dear reader.</aside>
<div class="ad">Buy now the best of all things that you could ever want to have in your house.</div><p>Last &lt;p&gt; of it.</p>
<section id="comments"><article class="comment"><p>I think that this is a very good article and I read it with pleasure.</p></article></section></article></main>
<form><p>Subscribe to our letter and get the best stories of each week into your mail box.</p><input></form>
<!-- <p>not this long and hidden paragraph of words</p> --><footer>&copy; 2020 by us, who made this page for you to read and enjoy</footer></body>"""


def test_page():
    assert H.main_text(PAGE) == "A title & more\nFirst paragraph with bold and a link… over lines.\nShort.\nLast <p> of it."


def test_structureless_page():
    page = "<div><a href=1>Home</a> | <a href=2>News</a></div><div>" + "A long text of many words. " * 8 + "</div><div>" + "And another one, no less long. " * 6 + "</div><div><a href=3>Next</a></div>"
    assert H.main_text(page).count("\n") == 1 and "Home" not in H.main_text(page)


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "<script>", "</div></p>", "&", "<a href='", "<b><i></b>"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page), str)


def test_synthetic_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op7_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "a"), (1, "u", None, "a"), (None, None, "<p>" + "w " * 200_000, "b"), (2, "u", "", None)], "page_id long, url string, html string, text string")
    assert H.extract(df).count() == 4 and H.extract(df.where("1 = 0")).count() == 0


def test_doubtful_names_are_decided_by_words_and_links():
    from plumbline.llm.htmltext import main_text

    words = lambda n: " ".join(f"word{i}" for i in range(n))
    for name in ("social", "related", "search", "side", "tags", "alert", "promo"):
        page = f"<body><div class='{name}'><p>{words(300)}</p><p>short line</p><p><a href='x'>{words(120)}</a></p></div></body>"
        assert main_text(page) == words(300), name
    plain = f"<body><p><a href=a>one</a> <a href=b>two</a></p><p>{words(80)}</p><p>{words(60)}</p><p><a href=c>three</a></p></body>"
    assert main_text(plain) == f"{words(80)}\n{words(60)}"
    assert main_text(f"<body><div class='comments'><p>{words(300)}</p></div><p>{words(90)}</p></body>") == words(90)
