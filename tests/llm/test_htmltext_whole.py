"""Self-closed and unclosed elements end no article; formulas stay."""

import pytest

from plumbline.llm import htmltext as H

FIRST, LAST = "The first paragraph of an article has quite a few words in it.", "The last paragraph of it has no fewer words than the first."
PAGE = "<html><body><main><article><p>{}</p>{}<p>{}</p></article></main></body></html>"


@pytest.mark.parametrize("name", "svg iframe object canvas audio video button select noscript".split())
@pytest.mark.parametrize("form", ['<{} class="icon"/>', '<{} class="icon" />', "<{}>", "<{0}/><p>Between them.</p><{0}>hidden</{0}>", "<{0}>hidden <b>words</b></{0}>"])
def test_article_is_whole(name, form):
    got = H.main_text(PAGE.format(FIRST, form.format(name), LAST))
    assert got == "\n".join([FIRST, "Between them.", LAST] if "Between" in form else [FIRST, LAST])


@pytest.mark.parametrize("name", ["script", "style", "template", "title", "textarea"])
def test_raw_elements(name):
    assert H.main_text(PAGE.format(FIRST, f'<{name} id="x"/>', LAST)) == f"{FIRST}\n{LAST}"
    assert H.main_text(PAGE.format(FIRST, f"<{name} src=/x/>a < b</{name}>", LAST)) == f"{FIRST}\n{LAST}"
    assert H.main_text(PAGE.format(FIRST, f"<{name}>a < b</{name}>", LAST)) == f"{FIRST}\n{LAST}"


def test_formulas_stay():
    page = PAGE.format("Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> in all of physics.", "", LAST)
    assert H.main_text(page) == f"Energy is E=mc2 in all of physics.\n{LAST}"


def test_links_keep_their_text_after_an_icon():
    assert H.blocks("<p><a href=x><svg><path d=1></svg>Home page</a></p>") == [("Home page", 2, 2, 0, 0)]
