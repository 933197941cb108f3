"""The tree decides: names that mean nothing here, elements that hold most of a page, pages without names, splits by brute force."""

import random
import re

import pytest

from plumbline.llm import htmltext as H


def words(n, tag="word"):
    return " ".join(f"{tag}{i}" for i in range(n))


NAV = "<nav><a href=1>One</a> <a href=2>Two</a></nav>"
TEXTS = [words(n, f"w{k}x") for k, n in enumerate((40, 25, 60, 12, 33))]
BODY = "".join(f"<p>{t}</p>" for t in TEXTS)


@pytest.mark.parametrize("name", ["home no-sidebar", "has-footer", "comments-open", "nav", "sidebar", "single-post with-comments menu-open"])
def test_body_names_say_nothing(name):
    for page in (f'<body class="{name}">{NAV}<article>{BODY}</article></body>', f'<html class="{name}"><body>{NAV}<div>{BODY}</div></body></html>'):
        assert H.main_text(page) == "\n".join(TEXTS)


@pytest.mark.parametrize("name", ["post comments-closed", "long-form", "no-comments", "entry has-sidebar", "comment-free"])
def test_names_count_as_a_whole(name):
    assert H.main_text(f'<body>{NAV}<article class="{name}">{BODY}</article></body>') == "\n".join(TEXTS)


@pytest.mark.parametrize("element", ['div class="article-header"', 'div class="header"', "header", 'header class="page-header"'])
def test_an_articles_own_header_stays(element):
    tag = element.split()[0]
    page = f"<body>{NAV}<article><{element}><h1>The title</h1><p>{words(20)}</p></{tag}>{BODY}</article></body>"
    assert H.main_text(page) == "\n".join(["The title", words(20), *TEXTS])


@pytest.mark.parametrize("element", ["form id=aspnetForm", "aside", 'div class="sidebar"', 'div id="discussion"', 'section class="notice"', "footer"])
def test_what_holds_most_of_a_page_is_judged_by_words_and_links(element):
    tag = element.split()[0]
    page = f"<body><{element}><p><a href=1>One two</a></p>{BODY}<p><a href=2>three</a></p></{tag}><div>end</div></body>"
    assert H.main_text(page).split("\n")[: len(TEXTS)] == TEXTS and "One two" not in H.main_text(page)
    small = f"<body><article>{BODY}</article><{element}><p>{words(18)}</p></{tag}></body>"
    assert H.main_text(small) == "\n".join(TEXTS)


def test_comments_stay_out():
    comment = f"<article><p>{words(30, 'said')}</p></article>"
    for name in ("comments", "comment-list", "disqus", "user-comments"):
        assert H.main_text(f'<body><article>{BODY}<section id="{name}">{comment * 2}</section></article></body>') == "\n".join(TEXTS), name


def test_short_paragraphs_without_names():
    lines = ["A short line here.", "Then a second short one.", "And the last of them.", "It ends."]
    page = "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
    assert H.main_text(page) == "\n".join(lines)


def test_random_names_change_few_blocks(spark, sf_dir):
    rng, changed, total = random.Random(2), 0, 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        other = re.sub(r'(class|id|role)="[^"]*"', lambda m: f'{m[1]}="x{rng.getrandbits(32):x}"', r["html"])
        a, b = H.main_text(r["html"]).split("\n"), H.main_text(other).split("\n")
        total += len(H.blocks(r["html"]))
        changed += len(set(a) ^ set(b))
    assert changed < 0.1 * total


def gini(rows):
    p = sum(r[-1] for r in rows) / len(rows) if rows else 0
    return 2 * p * (1 - p) * len(rows)


def check(node, rows):
    """The node's split is one of least impurity over all features and all limits between values."""
    if node.feature < 0:
        assert node.value == (2 * sum(r[-1] for r in rows) > len(rows))
        return 1
    best = min(
        gini([r for r in rows if r[f] <= v]) + gini([r for r in rows if r[f] > v])
        for f in range(len(rows[0]) - 1) for v in {r[f] for r in rows} if any(r[f] > v for r in rows)
    )
    low, high = [r for r in rows if r[node.feature] <= node.limit], [r for r in rows if r[node.feature] > node.limit]
    assert low and high and gini(low) + gini(high) == pytest.approx(best)
    return check(node.low, low) + check(node.high, high)


def test_splits_by_brute_force():
    assert check(H.tree(), H.LABELLED) > 5
    wrong = [r for r in H.LABELLED if H.tree()(r[:-1]) != bool(r[-1])]
    assert len(wrong) <= 0.03 * len(H.LABELLED)


def leaves(node, seen=()):
    if node.feature < 0:
        return [(node.value, seen)]
    return leaves(node.low, (*seen, node.feature)) + leaves(node.high, (*seen, node.feature))


def test_no_branch_is_decided_by_the_hint_alone():
    assert all(set(seen) - {7} for _, seen in leaves(H.tree()))


def plain_features(parts):
    """parts: (text, linked words, heading, hint, element)."""
    size = [len(t.split()) for t, *_ in parts]
    out = []
    for i, (t, linked, heading, hint, element) in enumerate(parts):
        near = lambda j: (size[j], parts[j][1] / size[j]) if 0 <= j < len(parts) else (0, 0.0)
        share = sum(n for n, p in zip(size, parts) if p[4] == element) / sum(size)
        out.append((t, (size[i], linked / size[i], *near(i - 1), *near(i + 1), heading, hint, share)))
    return out


def test_features():
    page = (
        '<body><nav>a <a href=1>b c</a><div>d</div></nav><h2>Title here</h2><div class="promo">x y<p>z</p></div>'
        '<main><header>lead</header>one <a href=2>two</a> three<ul class="menu"><li>m</ul>four</main><section id=comments><article>said so</article></section>tail</body>'
    )
    parts = [("a b c", 2, 0, -2, "nav"), ("d", 0, 0, -2, "nav"), ("Title here", 0, 1, 0, None), ("x y", 0, 0, -1, "promo"), ("z", 0, 0, -1, "promo"), ("lead", 0, 0, 1, "main"),
             ("one two three", 1, 0, 1, "main"), ("m", 0, 0, -2, "menu"), ("four", 0, 0, 1, "main"), ("said so", 0, 0, -2, "comments"), ("tail", 0, 0, 0, None)]
    assert H.features(page) == plain_features(parts)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>one two</p>", "kept")], "page_id long, url string, html string, text string")
    out = H.extract(df, keep=("url", "text"))
    assert out.columns == ["page_id", "url", "text", "text_", "n_chars"] and out.first()["text"] == "kept"
