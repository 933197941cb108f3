"""Main text of web pages: flat text blocks classified by a decision tree on shallow features.

A page is read once, as a flat list of blocks (text between block-level tags). A block's features are its number of
words and its link density, the same of the block before and after, whether it is a heading, a structural hint from
the innermost element that says something (-2: by its meaning no part of an article, say a menu, a footer, a form; -1: a name
that boilerplate often has; +1: article; 0: nothing), and the share of the page's words that stand under that element.
Inside readers' comments it is the comments' element that speaks. No hint decides alone: an element that holds most of
a page is no sidebar whatever its name, and then words and links decide. Names count as a whole (`no-sidebar` and
`article-header` name no sidebar and no header), and those of html and body, which say what a page has, do not count.
The tree is grown (Gini impurity) on the small labelled table below. Pages stay in their partition: there is no shuffle.

Defined cases: null and empty pages give an empty text; pages without tags are one block; unclosed elements end
where an enclosing element ends; a start tag that ends in /> opens nothing; the text of HIDDEN elements is left out only
up to their own end tag, one without it hides nothing; repeated rows give equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, spread

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|title|textarea)(?![\w:-])"
    r"(?:\"[^\"]*\"|'[^']*'|=\s*[^\s'\">]+|[^'\">/]|/(?!\s*>))*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
_CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tr td th tbody figure details dialog menu blockquote center fieldset".split())
#: Elements whose text is no text of the page.
HIDDEN = frozenset("noscript select svg iframe object canvas audio video button".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WHERE = r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|sub|mobile|desktop|user|cookie|privacy|header|footer|comment|comments)[-_])?"
_WHAT = r"(?:[-_](?:container|wrapper|wrap|inner|outer|box|bar|area|list|section|block|links?|left|right|top|bottom|primary|secondary|slot|unit))?"
_BAD_NAME = re.compile(
    rf"^{_WHERE}(?:ads?|adv|adverts?|advertisement|breadcrumbs?|comments?|consent|contentinfo|cookies?|disqus|footer|foot|"
    rf"masthead|menu|menubar|nav|navbar|navigation|newsletter|notice|notices|pagination|replies|reply|sidebar|sponsor|sponsored|subscribe|"
    rf"topbar|gdpr|login|signup|discussion|responses){_WHAT}$",
    re.I,
)
#: A header by name, which within an article is the article's own.
_HEAD_NAME = re.compile(rf"^{_WHERE}(?:header|masthead){_WHAT}$", re.I)
#: Names that boilerplate often has.
_DOUBTFUL = re.compile(
    rf"^{_WHERE}(?:alert|banner|complementary|form|modal|pager|popup|promo|promotion|recommended|related|search|share|sharing|side|social|tags|toolbar|widgets?){_WHAT}$", re.I
)
_GOOD_NAME = re.compile(r"^(?:article|articlebody|body|content|entry|hentry|main|maincontent|post|posttext|story|text|(?:article|entry|main|page|post|story)[-_](?:body|content|text))$", re.I)
_COMMENTS = re.compile(rf"^{_WHERE}(?:comments?|replies|reply|disqus|discussion|responses){_WHAT}$", re.I)

#: Labelled blocks, made by hand: words, link density, words before, link density before, words after, link density
#: after, heading, hint; then 1 for main text. Their elements hold the usual share of a page, see USUAL.
_USUAL_BLOCKS = [
    (6, 1.0, 0, 0.0, 1, 1.0, 0, -2, 0), (1, 1.0, 6, 1.0, 1, 1.0, 0, -2, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, -2, 0),
    (12, 0.0, 1, 1.0, 10, 0.0, 0, -2, 0), (25, 0.0, 2, 1.0, 60, 0.0, 0, -2, 0), (80, 0.0, 40, 0.0, 6, 0.5, 0, -2, 0),
    (14, 0.1, 70, 0.0, 0, 0.0, 0, -2, 0), (3, 0.0, 12, 0.0, 45, 0.0, 1, -2, 0), (45, 0.0, 3, 0.0, 30, 0.0, 0, -2, 0),
    (30, 0.2, 50, 0.0, 10, 1.0, 0, -2, 0), (2, 0.5, 30, 0.0, 2, 0.5, 0, -2, 0), (120, 0.0, 90, 0.0, 3, 0.0, 0, -2, 0),
    (16, 0.0, 2, 0.5, 3, 0.0, 0, -2, 0), (19, 0.0, 0, 0.0, 4, 0.0, 0, -2, 0), (24, 0.0, 30, 0.0, 0, 0.0, 0, -2, 0),
    (38, 0.0, 6, 0.0, 8, 0.0, 0, -2, 0), (48, 0.1, 70, 0.0, 2, 0.0, 0, -2, 0), (64, 0.0, 5, 0.0, 4, 0.0, 0, -2, 0),
    (150, 0.0, 20, 0.0, 80, 0.0, 0, -2, 0), (300, 0.0, 9, 0.0, 0, 0.0, 0, -2, 0), (17, 0.0, 17, 0.0, 17, 0.0, 0, -2, 0),
    (55, 0.0, 60, 0.0, 50, 0.0, 0, -2, 0), (7, 0.0, 25, 0.0, 19, 0.0, 1, -2, 0), (2, 0.0, 0, 0.0, 4, 0.0, 1, -2, 0),
    (33, 0.0, 2, 0.0, 1, 0.0, 0, -2, 0), (27, 0.1, 3, 1.0, 70, 0.0, 0, -2, 0), (9, 0.0, 9, 0.0, 9, 0.0, 1, -2, 0),
    (5, 0.0, 30, 0.0, 3, 1.0, 0, 1, 1), (2, 0.0, 10, 0.0, 2, 0.5, 0, 1, 1), (9, 0.0, 1, 1.0, 4, 1.0, 1, 1, 1),
    (13, 0.0, 50, 0.0, 6, 1.0, 0, 1, 1), (1, 0.0, 4, 0.0, 1, 1.0, 0, 1, 1), (35, 0.5, 12, 0.0, 5, 0.8, 0, 1, 1),
    (7, 0.1, 7, 0.0, 9, 0.4, 0, 1, 1), (3, 0.0, 0, 0.0, 12, 0.3, 1, 1, 1), (11, 0.3, 60, 0.0, 2, 1.0, 0, 1, 1),
    (16, 0.0, 2, 0.5, 3, 0.0, 0, 1, 1), (19, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1), (24, 0.1, 30, 0.0, 0, 0.0, 0, 1, 1),
    (38, 0.0, 6, 0.0, 8, 0.0, 0, 1, 1), (64, 0.2, 5, 0.0, 4, 0.0, 0, 1, 1), (300, 0.0, 9, 0.0, 0, 0.0, 0, 1, 1),
    (7, 0.0, 25, 0.0, 19, 0.0, 1, 1, 1), (2, 0.0, 0, 0.0, 4, 0.0, 1, 1, 1), (6, 0.0, 6, 0.0, 2, 0.0, 0, 1, 1),
    (30, 0.6, 20, 0.0, 25, 0.0, 0, 1, 1), (4, 0.5, 4, 0.0, 4, 0.0, 0, 1, 1), (12, 0.7, 40, 0.0, 30, 0.0, 0, 1, 1),
    (60, 0.0, 30, 0.0, 3, 0.0, 0, 0, 1), (150, 0.0, 90, 0.0, 5, 0.0, 0, 0, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (52, 0.1, 10, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 25, 0.0, 6, 0.0, 0, 0, 1), (70, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1),
    (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (6, 0.0, 24, 0.0, 40, 0.0, 0, 0, 1), (13, 0.0, 60, 0.0, 22, 0.0, 0, 0, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), (3, 0.0, 9, 0.0, 3, 1.0, 0, 0, 0), (5, 0.0, 12, 0.0, 4, 0.3, 1, 0, 0),
    (10, 0.0, 12, 0.0, 50, 0.0, 1, 1, 1), (10, 0.0, 12, 0.0, 3, 0.0, 1, 1, 1), (1, 0.0, 10, 0.0, 40, 0.0, 0, 1, 1),
    (2, 0.0, 1, 0.0, 0, 0.0, 0, 1, 1), (50, 0.0, 10, 0.0, 60, 0.0, 0, 1, 1), (60, 0.1, 50, 0.0, 14, 0.1, 0, 1, 1),
    (40, 0.3, 60, 0.0, 20, 0.0, 0, 1, 1), (8, 0.0, 40, 0.0, 35, 0.0, 0, 1, 1), (5, 0.4, 30, 0.0, 28, 0.0, 0, 1, 1),
    (200, 0.0, 8, 0.0, 150, 0.0, 0, 1, 1), (1, 0.0, 1, 1.0, 14, 0.1, 1, 1, 1), (3, 0.0, 20, 0.0, 25, 0.0, 0, 1, 1),
    (2, 1.0, 50, 0.0, 2, 1.0, 0, 1, 0), (4, 1.0, 2, 1.0, 4, 1.0, 0, 1, 0), (7, 1.0, 40, 0.0, 14, 0.1, 0, 1, 0),
    (3, 0.67, 0, 0.0, 48, 0.0, 0, 0, 0), (4, 0.5, 2, 1.0, 40, 0.0, 0, 0, 0), (6, 0.6, 0, 0.0, 60, 0.0, 0, 0, 0),
    (5, 0.45, 1, 1.0, 35, 0.0, 0, 0, 0), (2, 0.5, 0, 0.0, 90, 0.0, 0, 0, 0), (7, 0.7, 9, 0.0, 30, 0.0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0), (1, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 1, 1.0, 12, 0.0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (3, 0.5, 0, 0.0, 2, 1.0, 0, 0, 0),
    (9, 0.9, 5, 1.0, 4, 1.0, 0, 0, 0), (18, 0.8, 30, 0.0, 8, 1.0, 0, 0, 0), (4, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0),
    (6, 0.2, 3, 1.0, 0, 0.0, 0, 0, 0), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0), (2, 0.0, 0, 0.0, 2, 0.5, 0, 0, 0),
    (5, 0.0, 2, 1.0, 4, 0.0, 0, 0, 0), (30, 0.6, 20, 0.7, 25, 0.8, 0, 0, 0), (22, 0.5, 3, 1.0, 2, 1.0, 0, 0, 0),
    (35, 0.0, 8, 0.0, 50, 0.0, 0, 0, 1), (50, 0.0, 35, 0.0, 42, 0.1, 0, 0, 1), (42, 0.1, 50, 0.0, 12, 0.0, 0, 0, 1),
    (90, 0.2, 4, 0.0, 70, 0.0, 0, 0, 1), (25, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1), (22, 0.1, 40, 0.0, 5, 1.0, 0, 0, 1),
    (12, 0.0, 40, 0.0, 45, 0.0, 0, 0, 1), (9, 0.0, 30, 0.0, 25, 0.0, 0, 0, 1), (14, 0.0, 20, 0.1, 18, 0.0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 45, 0.0, 1, 0, 1), (5, 0.0, 30, 0.0, 35, 0.0, 1, 0, 1), (3, 0.0, 40, 0.0, 60, 0.0, 1, 0, 1),
    (11, 0.0, 1, 1.0, 30, 0.0, 1, 0, 1), (18, 0.0, 30, 0.0, 3, 1.0, 0, 0, 1), (28, 0.3, 35, 0.0, 20, 0.0, 0, 0, 1),
    (6, 1.0, 0, 0.0, 1, 1.0, 0, -1, 0), (12, 0.0, 1, 1.0, 10, 0.0, 0, -1, 0), (25, 0.0, 2, 1.0, 60, 0.0, 0, -1, 0),
    (45, 0.0, 3, 0.0, 30, 0.0, 0, -1, 0), (64, 0.0, 5, 0.0, 4, 0.0, 0, -1, 0), (38, 0.0, 60, 0.0, 80, 0.0, 0, -1, 0),
    (80, 0.5, 40, 0.0, 60, 0.5, 0, -1, 0), (130, 0.6, 30, 0.0, 90, 0.7, 0, -1, 0), (7, 0.0, 25, 0.0, 19, 0.0, 1, -1, 0),
    (3, 0.0, 120, 0.0, 150, 0.0, 0, -1, 0), (70, 0.0, 50, 0.0, 2, 1.0, 0, -1, 0), (16, 0.0, 2, 0.5, 3, 0.0, 0, -1, 0),
    (120, 0.0, 90, 0.0, 100, 0.0, 0, -1, 1), (150, 0.0, 20, 0.0, 80, 0.0, 0, -1, 1), (300, 0.0, 9, 0.0, 0, 0.0, 0, -1, 1),
    (110, 0.1, 60, 0.0, 70, 0.0, 0, -1, 1), (200, 0.0, 2, 1.0, 3, 1.0, 0, -1, 1), (180, 0.2, 0, 0.0, 140, 0.1, 0, -1, 1),
    (120, 0.0, 90, 0.0, 60, 0.0, 0, 1, 1), (45, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1), (9, 0.0, 60, 0.0, 16, 0.0, 0, 1, 1),
]
#: The shares of a page's words under an element, by hint, that each of the blocks above stands for.
USUAL = {-2: (0.1, 0.4), -1: (0.1, 0.4), 0: (0.2, 0.5, 0.8), 1: (0.2, 0.5, 0.8)}
#: More labelled blocks, with the share before the label: names against most of a page's words, little articles, pages without names.
_UNUSUAL_BLOCKS = [
    (60, 0.0, 30, 0.0, 3, 0.0, 0, -2, 0.9, 1), (20, 0.0, 25, 0.0, 40, 0.0, 0, -2, 0.9, 1), (150, 0.0, 90, 0.0, 80, 0.0, 0, -2, 0.95, 1),
    (12, 0.0, 60, 0.0, 45, 0.0, 0, -2, 0.9, 1), (8, 0.0, 2, 1.0, 45, 0.0, 1, -2, 0.9, 1), (30, 0.1, 20, 0.0, 0, 0.0, 0, -2, 1.0, 1),
    (9, 0.0, 8, 0.0, 10, 0.0, 0, -2, 0.9, 1), (5, 0.0, 30, 0.0, 35, 0.0, 1, -2, 0.95, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, -2, 1.0, 1),
    (60, 0.0, 30, 0.0, 3, 0.0, 0, -1, 0.9, 1), (20, 0.0, 25, 0.0, 40, 0.0, 0, -1, 0.95, 1), (12, 0.0, 60, 0.0, 45, 0.0, 0, -1, 0.9, 1),
    (3, 1.0, 2, 1.0, 2, 1.0, 0, -2, 0.9, 0), (2, 1.0, 50, 0.0, 2, 1.0, 0, -2, 0.9, 0), (20, 0.8, 3, 1.0, 6, 0.9, 0, -2, 0.8, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, -2, 1.0, 0), (6, 0.7, 9, 0.5, 4, 1.0, 0, -1, 0.9, 0), (120, 0.6, 30, 0.4, 90, 0.7, 0, -1, 0.9, 0),
    (2, 0.0, 250, 0.0, 90, 1.0, 0, -1, 1.0, 0), (3, 0.0, 60, 0.0, 20, 1.0, 0, -2, 0.9, 0), (2, 0.0, 120, 0.0, 30, 1.0, 0, -1, 0.9, 0),
    (300, 0.0, 0, 0.0, 90, 0.0, 0, -2, 0.77, 0), (60, 0.0, 40, 0.0, 80, 0.0, 0, -2, 0.75, 0), (30, 0.0, 12, 0.0, 25, 0.0, 0, -2, 0.7, 0),
    (16, 0.0, 9, 0.0, 0, 0.0, 0, -2, 0.5, 0), (14, 0.0, 6, 1.0, 2, 0.0, 0, -2, 0.4, 0), (40, 0.0, 12, 0.0, 20, 0.0, 0, -2, 0.5, 0),
    (25, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0.1, 1), (2, 0.0, 14, 0.0, 16, 0.0, 1, 1, 0.1, 1), (4, 0.0, 13, 0.0, 16, 0.0, 0, 1, 0.2, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1.0, 1), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 1.0, 1), (5, 0.0, 5, 0.0, 6, 0.0, 0, 0, 1.0, 1),
    (2, 0.0, 6, 0.0, 7, 0.0, 0, 0, 1.0, 1), (6, 0.0, 7, 0.0, 0, 0.0, 0, 0, 1.0, 1), (4, 0.0, 0, 0.0, 6, 0.0, 1, 0, 1.0, 1),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1.0, 0), (2, 0.5, 0, 0.0, 3, 1.0, 0, 0, 1.0, 0), (1, 1.0, 7, 0.0, 0, 0.0, 0, 0, 1.0, 0), (3, 0.67, 0, 0.0, 48, 0.0, 0, 0, 1.0, 0),
]
LABELLED = [(*b[:8], share, b[8]) for b in _USUAL_BLOCKS for share in USUAL[b[7]]] + _UNUSUAL_BLOCKS


@dataclass
class Node:
    value: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def __call__(self, x: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.limit else node.high
        return node.value


def grow(rows: list[tuple], depth: int = 8) -> Node:
    """A tree that at each node takes the split of least Gini impurity, first features and lower limits first."""
    ones = sum(r[-1] for r in rows)
    leaf = Node(2 * ones > len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return leaf
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            parts = [[r for r in rows if (r[f] > (a + b) / 2) == side] for side in (False, True)]
            impurity = sum(2 * p * (len(part) - p) / len(part) for part in parts if (p := sum(r[-1] for r in part)) or part)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (a + b) / 2, parts)
    if best is None:
        return leaf
    return Node(leaf.value, best[1], best[2], grow(best[3][0], depth - 1), grow(best[3][1], depth - 1))


@lru_cache(1)
def tree() -> Node:
    return grow(LABELLED)


@lru_cache(4096)
def _hint(tag: str, attrs: str) -> tuple[int, str]:
    """What an element says of its text, and what it is: readers' comments, a header, an article, or none of these."""
    if tag in ("html", "body"):
        return 0, ""
    names = [x for m in _NAMED.finditer(attrs) for x in next(g for g in (*m.groups(), "") if g is not None).split()]
    if any(_COMMENTS.match(x) for x in names):
        return -2, "comments"
    if tag == "header" or any(_HEAD_NAME.match(x) for x in names):
        return -2, "header"
    if tag in _BAD_TAGS or any(_BAD_NAME.match(x) for x in names):
        return -2, ""
    if any(_DOUBTFUL.match(x) for x in names):
        return -1, ""
    return (1, "article") if tag in ("article", "main") or any(_GOOD_NAME.match(x) for x in names) else (0, "")


class _Reader:
    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, int, int, int]] = []  # text, words, linked words, heading, hint, element that gives the hint
        self.stack: list[tuple[str, int, str, int]] = []  # tag, hint, what it is, number
        self.elements = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = 0
        self.heading = 0
        self.hidden = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                linked = len(html.unescape(" ".join(self.linked)).split())
                words = text.count(" ") + 1
                self.blocks.append((text, words, min(linked, words), self.heading, *self.hint()))
        self.parts, self.linked = [], []

    def hint(self) -> tuple[int, int]:
        """The hint and the number of the element that gives it: comments first, else the innermost that says something."""
        found, article = (0, 0), any(kind == "article" for _, _, kind, _ in self.stack)
        for _, hint, kind, number in reversed(self.stack):
            if kind == "comments":
                return hint, number
            if not found[0] and hint and not (kind == "header" and article):
                found = hint, number
        return found

    def text(self, s: str) -> None:
        if s and not self.hidden:
            self.parts.append(s)
            if self.in_link:
                self.linked.append(s)

    def tag(self, name: str, end: bool, attrs: str, hides: bool = False) -> None:
        if name in HIDDEN:
            self.flush()
            if hides:
                self.push(name, 0, "")
                self.hidden += 1
            elif end:
                self.close(name)
            return
        if self.hidden and name not in _CONTAINERS:
            return
        if name in _INLINE:
            if name == "br":
                self.text(" ")
            elif name == "a":
                self.in_link = 0 if end else 1
            return
        if not self.hidden:
            self.flush()
            self.in_link = 0
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                self.heading = 0 if end else 1
            elif not end:
                self.heading = 0
        if name in _CONTAINERS:
            if end:
                self.close(name)
            elif not attrs.rstrip().endswith("/"):
                self.push(name, *_hint(name, attrs))

    def push(self, name: str, hint: int, kind: str) -> None:
        self.elements += 1
        self.stack.append((name, hint, kind, self.elements))

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.hidden -= sum(x[0] in HIDDEN for x in self.stack[k:])
                del self.stack[k:]
                break


def _hiding(tokens: list[re.Match]) -> set[int]:
    """Positions of start tags of HIDDEN elements whose own end tag comes before an enclosing element ends."""
    stack, found = [], set()
    for i, m in enumerate(tokens):
        name = (m["tag"] or "").lower()
        if name not in HIDDEN and name not in _CONTAINERS:
            continue
        if not m["end"]:
            if not m["attrs"].rstrip().endswith("/"):
                stack.append((name, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if name in HIDDEN:
                    found.add(stack[k][1])
                del stack[k:]
                break
    return found


def _read(page: str) -> list[tuple[str, int, int, int, int, int]]:
    r, at = _Reader(), 0
    tokens = list(_TOKEN.finditer(page))
    hiding = _hiding(tokens)
    for i, m in enumerate(tokens):
        r.text(page[at : m.start()])
        at = m.end()
        if m["tag"]:
            r.tag(m["tag"].lower(), m["end"] == "/", m["attrs"], i in hiding)
        elif m["raw"]:
            r.flush()
    r.text(page[at:])
    r.flush()
    return r.blocks


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """The flat list of a page's text blocks: text, words, linked words, heading, hint."""
    return [b[:5] for b in _read(page)]


def features(page: str) -> list[tuple[str, tuple]]:
    """Each block's text and features, in the order of LABELLED."""
    found = _read(page)
    dense = [(b[1], b[2] / b[1]) for b in found]
    under: dict[int, int] = {}
    for b in found:
        under[b[5]] = under.get(b[5], 0) + b[1]
    total, edge, out = sum(under.values()), (0, 0.0), []
    for i, b in enumerate(found):
        before, after = dense[i - 1] if i else edge, dense[i + 1] if i + 1 < len(dense) else edge
        out.append((b[0], (*dense[i], *before, *after, b[3], b[4], under[b[5]] / total)))
    return out


def main_text(page: str | None) -> str:
    t = tree()
    return "\n".join(text for text, x in features(page or "") if t(x))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: id, the columns in keep, text and n_chars (its code points); names that keep has already get underscores behind them."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    html_at = fresh(pages, "_html")
    kept = pages.select(*dict.fromkeys([id_col, *keep]))
    df = spread(pages.select(*kept.columns, F.col(html_col).cast("string").alias(html_at)))
    schema = kept.schema.add(fresh(kept, "text"), "string").add(fresh(kept, "n_chars"), "long")
    names = schema.names
    return df.mapInArrow(run, schema)
