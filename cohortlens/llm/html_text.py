"""Main text of web pages by shallow text features.

A page is cut into flat blocks of text at block-level tags. A block is described by its word count and link density, those
of its neighbours, and where it stands: inside an article, or inside something that by its tag or whole name isn't one, or by
a part of its name may not be. A decision tree trained on the small labelled table below says which blocks are main text: a
list of links is none wherever it stands, and what a name leaves open its words and links decide. Everything is a map over the
pages; the work is proportional to a page's length whatever its markup.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Fixed values of HTML: elements without end tag, elements whose content is not text, block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg canvas audio video head title select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIBLING_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Words of a class or id that name what surrounds an article, words that may also name a part of one, and landmark roles.
CLUTTER = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs pagination pager banner "
    "sidebar footer masthead topbar cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login share sharing social "
    "comment comments commentlist disqus reply replies".split()
)
#: Words that say nothing beside one of CLUTTER: with any other word (`ad-hoc`, `share-prices`) a name is ambiguous.
LAYOUT = frozenset(
    "a area article aside bar block bottom box btn button buttons card center col column container content entry fixed footer form global group header icon icons id inline inner "
    "item items left link links list main mobile module outer page panel post primary region right row secondary section sidebar site slot small sticky story text title tools top "
    "unit widget wrap wrapper".split()
)
AMBIGUOUS = frozenset("header form search related recommended trending popular tags discussion respond widget rail toolbar overlay copyright disclaimer promotion skip dialog".split())
ROLES = frozenset("banner complementary contentinfo form navigation search dialog alert alertdialog menu menubar".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text prose".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTES = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    words: int
    link: float  # share of its words inside links
    heading: int
    article: int  # inside article or main, or a container named like one
    clutter: float  # inside nav, footer, form and the like, or a container named so; 0.5 for an ambiguous name


def _signs(tag: str, attributes: str, within: bool) -> tuple[int, float]:
    """(article, clutter) as the element's tag and names say. `within`: an article is around it."""
    article = tag in ("article", "main")
    clutter = 1.0 if tag in ("nav", "footer", "aside", "form", "menu", "dialog", "fieldset") or (tag == "header" and not within) else 0.0
    if "=" in attributes and tag not in ("body", "html", "article", "main"):
        named: set[str] = set()
        for name, value in NAMES.findall(attributes):
            value = value.strip("\"'")
            if name.lower() == "role":
                clutter = max(clutter, float(value.strip().lower() in ROLES))
                continue
            for whole in value.split():
                parts = {p.lower() for p in PARTS.findall(whole)}
                named |= parts
                if parts & CLUTTER:
                    clutter = max(clutter, 1.0 if parts <= CLUTTER | LAYOUT | AMBIGUOUS else 0.5)
        if named & AMBIGUOUS and not (within and named & AMBIGUOUS == {"header"}):
            clutter = max(clutter, 0.5)
        article |= bool(named & ARTICLE_WORDS) and not clutter and tag in ("div", "section", "td")
    return int(article), clutter


class _Open:
    """The open elements, with the places of each tag and of block-level ones, so that no search walks through them."""

    def __init__(self):
        self.stack: list[tuple[str, int, float, bool]] = []  # tag, and article, clutter, hidden so far
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.links = self.headings = 0

    def push(self, tag: str, article: int, clutter: float, hidden: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, article, clutter, hidden))
        self.links += tag == "a"
        self.headings += tag in HEADINGS

    def last(self, tags) -> int:
        """The place of the innermost of these elements, -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()
            self.links -= tag == "a"
            self.headings -= tag in HEADINGS

    def state(self) -> tuple[str, int, float, bool]:
        return self.stack[-1] if self.stack else ("", 0, 0.0, False)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space turned into single spaces, character references decoded."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked: list[str] = []
    at, size, last_end, quoted = 0, len(page), page.rfind(">"), True

    def flush() -> None:
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                words = text.count(" ") + 1
                inside = len(html.unescape(" ".join(linked)).split())
                _, article, clutter, _ = opened.state()
                out.append(Block(text, words, min(inside / words, 1.0), int(opened.headings > 0), article, clutter))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text and not opened.state()[3]:
            parts.append(text)
            if opened.links:
                linked.append(text)

    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if page.startswith("<!--", start):
            add(page[at:start])
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            add(page[at:start])
            end = page.find("]]>", start + 9)
            add(html.escape(page[start + 9 : size if end < 0 else end]))
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            add(page[at:start])
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("</", start)
        name = NAME.match(page, start + 1 + closing) if start < last_end else None
        if name is None:  # a sign, not a tag
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        whole = ATTRIBUTES.match(page, name.end()) if quoted else None
        if whole is None:  # a quote that swallows the rest of the page is none, here and further on
            quoted = False
            at = page.find(">", name.end()) + 1 or size
        else:
            at = whole.end()
        tag, attributes = name[0].lower(), page[name.end() : at - 1]
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if closing:
            if tag in BLOCKS or tag in HIDDEN:
                flush()
            place = opened.last((tag,))
            if place >= 0 and (tag in BLOCKS or not opened.block_places or place > opened.block_places[-1]):
                opened.close(place)
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and opened.block_places and opened.block_places[-1] == opened.last(("p",)):
                opened.close(opened.block_places[-1])
            if tag in SIBLINGS and opened.last(SIBLINGS[tag]) > opened.last(SIBLING_SCOPE[tag]):
                opened.close(opened.last(SIBLINGS[tag]))
        _, article, clutter, hidden = opened.state()
        a, c = _signs(tag, attributes, bool(article))
        if attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        opened.push(tag, article | a, max(clutter, c), hidden or tag in HIDDEN)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = (page.find(">", end.end()) + 1 or size) if end else size
            opened.close(len(opened.stack) - 1)
    flush()
    return out


FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "heading", "inside", "clutter", "outside")

#: The labelled table, from blocks of pages of many layouts: FEATURES, then 1 for main text. `outside`: the page marks an
#: article and the block isn't in it.
LABELLED = (
    (6, 0.0, 106, 0.0, 0, 0.0, 0, 0, 0.0, 1, 0), (1, 1.0, 6, 1.0, 7, 0.0, 0, 0, 0.5, 1, 0), (2, 0.0, 4, 0.0, 1, 1.0, 1, 0, 0.5, 1, 0),
    (3, 1.0, 3, 0.0, 8, 1.0, 0, 0, 0.5, 1, 0), (3, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0.5, 1, 0), (5, 1.0, 9, 1.0, 9, 1.0, 0, 0, 0.5, 1, 0),
    (9, 1.0, 7, 1.0, 4, 1.0, 0, 0, 0.5, 1, 0), (2, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1.0, 1, 0), (2, 1.0, 12, 0.0, 3, 1.0, 0, 0, 1.0, 1, 0),
    (2, 1.0, 99, 0.0, 15, 0.1, 0, 0, 1.0, 1, 0), (3, 1.0, 19, 0.2, 74, 0.0, 0, 0, 1.0, 1, 0), (10, 1.0, 18, 1.0, 27, 0.2, 0, 0, 1.0, 1, 0),
    (12, 0.0, 20, 0.0, 6, 0.0, 0, 0, 1.0, 1, 0), (14, 0.0, 3, 1.0, 7, 0.0, 0, 0, 1.0, 1, 0), (26, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1.0, 1, 0),
    (86, 0.0, 5, 0.0, 1, 0.0, 0, 0, 1.0, 1, 0), (113, 0.0, 89, 0.0, 80, 0.0, 0, 0, 1.0, 1, 0), (1, 0.0, 5, 0.0, 8, 0.0, 1, 1, 0.0, 0, 1),
    (1, 0.0, 17, 0.0, 16, 0.0, 0, 1, 0.0, 0, 1), (1, 0.0, 1, 1.0, 6, 0.0, 1, 1, 0.0, 0, 1), (1, 1.0, 24, 0.0, 65, 0.0, 0, 1, 0.0, 0, 1),
    (1, 1.0, 12, 0.0, 10, 0.0, 0, 1, 0.0, 0, 1), (1, 0.0, 6, 0.0, 13, 0.5, 0, 1, 0.0, 0, 1), (1, 1.0, 3, 0.0, 14, 0.0, 0, 1, 0.0, 0, 1),
    (2, 0.0, 1, 0.0, 3, 1.0, 0, 1, 0.0, 0, 1), (2, 0.0, 9, 0.0, 3, 1.0, 1, 1, 0.0, 0, 1), (2, 0.0, 118, 0.0, 5, 0.0, 0, 1, 0.0, 0, 1),
    (2, 0.0, 19, 0.0, 1, 1.0, 1, 1, 0.0, 0, 1), (5, 0.0, 51, 0.4, 1, 0.0, 0, 1, 0.0, 0, 1), (5, 0.0, 7, 0.0, 6, 0.0, 1, 1, 0.0, 0, 1),
    (6, 0.0, 17, 0.0, 2, 1.0, 1, 1, 0.0, 0, 1), (7, 0.0, 34, 0.0, 38, 0.0, 1, 1, 0.0, 0, 1), (9, 0.7, 4, 0.0, 39, 0.0, 0, 1, 0.0, 0, 1),
    (10, 0.0, 5, 0.0, 6, 0.0, 0, 1, 0.0, 0, 1), (12, 0.0, 28, 1.0, 4, 0.0, 1, 1, 0.0, 0, 1), (14, 0.0, 20, 0.0, 1, 1.0, 1, 1, 0.0, 0, 1),
    (15, 0.0, 2, 0.0, 20, 0.0, 0, 1, 0.0, 0, 1), (17, 0.0, 5, 0.0, 7, 0.0, 0, 1, 0.0, 0, 1), (24, 0.0, 26, 0.2, 13, 1.0, 0, 1, 0.0, 0, 1),
    (34, 0.0, 7, 0.0, 8, 0.0, 0, 1, 0.0, 0, 1), (69, 0.0, 7, 0.0, 2, 1.0, 0, 1, 0.0, 0, 1), (80, 0.0, 5, 0.0, 9, 0.0, 0, 1, 0.0, 0, 1),
    (169, 0.6, 3, 0.0, 14, 0.0, 0, 1, 0.0, 0, 1), (347, 0.0, 78, 0.0, 88, 0.5, 0, 1, 0.0, 0, 1), (1, 0.0, 5, 0.0, 1, 1.0, 1, 1, 0.5, 0, 0),
    (1, 1.0, 6, 1.0, 2, 1.0, 0, 1, 0.5, 0, 0), (2, 0.0, 11, 0.0, 38, 0.0, 1, 1, 0.5, 0, 1), (2, 0.0, 5, 0.0, 7, 1.0, 1, 1, 0.5, 0, 0),
    (2, 0.0, 3, 0.0, 94, 0.1, 1, 1, 0.5, 0, 1), (3, 0.0, 199, 0.0, 29, 0.0, 1, 1, 0.5, 0, 1), (3, 0.0, 5, 1.0, 7, 1.0, 1, 1, 0.5, 0, 0),
    (3, 0.0, 87, 0.0, 2, 1.0, 1, 1, 0.5, 0, 0), (3, 0.0, 9, 0.0, 33, 0.1, 1, 1, 0.5, 0, 1), (4, 1.0, 9, 1.0, 9, 1.0, 0, 1, 0.5, 0, 0),
    (4, 0.0, 7, 0.0, 75, 0.0, 1, 1, 0.5, 0, 1), (5, 1.0, 9, 1.0, 21, 0.0, 0, 1, 0.5, 0, 0), (5, 1.0, 1, 0.0, 1, 1.0, 0, 1, 0.5, 0, 0),
    (7, 1.0, 9, 1.0, 9, 1.0, 0, 1, 0.5, 0, 0), (20, 0.0, 3, 0.0, 2, 1.0, 0, 1, 0.5, 0, 1), (25, 0.0, 3, 0.0, 5, 0.0, 0, 1, 0.5, 0, 1),
    (58, 0.0, 10, 0.0, 25, 1.0, 0, 1, 0.5, 0, 1), (58, 0.0, 55, 0.0, 0, 0.0, 0, 1, 0.5, 0, 1), (69, 0.0, 25, 0.3, 61, 0.0, 0, 1, 0.5, 0, 1),
    (77, 0.1, 42, 0.1, 38, 0.0, 0, 1, 0.5, 0, 1), (120, 0.0, 104, 0.1, 20, 0.0, 0, 1, 0.5, 0, 1), (1, 1.0, 11, 0.0, 2, 1.0, 0, 1, 1.0, 0, 0),
    (1, 1.0, 3, 1.0, 18, 0.0, 0, 1, 1.0, 0, 0), (1, 1.0, 14, 0.0, 3, 1.0, 0, 1, 1.0, 0, 0), (1, 1.0, 2, 1.0, 54, 0.0, 0, 1, 1.0, 0, 0),
    (3, 1.0, 2, 1.0, 71, 0.0, 0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 41, 0.0, 0, 1, 1.0, 0, 0), (6, 0.0, 3, 0.0, 3, 0.0, 0, 1, 1.0, 0, 0),
    (22, 0.0, 90, 0.0, 12, 0.0, 0, 1, 1.0, 0, 0), (25, 1.0, 14, 0.0, 28, 0.0, 0, 1, 1.0, 0, 0), (44, 0.0, 93, 0.0, 18, 0.0, 0, 1, 1.0, 0, 0),
    (1, 1.0, 26, 0.0, 4, 1.0, 0, 0, 0.0, 0, 0), (1, 1.0, 79, 0.0, 2, 1.0, 0, 0, 0.0, 0, 0), (1, 1.0, 27, 0.1, 3, 1.0, 0, 0, 0.0, 0, 0),
    (1, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0.0, 0, 0), (2, 1.0, 18, 0.0, 3, 1.0, 0, 0, 0.0, 0, 0), (3, 1.0, 2, 1.0, 85, 0.0, 0, 0, 0.0, 0, 0),
    (3, 1.0, 2, 1.0, 32, 0.0, 0, 0, 0.0, 0, 0), (3, 1.0, 1, 1.0, 5, 0.0, 0, 0, 0.0, 0, 0), (4, 1.0, 18, 0.0, 1, 1.0, 0, 0, 0.0, 0, 0),
    (4, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0.0, 0, 0), (4, 0.0, 2, 1.0, 26, 0.1, 1, 0, 0.0, 0, 1), (18, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0.0, 0, 1),
    (34, 0.0, 9, 0.0, 1, 0.0, 0, 0, 0.0, 0, 1), (52, 0.1, 105, 0.0, 51, 0.1, 0, 0, 0.0, 0, 1), (55, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1),
    (59, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0.0, 0, 0), (60, 0.0, 180, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (61, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1),
    (65, 0.0, 77, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (89, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (189, 0.0, 36, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1),
    (195, 0.0, 83, 0.0, 190, 0.0, 0, 0, 0.0, 0, 1), (198, 0.0, 83, 0.0, 4, 1.0, 0, 0, 0.0, 0, 1), (1, 0.0, 92, 0.1, 9, 1.0, 1, 0, 0.5, 0, 0),
    (1, 1.0, 3, 1.0, 1, 0.0, 0, 0, 1.0, 0, 0), (30, 0.0, 2, 1.0, 0, 0.0, 0, 0, 1.0, 0, 0),
    # lists of links in an article
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0.0, 0, 0), (1, 1.0, 1, 1.0, 3, 1.0, 0, 1, 0.0, 0, 0), (4, 1.0, 6, 1.0, 5, 1.0, 0, 1, 0.0, 0, 0),
    (2, 1.0, 60, 0.0, 3, 1.0, 0, 1, 0.0, 0, 0), (3, 1.0, 8, 0.0, 1, 1.0, 0, 1, 0.0, 0, 0), (5, 1.0, 2, 0.0, 4, 1.0, 0, 1, 0.0, 0, 0),
    (3, 1.0, 2, 1.0, 40, 0.0, 0, 1, 0.0, 0, 0), (2, 1.0, 4, 1.0, 5, 0.0, 0, 1, 0.0, 0, 0), (6, 1.0, 3, 1.0, 12, 0.1, 0, 1, 0.0, 0, 0),
    # short items without links under an ambiguous name in an article
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0.5, 0, 1), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0.5, 0, 1), (3, 0.0, 18, 0.0, 2, 0.0, 0, 1, 0.5, 0, 1),
    (2, 0.0, 4, 0.0, 22, 0.0, 0, 1, 0.5, 0, 1), (8, 0.0, 12, 0.0, 9, 0.0, 0, 1, 0.5, 0, 1), (5, 0.0, 40, 0.0, 60, 0.0, 0, 1, 0.5, 0, 1),
    # pages that mark no article: short lines at either end, and a page of one line
    (1, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0.0, 0, 0), (2, 0.0, 0, 0.0, 1, 0.0, 0, 0, 0.0, 0, 0), (2, 0.0, 1, 0.0, 18, 0.0, 0, 0, 0.0, 0, 0),
    (1, 0.0, 2, 0.0, 40, 0.0, 0, 0, 0.0, 0, 0), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0.0, 0, 0), (3, 0.0, 18, 0.0, 0, 0.0, 0, 0, 0.0, 0, 0),
    (5, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0.0, 0, 0), (4, 0.0, 19, 0.0, 2, 0.0, 0, 0, 0.0, 0, 0), (2, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0.0, 0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 0, 1), (1, 0.0, 18, 0.0, 18, 0.0, 0, 0, 0.0, 0, 1),
    (3, 0.0, 44, 0.0, 61, 0.0, 0, 0, 0.0, 0, 1), (18, 0.0, 0, 0.0, 1, 0.0, 0, 0, 0.0, 0, 1), (18, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0.0, 0, 1),
)


def train(table: tuple[tuple[float, ...], ...] = LABELLED, depth: int = 12) -> tuple:
    """A binary decision tree, grown by the Gini impurity until its leaves are pure: (feature, cut, below, above) or a label."""
    data = np.array([r[:-1] for r in table], dtype=float)
    labels = np.array([int(r[-1]) for r in table])

    def grow(rows: np.ndarray, left: int):
        y = labels[rows]
        if left == 0 or y.min() == y.max():
            return int(y.mean() >= 0.5)
        best = (np.inf, 0, 0.0)
        for f in range(data.shape[1]):
            order = rows[np.argsort(data[rows, f], kind="stable")]
            values, ones = data[order, f], np.cumsum(labels[order])
            below = np.flatnonzero(np.diff(values) > 0)
            if not len(below):
                continue
            n, k = below + 1, ones[below]
            rest, more = len(rows) - n, ones[-1] - k
            impurity = 2 * k * (n - k) / n + 2 * more * (rest - more) / rest
            j = int(impurity.argmin())
            if impurity[j] < best[0] - 1e-12:
                best = (float(impurity[j]), f, float(values[below[j]] + values[below[j] + 1]) / 2)
        if not np.isfinite(best[0]):
            return int(y.mean() >= 0.5)
        lower = data[rows, best[1]] < best[2]
        return best[1], best[2], grow(rows[lower], left - 1), grow(rows[~lower], left - 1)

    return grow(np.arange(len(labels)), depth)


@functools.cache
def default_tree() -> tuple:
    return train()


def classify(tree, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block of a page."""
    marked = any(b.article and not b.clutter for b in found)
    sizes = [(0, 0.0), *[(b.words, b.link) for b in found], (0, 0.0)]
    return [(b.words, b.link, *sizes[k], *sizes[k + 2], b.heading, b.article, b.clutter, int(marked and not b.article)) for k, b in enumerate(found)]


def main_text(page: str, tree: tuple | None = None) -> tuple[str, int]:
    """(main text, number of blocks kept)."""
    tree = tree or default_tree()
    found = blocks(page)
    kept = [b.text for b, x in zip(found, features(found), strict=True) if classify(tree, x)]
    return " ".join(kept), len(kept)


def extracted(df: DataFrame, page: Column, tree: tuple | None = None) -> Column:
    """A struct (text, n_blocks); an empty text for null, empty or textless pages."""
    tree = tree or default_tree()

    def run(pages: list[str | None]) -> list[pa.Array]:
        found = [main_text(p or "", tree) for p in pages]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())]

    return text_column(df.sparkSession, run, "text string, n_blocks long")(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks), a row for each row of `pages`, repeated ids too; other columns are not read.

    Null, empty and textless pages have an empty text and no blocks; null ids and urls are carried along; an empty input gives
    no rows.
    """
    found = pages.select(id_col, url_col, extracted(pages, F.col(html_col)).alias("found"))
    return found.select(id_col, url_col, "found.text", F.char_length("found.text").cast("long").alias("n_chars"), "found.n_blocks")
