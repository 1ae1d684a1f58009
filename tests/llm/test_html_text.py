import os
import random
import time
from html.parser import HTMLParser

import pytest

from cohortlens.llm import html_text as H

LONG = "This is a sentence of the article that goes on for quite a number of words in a row."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain words without any markup at all in this page", "plain words without any markup at all in this page"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>x&nbsp;y<br>z</article><footer>c</footer>", f"T & U {LONG} x y z"),
        (f"<article><p>{LONG}</p><div class='ad'>Buy now and save a lot of money on this one</div><p>Short.</p></article>", f"{LONG} Short."),
        (f"<article><script>var a='</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- a > b --><p><b>Bold</b> <i>it</i>alic</p></article>", f"{LONG} Bold italic"),
        (f"<article><p>{LONG}</p><form>Mail <input><button>go</button></form></article><div class='comments'><p>{LONG}</p></div>", LONG),
        (f"<div id='cookie-banner'>We use cookies on this site to make it better for all</div><main><p>{LONG}</p></main><aside><p>{LONG}</p></aside>", LONG),
        (f"<header><h1>Site name</h1></header><div class=menu><a>One</a> <a>Two</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div class=footer>(c) 2020</div>", f"{LONG} {LONG}"),
        ("<article><p>a &lt;b&gt; &#233;&#x41;&unknown; &amp;amp;</p></article>", "a <b> éA&unknown; &amp;"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one two c1 c2"),
        ("<article><p>unclosed <b>tags <p>next", "unclosed tags next"),
        ("<article><section class='comments'><p>Great post, I agree with it.</p></section><p>Kept.</p></article>", "Kept."),
        ("<article><p hidden>one</p><p style='display: none' aria-hidden=true>two</p><math><mi>x</mi></math> <object>three</object></article>", "one two x three"),
        (f"<article><section class='related-work'><h2>Related work</h2><p>{LONG}</p></section><div class='search-method'>{LONG}</div></article>", f"Related work {LONG} {LONG}"),
        (f"<article><p>{LONG}</p><div class=related><h3>Related</h3><ul><li><a>One more</a><li><a>Another one</a></ul></div></article>", LONG),
        (f"<p>{LONG}</p><p>Yes.</p><p>{LONG}</p>", f"{LONG} Yes. {LONG}"),
        (f"<ul><li><a>Home</a><li><a>About us</a></ul><p>{LONG}</p>", LONG),
        ("<article><p title='a > b' data-x=\"c > d\">kept</p><p class=\"open>so is this</p></article>", "kept so is this"),
        ("<article><p>a < b and 3 <4 </p><b>x</b></article>", "a < b and 3 <4 x"),
        ("<article><header><h1>Title</h1></header><p>body</p></article>", "Title body"),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>body</p><div class='post-footer'>Filed under</div></article>", "Title body"),
        (f"<div role='banner'>Site name and its motto</div><article><p>{LONG}</p></article><div role='contentinfo'>Imprint of the site</div>", LONG),
        ("<ARTICLE><P CLASS=x>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>a\n\t b &nbsp; c</p></article>", "a b c"),
        ("<", "<"),
        (f"<article><div class='ad-hoc'><p>{LONG}</p></div><section id='share-prices'><h2>Prices</h2><p>{LONG}</p></section><section class='menu-of-the-day'><ul><li>Soup<li>Fish and chips</ul></section></article>", f"{LONG} Prices {LONG} Soup Fish and chips"),
        (f"<article><p>{LONG}</p><div class='ad-slot'>{LONG}</div><div class='cookie-banner'>{LONG}</div><ul class='share-buttons'><li>Mail</ul></article>", LONG),
        (f"<div>Home</div><div>About us</div><p>{LONG}</p><p>{LONG}</p><div>(c) 2020 All rights reserved</div>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><ul><li><a>One</a><li><a>Two more</a><li><a>Three</a></ul><p>{LONG} <a>x</a></p></article>", f"{LONG} {LONG} x"),
        (f"<article><p>{LONG}</p><p><a>One</a></p><p>{LONG}</p></article>", f"{LONG} One {LONG}"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page)[0] == text


def test_the_tree_fits_its_table():
    tree = H.train()
    for row in H.LABELLED:
        assert H.classify(tree, row[:-1]) == row[-1]
    assert H.train(((1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),)) == 1

    def used(node):
        return set() if isinstance(node, int) else {H.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert {"words", "link", "words_after", "link_after"} <= used(tree)  # densities decide, not names alone


SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """The text of the given pages' articles by their one layout: what stands in `article`, but not in a division."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attributes):
        self.inside += tag == "article"
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.parts.append("" if tag in ("b", "i", "a") else " ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_pages_by_another_parser(spark):
    from cohortlens.llm import common, queries

    pages = {r["page_id"]: r["html"] for r in common.table(spark, SF, "pages", "page_id", "html").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op9_html_text(spark, SF).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        parser = Article()
        parser.feed(page or "")
        assert got[k].split() == "".join(parser.parts).split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_words_and_links_decide_on_given_pages(spark):
    from cohortlens.llm import common

    rng, tree, changed, total = random.Random(4), H.default_tree(), 0, 0
    for r in common.table(spark, SF, "pages", "html").limit(200).collect():
        for x in H.features(H.blocks(r["html"] or "")):
            other = tuple(rng.choice((rng.randrange(200), rng.randrange(6))) if name.startswith("words") else rng.choice((0.0, rng.random(), 1.0)) if name.startswith("link") else v for name, v in zip(H.FEATURES, x, strict=True))
            changed, total = changed + (H.classify(tree, x) != H.classify(tree, other)), total + 1
    assert changed > 0.05 * total


def test_the_tree_is_the_brute_force_one():
    rng = random.Random(8)
    table = tuple((*[rng.randrange(4) for _ in range(10)], rng.randrange(2)) for _ in range(40))

    def grow(rows):
        y = [r[-1] for r in rows]
        if len(set(y)) == 1:
            return y[0]
        best = None
        for f in range(10):
            values = sorted({r[f] for r in rows})
            for cut in [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]:
                parts = [[r[-1] for r in rows if r[f] < cut], [r[-1] for r in rows if r[f] >= cut]]
                gini = sum(2 * sum(p) * (len(p) - sum(p)) / len(p) for p in parts)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, cut)
        if best is None:
            return int(sum(y) / len(y) >= 0.5)
        return best[1], best[2], grow([r for r in rows if r[best[1]] < best[2]]), grow([r for r in rows if r[best[1]] >= best[2]])

    assert H.train(table, 99) == grow(list(table))


WORDS = ["sea", "blue", "calm", "wind", "the", "stone"]


def planted_page(rng):
    """(a page, its article's text): menus, adverts, notices, forms, side bars and comments around and inside the article."""
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    menu = lambda: "<ul>" + "".join(f"<li><a href=x>{text(rng.randint(1, 3))}</a>" for _ in range(rng.randint(2, 7))) + "</ul>"
    clutter = [
        lambda: f"<nav>{menu()}</nav>",
        lambda: f"<div class='ad'>{text(rng.randint(2, 40))}</div>",
        lambda: f"<aside><h3>{text(2)}</h3><p>{text(rng.randint(3, 60))}</p></aside>",
        lambda: "<section id=comments>" + "".join(f"<p>{text(rng.randint(1, 90))}</p>" for _ in range(3)) + "</section>",
        lambda: f"<div class='cookie-notice'>{text(rng.randint(5, 30))}</div>",
        lambda: f"<form>{text(3)}<input><select><option>{text(1)}</select></form>",
        lambda: f"<div class='related-posts'><b>{text(2)}</b>{menu()}</div>",
        lambda: f"<script>{text(9)}</script><style>{text(2)}</style><!-- {text(4)} -->",
    ]
    kept, inner = [], ""
    for _ in range(rng.randint(1, 9)):
        kind = rng.randrange(6)
        if kind == 0:
            inner += rng.choice(clutter)()
            continue
        t = text(rng.choice([1, 2, 5, 20, 90, 300]))
        kept.append(t)
        inner += [f"<h2>{t}</h2>", f"<p>{t}", f"<blockquote>{t}</blockquote>", f"<ul><li>{t}</ul>", f"<p><i>{t}</i></p>"][kind - 1]
    tag = rng.choice(["article", "main"])
    page = f"<title>{text(3)}</title><header>{text(4)}</header>" + "".join(rng.choice(clutter)() for _ in range(rng.randrange(3)))
    return f"{page}<{tag}>{inner}</{tag}>" + "".join(rng.choice(clutter)() for _ in range(rng.randrange(3))) + f"<footer>{text(9)}</footer>", " ".join(kept)


def test_planted_articles_are_found_whole():
    rng = random.Random(9)
    for _ in range(400):
        page, text = planted_page(rng)
        if text:
            assert H.main_text(page)[0] == text, page


@pytest.mark.parametrize(
    "part",
    ["<a ", "</b>", "<", "<p class=\"", "<a b='>", "<script", "</script ", "<![CDATA[", "<!--", "<!", "<i>", "<li><i>", "<div></b>", "<b><div></b>", "<td><p>", "&amp", "<a href='x\">", "<h1><h2>"],
)
def test_work_is_proportional_to_length(part):
    for page in (part * (1_000_000 // len(part)), "<script>" + part * (1_000_000 // len(part)), "<div><b>" * 50_000 + part * (500_000 // len(part))):
        start = time.process_time()
        H.main_text(page)
        assert time.process_time() - start < 6


def test_whole_tables(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (None, "v", "<article>" + "<p>word word</p>" * 20000 + "</article>", "x"), (1, "u", "<p></p>", "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got.collect())) == [(0, "v", 20000 * 10 - 1), (1, "u", 0), (1, "u", len(LONG)), (2, "", 0)]
    assert got.limit(0).count() == 0
