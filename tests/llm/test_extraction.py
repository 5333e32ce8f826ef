import math
from itertools import product

import numpy as np
import pytest

from bondweave.llm import extraction
from bondweave.llm.html_blocks import leaf_blocks
from bondweave.llm.labelled_pages import labelled_pages


def texts(html):
    return [b.text for b in leaf_blocks(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a <b>b</b>c<br>d\n\n e</p>f", ["a bc", "d e", "f"]),
        ("<p>a<p>b<li>c<li>d", ["a", "b", "c", "d"]),
        ("<script>var t='<p>x</p>';</script><style>p{}</style>y<!-- <p>z</p> -->", ["y"]),
        ("<div title='a>b'>t</div>1 < 2 &lt; 3", ["t", "1 < 2 < 3"]),
        ("<p>x</div></span>y</p>", ["x", "y"]),
        ("<script>never closed <p>a", []),
        ("a<!-- never closed <p>b", ["a"]),
        ("<p>&eacute;&#233;&#xe9;&nbsp;&unknown;</p>", ["ééé &unknown;"]),
        ("<textarea>t</textarea><title>n</title>x", ["x"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


def test_blocks_survive_long_and_hostile_pages():
    assert len(texts("<p>" + "word " * 200_000)[0]) == 999_999
    assert len(texts("<div>" * 3000 + "x" + "</div>" * 3000)) == 1
    texts('<p class="' * 20_000)
    texts("<" * 100_000)


def test_ancestors():
    (b,) = leaf_blocks('<nav class="Top-menu2" id=x><ul><li><a href="/">t</a></ul></nav>')
    assert [t for t, _ in b.ancestors] == ["nav", "ul", "li"] and b.ancestors[0][1] == ("top", "menu", "2", "x") and b.linked == 1


def test_held_out_pages():
    crf = extraction.trained()
    pages = extraction.labelled_blocks(labelled_pages(200, 4321))
    wrong = total = 0
    for p in pages:
        got = crf.decode([b for b, _ in p])
        wrong += sum(g != label for g, (_, label) in zip(got, p))
        total += len(p)
    assert wrong / total < 0.03


def test_viterbi_against_all_labelings():
    crf = extraction.trained()
    for html in labelled_pages(30, 77):
        blocks = leaf_blocks(html)[:8]
        e = [sum(crf.weights.get(f, 0) for f in extraction.block_features(b, blocks[i - 1] if i else None)) for i, b in enumerate(blocks)]

        def score(labels):
            return crf.start[labels[0]] + sum(x for x, y in zip(e, labels) if y) + sum(crf.step[a][b] for a, b in zip(labels, labels[1:]))

        best = max(product((0, 1), repeat=len(blocks)), key=score)
        assert math.isclose(score(best), score([int(x) for x in crf.decode(blocks)]), rel_tol=1e-9)


def test_training_gradient_reaches_likely_labels():
    """Trained on pages whose label is in one feature, the field learns it."""
    pages = extraction.labelled_blocks(labelled_pages(60, 5))
    crf = extraction.train(pages)
    acc = np.mean([g == label for p in pages for g, (_, label) in zip(crf.decode([b for b, _ in p]), p)])
    assert acc > 0.97


PAGE = (
    "<html><head><title>T</title></head><body><div class='cookie-banner'><p>We use cookies.</p></div><header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav>"
    "<article><h1>Title &amp; more</h1><p>First   paragraph of the story, long enough to matter.</p><div class='advert'>Buy now</div><p>Second paragraph of the story, also long enough.</p></article>"
    "<aside class='sidebar'><h3>Related</h3><a href='/x'>Other story</a></aside><section class='comments'><div class='comment'><p>Nice story, I liked it a lot.</p></div></section><form><label>Mail</label><input></form><footer>&copy; Site</footer></body></html>"
)


def test_query_shape(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text")
    got = extraction.extract(df).collect()
    want = "Title & more First paragraph of the story, long enough to matter. Second paragraph of the story, also long enough."
    assert sorted((str(r.page_id), r.text) for r in got) == sorted([("1", want), ("2", ""), ("3", ""), ("None", want), ("1", want)])
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("quote", "\"'")
@pytest.mark.parametrize("n", [100, 5000, 300_000])
def test_attribute_values_of_any_length(quote, n):
    assert texts(f"<p data-s={quote}{'x' * n}a > LEAKED b{quote}>Main text.") == ["Main text."]


def test_legal_signs_anywhere_in_a_block():
    (b,) = leaf_blocks("<p>" + "word " * 100 + "cookie</p>")
    assert "legal" in extraction.block_features(b, None)


HOSTILE = ["<a ", "<b x='", "<div>x", "<a \">\"", "<p><div><span></p>", "<i><b></i>", "<![CDATA[x", "<!x", "<script>", "</section>x", "<td><tr>", "< ", "<div class='c{}'>x", "&lt", "<a \"'>", "<a href='<'>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_a_megabyte_of_broken_markup(piece):
    import time

    n = 1_000_000 // len(piece)
    page = "".join(piece.format(i) for i in range(n)) if "{}" in piece else piece * n
    began = time.perf_counter()
    extraction.main_text(page, extraction.trained())
    assert time.perf_counter() - began < 20


def test_deep_stacks_with_stray_ends():
    assert len(leaf_blocks("<p><div>" + "<span>" * 50_000 + "x" + "</p>" * 50_000 + "y" + "</section>" * 50_000)) == 2


# Pages written by hand, none by the generator: (html, main text).
BY_HAND = [
    ("<div>Just a plain paragraph of some words that ends with a stop.</div>", "Just a plain paragraph of some words that ends with a stop."),
    ("<body><p>One.</p><p>Two sentences here.</p></body>", "One. Two sentences here."),
    ("Only text, without any tag at all.", "Only text, without any tag at all."),
    ("<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "The formula x=2 holds."),
    (
        "<!doctype html><html lang=en><head><meta charset=utf-8><title>Bread - My Blog</title><style>b{}</style></head><body class='home single'><header id='masthead' class='site-header'><p class='site-title'><a href='/'>My Blog</a></p><nav id='site-navigation'><ul id='menu-main'><li><a href='/'>Home</a></li><li><a href='/about'>About</a></li></ul></nav></header>"
        "<main id='main'><article class='post hentry'><h1 class='entry-title'>How I bake bread</h1><div class='entry-content'><p>Mix flour, water, salt and yeast. Let it rest for an hour.</p><h2>Baking</h2><p>Bake it at 230 degrees until the crust is brown &amp; hard.</p><ul><li>Let it cool.</li><li>Cut it with a long knife.</li></ul></div></article></main>"
        "<aside id='secondary' class='widget-area'><h2>Recent posts</h2><ul><li><a href='/x'>Soup for winter</a></li></ul></aside><footer id='colophon' class='site-footer'><p>Proudly powered by a blog engine</p></footer></body></html>",
        "How I bake bread Mix flour, water, salt and yeast. Let it rest for an hour. Baking Bake it at 230 degrees until the crust is brown & hard. Let it cool. Cut it with a long knife.",
    ),
    (
        "<html><body bgcolor=white><h1>Notes on sorting</h1><p>Sorting is the act of bringing things into order.<p>There are many ways to do it, and most of them are slow on long lists.<p>This page compares three of them in some detail.</body></html>",
        "Notes on sorting Sorting is the act of bringing things into order. There are many ways to do it, and most of them are slow on long lists. This page compares three of them in some detail.",
    ),
    (
        "<body><div class='cookie-notice'>This site uses cookies. <button>Accept</button></div><div id='nav'><a href='1'>News</a> <a href='2'>Sport</a> <a href='3'>Weather</a></div><div class='story-body'><h1>Rain is coming</h1><p>Heavy rain will reach the coast on Monday, the weather office said.</p><div class='ad-slot'>Advertisement</div><p>Rivers may rise quickly in the hills.</p></div><div class='related'><h3>More stories</h3><a href='4'>Snow last year</a></div><div id='comments'><div class='comment'><p>It always rains here!</p></div></div><div id='footer'>&copy; 2024 The Daily Paper</div></body>",
        "Rain is coming Heavy rain will reach the coast on Monday, the weather office said. Rivers may rise quickly in the hills.",
    ),
]


@pytest.mark.parametrize("html, want", BY_HAND)
def test_pages_written_by_hand(html, want):
    assert extraction.main_text(html, extraction.trained()) == want
