"""Main text of pages: broken markup, varied layouts, held-out layouts, and rows of every odd kind."""

from __future__ import annotations

import numpy as np
import pytest

from quillgraph.llm.boosting import fit
from quillgraph.llm.dom import one_line, read_blocks
from quillgraph.llm.html_text import _MARKS, _Layouts, block_features, decode, extract_texts, fit_extractor, labelled_blocks, main_text

PAGES = {
    """<body><header><h1>Site</h1></header><div id="cookie-banner">We use cookies.</div><div class="sidebar"><p>Side text.</p></div><div class="post-content"><h1>Title</h1>
    <p>Hello world, this is one.</p><div class="ad-slot">Buy now</div><p>Second &amp; last&nbsp;one.</p></div><div id="comments"><div class="comment"><p>Great article, thanks!</p></div></div>
    <form><label>Mail</label></form><footer>(c) x</footer></body>""": "Title Hello world, this is one. Second & last one.",
    "<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A</h1><p><b>One <i>t</i>wo.<br><p>Three<script>var t='</p>';</script></article><!-- x --><footer>F</footer>": "A One two. Three",
    "plain text only": "plain text only", "": "", "<p>x": "x",
}


@pytest.fixture(scope="module")
def trees(spark):
    return fit_extractor(spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "page_id long, html string"))


def test_pages(spark, trees):
    rows = [(i, "u", p, "x") for i, p in enumerate(PAGES)] + [(0, None, None, None), (None, "u", "   ", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = {r.row.html: (r.text, r.n_chars) for r in extract_texts(df, model=trees).collect()}
    assert got == {p: (t, len(t)) for p, t in PAGES.items()} | {None: ("", 0), "   ": ("", 0)}
    assert extract_texts(df.limit(0)).count() == 0


def test_markup_of_any_kind_is_read():
    for page in ["<", "<a", "<p <b>x", "</p></div>", "<div class='x>y</div>", "<!-- never closed", "<script>never closed", "&#xD800; &bogus; &amp", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>" * 3000 + "x"]:
        read_blocks(page)
    cells = [one_line(b.text) for b in read_blocks("<table><tr><td>a<td>b<tr><td>c</table>") if b.tag == "td"]
    assert cells == ["a", "b", "c"]


def test_held_out_layouts(trees):
    made, right = _Layouts([], 4321), 0
    for _ in range(100):
        blocks = read_blocks(made.page())
        pieces = ["".join(b.text) for b in blocks]
        want = " ".join(" ".join(p.replace(_MARKS[True], "").split()) for p in pieces if _MARKS[True] in p)
        for block, piece in zip(blocks, pieces):
            block.text = [piece.replace(_MARKS[True], "").replace(_MARKS[False], "")]
        right += main_text(blocks, trees.margin(block_features(blocks))).split() == want.split()
    assert right >= 85


def test_choices_never_contradict():
    dice = np.random.default_rng(2)
    for _ in range(30):
        blocks = read_blocks(_Layouts([], int(dice.integers(1000))).page())
        kept = decode(blocks, dice.normal(size=len(blocks)))
        assert all(not k or kept[b.parent] for b, k in zip(blocks[1:], kept[1:]))


def test_trees_as_expression(spark):
    from pyspark.sql import functions as F
    x, y = labelled_blocks([], 30, 1)
    model = fit(x[:, -12:], y, trees=5, depth=3)
    rows = spark.createDataFrame([(row.tolist(), float(m)) for row, m in zip(x[:60, -12:], model.margin(x[:60, -12:]))], "f array<double>, want double")
    assert rows.filter(F.abs(model.expression([F.col("f")[i] for i in range(12)]) - F.col("want")) > 1e-9).count() == 0
