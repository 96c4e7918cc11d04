"""Main text of web pages: boosted trees over DOM features, decoded over the tree.

Each block of a page (and each run of text beside block children) gets the log-odds of being part of the article, from
subtree density, attribute tokens of itself and its ancestors, depth and sibling statistics. Decoding is top-down over
sums: a block's value is its own log-odds plus the positive values of its children, and a block is kept only if
its parent is kept and its value is positive. So nothing is kept inside a dropped block, and a kept block keeps the
blocks around it: contradictory choices cannot arise.

The trees are fitted when the query starts, on about SAMPLE_PAGES pages of the table (twice as many at most): their sentences are laid out
anew in varied layouts whose article, menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are known. No page is labelled by hand, and the sample is chosen by a hash of page_id. All pages are extracted.

Defined results: null, empty and blank pages have empty text. Pages whose blocks are all dropped have empty text. Each row
is extracted alone, so repeated rows are equal; null ids and urls are carried. An empty table gives an empty result and
fits trees on fixed filler sentences. Markup may be broken in any way; a page is one value of a row.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.boosting import BoostedTrees, fit
from quillgraph.llm.common import hashed_sample, row_batches
from quillgraph.llm.dom import HEADINGS, Block, one_line, read_blocks
from quillgraph.session import table

SAMPLE_PAGES = 200
SAMPLE_CHARS = 20_000
LAYOUTS = 400
SEED = 7
PAGES_AT_ONCE = 256

# Attribute words that name parts of a page.
NAMES = {
    "menu": "nav navigation navbar menu menus breadcrumb breadcrumbs toc tabs pagination pager skip submenu dropdown hamburger sitemap",
    "header": "header masthead topbar banner branding logo toolbar",
    "footer": "footer foot bottom copyright colophon legal imprint",
    "sidebar": "sidebar aside rail widget widgets related recommended recommendations popular trending more tags tagcloud archive archives outbrain taboola complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall toast banner message disclaimer announcement privacy",
    "advert": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted dfp commercial affiliate",
    "form": "form login signin signup register search searchbox contact poll survey feedback input field",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread feedback reviews review reader readers",
    "share": "share sharing social follow facebook twitter bookmark print",
    "article": "article articlebody post entry story content contents main body text prose blogpost hentry news paragraph page",
}
_NAME_OF = {word: group for group, words in NAMES.items() for word in words.split()}
GROUPS = tuple(NAMES)
TAG_GROUPS = {
    "menu": ("nav", "menu", "dir"), "header": ("header", "hgroup"), "footer": ("footer",), "sidebar": ("aside",), "form": ("form", "fieldset", "button", "label", "legend", "output"),
    "list": ("ul", "ol", "dl"), "item": ("li", "dt", "dd"), "table": ("table", "tbody", "thead", "tr", "td", "th"), "article": ("article", "main"),
    "paragraph": ("p", "blockquote", "pre"), "heading": tuple(HEADINGS), "figure": ("figure", "figcaption"), "text": ("#text",), "box": ("div", "section", "center", "details", "dialog")}
_TAG_OF = {tag: group for group, tags in TAG_GROUPS.items() for tag in tags}
TAGS = tuple(TAG_GROUPS)
_JUNK_GROUPS = ("menu", "header", "footer", "sidebar", "notice", "advert", "form", "comment", "share")
FEATURES = (
    [f"tag_{g}" for g in TAGS] + [f"name_{g}" for g in GROUPS] + [f"over_{g}" for g in ("menu", "header", "footer", "sidebar", "form", "article")]
    + [f"over_name_{g}" for g in GROUPS] + ["hidden", "over_hidden", "depth", "chars", "own_chars", "link_share", "blocks", "chars_per_block",
       "paragraphs", "items", "stops", "sibling_place", "sibling_count", "same_tag_siblings", "page_place", "page_share", "article_above", "article_below", "junk_below", "any_junk", "any_junk_above"])


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(blocks)
    texts = [one_line(b.text) for b in blocks]
    own = np.array([len(t) for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("。") for t in texts], float)
    links = np.array([b.link_chars for b in blocks], float)
    tags = [_TAG_OF.get(b.tag) for b in blocks]
    names = [{_NAME_OF[t] for t in b.tokens if t in _NAME_OF} for b in blocks]
    count, paragraphs, items = np.ones(n), np.array([t == "paragraph" for t in tags], float), np.array([t == "item" for t in tags], float)
    chars, article, junk = own.copy(), np.array([t == "article" for t in tags], float), np.zeros(n)
    own_junk = [bool(names[i] & set(_JUNK_GROUPS)) or tags[i] in ("menu", "header", "footer", "sidebar", "form") for i in range(n)]
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        for total in (chars, stops, links, count, paragraphs, items, article):
            total[p] += total[i]
        junk[p] += junk[i] + own_junk[i]
    whole = max(chars[0], 1.0)
    before = np.cumsum(own) - own
    over_tags: list[set] = [set()] * n
    over_names: list[set] = [set()] * n
    over_hidden, over_junk = [False] * n, [False] * n
    out = np.zeros((n, len(FEATURES)))
    for i, block in enumerate(blocks):
        p = block.parent
        if p >= 0:
            over_tags[i] = over_tags[p] | {tags[p]} if tags[p] else over_tags[p]
            over_names[i] = over_names[p] | names[p] if names[p] else over_names[p]
            over_hidden[i] = over_hidden[p] or blocks[p].hidden
            over_junk[i] = over_junk[p] or own_junk[p]
        family = blocks[p].children if p >= 0 else [0]
        out[i] = (
            [tags[i] == g for g in TAGS] + [g in names[i] for g in GROUPS]
            + [g in over_tags[i] for g in ("menu", "header", "footer", "sidebar", "form", "article")] + [g in over_names[i] for g in GROUPS]
            + [block.hidden, over_hidden[i], block.depth, chars[i], own[i], links[i] / max(chars[i], 1), count[i], chars[i] / count[i],
               paragraphs[i], items[i], stops[i] / max(chars[i], 1) * 100, 0.0, len(family), 0.0, before[i] / whole, chars[i] / whole,
               "article" in over_tags[i], article[i], junk[i], own_junk[i], over_junk[i]])
    place, same = FEATURES.index("sibling_place"), FEATURES.index("same_tag_siblings")
    for block in blocks:
        kinds: dict[str, int] = {}
        for child in block.children:
            kinds[blocks[child].tag] = kinds.get(blocks[child].tag, 0) + 1
        for at, child in enumerate(block.children):
            out[child, place] = at / len(block.children)
            out[child, same] = kinds[blocks[child].tag]
    return out


def decode(blocks: list[Block], margin: np.ndarray) -> list[bool]:
    """Which blocks are kept: the best choice in which every kept block's parent is kept. The root is always kept."""
    value = margin.astype(float).copy()
    for i in range(len(blocks) - 1, 0, -1):
        if value[i] > 0:
            value[blocks[i].parent] += value[i]
    kept = [True] * len(blocks)
    for i in range(1, len(blocks)):
        kept[i] = kept[blocks[i].parent] and value[i] > 0
    return kept


def main_text(blocks: list[Block], margin: np.ndarray) -> str:
    """Texts of the kept blocks in page order."""
    kept = decode(blocks, margin)
    lines = (one_line(block.text) for block, keep in zip(blocks, kept) if keep and block.text)
    return " ".join(line for line in lines if line)


_FILLER = ("The council met on Monday, and the plan was agreed.", "Rain fell for three days.", "Prices rose again, the report says, but slowly.", "She opened the old door.")


class _Layouts:
    """Pages in varied layouts, built of given sentences, with the truth of every part."""

    def __init__(self, sentences: list[str], seed: int):
        self.sentences, self.dice = sentences or list(_FILLER), random.Random(seed)

    def _some(self, least: int, most: int) -> str:
        return " ".join(self.dice.choice(self.sentences) for _ in range(self.dice.randint(least, most)))

    def _words(self, n: int) -> str:
        return " ".join(self.dice.choice(self.sentences).split()[:n])

    def _attributes(self, group: str | None, chance: float = 0.85) -> str:
        noise = self.dice.choice(["", "", "row", "col", "box", "x", "wrap", "inner", "block", "container"])
        name = self.dice.choice(NAMES[group].split()) if group and self.dice.random() < chance else ""
        both = self.dice.choice([f"{name} {noise}", f"{noise} {name}", f"{name}-{noise}" if name and noise else name or noise]).strip()
        return f' {self.dice.choice(["class", "class", "id"])}="{both}"' if both else ""

    def _links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self._words(self.dice.randint(1, 3))}</a></li>' for i in range(n))

    def _junk(self, kind: str) -> str:
        d = self.dice
        p = lambda least=1, most=2: f"<p>{self._some(least, most)}</p>"
        named = self._attributes(kind, 1.0)
        if kind == "menu":
            inside = d.choice([f"<ul>{self._links(d.randint(2, 8))}</ul>", "".join(f'<a href="/{i}">{self._words(1)}</a> ' for i in range(d.randint(2, 7)))])
            return d.choice([f"<nav>{inside}</nav>", f"<nav{named}>{inside}</nav>", f"<div{named}>{inside}</div>", f'<ul{named}>{self._links(d.randint(2, 8))}</ul>'])
        if kind == "header":
            inside = d.choice([f"<h1>{self._words(3)}</h1>", f"<p>{self._words(6)}</p>", f'<a href="/">{self._words(2)}</a>', f"<div>{self._words(4)}</div>", self._words(4)]) + (self._junk("menu") if d.random() < 0.4 else "")
            return d.choice([f"<header>{inside}</header>", f"<header{named}>{inside}</header>", f"<div{named}>{inside}</div>"])
        if kind == "footer":
            inside = d.choice([f"&copy; {self._words(3)} &middot; {self._some(1, 1)}", p(), f"<ul>{self._links(3)}</ul>{p()}", f"<div>{self._some(1, 2)}</div>"])
            return d.choice([f"<footer>{inside}</footer>", f"<footer{named}>{inside}</footer>", f"<div{named}>{inside}</div>"])
        if kind == "sidebar":
            inside = d.choice([f"<h3>{self._words(2)}</h3><ul>{self._links(4)}</ul>", p(), f"<h2>{self._words(2)}</h2>{p()}{p()}", self._some(1, 2)])
            return d.choice([f"<aside>{inside}</aside>", f"<aside{named}>{inside}</aside>", f"<div{named}>{inside}</div>", f"<section{named}>{inside}</section>"])
        if kind == "form":
            inside = f'<label>{self._words(2)}</label><input name="q"><button>{self._words(1)}</button>' + (p(1, 1) if d.random() < 0.4 else "")
            return d.choice([f"<form>{inside}</form>", f'<form action="/s"{named}>{inside}</form>', f"<div{named}><form>{inside}</form></div>"])
        if kind == "comment":
            one = lambda: d.choice([
                f'<div class="comment"><b>{self._words(1)}</b> {p(1, 3)}</div>', f"<li>{p(1, 3)}</li>", f"<article{self._attributes(kind, 1.0)}>{p(1, 3)}</article>",
                f'<div class="comment-body">{self._some(1, 3)}</div>', f"<p>{self._some(1, 3)}</p>", f"<div><p>{self._some(1, 2)}</p><a href='#'>{self._words(1)}</a></div>"])
            shape = one()
            inside = f"<h3>{self._words(1)}</h3>" * d.randint(0, 1) + "".join(one() if d.random() < 0.5 else shape for _ in range(d.randint(1, 5)))
            return d.choice([f"<section{named}>{inside}</section>", f"<div{named}>{inside}</div>", f"<ol{named}>{inside}</ol>", f"<ul{named}>{inside}</ul>"])
        inside = d.choice([self._some(1, 2), p(), f"<p>{self._some(1, 1)}</p><a href='/x'>{self._words(1)}</a>", f"<span>{self._some(1, 2)}</span>"])
        return d.choice([f"<div{named}>{inside}</div>", f"<div{named}>{inside}</div>", f"<section{named}>{inside}</section>", f"<p{named}>{self._some(1, 2)}</p>", f"<aside{named}>{inside}</aside>"])

    def _article(self) -> list[tuple[str, bool]]:
        """Parts of an article, marked True, with junk that sites put inside it, marked False."""
        d, parts = self.dice, []
        if d.random() < 0.8:
            title = f"<h1>{self._words(d.randint(3, 8))}</h1>"
            parts.append((d.choice([title, title, f"<header>{title}</header>", f'<div class="title">{title}</div>']), True))
        for _ in range(d.choice([1, 2, 3, 5, 8, 12])):
            body = self._some(1, d.choice([1, 3, 6]))
            parts.append((d.choice([
                f"<p>{body}</p>"] * 6 + [f"<p><b>{self._some(1, 1)}<br><p>{body}</p>", f"<p>{body}", f"<h2>{self._words(4)}</h2><p>{body}</p>", f"<blockquote><p>{body}</p></blockquote>",
                f"<ul><li>{self._some(1, 1)}</li><li>{self._some(1, 1)}</li></ul>", f"<ol><li>{self._some(1, 2)}</li></ol>", f"<pre>{body}</pre>", f"<div>{body}</div>",
                f"<table><tr><td>{self._words(3)}</td><td>{self._words(2)}</td></tr></table>", f"<p>{self._some(1, 1)} <a href='/l'>{self._words(3)}</a> <em>{self._words(2)}</em></p>",
                f"<figure><img src='a.png'><figcaption>{self._words(6)}</figcaption></figure>", f"<section><h3>{self._words(2)}</h3><p>{body}</p></section>", body]), True))
            if d.random() < 0.12:
                parts.append((self._junk(d.choice(["advert", "share", "notice", "sidebar", "form"])), False))
        return parts

    def page(self) -> tuple[str, list[bool]]:
        """A page whose text pieces carry marks, so that truth can be read off the parsed blocks."""
        d = self.dice
        above = [self._junk(k) for k in ("menu", "header", "notice", "advert", "form", "sidebar") if d.random() < 0.45]
        below = [self._junk(k) for k in ("sidebar", "comment", "footer", "advert", "notice", "form", "menu", "share") if d.random() < 0.45]
        d.shuffle(above)
        mark = lambda part, good: part.replace(">", f">{_MARKS[good]}")
        inside = "".join(mark(part, good) for part, good in self._article())
        if d.random() < 0.2 and below:
            inside += mark(below.pop(), False)
        tag = d.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        named = self._attributes("article", 0.3 if tag in ("article", "main") else 0.7)
        main = f"<table><tr><td{named}>{inside}</td></tr></table>" if tag == "td" else f"<{tag}{named}>{inside}</{tag}>" if d.random() < 0.95 else inside
        for _ in range(d.choice([0, 0, 1, 2])):
            near = mark(below.pop(0), False) if below and d.random() < 0.3 else ""
            main = d.choice([f"<div{self._attributes('article', 0.3)}>{main}{near}</div>", f"<main>{main}{near}</main>", f"<div>{near}{main}</div>"])
        return "<html><head><title>t</title></head><body>" + "".join(mark(x, False) for x in above) + main + "".join(mark(x, False) for x in below) + "</body></html>"


_MARKS = {True: "\ue000", False: "\ue001"}  # private characters


def labelled_blocks(sentences: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(features, truth) of the blocks of laid-out pages. A block is true if it holds article text."""
    made, rows, truth = _Layouts(sentences, seed), [], []
    for _ in range(layouts):
        blocks = read_blocks(made.page())
        good, bad = np.zeros(len(blocks)), np.zeros(len(blocks))
        for i, block in enumerate(blocks):
            text = "".join(block.text)
            good[i], bad[i] = text.count(_MARKS[True]), text.count(_MARKS[False])
            block.text = [text.replace(_MARKS[True], "").replace(_MARKS[False], "")]
        for i in range(len(blocks) - 1, 0, -1):
            good[blocks[i].parent] += good[i]
            bad[blocks[i].parent] += bad[i]
        told = (good + bad > 0) & (np.arange(len(blocks)) > 0)
        rows.append(block_features(blocks)[told])
        truth.append((good > 0)[told])
    return np.concatenate(rows), np.concatenate(truth).astype(float)


def fit_extractor(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> BoostedTrees:
    """Trees fitted on layouts of the sentences of a sample of pages."""
    chosen = hashed_sample(pages.select(F.col(page_id).alias("id"), F.substring(page, 1, SAMPLE_CHARS).alias("page")).filter("length(page) > 0"), "id", SAMPLE_PAGES)
    texts = sorted(row["page"] for row in chosen.collect())
    sentences = [line[:400] for text in texts for block in read_blocks(text) if len(line := one_line(block.text)) > 30]
    return fit(*labelled_blocks(sentences), trees=30)


def extract_texts(pages: DataFrame, page: str = "html", model: BoostedTrees | None = None, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside text and n_chars."""
    trees = model or fit_extractor(pages, page=page)
    rows = pages.select(F.struct(*carry).alias("row"), F.col(page).alias("_page"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for part in row_batches([batch], ("_page",), PAGES_AT_ONCE):
                trees_of = [read_blocks(raw or "") for (raw,) in part]
                margins = np.split(trees.margin(np.concatenate([block_features(b) for b in trees_of])), np.cumsum([len(b) for b in trees_of])[:-1])
                texts += map(main_text, trees_of, margins)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], ["row", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_texts(pages, carry=("page_id", "url")).select("row.page_id", "row.url", "text", "n_chars")
