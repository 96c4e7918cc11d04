"""A tolerant reader of HTML into blocks, and what the extractor measures of them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg math object canvas audio video select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl div section article main aside nav header footer form td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_LETTERS = re.compile(r"[^a-zA-Z]+")


@dataclass
class Block:
    """A block element, or (tag "#text") a run of text beside block children."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    hidden: bool = False
    text: list[str] = field(default_factory=list)
    link_chars: int = 0
    children: list[int] = field(default_factory=list)


def attribute_tokens(rest: str) -> tuple[str, ...]:
    """Lower-case letter runs of class, id, role and the like."""
    if "=" not in rest:
        return ()
    values = " ".join(a or b or c for a, b, c in _NAMED.findall(rest))
    return tuple(t.lower() for t in _NOT_LETTERS.split(_CAMEL.sub(" ", values)) if t)


def read_blocks(page: str) -> list[Block]:
    """Blocks in page order; block 0 is the root. Comments, scripts, styles and the head leave nothing.

    Unclosed and crossing elements are closed as browsers close them in the common cases: a block start ends an open
    paragraph, items and cells end their kind, an end tag closes up to its start or is ignored.
    """
    blocks = [Block("#root", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones have the block they are in
    run = [0]  # the block that takes text now
    links = 0
    at, size = 0, len(page)

    def add_text(raw: str) -> None:
        nonlocal links
        owner = stack[-1][1]
        if run[0] != owner or (blocks[owner].children and blocks[blocks[owner].children[-1]].tag != "#text"):
            run[0] = owner
        target = owner
        if blocks[owner].children:
            last = blocks[owner].children[-1]
            if blocks[last].tag == "#text":
                target = last
            elif raw.strip():
                blocks.append(Block("#text", owner, blocks[owner].depth + 1))
                target = len(blocks) - 1
                blocks[owner].children.append(target)
            else:
                return
        text = html.unescape(raw) if "&" in raw else raw
        blocks[target].text.append(text)
        if links:
            blocks[target].link_chars += len(text.strip())

    def open_block(tag: str, rest: str) -> None:
        owner = stack[-1][1]
        if blocks[owner].text and not blocks[owner].children and any(t.strip() for t in blocks[owner].text):
            # Text before the first block child becomes a run of its own.
            blocks.append(Block("#text", owner, blocks[owner].depth + 1, text=blocks[owner].text, link_chars=blocks[owner].link_chars))
            blocks[owner].children.append(len(blocks) - 1)
            blocks[owner].text, blocks[owner].link_chars = [], 0
        blocks.append(Block(tag, owner, blocks[owner].depth + 1, attribute_tokens(rest), bool(rest) and bool(_HIDDEN.search(rest))))
        blocks[owner].children.append(len(blocks) - 1)
        stack.append((tag, len(blocks) - 1))

    def close(tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                links -= sum(name == "a" for name, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    while at < size:
        token = _TOKEN.search(page, at)
        if not token:
            add_text(page[at:])
            break
        if token.start() > at:
            add_text(page[at:token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA["):
                add_text(token[0][9:].removesuffix("]]>"))
            continue
        rest = token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            if name == "br":
                add_text(" ")
            elif name not in VOID:
                close((name,), frozenset() if name not in INLINE else SCOPES)
            continue
        if name in RAW or name == "head":
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>" + (r"|(?=<body[\s>])" if name == "head" else ""), re.I).search(page, at)
                at = end.end() if end else (size if name != "head" else at)
            continue
        if name in INLINE:
            if name == "a":
                close(("a",), SCOPES)
                links += 1
            if name not in VOID:
                stack.append((name, stack[-1][1]))
            continue
        if name == "br":
            add_text(" ")
            continue
        if name in CLOSES_P:
            close(("p",), frozenset(SCOPES - {"p"}))
        if name in SAME_CLOSE:
            scopes = frozenset({"table"}) if name in ("tr", "td", "th", "tbody", "thead", "tfoot") else frozenset("ul ol dl menu".split())
            close(SAME_CLOSE[name], scopes)
        if name in VOID:
            add_text(" ")
            continue
        if name in ("html", "body"):
            blocks[0].tokens += attribute_tokens(rest)
            continue
        open_block(name, rest)
    return blocks


def one_line(pieces: list[str]) -> str:
    """Text of a block: runs of white space become one space."""
    return " ".join("".join(pieces).split())
