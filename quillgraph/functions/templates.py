"""Template strings with substitutions, rewritten so that a scan without a memory can read them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What code holds between templates. Quotes and comments are taken whole, so a backtick in them opens nothing.
_CODE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|\s+|[A-Za-z_$][\w$]*|=>|[^\s]")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
# A slash behind one of these opens a regular expression, as a value may start there.
_VALUE_NEXT = {"", "=>", *"=(,:[!&|?{;+*%~^", "return", "typeof", "case"}


def _blank(text: str) -> str:
    """As many characters, with the line ends where they were."""
    return re.sub(r"[^\n]", " ", text)


def plain_templates(text: str) -> str:
    """The text, as long as it was, with the substitutions of templates in parentheses outside the quotes.

    `a ${f(x)} b ${y} c` becomes a quoted blank, then (f(x)) + (y). Each open substitution is an entry on a stack that counts its
    open braces, so templates nest to any depth. A template that does not end leaves the text as it is.
    """
    out: list[str] = []
    braces: list[int] = []
    at, before = 0, ""
    while at < len(text):
        part = _CODE.match(text, at)[0]
        if part == "/" and before in _VALUE_NEXT and (found := _REGEX.match(text, at)):
            part = found[0]
        resumes = part == "}" and braces and braces[-1] == 0
        if part == "`" or resumes:
            found = _TEXT.match(text, at + 1)
            if not found:
                return text
            words, opens = found[0], found[1] == "${"
            if resumes:
                braces.pop()
                out.append(")" + (_blank(words[:-2]) + "+(" if opens else _blank(words)))
            else:
                out.append("`" + (_blank(words[:-2]) + "`(" if opens else words))
            if opens:
                braces.append(0)
            at += 1 + len(words)
            before = "(" if opens else ")"
            continue
        if braces and part in "{}":
            braces[-1] += 1 if part == "{" else -1
        out.append(part)
        at += len(part)
        if not part.isspace() and not part.startswith(("//", "/*")):
            before = part
    return text if braces else "".join(out)


@F.pandas_udf(StringType())
def _plain_templates(texts: pd.Series) -> pd.Series:
    return texts.map(plain_templates, na_action="ignore")


def with_plain_templates(text: Column) -> Column:
    """plain_templates of a column."""
    return _plain_templates(text)
