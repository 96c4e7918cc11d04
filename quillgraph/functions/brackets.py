"""Places of the tokens of texts: lines, brackets, and where a statement ends, for all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = " \t\r\f\x0b"
OPENING, CLOSING = ("{", "(", "["), ("}", ")", "]")
STATEMENT_WORDS = ("const", "let", "var", "function", "class", "return", "if", "for", "while", "export", "import", "switch", "try", "throw")
RESERVED = (
    "if", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "throw", "try", "catch", "finally",
    "else", "function", "class", "extends", "new", "typeof", "void", "delete", "instanceof", "in", "of", "var", "let", "const",
    "import", "export", "from", "yield", "await", "async", "this", "super", "true", "false", "null", "undefined", "static",
)
HEAD_WORDS = ("if", "for", "while", "await")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$")
_VALUE_END, _VALUE_START = _LETTERS | set("\"'`)]}"), _LETTERS | set("\"'{")
_NO_VALUE = frozenset(RESERVED) - {"this", "super", "true", "false", "null", "undefined"}
_GOES_ON = frozenset(("in", "instanceof", "of", "extends", "from", "as"))
BLOCK_ENDS = (";", "{", "}")
LOOPS = ("if", "for", "while")
ROWS = 200

#: What is known of each token; positions count from 1, and no position is null.
FIELDS = {
    "tok": "string", "line": "int", "at": "int", "level": "int", "encl": "int", "arg_no": "bigint", "pair": "int", "class_idx": "int",
    "word": "string", "word_idx": "int", "declares": "boolean", "new_statement": "boolean", "term_idx": "int", "stop_idx": "int",
    "n_words": "int", "n_sites": "int", "n_marked": "int", "n_names": "int", "n_targets": "int",
}
#: Positions that may hold a fact: words, tokens before a parenthesis, tokens that may carry a mark, may start a function, may nest,
#: words that may be read, may be written, may be declared outside of any bracket. What Spark looks at token by token are these.
#: n_words and its like tell how many there are up to a token.
PLACES = dict.fromkeys(("words", "sites", "marked", "starts", "blocks", "names", "targets", "declared"), "int")
DECLARING = ("let", "const", "var")
ASSIGNING = ("=", "+=", "-=", "*=", "/=", "%=", "**=")
MARKED = (
    "if", "for", "while", "case", "default", "?", "catch", "&&", "||", "??", "do", "try", "switch", "=>", "function", "throw", "await", "yield", "...")
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _set(words: pa.Array, members) -> np.ndarray:
    return pc.is_in(words, value_set=pa.array(list(members), pa.string())).to_numpy(zero_copy_only=False)


def _in_text_order(raws: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all rows and the row of each. Texts of one row are read token by token in turn."""
    texts = raws.flatten()
    n_texts = pc.list_value_length(raws).fill_null(0).to_numpy(zero_copy_only=False)
    n_tokens = pc.list_value_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.repeat(np.arange(len(raws)), n_texts), n_tokens)
    values = texts.flatten()
    if (n_texts > 1).any():
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
        order = np.lexsort((np.repeat(np.arange(len(texts)), n_tokens), place, rows))
        values, rows = values.take(pa.array(order)), rows[order]
    return values, rows


def _running(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums up to each place, from the first place of its run on."""
    sums = np.concatenate(([0], np.cumsum(steps)))
    return sums[1:] - sums[first]


def _last(marked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Last marked place of the run up to each place, -1 where there is none."""
    seen = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    return np.where(seen >= first, seen, -1)


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    change = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.maximum.accumulate(np.where(change, np.arange(len(keys)), 0))


def placed_rows(raws: pa.ListArray, only: Collection[str] = (*FIELDS, *PLACES)) -> dict[str, pa.Array]:
    """The FIELDS and PLACES of rows of texts, each the tokens of the text with the blanks before them, as lists; those named in only.

    Comments and line ends are left out. A level is a depth; brackets of one level alternate, so the next one there closes an opening
    one (pair). encl is the bracket last opened at the level, arg_no the commas behind it. term_idx is the next token that ends an
    expression of the level, stop_idx where the statement of an if or a loop ends. class_idx tells the block of a class by its word.
    Nothing is done token by token: what a token is is looked up once for each distinct one, what stands before it at its level is
    the last mark in an order by level.
    """
    values, rows = _in_text_order(raws)
    n_rows = len(raws)
    known = values.dictionary_encode()
    code = known.indices.to_numpy(zero_copy_only=False)
    whole = known.dictionary
    text = pc.utf8_ltrim(whole, characters=BLANK)
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths, blank = number(pc.utf8_length(whole)), number(pc.utf8_length(text))
    newlines = number(pc.count_substring(whole, "\n"))
    silent = _set(text, "\n") | pc.starts_with(text, "//").to_numpy(zero_copy_only=False) | pc.starts_with(text, "/*").to_numpy(zero_copy_only=False)
    # Lines and places in the text count what is left out.
    lead = _first_of_runs(rows) if len(rows) else np.zeros(0, np.int64)
    line_ends = newlines[code]
    line = 1 + _running(line_ends, lead) - line_ends
    at = _running(lengths[code], lead) - blank[code] + 1
    keep = ~silent[code]
    rows, code, line, at = rows[keep], code[keep], line[keep], at[keep]
    n = len(code)
    if n == 0:
        empty = pa.array(np.zeros(n_rows + 1, np.int32))
        return {f: pa.ListArray.from_arrays(empty, pa.array([], _ARROW[kind])) for f, kind in {**FIELDS, **PLACES}.items() if f in only}

    here = np.arange(n)
    lead = _first_of_runs(rows)
    idx = here - lead + 1
    starts = idx == 1
    ends = np.concatenate((starts[1:], [True]))
    is_in = cache(lambda members: _set(text, members)[code])
    previous = lambda marked: np.concatenate(([False], marked[:-1])) & ~starts
    following = lambda marked: np.concatenate((marked[1:], [False])) & ~ends
    opens, closes, statement, comma = is_in(OPENING), is_in(CLOSING), is_in((";", *STATEMENT_WORDS)), is_in((",",))

    # A closing bracket is on the level of the one it closes; behind it the text goes on one level further out.
    level = _running(opens.astype(np.int64) - closes, lead) + closes
    low = level.min() - 1
    span = level.max() - low + 1
    key = rows * span + (level - low)
    order = np.argsort(key, kind="stable")
    group = _first_of_runs(key[order])

    def unsorted(found: np.ndarray) -> np.ndarray:
        out = np.empty(n, found.dtype)
        out[order] = found
        return out

    def last_at_level(marked: np.ndarray) -> np.ndarray:
        """Last marked token at the level up to each token, -1 where there is none."""
        found = _last(marked[order], group)
        return unsorted(np.where(found >= 0, order[found], -1))

    bracket = order[(opens | closes)[order]]
    same = np.concatenate((key[bracket[1:]] == key[bracket[:-1]], [False])) if len(bracket) else np.zeros(0, bool)
    pair = np.full(n, -1)
    left, right = bracket[:-1][same[:-1]], bracket[1:][same[:-1]]
    pair[right[closes[right]]] = left[closes[right]]
    pair[left[opens[left]]] = right[opens[left]]

    encl = last_at_level(opens)
    first_char = pc.utf8_slice_codeunits(text, 0, 1)

    def arg_no() -> np.ndarray:
        """Commas with the same bracket; those outside of any count together."""
        by_level = unsorted(_running(comma[order].astype(np.int64), group))
        outside = _running((comma & (encl < 0)).astype(np.int64), lead)
        return np.where(encl < 0, outside, by_level - by_level[encl])

    def class_idx() -> np.ndarray:
        named = previous(is_in(("class",))) & ~previous(previous(is_in((".", "?.")))) & ~is_in((":",))
        class_mark = _last(named | previous(is_in(BLOCK_ENDS)), lead)
        return np.where((class_mark >= 0) & named[class_mark], idx[class_mark] - 1, 0)

    @cache
    def word_at() -> np.ndarray:
        return last_at_level(statement)

    def word() -> pa.Array:
        return text.take(pa.array(code[word_at()], mask=word_at() < 0))

    def declares() -> np.ndarray:
        declaring = last_at_level(statement | opens)
        return (declaring >= 0) & is_in(DECLARING)[declaring]

    @cache
    def fresh() -> np.ndarray:
        """A line end between a value and something that starts one ends a statement, but not behind the head of an if or a loop."""
        value_end = (_set(first_char, _VALUE_END) & ~_set(text, _NO_VALUE))[code]
        value_start = (_set(first_char, _VALUE_START) & ~_set(text, _GOES_ON))[code]
        new_line = np.concatenate(([False], line[1:] > line[:-1]))
        before_closed = np.concatenate(([-1], np.where(is_in((")",)), pair, -1)[:-1]))
        head_word = (before_closed >= 0) & (idx[before_closed] >= 2) & is_in(HEAD_WORDS)[np.maximum(before_closed - 1, 0)]
        return previous(value_end) & value_start & new_line & ~(previous(is_in((")",))) & head_word)

    def term() -> np.ndarray:
        stops_term = (fresh() | closes | statement | comma)[order]
        reach = np.concatenate((np.minimum.accumulate(np.where(stops_term, here, n)[::-1])[::-1][1:], [n]))
        reach_in = (reach < n) & (group[np.minimum(reach, n - 1)] == group)
        return unsorted(np.where(reach_in, order[np.minimum(reach, n - 1)], -1))

    def stop() -> np.ndarray:
        no_else = ~following(is_in(("else",)))
        semicolon, brace = is_in((";",)), is_in(("}",)) & no_else
        own = (closes | semicolon) & no_else & ~fresh()
        # A closing brace counts for its own level and for the one around it.
        event = np.concatenate((key[fresh()] * n + here[fresh()], key[own] * n + here[own], (key[brace] - 1) * n + here[brace]))
        stop_at = np.concatenate((idx[fresh()] - 1, idx[own], idx[brace]))
        sort = np.argsort(event, kind="stable")
        event, stop_at = event[sort], stop_at[sort]
        loop = np.flatnonzero(is_in(LOOPS))
        found = np.searchsorted(event, key[loop] * n + loop, side="right")
        inside = (found < len(event)) & (event[np.minimum(found, len(event) - 1)] // n == key[loop]) if len(event) else np.zeros(len(loop), bool)
        stops = np.zeros(n, np.int64)
        stops[loop[inside]] = stop_at[found[inside]]
        return stops

    @cache
    def chosen(place: str) -> np.ndarray:
        if place == "words":
            return (_set(first_char, _LETTERS) & ~_set(first_char, "0123456789"))[code]
        if place == "sites":
            return following(is_in(("(",)))
        if place == "marked":
            return is_in(MARKED) | _set(first_char, "`")[code] | following(is_in(("=",)))
        if place == "starts":
            # A call looks like a method up to its closing parenthesis; only a method goes on with a block.
            closed = np.concatenate((pair[1:], [-1]))
            method = chosen("sites") & (closed >= 0) & (is_in((")",)) & following(is_in(("{",))))[closed]
            return is_in(("function", "=>")) | (method & chosen("words"))
        if place == "blocks":
            return (is_in(("{",)) & previous(is_in((")", "else", "try", "do", "finally", "=>")))) | (is_in(LOOPS) & following(is_in(("(", "await"))))
        if place == "names":
            return chosen("words") & ~previous(is_in((".",))) & (~is_in(RESERVED) | chosen("sites"))
        if place == "targets":
            declared = previous(is_in(DECLARING)) | (previous(comma) & declares())
            return chosen("names") & (declared | following(is_in(ASSIGNING)))
        return chosen("words") & (level == 0) & previous(is_in((*DECLARING, ",")))

    counts = np.bincount(rows, minlength=n_rows)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    place = lambda found: pa.array(np.where(found >= 0, idx[found], 0), pa.int32(), mask=found < 0)
    ints = lambda a: pa.array(a, pa.int32())
    nulled = lambda found: pa.array(found, pa.int32(), mask=found == 0)
    of_token = {
        "tok": lambda: text.take(pa.array(code)), "line": lambda: ints(line), "at": lambda: ints(at), "level": lambda: ints(level),
        "encl": lambda: place(encl), "arg_no": lambda: pa.array(arg_no(), pa.int64()), "pair": lambda: place(pair),
        "class_idx": lambda: ints(class_idx()), "word": word, "word_idx": lambda: place(word_at()), "declares": lambda: pa.array(declares()),
        "new_statement": lambda: pa.array(fresh()), "term_idx": lambda: place(term()), "stop_idx": lambda: nulled(stop()),
        **{f"n_{c}": lambda c=c: ints(_running(chosen(c).astype(np.int64), lead)) for c in ("words", "sites", "marked", "names", "targets")}}
    out = {f: pa.ListArray.from_arrays(offsets, of_token[f]()) for f in FIELDS if f in only}
    for f in (p for p in PLACES if p in only):
        picked = np.bincount(rows[chosen(f)], minlength=n_rows)
        out[f] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(picked))).astype(np.int32)), ints(idx[chosen(f)]))
    return out


def placed(raws: list[str]) -> tuple[list, ...]:
    """The FIELDS of one text."""
    columns = placed_rows(pa.array([[raws]], pa.list_(pa.list_(pa.string()))))
    return tuple(columns[f][0].as_py() for f in FIELDS)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ROWS rows that hold all rows of their files. Rows come in the order of their files."""
    held: list[pa.RecordBatch] = []  # rows of the last file
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ends = _file_ends(part)
            goes_on = bool(held) and held[-1].column("file")[-1].as_py() == part.column("file")[0].as_py()
            if len(ends) > 1:
                yield _joined([*held, part.slice(0, ends[-2])])
                held = [part.slice(ends[-2])]
            elif goes_on or not held:
                held.append(part)
            else:
                yield _joined(held)
                held = [part]
    if held:
        yield _joined(held)


def _file_ends(rows: pa.RecordBatch) -> np.ndarray:
    """Behind the last row of each file."""
    code = rows.column("file").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))


def placed_batches(batches: Iterator[pa.RecordBatch], only: Collection[str]) -> Iterator[pa.RecordBatch]:
    """Rows (file, n_texts, FIELDS and PLACES in only as arrays) for rows (file, raws) in the order of their files; texts as arrays if there are."""
    for rows in _files(batches):
        ends = _file_ends(rows)
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        of_file = lambda name: pa.ListArray.from_arrays(offsets, rows.column(name))
        columns = {"file": rows.column("file").take(pa.array(ends - 1)), "n_texts": pa.array(np.diff(ends, prepend=0), pa.int32())}
        if "text" in rows.schema.names:
            columns["texts"] = of_file("text")
        columns |= {f"_{f}": values for f, values in placed_rows(of_file("raws"), only).items()}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
