"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would form (ties: the
left one first) and merges until no pair forms a piece. No piece of such a vocabulary holds the space mark after
another character, so merges never cross the start of a word: words are encoded alone, and each worker remembers
the words it has seen. Every word that is new to a worker's memory is checked against the sentencepiece library,
Arrow batch by Arrow batch, and whole documents are decoded by the library; a difference stops the job.

Defined results: null and empty texts have no ids and decode to the empty text. Characters without a piece become
byte pieces, or the unknown id where the vocabulary has none. Rows are encoded alone, so repeated rows are equal;
a null doc_id is carried. An empty table gives an empty result. A text may be of any length; words over
REMEMBERED_CHARS are encoded but not remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import carried, documents, texts_of

MARK = "▁"  # stands for a space
REMEMBERED_WORDS = 150_000
REMEMBERED_CHARS = 64
SHORT = 32
WIDE = 1 << 32
NEVER = 1 << 40
CLOSING = ",;:!?)"
_ENCODERS: dict[str, PieceEncoder] = {}


def default_model() -> str:
    """Path of the public vocabulary; every machine has it with the package."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<i4").tobytes()


class PieceEncoder:
    """Encoder of one vocabulary, with the words it has met."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = range(self.library.get_piece_size())
        plain = [i for i in size if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.scores = {self.library.id_to_piece(i): self.library.get_score(i) for i in plain}
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in size if self.library.is_byte(i)}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        # Where no piece has a line end, lines are independent as well, and so is closing punctuation that no
        # piece has after a letter. Both only make parts that more words share.
        ends = "" if any("\n" in piece for piece in self.ids) else "\n"
        close = "".join(c for c in CLOSING if not any(re.search(rf"[^\W_]{re.escape(c)}", piece) for piece in self.ids))
        stop = f"{MARK}{ends}"
        self.parts = re.compile("|".join(
            ([f"{MARK}*[^{stop}{close}]++(?<=[^\\W_])(?=[{close}])"] if close else [])
            + [f"{MARK}+[^{stop}]*", f"[^{stop}]+"] + ([f"{ends}+"] if ends else [])))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._table_of_pairs()

    def _table_of_pairs(self) -> None:
        """Pairs of pieces that form a piece, sorted by both ids, each with its rank in the agenda and the id it forms."""
        levels = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [(self.ids[left] * WIDE + self.ids[right], levels[self.scores[piece]], i)
                 for piece, i in self.ids.items() for at in range(1, len(piece))
                 if (left := piece[:at]) in self.ids and (right := piece[at:]) in self.ids]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pairs, self.ranks, self.formed = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], NEVER), np.append(table[:, 2], -1)
        letters = sorted((ord(piece), i) for piece, i in self.ids.items() if len(piece) == 1)
        self.letters, self.letter_ids = (np.array(x, np.int64) for x in zip(*letters))

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, formed id) of adjacent symbols. Negative symbols are characters without a piece and never merge."""
        key = np.where((left >= 0) & (right >= 0), left * WIDE + right, -1)
        at = np.searchsorted(self.pairs, key)
        hit = self.pairs[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.formed[at]

    def merge_short(self, words: list[str]) -> list[bytes]:
        """Packed ids of many short parts at once: each round takes the best pair off the agenda of every part that has one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        symbols = np.where(self.letters[at] == points, self.letter_ids[at], -2 - points)
        grid = np.full((len(words), int(lengths.max()) + 1), -1, np.int64)  # -1: beyond the end
        grid[np.arange(grid.shape[1]) < lengths[:, None]] = symbols
        rank, _ = self._agenda(grid[:, :-1], grid[:, 1:])
        out, rows = np.empty_like(grid), np.arange(len(words))
        while len(rows):
            best = rank.argmin(axis=1)  # the leftmost of equals
            live = rank[np.arange(len(rows)), best] < NEVER
            out[rows[~live]] = -1
            out[rows[~live], :grid.shape[1]] = grid[~live]
            rows, grid, rank, best = rows[live], grid[live], rank[live], best[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            _, formed = self._agenda(grid[each, best], grid[each, best + 1])
            moved = np.arange(grid.shape[1] - 1) + (np.arange(grid.shape[1] - 1) > best[:, None])
            grid = np.concatenate([np.take_along_axis(grid, moved, 1), np.full((len(rows), 1), -1)], axis=1)
            rank = np.take_along_axis(rank, np.minimum(moved, rank.shape[1] - 1), 1)
            grid[each, best] = formed
            rank[each, best], _ = self._agenda(formed, grid[each, best + 1])
            inner = np.flatnonzero(best > 0)
            rank[inner, best[inner] - 1], _ = self._agenda(grid[inner, best[inner] - 1], formed[inner])
        kept = out != -1
        flat, ends = out[kept], np.cumsum(kept.sum(axis=1))
        if (flat < 0).any():
            return [_packed(chain.from_iterable([i] if i >= 0 else self._ids_of(chr(-2 - i)) for i in part.tolist())) for part in np.split(flat, ends[:-1])]
        flat, ends = flat.astype("<i4").tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each part with its ids, 4 bytes each; parts of similar length share a round, long ones have a heap each."""
        words = sorted(words, key=len)
        while words and len(words[-1]) > SHORT:
            word = words.pop()
            yield word, _packed(chain.from_iterable(map(self._ids_of, self._merge_long(list(word)))))
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            yield from zip(part, self.merge_short(part))

    def _merge_long(self, symbols: list[str]) -> list[str]:
        last = len(symbols) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (score := self.scores.get(both := symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (-score, left, right, len(both)))

        for left in range(last):
            propose(left, left + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            # One of the two was merged since: the pair is gone.
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [symbol for symbol in symbols if symbol]

    def _ids_of(self, symbol: str) -> list[int]:
        if symbol in self.ids:
            return [self.ids[symbol]]
        if self.bytes:
            return [self.bytes[b] for b in symbol.encode("utf-8")]
        return [self.library.unk_id()]

    def words(self, text: str) -> list[str]:
        """The text, with its leading mark, in parts that merges never cross."""
        return self.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of parts that are not remembered. The library puts a mark before a text, so those that begin with one can be checked as they are."""
        fresh = dict(self.merge(words))
        marked = [word for word in fresh if word[0] == MARK and word != MARK]
        for word, theirs in zip(marked, self.library.encode([word[1:] for word in marked], num_threads=1)):
            if fresh[word] != _packed(theirs):
                raise ValueError(f"the library encodes {word[:80]!r} differently")
        return fresh

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, 4 bytes each. Two generations of parts are remembered; the older one is dropped when the newer is full."""
        parts = [self.words(text) for text in texts]
        now: dict[str, bytes] = {}
        new = []
        for word in set(chain.from_iterable(parts)):
            ids = self.recent.get(word)
            if ids is None and (ids := self.older.get(word)) is not None:
                self.recent[word] = ids
            if ids is None:
                new.append(word)
            else:
                now[word] = ids
        fresh = self.learn(new)
        now |= fresh
        self.recent.update((word, ids) for word, ids in fresh.items() if len(word) <= REMEMBERED_CHARS)
        if len(self.recent) > REMEMBERED_WORDS:
            self.older, self.recent = self.recent, {}
        for words in parts:
            yield b"".join(map(now.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(iter(self.encode_texts([text or ""]))), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's decoding."""
        return self.library.decode(ids) if ids else ""


def encoder(model: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary."""
    if model not in _ENCODERS:
        _ENCODERS[model] = PieceEncoder(model)
    return _ENCODERS[model]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_pieces(docs: DataFrame, text: str = "text", model: str | None = None, digests: bool = False,
                  carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside n_tokens, ids and decoded; with `digests` their hashes in place of both."""
    path = model or default_model()
    rows = carried(docs, text, carry)
    fields = {"n_tokens": pa.int64()} | ({"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {"ids": pa.list_(pa.int32()), "decoded": pa.string()})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for part in texts_of(batch, text):
                for packed in pieces.encode_texts([one or "" for one in part]):
                    ids = np.frombuffer(packed, "<i4").tolist()
                    decoded = pieces.decode(ids)
                    out.append((len(ids), _sha(",".join(map(str, ids))), _sha(decoded)) if digests else (len(ids), ids, decoded))
            values = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("row")] + [pa.array(v, t) for v, t in zip(values, fields.values())], ["row", *fields])

    row_type = rows.schema["row"].dataType.simpleString()
    added = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(encoded, f"row {row_type}, n_tokens long, {added}")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return encode_pieces(documents(spark, sf_dir, "doc_id", "text"), digests=True, carry=("doc_id",)).select(
        "row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
