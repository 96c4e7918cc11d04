"""Token ids in files of Simple-8b words.

A file row is one frame: whole documents in ascending doc_id order with their ids packed into 64-bit words. The
four high bits of a word are its selector, which fixes how many ids of which width the other 60 bits hold. A value of
60 bits or more takes an escape: a word with selector 15, then the value as a word of its own. Every BLOCK ids start a
new word, and the frame lists the word at which each block starts, so blocks are packed, and decoded, side by side.

Frames are rows of Parquet, so Spark commits them as a whole, and a lost executor loses none. A range exchange on doc_id
makes the file order the id order; a frame holds its offset within its file, and the offset of each file is the sum
of the files before it (one row per file).

Defined results: null and empty texts have the end id alone. Null ids come first. Rows that share a doc_id follow each
other in the order of a hash of their texts, and each has its own start. An empty table gives no frame. A text is
never split: a frame closes after the document that fills it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from quillgraph.llm.common import documents, range_bounds, range_part, row_batches, written

END_ID = 2
BLOCK = 256
FRAME_IDS = 1 << 18
REMEMBERED_PARTS = 2_000_000
REMEMBERED_BYTES = 64
LINES = 500  # parts that the library encodes at once
# A part that holds no line end, no white space but one in front, and no beginning of a special token.
SIMPLE = "^ ?[!-;=-~À-ÿ]+$"
SLICE_ROWS = 4000

# Fixed values: (ids in a word, bits of each) by selector. Selectors 0 and 1 are runs of zeros; 15 is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = len(SELECTORS)
WIDE_FROM = 10  # selectors from here hold ids of 10 bits and more; the narrow ones need a run of small ids

# The split rule joins white space with what follows only where it is one space, so texts are cut, and the pieces encoded
# alone: at the start of a run of white space, behind a line end, and between a letter and one of these marks.
_BYTE = np.arange(256)
_WHITE = ((_BYTE >= 9) & (_BYTE <= 13)) | (_BYTE == 32)
_MARK = np.isin(_BYTE, list(b",.;:!?"))
_LETTER = (_BYTE < 128) & np.isin(_BYTE | 32, np.arange(97, 123))
# First bytes of characters that are never white space: ASCII but for _WHITE, and all others but those below U+00C0 and of E1 to E3.
_PLAIN_HEAD = ((_BYTE < 128) & ~_WHITE) | ((_BYTE >= 0xC3) & ~np.isin(_BYTE, (0xE1, 0xE2, 0xE3)))
_ENCODERS: dict[str, PartEncoder] = {}


def default_tokenizer() -> str:
    """Path of the public vocabulary; every machine has it with the package."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Whether a text in UTF-8 may be cut before each byte, as far as its neighbours tell. Wide white space never makes a cut unsafe."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    before, here = data[:-1], data[1:]
    white = _WHITE[here]
    latin = np.r_[False, (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)]  # letters from U+00C0 to U+00FF end here
    known = ((before < 128) & ~_WHITE[before]) | latin
    # Behind any other wide character only a single space in front of something plain is safe.
    lone = np.r_[white[:-1] & _PLAIN_HEAD[here[1:]] & (here[1:] < 128), False]
    line = np.r_[False, (before[1:] == 10) & known[:-1]] & _PLAIN_HEAD[here]  # behind one line end that is all the white space there
    cut[1:] = (white & (known | ((before >= 128) & lone))) | line | (_MARK[here] & (_LETTER[before] | latin))
    return cut


def _lists(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the values of lists that start and count so, one list behind another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class PartEncoder:
    """The tokenizers library over parts of texts, with the parts it has met and their ids as Arrow and numpy arrays."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.forget()

    def forget(self) -> None:
        self.parts = pa.array([], pa.binary())
        self.starts, self.counts, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each text) of strings; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = cut_points(data)
        for i in np.flatnonzero(special):  # a text that spells a special token is left to the library as a whole
            cut[offsets[i]:offsets[i + 1]] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        at, count, values = self._ids_of(parts.dictionary)
        kind = parts.indices.to_numpy()
        counts = count[kind]
        upto = np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]
        return values[_lists(at[kind], counts)], np.diff(upto)

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count) of each distinct part's ids within values."""
        place = pc.index_in(parts, value_set=self.parts).fill_null(-1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        new = parts.take(pa.array(unknown)).cast(pa.string())
        simple = pc.match_substring_regex(new, SIMPLE).to_numpy(zero_copy_only=False)
        order = np.append(np.flatnonzero(simple), np.flatnonzero(~simple))
        new = new.take(pa.array(order))
        new_counts, new_values = self._encode_new(new.to_pylist(), int(simple.sum()))
        place[unknown[order]] = len(self.starts) + np.arange(len(new))
        values = np.append(self.values, new_values)
        starts = np.append(self.starts, len(self.values) + np.cumsum(new_counts) - new_counts)
        counts = np.append(self.counts, new_counts)
        found = starts[place], counts[place], values
        if len(self.parts) + len(new) > REMEMBERED_PARTS:
            self.forget()
        else:
            short = pc.less_equal(pc.binary_length(new), REMEMBERED_BYTES).to_numpy(zero_copy_only=False)
            kept = np.append(np.ones(len(self.starts), bool), short)
            self.parts = pa.concat_arrays([self.parts, new.filter(pa.array(short)).cast(pa.binary())])
            self.values, self.counts = values[_lists(starts[kept], counts[kept])], counts[kept]
            self.starts = np.cumsum(self.counts) - self.counts
        return found

    def _encode_new(self, parts: list[str], simple: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, ids of all). The first, simple ones go to the library as lines of longer texts.

        A line end that no more than one space follows is an id of its own there, and joins no character.
        """
        counts, values = [], []
        for at in range(0, simple, LINES):
            text = "\n".join(parts[at:min(at + LINES, simple)])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            counts.append(np.diff(ends, prepend=-1) - 1)
            values.append(ids[ids != self.line])
        for found in self.library.encode_batch_fast(parts[simple:], add_special_tokens=False):
            counts.append([len(found.ids)])
            values.append(np.array(found.ids, np.uint32))
        return np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, np.uint32), *values])


def encoder(path: str) -> PartEncoder:
    """The worker's encoder of a vocabulary."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def _choose(values: np.ndarray) -> np.ndarray:
    """For each position of each block, the selector that packs most of the ids that follow it there. values: blocks x BLOCK."""
    blocks, width = values.shape
    places = np.arange(width, dtype=np.int16)
    choice = np.full(values.shape, ESCAPE, np.int8)

    def fits(rows: np.ndarray, bits: int) -> np.ndarray:
        """How many ids from each position on have at most so many bits; a block's end counts as room for any."""
        stop = np.where(rows >= (1 << bits), places, np.int16(width + 240))
        return np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1] - places

    left = np.int16(width) - places
    for selector in range(ESCAPE - 1, WIDE_FROM - 1, -1):
        n, bits = SELECTORS[selector]
        choice[fits(values, bits) >= np.minimum(n, left)] = selector
    n, bits = SELECTORS[WIDE_FROM - 1]
    small = np.flatnonzero((fits(values, bits) >= n).any(axis=1))
    if len(small):
        rows, picked = values[small], choice[small]
        for selector in range(WIDE_FROM - 1, -1, -1):
            n, bits = SELECTORS[selector]
            picked[fits(rows, bits) >= np.minimum(n, left)] = selector
        choice[small] = picked
    return choice


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned values."""
    if not len(ids):
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:len(ids)] = ids
    choice = _choose(padded.reshape(blocks, BLOCK))
    counts = np.array([n for n, _ in SELECTORS] + [1], np.int64)
    # All blocks walk from word to word together.
    at, rows, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(rows):
        starts.append(rows * BLOCK + at)
        at = at + counts[choice[rows, at]]
        going = at < BLOCK
        rows, at = rows[going], at[going]
    starts = np.sort(np.concatenate(starts))
    selectors = choice.reshape(-1)[starts].astype(np.int64)
    size = 1 + (selectors == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector, (n, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selectors == selector)
        word = np.full(len(mine), selector << 60, np.uint64)
        if bits:
            begin = starts[mine]
            end = (begin // BLOCK + 1) * BLOCK
            for k in range(n):
                inside = begin + k < end
                value = np.where(inside, padded[np.minimum(begin + k, len(padded) - 1)], np.uint64(0))
                word |= value << np.uint64(bits * k)
        words[place[mine]] = word
    mine = np.flatnonzero(selectors == ESCAPE)
    words[place[mine]] = np.uint64(ESCAPE << 60)
    words[place[mine] + 1] = padded[starts[mine]]
    return words.astype("<u8"), place[np.searchsorted(starts, np.arange(blocks) * BLOCK)]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of packed words. Each block is found by its offset; words of one selector are decoded together."""
    if not n:
        return np.empty(0, np.uint64)
    high = (words >> np.uint64(60)).astype(np.int64)
    # A word after an escape is a value, whatever its high bits are. Escapes in a row alternate.
    is_value = np.zeros(len(words), bool)
    for at in np.flatnonzero(high == ESCAPE).tolist():
        if not is_value[at] and at + 1 < len(words):
            is_value[at + 1] = True
    place = np.flatnonzero(~is_value)
    selectors = high[place]
    counts = np.array([c for c, _ in SELECTORS] + [1], np.int64)[selectors]
    block = np.searchsorted(offsets, place, side="right") - 1
    first = np.searchsorted(place, offsets)
    before = np.cumsum(counts) - counts
    start = block * BLOCK + before - before[first][block]
    out = np.zeros(len(offsets) * BLOCK, np.uint64)
    for selector, (c, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selectors == selector)
        if bits and len(mine):
            word, begin, end = words[place[mine]], start[mine], (block[mine] + 1) * BLOCK
            for k in range(c):
                inside = begin + k < end
                out[begin[inside] + k] = (word[inside] >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)
    mine = np.flatnonzero(selectors == ESCAPE)
    out[start[mine]] = words[place[mine] + 1]
    return out[:n]


FRAME = "shard int, shard_start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, words binary, offsets array<bigint>"
_FRAME_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))


def _frame(shard: int, start: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> pa.RecordBatch:
    words, offsets = pack(ids)
    row = (shard, start, len(ids), doc_ids, lengths, words.tobytes(), offsets.tolist())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FRAME_TYPES)], [c.split()[0] for c in FRAME.split(", ")])


def encode_frames(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Frames of the documents' ids, in ascending order of doc_id over shards and within them."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows go straight to the place of their id: texts are moved once, and no sample of them is taken.
    bounds = range_bounds(rows.select("id"), "id", n)
    placed = (rows.withColumn("shard", range_part(F.col("id"), bounds)).repartitionById(len(bounds) + 1, F.col("shard"))
              .withColumn("tie", F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), "tie").select("shard", "id", "text"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = encoder(path)
        number, start, size, doc_ids, lengths, pieces = 0, 0, 0, [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                number, keys = some.column("shard")[0].as_py(), some.column("id").to_pylist()
                ids, counts = parts.encode_texts(some.column("text"))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                upto = np.append(0, np.cumsum(counts))
                first = 0
                while first < len(keys):
                    # The document that fills the frame is its last one.
                    last = min(int(np.searchsorted(upto, upto[first] + FRAME_IDS - size)), len(keys))
                    doc_ids += keys[first:last]
                    lengths += counts[first:last].tolist()
                    pieces.append(ids[upto[first]:upto[last]])
                    size += int(upto[last] - upto[first])
                    first = last
                    if size >= FRAME_IDS:
                        yield _frame(number, start, doc_ids, lengths, np.concatenate(pieces))
                        start, size, doc_ids, lengths, pieces = start + size, 0, [], [], []
        if doc_ids:
            yield _frame(number, start, doc_ids, lengths, np.concatenate(pieces))

    return placed.mapInArrow(framed, FRAME)


def write_token_files(docs: DataFrame, path: str, **options) -> None:
    """Writes the frames of the documents as a folder of files."""
    encode_frames(docs, **options).write.parquet(path)


def read_token_files(frames: DataFrame, digests: bool = False) -> DataFrame:
    """One row per document of written frames: doc_id, start, n_tokens and its ids, or their CRC with `digests`.

    The sums of the shards are one row per file, whose number the writer fixed, so they are broadcast.
    """
    sums = frames.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("before_shard"))
    last = ("ids_crc32", pa.int64(), "long") if digests else ("ids", pa.list_(pa.int64()), "array<bigint>")

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("before_shard", "shard_start", "n_ids", "doc_ids", "lengths", "words", "offsets")
        for frame in chain.from_iterable(row_batches(batches, columns, 1)):
            before, start, n, doc_ids, lengths, words, offsets = frame
            ids = unpack(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), n).astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            cut = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            values = [zlib.crc32(part.tobytes()) for part in cut] if digests else [part.tolist() for part in cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts + before + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, last[1])],
                ["doc_id", "start", "n_tokens", last[0]])

    return frames.join(F.broadcast(sums), "shard").mapInArrow(documents_of, f"doc_id long, start long, n_tokens long, {last[0]} {last[2]}")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, read back from its token file."""
    frames = written(encode_frames(documents(spark, sf_dir, "doc_id", "text")))
    return read_token_files(frames, digests=True)
