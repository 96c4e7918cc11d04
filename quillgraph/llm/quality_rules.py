"""Quality rules by compression bands.

A text's zstandard ratio (compressed / raw bytes) must lie in a band that depends on its length: repetitive
text falls below it, incompressible text (random or encoded characters) rises above it. The same holds for fixed
chunks of a longer text and for what follows the last of them: a text is rejected when more than CHUNK_SHARE of its
bytes lie in chunks outside their band. A base rule on word counts and repeated windows comes first; a text must pass both.

Defined results: null and empty texts have no words, so they fail the base rule. Rows are judged alone, so
repeated rows and ties have equal verdicts; a null doc_id is carried. An empty table gives an empty result.
Very long texts are compressed as a stream of chunks; a text is one value of a row, so a row bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import carried, documents, texts_of, words_of

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.2  # of the bytes
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = "#*$%&|<>"

# (bytes up to, lowest ratio, highest ratio): short texts hold the frame header and little context, so they
# compress worse. Highest ratios lie between the largest ratio of clean prose at the class's shortest length (labelled
# documents cut to size: 0.88 at 200 bytes, 0.81 at 256, 0.76 at 400, 0.60 at 1024, 0.53 at 2000, 0.48 at 4096) and the smallest
# of base-64 and alphanumeric junk in words of 8 to 10 at its longest (0.88 at 250, 0.82 at 512, 0.77 at 1024, 0.75 at 2000,
# 0.73 at 16384). Up to about 128 bytes nothing is compressed in either, so no highest ratio can part them.
BANDS = ((128, 0.35, 1.30), (160, 0.35, 0.94), (200, 0.35, 0.92), (228, 0.35, 0.89), (256, 0.35, 0.86), (320, 0.30, 0.85), (400, 0.30, 0.83), (512, 0.30, 0.80),
         (640, 0.30, 0.77), (1024, 0.30, 0.74), (2048, 0.25, 0.69), (4096, 0.25, 0.66), (16384, 0.20, 0.62), (float("inf"), 0.15, 0.62))
CHUNK_BAND = (0.20, 0.66)

COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "chunks": pa.int64(), "chunks_outside": pa.int64()}
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, chunks long, chunks_outside long")


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values of small integers (the finaliser of a 64-bit mixer)."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which the text has at least twice, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    codes = mixed(ids)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + codes[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return again


def band_of(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio allowed for a text of so many bytes."""
    return next((low, high) for most, low, high in BANDS if n_bytes <= most)


def compression_verdict(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio, chunks, chunks outside their band, inside). A text of at most one chunk is judged whole and has at most one.

    The part after the last whole chunk is judged by the band of its length.
    """
    if not raw:
        return 1.0, 0, 0, False
    ratio = len(squeeze.compress(raw)) / len(raw)
    low, high = band_of(len(raw))
    chunks = len(raw) // CHUNK
    outside = 0
    for at in range(0, chunks * CHUNK, CHUNK):
        part = len(squeeze.compress(raw[at:at + CHUNK])) / CHUNK
        outside += not CHUNK_BAND[0] <= part <= CHUNK_BAND[1]
    outside_bytes = outside * CHUNK
    rest = raw[chunks * CHUNK:] if chunks else b""
    if rest:
        chunks += 1
        least, most = band_of(len(rest))
        if not least <= len(squeeze.compress(rest)) / len(rest) <= most:
            outside += 1
            outside_bytes += len(rest)
    return ratio, chunks, outside, low <= ratio <= high and outside_bytes <= CHUNK_SHARE * len(raw)


def judge(text: str | None, squeeze: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    words = words_of(text)
    n, repeated = len(words), repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    ratio, chunks, outside, inside = compression_verdict(text.encode("utf-8", "surrogatepass"), squeeze)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated,
            failed, inside and not failed, ratio, chunks, outside)


def quality_measures(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside the measures and verdict `kept` of each row. Narrow: nothing is shuffled."""
    rows = carried(docs, text, carry)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            values = list(zip(*(judge(one, squeeze) for part in texts_of(batch, text) for one in part))) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(v, t) for v, t in zip(values, COLUMNS.values()))], ["row", *COLUMNS])

    return rows.mapInArrow(judged, f"row {rows.schema['row'].dataType.simpleString()}, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows that pass, with their columns as they were."""
    return quality_measures(docs, text).filter("kept").select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_measures(documents(spark, sf_dir, "doc_id", "text"), carry=("doc_id",)).select("row.doc_id", *COLUMNS)
