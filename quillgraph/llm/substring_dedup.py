"""Removal of repeated passages, found by difference-cover anchors.

The residues COVER modulo PERIOD hold every difference: for any two positions some shift below PERIOD brings both to
residues in COVER. So two equal windows of WINDOW words share an anchor (ANCHOR = WINDOW - PERIOD + 1 words) that starts
at such a residue in both, and it is enough to hash anchors at 4 of 13 positions to notice every repeated window.

1. Anchors are counted by hash. Those seen twice set bits in a bitmap that is sized by their number up to FILTER_BITS;
   a bit that others share lets through more windows for the exact step and loses none.
2. Around anchors whose bit is set, the windows that hold the anchor are hashed whole. A task sorts some MOST_WINDOWS of
   them at a time; of these only the first of each kind goes on; the others are repeats already, so a passage that fills
   a table reaches the exchange once per so many windows. The first of all windows of a kind stays, every later one is a repeat.
3. Words under repeats leave. Only documents with a repeat are moved to meet their repeats.

Windows are judged on the input. They are compared by 64-bit hashes of 64-bit word hashes.

Defined results: null and empty texts have no words. Texts shorter than a window keep all words. Windows are ordered by
(doc_id, start); a null doc_id is larger than any other. Rows that share a doc_id count as one document: a window that
both have at one start repeats nothing, one that starts earlier in either is the first. An empty table gives an empty
result. A text may be of any length; positions are counted up to 2**31.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.bitmaps import ROW_BITS, as_array, in_array, pages_of, with_membership
from quillgraph.llm.common import documents, row_batches, words_of, written

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
FILTER_BITS = 1 << 31  # 256 MiB at most on each worker
LEAST_BITS = 1 << 20
NO_ID = (1 << 63) - 1
MOST_WINDOWS = 1 << 18  # what a task holds and sorts at a time, unless one text has more
_ODD = np.uint64(0x9FB21C651E98DF25)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, by its start."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _ODD + hashes[k:k + n]
    return out ^ (out >> np.uint64(29))


def anchors_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the anchors of a text that can hold a window."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    every = run_hashes(hashes, ANCHOR)
    starts = np.flatnonzero(_IN_COVER[np.arange(len(every)) % PERIOD])
    return starts, every[starts]


def windows_around(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of the given starts."""
    last = n_words - WINDOW
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, np.maximum(starts - (PERIOD - 1), 0), 1)
    np.add.at(edge, np.minimum(starts, last) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def covered(n_words: int, starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words lie under windows that start at `starts` and the runs - 1 positions after."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + runs + (WINDOW - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def _some(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Arrays of successive texts in lists of about MOST_WINDOWS entries."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= MOST_WINDOWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, times) for some texts each; times 2 stands for any larger number."""
    for found in _some(anchors_of(word_hashes(words_of(text)))[1:] for part in row_batches(batches, ("text",), 200) for (text,) in part):
        anchors, times = np.unique(np.concatenate([x for (x,) in found]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int8))], ["anchor", "times"])


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """Anchors (hash) that the table has at least twice."""
    counts = rows.select("text").mapInArrow(_anchor_counts, "anchor long, times tinyint")
    return counts.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor")


def _runs(ids: np.ndarray, checks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring starts of one text as (id, check, start, run)."""
    order = np.lexsort((at, checks, ids))
    ids, checks, at = ids[order], checks[order], at[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (checks[1:] != checks[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return ids[first], checks[first], at[first], at[last] - at[first] + 1 if len(first) else at[first]


def repeated_windows(rows: DataFrame) -> DataFrame:
    """Rows (id, check, at, run): `run` windows of the text from start `at` on that also start earlier. rows: (id, check, text)."""
    spark = rows.sparkSession
    anchors = written(repeated_anchors(rows))
    bits = LEAST_BITS
    while bits < min(16 * anchors.count(), FILTER_BITS):
        bits *= 2
    bitmap = spark.sparkContext.broadcast(as_array(pages_of(anchors, F.col("anchor"), bits), bits))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for key, check, text in (row for part in row_batches(batches, ("id", "check", "text"), 200) for row in part):
            hashes = word_hashes(words_of(text))
            starts, anchor = anchors_of(hashes)
            starts = starts[in_array(bitmap.value, anchor, bits)]
            if len(starts):
                at = windows_around(starts, len(hashes))
                yield run_hashes(hashes, WINDOW)[at].view(np.int64), np.full(len(at), key), np.full(len(at), check), at

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _some(around(batches)):
            kind, ids, checks, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, ids, kind))
            kind, ids, checks, at = kind[order], ids[order], checks[order], at[order]
            fresh = np.ones(len(kind), bool)
            fresh[1:] = kind[1:] != kind[:-1]
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            again = (ids != ids[first]) | (at != at[first])
            # Of rows that share id and start, each may be told apart by its text; all of them go on.
            more = _runs(ids[again], checks[again], at[again])
            once = ~again
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(kind[once]), pa.nulls(len(more[0]), pa.int64())]),
                pa.array(np.concatenate([ids[once], more[0]])), pa.array(np.concatenate([checks[once], more[1]]).astype(np.int32)),
                pa.array(np.concatenate([at[once], more[2]]).astype(np.int32)),
                pa.array(np.concatenate([np.ones(once.sum(), np.int32), more[3].astype(np.int32)]))], ["kind", "id", "check", "at", "run"])

    found = rows.mapInArrow(windows, "kind long, id long, check int, at int, run int")
    found = found.withColumn("known", F.col("kind").isNull()).withColumn("kind", F.coalesce("kind", F.xxhash64("id", "check", "at")))
    nth = F.rank().over(Window.partitionBy("kind", "known").orderBy("id", "at"))
    return found.withColumn("nth", nth).filter("known or nth > 1").select("id", "check", "at", "run")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, repeats in (row for part in row_batches([batch], ("text", "repeats"), 500) for row in part):
            words = words_of(text)
            kept = words
            if repeats:
                at, runs = np.array([(r["at"], r["run"]) for r in repeats], np.int64).T
                kept = list(compress(words, ~covered(len(words), at, runs)))
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        values = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("row")] + [pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.string()))],
            ["row", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside n_words, n_removed and kept_text (words left, joined by one space)."""
    body = F.col(text)
    rows = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(body).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("check"), body.alias("text"))
    repeats = written(repeated_windows(rows.select("id", "check", "text")).groupBy("id", "check")
                      .agg(F.collect_list(F.struct("at", "run")).alias("repeats")))
    key = F.xxhash64("id", "check")
    marked = with_membership(rows, pages_of(repeats, key, ROW_BITS), key, ROW_BITS, "_repeats")
    whole = marked.filter("not _repeats").select("row", "text", F.lit(None).cast(repeats.schema["repeats"].dataType).alias("repeats"))
    partly = marked.filter("_repeats").join(repeats, ["id", "check"], "left").select("row", "text", "repeats")
    row_type = rows.schema["row"].dataType.simpleString()
    return whole.unionByName(partly).mapInArrow(_kept, f"row {row_type}, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of what is left of every document."""
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"), carry=("doc_id",)).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
