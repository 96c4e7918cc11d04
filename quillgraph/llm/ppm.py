"""Scores of documents under a language model: prediction by partial matching over bytes.

The model is the trie of byte contexts up to ORDER of all training documents. A symbol's probability starts at the longest
context that training has seen. A symbol seen there has count / (total + distinct); otherwise the context escapes with
distinct / (total + distinct) (method C) to the next shorter one, where the symbols of the longer context are excluded,
down to equal shares of what is left of the alphabet. A text is its bytes and an end symbol, so scores are
log10 probabilities of whole texts. The model is pretrained: scoring changes no counts.

Since the symbols of a context also follow each shorter one, exclusion needs only sums per context, and the whole chain is
a join of each trie level with the level above it. Neither the trie nor the vocabulary is ever in one place. Documents
form blocks by ranges of doc_id; a block asks once for each (context, symbol) and word it holds, the answers are
found by equi-joins, and each block meets its answers to score its documents. Tables stored in id order ask little
more than once per block; any other order asks more often for the same result.

The unigram base model is kept beside it: words in lower case (A-Z) and one end token per text, add-one smoothed.

Defined results: null and empty texts are the end alone. A null doc_id counts as the empty text for the choice of
training rows and is spread over blocks by its text. Rows are scored alone; repeated rows have equal scores and each
counts in training. With no training row every symbol has an equal share. An empty table gives an empty result. A text
may be of any length; a block is at least one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillgraph.llm.common import documents, range_bounds, range_part, row_batches, whole_text, written

ORDER = 4
SYMBOLS = 256  # byte values; 0xFE and 0xFF are in no UTF-8 text: end and start
START, END = b"\xff", b"\xfe"
HELD_OUT = (7, 2)
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 1 << 20
MERGED_AT = 8  # slices whose distinct keys wait to be merged
GRAM, WORD = 0, 1
END_WORD = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line end


def is_held_out(doc_id: Column) -> Column:
    modulus, rest = HELD_OUT
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == rest


def grams_of(raw: bytes) -> Iterator[np.ndarray]:
    """Each symbol of a text behind its ORDER symbols of context, as one number whose low byte is the symbol; a slice at a time."""
    padded = START * ORDER + raw + END
    for at in range(0, len(raw) + 1, SLICE_BYTES):
        data = np.frombuffer(padded[at:at + SLICE_BYTES + ORDER], np.uint8).astype(np.int64)
        n = len(data) - ORDER
        out = data[:n].copy()
        for k in range(1, ORDER + 1):
            out = (out << 8) | data[k:k + n]
        yield out


def words_hashed(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text in lower case, then the end token."""
    words = raw.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END_WORD
    return out.view(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


class _Wanted:
    """Keys of one kind that the rows of a block hold, with their training counts."""

    def __init__(self) -> None:
        self.waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size = 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, train: bool) -> None:
        self.waiting[train].append(keys)
        self.size += len(keys)
        if self.size > SLICE_BYTES:
            self.settle()

    def settle(self) -> None:
        for train, waiting in self.waiting.items():
            if waiting:
                keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
                self.keys.append(keys)
                self.counts.append(counts if train else np.zeros(len(keys), np.int64))
        self.waiting, self.size = {True: [], False: []}, 0
        if len(self.keys) > MERGED_AT:
            self.keys, self.counts = ([part] for part in _merged(self.keys, self.counts))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        return _merged(self.keys, self.counts)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, kind, key, n): what each block asks for, and how often its training rows have it."""
    for batch in batches:
        blocks: dict[int, tuple[_Wanted, _Wanted]] = {}
        for block, held_out, text in (row for part in row_batches([batch], ("block", "held_out", "text"), 500) for row in part):
            grams, words = blocks.setdefault(block, (_Wanted(), _Wanted()))
            raw = (text or "").encode("utf-8", "surrogatepass")
            for part in grams_of(raw):
                grams.add(part, not held_out)
            words.add(words_hashed(raw), not held_out)
        for block, kinds in blocks.items():
            for kind, wanted in zip((GRAM, WORD), kinds):
                keys, counts = wanted.rows()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), block, np.int32)), pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts)],
                    ["block", "kind", "key", "n"])
        del blocks
        pa.default_memory_pool().release_unused()


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / under)


def symbol_scores(grams: DataFrame) -> DataFrame:
    """Rows (gram, score): log10 of the probability of each gram's symbol in its context. grams: (gram, n), one row per gram, n may be 0."""
    def level(k: int) -> DataFrame:
        mask = (1 << (8 * (k + 1))) - 1
        return grams.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n"))

    everything = Window.partitionBy()
    seen = (F.col("n") > 0).cast("long")
    # `below`: probability after an escape into the level under this one. `alone`: probability when this is the longest known context.
    rows = (level(0).withColumn("total", F.sum("n").over(everything)).withColumn("distinct", F.sum(seen).over(everything)))
    rest = F.lit(1.0) / F.greatest(SYMBOLS - F.col("distinct"), F.lit(1))
    size = F.col("total") + F.col("distinct")
    rows = rows.withColumn("alone", F.coalesce(_ratio(F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(F.col("distinct") * rest), size), rest))
    rows = rows.withColumn("below", rest)
    for k in range(1, ORDER + 1):
        mask = (1 << (8 * k)) - 1
        lower = rows.select(*[F.col(c).alias(f"l_{c}") for c in ("gram", "n", "total", "distinct", "alone", "below")])
        rows = level(k).join(lower, F.col("gram").bitwiseAND(F.lit(mask)) == F.col("l_gram"))
        context = Window.partitionBy(F.shiftright("gram", 8))
        rows = (rows.withColumn("total", F.sum("n").over(context)).withColumn("distinct", F.sum(seen).over(context))
                .withColumn("excluded", F.sum(F.when(F.col("n") > 0, F.col("l_n")).otherwise(0)).over(context)))
        new = F.col("l_distinct") - F.col("distinct")
        left = F.col("l_total") - F.col("excluded") + new
        below = (F.when(F.col("l_n") > 0, _ratio(F.col("l_n"), left))
                 .otherwise(F.coalesce(_ratio(new, left), F.lit(1.0)) * F.col("l_below")))
        rows = rows.withColumn("below", below)
        alone = F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(F.col("distinct") * F.col("below"))
        rows = rows.withColumn("alone", F.coalesce(_ratio(alone, F.col("total") + F.col("distinct")), F.col("l_alone")))
        rows = rows.select("gram", "n", "total", "distinct", "alone", "below")
    return rows.select("gram", F.log10("alone").alias("score"))


class Lookup:
    """Values by 64-bit key: open addressing, looked up for whole arrays. Every key asked for is present."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.used = np.zeros(1 << bits, bool)
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, values.dtype)
        at = self._first(keys)
        while len(keys):
            # One of those that want a free place gets it; the others try the next one.
            free = np.flatnonzero(~self.used[at])
            self.keys[at[free]] = keys[free]
            self.used[at[free]] = True
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        missed = np.flatnonzero(self.keys[at] != keys)
        while len(missed):
            at[missed] = (at[missed] + 1) & self.mask
            missed = missed[self.keys[at[missed]] != keys[missed]]
        return self.values[at]


def _block_scorer(tokens: int, distinct: int):
    """Scores the texts of a block from its answers."""
    under = float(np.log10(tokens + distinct + 1))

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key, value = (answers.column(c).to_numpy() for c in ("kind", "key", "value"))
        scores, counts = (Lookup(key[kind == k], value[kind == k]) for k in (GRAM, WORD))
        out = []
        for (text,) in (row for part in row_batches(texts.select(["text"]).to_batches(), ("text",), 500) for row in part):
            raw = (text or "").encode("utf-8", "surrogatepass")
            score = sum(float(scores[part].sum()) for part in grams_of(raw))
            found = counts[words_hashed(raw)]
            out.append((len(found), int((found > 0).sum()), float(np.log10(found + 1).sum() - len(found) * under), score))
        columns = list(zip(*out)) or [()] * 4
        pa.default_memory_pool().release_unused()
        return pa.table([texts.column("row"), *[pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]],
                        names=["row", "n_tokens", "n_known", "base_score", "score"])

    return scored


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside held_out, n_tokens, n_known, train_tokens, base_score and score."""
    body, key = F.col(text), F.col(doc_id)
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    bounds = range_bounds(docs.select(key.cast("long").alias("id")), "id", blocks)
    block = F.when(key.isNull(), F.pmod(F.xxhash64(body), F.lit(len(bounds) + 1)).cast("int")).otherwise(range_part(key.cast("long"), bounds))
    rows = docs.select(F.struct(F.struct(*carry).alias("columns"), is_held_out(key).alias("held_out")).alias("row"),
                       block.alias("block"), is_held_out(key).alias("held_out"), whole_text(body).alias("text"))
    wanted = written(rows.select("block", "held_out", "text").mapInArrow(_wanted, "block int, kind tinyint, key long, n long"))
    counts = written(wanted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    known = counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = known["tokens"] or 0, known["distinct"]
    grams = symbol_scores(counts.filter(F.col("kind") == GRAM).select(F.col("key").alias("gram"), "n"))
    model = written(grams.select(F.lit(GRAM).cast("tinyint").alias("kind"), F.col("gram").alias("key"), F.col("score").alias("value"))
                    .unionByName(counts.filter(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value"))))
    answers = wanted.select("block", "kind", "key").join(model, ["kind", "key"]).select("block", "kind", "key", "value")
    schema = StructType([StructField("row", rows.schema["row"].dataType)] + [StructField(c, LongType()) for c in ("n_tokens", "n_known")]
                        + [StructField(c, DoubleType()) for c in ("base_score", "score")])
    scored = (rows.select("block", "row", "text").groupBy("block").cogroup(answers.groupBy("block"))
              .applyInArrow(_block_scorer(tokens, distinct), schema))
    return scored.select(F.col("row.columns").alias("row"), "row.held_out", "n_tokens", "n_known",
                         F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return score_documents(documents(spark, sf_dir, "doc_id", "text"), carry=("doc_id",)).select(
        "row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
