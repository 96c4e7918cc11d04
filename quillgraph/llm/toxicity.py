"""Toxicity by compression distance: how much shorter windows of a text become under a dictionary of toxic text than under one of ordinary text.

Two zstandard dictionaries come from a sample of labelled documents. The ordinary one is trained on windows of ordinary texts. The
toxic one starts from the same content, so that it knows prose equally well, and ends in the word beginnings that mark toxic text:
those in significantly more distinct contexts (word before, word, word after) of toxic than of ordinary texts. Contexts, not
occurrences, are counted, so copies of one text prove nothing. (zstandard's trainer picks by frequency alone; from toxic windows it
takes prose.) A window is WINDOW words, half of them shared with the next; its gain is the difference of its two lengths.

Boosted trees turn the distribution of a text's gains into log-odds. They are fitted on sampled documents that the dictionaries have not
seen, and shifted from the sample's share of toxic documents to that of all labels; a score of 0.5 is therefore the even chance.

The sample is the only bounded part: at most SAMPLE_TOXIC and SAMPLE_ORDINARY documents, by a hash of their ids, and of each at
most SAMPLE_WORDS words in evenly spread runs. Scoring is narrow and reads whole texts; the model (two dictionaries, trees) has a fixed size.

Defined results: null and empty texts have no gain and get a score like any other. A label without toxic, with a null id, or for an
unknown id is not used; an id labelled both ways counts as toxic, and of several texts with one id the sample takes one by hash. Without
labels of both kinds every score is the share of toxic labels (0 if there are none). Equal texts have equal scores. An empty table gives
an empty result. Columns other than id, text and toxic are carried, never read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.boosting import BoostedTrees, fit
from quillgraph.llm.common import carried, documents, texts_of
from quillgraph.session import table

SAMPLE_TOXIC = 800
SAMPLE_ORDINARY = 1600
SAMPLE_WORDS = 600
SAMPLE_RUN = 60  # neighbouring words of a long sampled text
DICTIONARY_BYTES = 16384
STEMS = 400  # word beginnings in the toxic dictionary, at most
LEAST_CONTEXTS = 3
LEAST_G2 = 16.0  # log-likelihood ratio; 16 is about one in 30 000 by chance
LEAST_LIFT = 4.0
WINDOW, STEP = 12, 6
GAINS = (2, 3, 4)  # bytes; the share of windows that reach each is a feature
# In front of every window and at the end of both dictionaries, so that a single match already makes a window compressible.
PAD = b"0123456789" * 7

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def letters_of(text: str | None) -> list[bytes]:
    """Runs of letters and of bytes above ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join([b"", *words[at:at + WINDOW], b""]) for at in range(0, max(len(words) - WINDOW + STEP, 1), STEP)]


def spread_words(words: list[bytes]) -> list[bytes]:
    """All words, or SAMPLE_WORDS of them in runs that are spread evenly over the text."""
    if len(words) <= SAMPLE_WORDS:
        return words
    runs = SAMPLE_WORDS // SAMPLE_RUN
    starts = [k * (len(words) - SAMPLE_RUN) // (runs - 1) for k in range(runs)]
    return [w for at in starts for w in words[at:at + SAMPLE_RUN]]


def _beginnings(word: bytes) -> list[bytes]:
    """Beginnings of 3 to 8 bytes that end with a character, and the whole word with a space behind it."""
    return [word[:k] for k in range(3, min(len(word), 9)) if word[k] & 0xC0 != 0x80] + [word + b" "]


def context_counts(texts: list[list[bytes]]) -> tuple[dict[bytes, int], int]:
    """(distinct contexts of every word beginning, distinct contexts of all words)."""
    ids: dict[bytes, int] = {}
    gram, context = array("Q"), array("Q")
    for words in texts:
        for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
            if len(word) > 2:
                seen = xxhash.xxh64_intdigest(b" ".join((before, word, after)))
                for part in _beginnings(word):
                    gram.append(ids.setdefault(part, len(ids)))
                    context.append(seen)
    # 24 bits of the beginning, 40 of the context.
    pairs = np.unique(np.array(gram, np.uint64) << np.uint64(40) | np.array(context, np.uint64) >> np.uint64(24))
    counts = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=len(ids))
    found = {part: int(counts[i]) for part, i in ids.items()}
    return found, sum(n for part, n in found.items() if part.endswith(b" "))


def _g2(toxic: int, all_toxic: int, ordinary: int, all_ordinary: int) -> float:
    """Log-likelihood ratio of two shares, negative where the toxic share is the smaller one."""
    even = (toxic + ordinary) / (all_toxic + all_ordinary)
    ratio = 2 * sum(k * math.log(k / (n * even)) for k, n in ((toxic, all_toxic), (ordinary, all_ordinary)) if k)
    return ratio if toxic * all_ordinary > ordinary * all_toxic else -ratio


def marking_stems(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Word beginnings that mark toxic text, strongest first; none begins another. Each is as long as most of its contexts allow."""
    in_toxic, all_toxic = context_counts(toxic)
    in_ordinary, all_ordinary = context_counts(ordinary)
    if not all_toxic or not all_ordinary:
        return []
    marks = {}
    for part, n in in_toxic.items():
        other = in_ordinary.get(part, 0)
        if n >= LEAST_CONTEXTS and n * all_ordinary >= LEAST_LIFT * (other + 0.5) * all_toxic:
            marks[part] = _g2(n, all_toxic, other, all_ordinary)
    chosen: list[bytes] = []
    for part in sorted((p for p in marks if marks[p] >= LEAST_G2), key=lambda p: (-marks[p], p)):
        if len(chosen) < STEMS and not any(part.startswith(c.rstrip()) or c.startswith(part.rstrip()) for c in chosen):
            chosen.append(part)
    stems = []
    for part in chosen:
        longer = [p for p in in_toxic if p.startswith(part) and 5 * in_toxic[p] >= 4 * in_toxic[part]]
        stems.append(max(longer, key=lambda p: (len(p), p)))
    return stems


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Default tables and the content as it is, so that lengths differ by matches alone."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


def _trained(windows: list[bytes]) -> bytes:
    """A dictionary by zstandard's trainer; the windows themselves where they are too few to train on."""
    whole = b"".join(windows)
    if len(whole) <= 8 * DICTIONARY_BYTES:
        return whole[-DICTIONARY_BYTES:]
    return zstandard.train_dictionary(DICTIONARY_BYTES, windows).as_bytes()


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    trees: BoostedTrees | None
    shift: float  # log-odds from the sample's share to that of all labels, or those of the share itself without trees

    def lengths(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary + PAD), _compressor(self.toxic + PAD)

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = np.full(len(features), self.shift) if self.trees is None else self.trees.margin(features) + self.shift
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def gain_features(words: list[bytes], plain: zstandard.ZstdCompressor, marked: zstandard.ZstdCompressor) -> list[float]:
    """Distribution of the gains of a text's windows: largest ones, means, shares at thresholds, spread, number, and the ordinary ratio."""
    windows = windows_of(words)
    before = np.array([len(plain.compress(PAD + w)) for w in windows], float)
    gains = before - [len(marked.compress(PAD + w)) for w in windows]
    most = np.sort(gains)[::-1]
    return [most[0], most[min(1, len(most) - 1)], most[min(3, len(most) - 1)], gains.mean(), np.clip(gains, 0, None).mean(),
            *((gains >= g).mean() for g in GAINS), math.log(len(gains)), before.sum() / sum(map(len, windows)), gains.std()]


def _chosen_ids(labels: DataFrame, doc_id: str, toxic: str) -> tuple[DataFrame, dict[int, int]]:
    """(rows (id, y, place) of the sample, labelled ids of each kind). Ids are chosen by hash, alike at every size.

    A task sends only ids within one and a half times the share that the sample needs, and no more than the sample.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.max(F.least("y", F.lit(1))).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    place = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 53) - 1))
    parts = [known.filter(F.col("y") == y).withColumn("place", place)
             .filter(F.col("place") <= min(1.5 * most / max(counts.get(y, 0), 1), 1.0) * (1 << 53)).orderBy("place", "id").limit(most)
             for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    return parts[0].unionByName(parts[1]), counts


def _sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str) -> tuple[list[tuple[int, list[bytes]]], dict[int, int]]:
    """((label, words) of the sampled documents in order of their hashes, labelled ids of each kind)."""
    ids, counts = _chosen_ids(labels, doc_id, toxic)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("id", "y", "place", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                words = [b" ".join(spread_words(letters_of(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("y"), pa.array(words, pa.binary())], ["place", "y", "words"])

    short = rows.mapInArrow(cut, "place long, y int, words binary")
    one = short.groupBy("place", "y").agg(F.min(F.struct(F.xxhash64("words").alias("h"), "words"))["words"].alias("words"))
    found = sorted((r["place"], r["y"], bytes(r["words"])) for r in one.collect())
    return [(y, words.split()) for _, y, words in found], counts


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Dictionaries from every other sampled document of each kind, trees from the others."""
    sample, counts = _sampled(docs, labels, doc_id, text, toxic)
    odds = math.log((counts.get(1, 0) + 1e-9) / (counts.get(0, 0) + 1e-9)) if counts else -700.0
    kinds = [[words for y, words in sample if y == kind] for kind in (0, 1)]
    if min(map(len, kinds)) < 2:
        return ToxicityModel(b"", b"", None, odds)
    ordinary = _trained([w for words in kinds[0][::2] for w in windows_of(words)])
    stems = marking_stems(kinds[1][::2], kinds[0][::2])
    # The strongest stems come last: the nearer the cheaper. Twice, as zstandard indexes the last bytes of a dictionary less densely.
    marked = ordinary + b"".join(b" " + stem for stem in reversed(stems)) * 2
    model = ToxicityModel(ordinary, marked, None, 0.0)
    plain, toxics = model.lengths()
    rest = [(y, words) for y in (0, 1) for words in kinds[y][1::2]]
    y = np.array([k for k, _ in rest], float)
    model.trees = fit(np.array([gain_features(words, plain, toxics) for _, words in rest]), y, trees=100, depth=2, rate=0.1)
    model.shift = odds - math.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside each row's score. Narrow."""
    rows = carried(docs, text, carry)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, marked = model.lengths()
        for batch in batches:
            features = [gain_features(letters_of(t), plain, marked) for part in texts_of(batch, text, 200) for t in part]
            score = model.scores(np.array(features)) if features else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    return rows.mapInArrow(scored, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Whether an id is never learned from; a null id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scores = toxicity_scores(docs, fit_toxicity(docs, labels), carry=("doc_id",))
    return scores.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
