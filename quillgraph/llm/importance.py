"""Importance resampling towards a target distribution, on hashed features of one and two words.

Features are counted in buckets of their CRC-32 over all documents and over all target texts; a bucket's gain is its
log ratio of smoothed shares. A document's weight is the mean gain of its features; a Gumbel term that depends on the
document's id alone makes the highest scores a draw without replacement in proportion to exp(weight). Checksums come from
position tables over whole batches (crc_features), so there is no loop over words.

Counts leave a task as at most BUCKETS rows. The gains are BUCKETS numbers at every size of the input, so every task gets
them. Nothing else is broadcast and no text is shuffled. Places are running sums: of score ranges, of scores
within a range, and of ids within one score, so no task orders the whole table.

Defined results: a null or empty text has no features, weight 0 and is never drawn. A null id counts as the
empty string in the hash and comes after all other ids. Ties in score go to the smaller id, then to fewer features; rows
alike in all of these take consecutive ranks in any order. An empty corpus or target has no counts: gains then
follow from the smoothing alone. Columns other than id and text are carried, never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import carried, documents, texts_of, written
from quillgraph.llm.crc_features import feature_crcs
from quillgraph.session import table

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = (25, 100)
SEED = 7
SCORE_RANGE = 256  # neighbouring scores that are summed together first
SLICE_BYTES = 1 << 19

# Lower-case letters, digits and all bytes above ASCII make words; A-Z become a-z, all else becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, text of each feature, words of each text); a text's features lie together."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LETTERS) for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raws])
    inside = data != 32
    last = np.flatnonzero(inside[:-1] & ~inside[1:])  # every word has a space behind it
    kept = inside.copy()
    kept[last + 1] = True
    at = np.cumsum(kept) - 1
    spaces = at[last + 1]
    starts = np.r_[0, spaces[:-1] + 1].astype(np.int64)[:len(spaces)]
    text = np.searchsorted(ends_of_texts, last, side="right")
    follows = np.r_[text[1:] == text[:-1], False] if len(text) else np.zeros(0, bool)
    words, pairs = feature_crcs(data[kept], starts, spaces - starts, follows)
    owner = np.r_[text, text[follows]]
    return (np.r_[words, pairs] % BUCKETS).astype(np.int64), owner, np.bincount(text, minlength=len(texts))


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of about SLICE_BYTES characters; a longer text is a run of its own."""
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= SLICE_BYTES:
            yield texts[at:i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (bucket, n): occurrences of the features of all whole texts. A task sends one row per bucket."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist()):
                total += np.bincount(_features(part)[0], minlength=BUCKETS)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], ["bucket", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (bucket, gain) for all buckets, from the bucket counts of the corpus and of the target."""
    spark = corpus.sparkSession
    both = (corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
            .unionByName(spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))))
    counts = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda column: F.col(column).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + BUCKETS)) / ((d("s") + 1) * (d("all_t") + BUCKETS))
    return counts.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def document_weights(docs: DataFrame, gains: DataFrame, text: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside n_words, n_features and weight of each row. Narrow."""
    rows = carried(docs, text, carry)
    table_of_gains = np.zeros(BUCKETS, np.int64)
    for r in gains.collect():  # BUCKETS rows
        table_of_gains[r["bucket"]] = r["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(table_of_gains)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weights = [], []
            for some in texts_of(batch, text):
                for part in _slices(some):
                    bucket, owner, n_words = _features(part)
                    sums = np.zeros(len(part), np.int64)
                    np.add.at(sums, owner, shared.value[bucket])
                    words.append(n_words)
                    weights.append(sums // np.maximum(2 * n_words - 1, 1))
            n = np.concatenate(words) if words else np.zeros(0, np.int64)
            w = np.concatenate(weights) if weights else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n), pa.array(np.maximum(2 * n - 1, 0)), pa.array(w)], ["row", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weighed, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long")


def score_of(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """The weight and the Gumbel term of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _cut(scores: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows (score, above): how many candidates have a higher score, and the lowest score of the first `most` candidates."""
    per_score = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / SCORE_RANGE))
    per_score = written(per_score)
    before = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    parts = (per_score.groupBy("part").agg(F.sum("n").alias("in_part"))
             .withColumn("offset", F.coalesce(F.sum("in_part").over(before), F.lit(0))))
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = written(per_score.join(parts, "part").select(
        "score", "n", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("offset")).alias("above")))
    lowest = above.filter(F.col("above") < most).agg(F.min("score")).first()[0]
    return above, lowest


def ranked(rows: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score) with their rank among the drawn, or null.

    share[0] of share[1] of the rows with least_words are drawn. Rows below the last score drawn pass as they are; above it
    equal rows are counted before they are ordered, so an id that many rows share is one key.
    """
    eligible = F.col("n_words") >= least_words
    most = rows.filter(eligible).count() * share[0] // share[1]
    blank = F.lit(None).cast("long").alias("rank")
    if not most:
        return rows.select("*", blank)
    above, lowest = _cut(rows.filter(eligible), most)
    inside = eligible & (F.col("score") >= lowest)
    key = ["score", "id", "n_words", "n_features", "weight"]
    copies = rows.filter(inside).groupBy(*key).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("id").isNull(), "id", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    placed = (copies.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0)))
              .join(above.select("score", "above"), "score")
              .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
              .withColumn("rank", F.col("above") + F.col("before") + F.col("nth")))
    placed = placed.select(*rows.columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return rows.filter(~inside).select("*", blank).unionByName(placed)


def _gains(docs: DataFrame, target: DataFrame, text: str, target_text: str) -> DataFrame:
    return written(bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text)))


def resample_report(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document, drawn or not: id, n_words, n_features, weight, score, rank."""
    weights = document_weights(docs, _gains(docs, target, text, target_text), text, carry=(doc_id,))
    rows = weights.select(F.col(f"row.`{doc_id}`").alias("id"), "n_words", "n_features", "weight")
    return ranked(written(rows.withColumn("score", score_of(F.col("id"), F.col("weight")))))


def _first_rows(rows: DataFrame, most: Column) -> DataFrame:
    """As many of the rows as `most` says, without a window over them: places are offsets of partitions plus places within them."""
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return rows.withColumn("_part", part).join(offsets, "_part").filter(F.col("_offset") + place < most)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn documents, with all their columns as they were.

    Rows meet the draw by (score, id, features). All rows of such a key are drawn, or none, but for the key at the
    cut: of its rows, alike in all that decides, any are taken up to the number the draw allows.
    """
    weighed = document_weights(docs, _gains(docs, target, text, target_text), text)
    weighed = written(weighed.select("row", F.col(f"row.`{doc_id}`").alias("id"), "n_words", "n_features", "weight")
                      .withColumn("score", score_of(F.col("id"), F.col("weight"))))
    key = ["score", "id", "n_features"]
    report = ranked(weighed.drop("row")).filter(F.col("n_words") >= LEAST_WORDS)
    plan = written(report.groupBy(*key).agg(F.count("rank").alias("taken"), F.count("*").alias("copies")).filter("taken > 0")).alias("p")
    same = F.lit(True)
    for name in key:
        same = same & F.col(f"w.{name}").eqNullSafe(F.col(f"p.{name}"))
    met = weighed.alias("w").join(plan, same).select("row", "taken", "copies")
    whole = met.filter("taken = copies").select("row")
    return whole.unionByName(_first_rows(met.filter("taken < copies"), F.col("taken")).select("row")).select("row.*")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document against the benchmark texts."""
    report = resample_report(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return report.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


# CRC-32 of a byte behind a remainder of zero, for the twin's loop over bytes.
_CRC_STEP = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
q AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
f AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM q),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
b AS (
  SELECT f, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT),
    lambda c, y: xor(list_extract(CAST({_CRC_STEP} AS UBIGINT[]), ((xor(c, y) & 255) + 1)::BIGINT), c >> 8)), 4294967295::UBIGINT) % {BUCKETS} AS bucket
  FROM h),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (f) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
gain AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (t_s.s_all + {BUCKETS})) / ((s + 1)::DOUBLE * (t_s.t_all + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket CROSS JOIN n t_s),
w AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN gain USING (bucket) GROUP BY r),
e AS (
  SELECT d.r, doc_id, len(d.w) AS words, greatest(2 * len(d.w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w ON d.r = w.r),
k AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank
  FROM e WHERE words >= {LEAST_WORDS} QUALIFY rank <= (SELECT count(*) FROM e WHERE words >= {LEAST_WORDS}) * {SHARE[0]} // {SHARE[1]})
SELECT doc_id, n_features, weight, score, rank FROM e LEFT JOIN k ON e.r = k.r
"""
