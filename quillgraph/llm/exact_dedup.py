"""Exact duplicates by progressive refinement: length, then a prefix hash, then a hash of the whole text.

The first two levels read a narrow signature of each row. What survives them goes into a bitmap of fixed
size, and only rows whose bit is set have their whole text normalised, hashed and, where texts are
wanted, moved. A bit that two signatures share costs one needless hash and changes no result.

Defined results: null texts count as empty and equal each other. Rows of one group that share the
smallest doc_id are numbered and the first stays. A null doc_id is larger than any other; a group of
null ids alone has keep_id null and keeps one row. An empty table gives an empty result. Columns of the
input other than doc_id and text are carried, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.bitmaps import ROW_BITS, pages_of, with_membership
from quillgraph.llm.common import documents, one_spaced, written

PREFIX_CHARS = 256


def signature(norm: Column) -> Column:
    """(length, prefix hash) of a normalised text: equal texts have equal signatures."""
    return F.struct(F.length(norm).alias("length"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix"))


def surviving_signatures(signatures: DataFrame) -> DataFrame:
    """Signatures (length, prefix) that more than one row has: first by length alone, then with the prefix."""
    signatures = written(signatures)
    lengths = written(signatures.groupBy("length").count().filter("count > 1").select("length"))
    return (signatures.join(lengths, "length", "left_semi")
            .groupBy("length", "prefix").count().filter("count > 1").select("length", "prefix"))


def _with_survival(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The input rows as one struct, so that no column name can clash, beside id, norm and _survives."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), one_spaced(F.col(text)).alias("norm"))
    rows = rows.withColumn("sig", signature(F.col("norm")))
    survivors = surviving_signatures(rows.select("sig.length", "sig.prefix"))
    pages = pages_of(survivors, F.xxhash64("length", "prefix"), ROW_BITS)
    return with_membership(rows, pages, F.xxhash64("sig.length", "sig.prefix"), ROW_BITS, "_survives")


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, full_hash.

    full_hash is null for rows that were told apart before their whole text was hashed, unless hash_all asks for it.
    """
    full = F.sha2(F.col("norm"), 256)
    rows = _with_survival(docs, doc_id, text).select(
        "id", "_survives", (full if hash_all else F.when(F.col("_survives"), full)).alias("full_hash"))
    rows = written(rows)
    alone = rows.filter("not _survives").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash")
    copies = written(rows.filter("_survives").groupBy("full_hash", "id").agg(F.count("*").alias("copies")))
    groups = written(copies.groupBy("full_hash").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    shared = (copies.join(groups, "full_hash")
              .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
              .select("id", "keep_id", "group_size",
                      (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "full_hash"))
    return alone.unionByName(shared)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without later copies, all columns as they were.

    Rows that the first two levels tell apart stay where they are. The others are shuffled by (hash, id),
    which spreads a large group over its ids, and meet the one claim (hash, smallest id) of their group.
    """
    rows = _with_survival(docs, doc_id, text)
    alone = rows.filter("not _survives").select("row.*")
    claim = F.concat_ws(":", "full_hash", F.coalesce(F.col("id").cast("string"), F.lit("null")))
    full = (rows.filter("_survives").withColumn("full_hash", F.sha2(F.col("norm"), 256))
            .select("row", "id", "full_hash").withColumn("claim", claim))
    first = written(full.groupBy("full_hash").agg(F.min("id").alias("id")).select(claim.alias("claim")))
    kept = full.join(first, "claim", "left_semi").dropDuplicates(["claim"]).select("row.*")
    return alone.unionByName(kept)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it. The report names the hash of every text, so lone rows are hashed too."""
    return duplicate_classes(documents(spark, sf_dir, "doc_id", "text"), hash_all=True).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h),
r AS (SELECT n.doc_id, n.h, row_number() OVER (PARTITION BY n.h, n.doc_id) AS nth FROM n)
SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id IS NOT DISTINCT FROM g.keep_id AND r.nth = 1 AS kept, r.h AS text_sha256
FROM r JOIN g ON r.h = g.h
"""
