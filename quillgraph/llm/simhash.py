"""Near duplicates by SimHash fingerprints and a vantage-point tree.

A fingerprint has a 1 where more than half of the shingle hashes have one. Two fingerprints are linked at
`radius` or fewer differing bits. Links are found exactly, on the distinct fingerprints:

* A tree of vantage points (`vantage_tree`) is built on a sample of about SAMPLE_PRINTS fingerprints, never more than
  twice as many, so that shards hold about SHARD members. The sample decides where borders run, not what is found.
* Every fingerprint goes to its own shard and to each shard whose border it is near; the triangle bounds prune
  all other branches. Two linked fingerprints therefore meet in some shard.
* Each task goes on with the tree inside its shard, with the shard's own members as vantage points, down to leaves
  that are compared directly. Fingerprints that no vantage point tells apart are grouped by a breadth-first search.

A shard yields at most one pair per member and leaf instead of all links, and the pairs of all shards are
joined into components. Copies have one fingerprint, so a group of them is one row here, whatever its size.

Defined results: null and empty texts, and texts without words, have fingerprint 0 and link to each other. Texts with
fewer words than a shingle give one shingle. A component is named by its smallest doc_id; a null doc_id counts as
larger than any other, and a component of null ids alone has a null name. Rows that repeat an id are each reported. An
empty table gives an empty result. Texts of any length are hashed in slices. Extra columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.bitmaps import ROW_BITS, pages_of, with_membership
from quillgraph.llm.common import carried, documents, hashed_sample, texts_of, written
from quillgraph.llm.components import component_labels
from quillgraph.llm.vantage_tree import Tree, build_tree, routed, shard_pairs

SHINGLE = 3
SEED = 42
RADIUS = 3
SAMPLE_PRINTS = 1 << 16
SHARD = 1 << 15
SLICE = 1 << 15  # shingles whose bits are counted at a time


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, a slice at a time, A-Z in lower case. bytes.lower() and bytes.split() keep to ASCII."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(line, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1]
    n = len(starts)
    for at in range(0, n, SLICE):
        cut = zip(starts[at:at + SLICE].tolist(), (ends[at + shingle - 1:min(at + SLICE, n) + shingle - 1] - 1).tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in cut], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 if it has no words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """The carried columns as struct `row`, beside its fingerprint as a signed long."""
    rows = carried(docs, text, carry)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(one, shingle) for part in texts_of(batch, text) for one in part]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.array(found, np.uint64).view(np.int64))], ["row", "fp"])

    return rows.mapInArrow(hashed, f"row {rows.schema['row'].dataType.simpleString()}, fp long")


def tree_of(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> Tree:
    """The tree that cuts the distinct fingerprints (fp) into shards. Only the bounded sample reaches the driver."""
    total = prints.count()
    few = hashed_sample(prints, "fp", SAMPLE_PRINTS) if total > shard else prints.limit(0)
    sample = np.array([row.fp for row in few.collect()], np.int64).view(np.uint64)
    return build_tree(np.sort(sample), total, shard, radius)


def shards(prints: DataFrame, tree: Tree, radius: int = RADIUS) -> DataFrame:
    """Rows (shard, fp): every fingerprint once for each shard that may hold a link of it."""
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            row, shard = routed(tree, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fps[row])], ["shard", "fp"])

    return prints.select("fp").mapInArrow(sent, "shard int, fp long")


def linked_fingerprints(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect every two within `radius` bits, directly or through others."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards arrive in order; the parts of one wait until the next begins.
        parts: list[np.ndarray] = []
        last = None

        def pairs() -> pa.RecordBatch:
            found = shard_pairs(np.concatenate(parts), radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            key, fps = batch.column("shard").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for at, end in zip(edges, edges[1:]):
                if at == end:
                    continue
                if parts and key[at] != last:
                    yield pairs()
                    parts.clear()
                last = key[at]
                parts.append(fps[at:end].copy())
        if parts:
            yield pairs()

    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = shards(prints, tree_of(prints, radius, shard), radius)
    return spread.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(linked, "a long, b long")


def near_duplicate_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per fingerprint of rows (id, fp): fp, component_id, n_rows of the component and first_fp, which its smallest id has."""
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
    labels = component_labels(written(linked_fingerprints(prints.select("fp"), radius)))
    named = written(prints.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("label", "fp").alias("label")))
    firsts = written(named.groupBy("label").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("first"), F.sum("n").alias("n_rows")))
    return written(named.select("fp", "label").join(firsts, "label").select(
        "fp", F.col("first.first_id").alias("component_id"), "n_rows", F.col("first.fp").alias("first_fp")))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fp and component_id."""
    rows = written(with_fingerprints(docs, text, shingle, (doc_id,)).select(F.col(f"row.{doc_id}").alias("id"), "fp"))
    return rows.join(near_duplicate_components(rows, radius), "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The input rows without near copies: of each component one row with its smallest doc_id stays, columns as they were.

    Texts of rows that are alone in their component stay where they are, but for the few that share a bit of the bitmap.
    """
    rows = written(with_fingerprints(docs, text, shingle))
    ids = rows.select(F.col(f"row.{doc_id}").alias("id"), "fp")
    found = near_duplicate_components(ids, radius)
    pages = pages_of(found.filter("n_rows > 1").select("fp"), F.xxhash64("fp"), ROW_BITS)

    def flagged(df: DataFrame) -> DataFrame:
        return with_membership(df, pages, F.xxhash64("fp"), ROW_BITS, "_moves")

    claim = F.concat_ws(":", F.col("fp").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    claims = written(flagged(found.filter("fp = first_fp").withColumnRenamed("component_id", "id"))
                     .filter("_moves").select(claim.alias("claim")))
    rows = flagged(rows)
    moved = rows.filter("_moves").withColumn("id", F.col(f"row.{doc_id}")).withColumn("claim", claim)
    return (rows.filter("not _moves").select("row.*")
            .unionByName(moved.join(claims, "claim", "left_semi").dropDuplicates(["claim"]).select("row.*")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicate_classes(documents(spark, sf_dir, "doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
