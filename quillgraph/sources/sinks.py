"""Writing labelled samples with their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.vocabulary import SEQUENCE_LENGTH, VOCABULARY

MANIFEST_VERSION = "1.1"


def dataset_manifest(samples: DataFrame) -> DataFrame:
    """One row about samples with ``label`` and ``category``. Only per-label counts are gathered."""
    counts = samples.groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"))
    categories = counts.groupBy("category").agg(F.sum("n").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("category", "n"))))
    return counts.agg(
        F.sum("n").alias("n_samples"),
        F.count_distinct("label").alias("n_labels"),
        F.array_sort(F.collect_set("label")).alias("label_index"),
    ).select(
        F.lit(MANIFEST_VERSION).alias("version"), "n_samples", "n_labels",
        F.lit(len(VOCABULARY)).alias("vocab_size"), F.lit(SEQUENCE_LENGTH).alias("sequence_length"),
        "label_index", categories.scalar().alias("category_distribution"))


def write_dataset(samples: DataFrame, path: str) -> None:
    """Samples by label as parquet, the manifest as JSON next to them.

    The rebalance hint lets adaptive execution split a label that holds most rows.
    """
    samples.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{path}/samples")
    dataset_manifest(samples).write.mode("overwrite").json(f"{path}/manifest")
