"""Class catalogue lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_catalogue(rows: DataFrame, catalogue: DataFrame, id_col: str = "class_id") -> DataFrame:
    """Adds ``label`` and ``category``; an unknown id keeps its id as label.

    ``catalogue`` has id, label, category. Spark broadcasts it only when its size is under the
    session's threshold and falls back to a shuffle join beyond it.
    """
    dim = catalogue.select(F.col("id").alias(id_col), F.col("label").alias("_label"),
                           F.col("category").alias("_category"))
    return (
        rows.join(dim, id_col, "left")
        .withColumn("label", F.coalesce("_label", F.col(id_col).cast("string")))
        .withColumn("category", F.coalesce("_category", F.lit("unknown")))
        .drop("_label", "_category")
    )
