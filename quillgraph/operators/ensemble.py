"""Merging the predictions of several engines.

Rows are (item, engine, engine_order, rank, class_id, confidence, error). A failed engine is one
row with an error and no class, so it joins in every count without stopping the merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed value: length of a merged ranking.
MERGED_LENGTH = 5


def combine_engines(results: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results)


def fail_where(predictions: DataFrame, condition, message: str) -> DataFrame:
    """Engine output with failure isolation: rows under ``condition`` shrink to one error row."""
    failed = predictions.filter(condition & (F.col("rank") == 1)).select(
        "item", "engine", "engine_order",
        F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast(predictions.schema["class_id"].dataType).alias("class_id"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(message).alias("error"),
    )
    kept = predictions.filter(~condition).select(
        "item", "engine", "engine_order", "rank", "class_id", "confidence", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(failed)


def votes(results: DataFrame) -> DataFrame:
    """Votes and mean confidence per (item, class). An engine votes once for a class.

    Confidences have two digits, so the mean is taken in whole hundredths and rounds half up exactly.
    """
    answers = results.filter(F.col("class_id").isNotNull())
    per_engine = answers.groupBy("item", "class_id", "engine").agg(F.max("confidence").alias("confidence"))
    return per_engine.groupBy("item", "class_id").agg(
        F.count(F.lit(1)).alias("votes"),
        (F.floor(F.sum(F.round(F.col("confidence") * 100).cast("long")) / F.count(F.lit(1)) + 0.5) / 100.0)
        .cast("double").alias("avg_confidence"),
    )


def engine_union(results: DataFrame, length: int = MERGED_LENGTH) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("avg_confidence"), F.desc("votes"), "class_id")
    return votes(results).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= length)


def engine_intersection(results: DataFrame) -> DataFrame:
    answering = results.filter(F.col("class_id").isNotNull()).groupBy("item").agg(
        F.count_distinct("engine").alias("n_engines"))
    return votes(results).join(answering, "item").filter(F.col("votes") >= F.col("n_engines")).drop("n_engines")


def engine_first(results: DataFrame) -> DataFrame:
    """Predictions of the first engine, in list order, that has any for the item."""
    answers = results.filter(F.col("class_id").isNotNull())
    first = answers.groupBy("item").agg(F.min("engine_order").alias("engine_order"))
    return answers.join(first, ["item", "engine_order"]).select("item", "engine", "rank", "class_id", "confidence")


def engine_status(results: DataFrame) -> DataFrame:
    """Per engine: items answered, items failed, error text; failures never drop an item."""
    return results.groupBy("engine", "engine_order").agg(
        F.count_distinct(F.when(F.col("error").isNull(), F.col("item"))).alias("n_answered"),
        F.count_distinct(F.when(F.col("error").isNotNull(), F.col("item"))).alias("n_failed"),
        F.max("error").alias("error"),
    )
