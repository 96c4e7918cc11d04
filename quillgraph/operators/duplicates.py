"""Items that share a class with high confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed value: confidence share from which two items count as the same logic.
SAME_LOGIC_SHARE = 0.70


def name_inputs(inputs: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """A missing name becomes ``function_<n>`` with n the running number in the batch."""
    return inputs.withColumn(name, F.coalesce(F.col(name), F.concat(F.lit("function_"), F.col(order).cast("string"))))


def attach_scores(inputs: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Every input stays: one that could not be scored gets no class and confidence 0."""
    return inputs.join(scored, key, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def require_two(inputs: DataFrame) -> DataFrame:
    """Comparing needs two inputs; one row is read to tell."""
    if len(inputs.limit(2).take(2)) < 2:
        raise ValueError("duplicate detection needs at least two inputs")
    return inputs


def duplicate_groups(scored: DataFrame, key: str, threshold: float = SAME_LOGIC_SHARE) -> DataFrame:
    """Members (class_id, key, confidence, group_size) of every group of two or more.

    The group is kept as rows: only its size is aggregated, so a class that holds most items is
    never collected.
    """
    eligible = scored.filter(
        F.col("class_id").isNotNull() & ~F.coalesce("is_ood", F.lit(False)) & (F.col("confidence") >= threshold * 100)
    ).select(key, "class_id", "confidence")
    sizes = eligible.groupBy("class_id").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size >= 2")
    return eligible.join(sizes, "class_id")


def ood_side_output(scored: DataFrame, key: str) -> DataFrame:
    return scored.filter("is_ood").select(key, "entropy", "normalized_entropy", "class_id", "confidence")


def pairwise_compare(pairs: DataFrame, scored: DataFrame, key: str, threshold: float = SAME_LOGIC_SHARE) -> DataFrame:
    """Verdict for each given pair (left_id, right_id)."""
    cols = ["class_id", "confidence", "normalized_entropy", "is_ood"]
    side = lambda s: scored.select(F.col(key).alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in cols])
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    blocked = F.col("left_is_ood") | F.col("right_is_ood")
    same = (
        ~blocked
        & (F.col("left_class_id") == F.col("right_class_id"))
        & (F.col("left_confidence") >= threshold * 100)
        & (F.col("right_confidence") >= threshold * 100)
    )

    def reason(s: str):
        share = F.floor(F.col(f"{s}_normalized_entropy") * 100 + 0.5).cast("string")
        return F.when(F.col(f"{s}_is_ood"), F.concat(F.lit(f"{s} out of distribution, entropy "), share, F.lit("%")))

    return both.select(
        "left_id",
        "right_id",
        blocked.alias("cannot_compare"),
        same.alias("is_duplicate"),
        F.when(same, F.col("left_class_id")).alias("class_id"),
        "left_class_id",
        "right_class_id",
        "left_confidence",
        "right_confidence",
        F.concat_ws("; ", reason("left"), reason("right")).alias("reason"),
    )
