"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import written


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): the smallest node that each node of the pairs reaches.

    Every round gives a node the smallest label among its neighbours and then the label of that label, so
    distances to the smallest node shrink by a factor each round. Rounds are written tables: nothing grows on
    the driver, large neighbourhoods meet in partial minima, and joins on busy nodes can be split by the planner.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        seen = (pairs.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near")))
        step = written(labels.join(seen, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        far = step.select(F.col("u").alias("label"), F.col("label").alias("far"))
        after = written(step.join(far, "label", "left").select("u", F.least(F.col("label"), F.col("far")).alias("label"), "old"))
        labels = after.select("u", "label")
        if after.filter("label < old").isEmpty():
            return labels.withColumnRenamed("u", "node")
