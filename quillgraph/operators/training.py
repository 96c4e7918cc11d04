"""Training-set split, label ids, metrics, early stopping and the distributed classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.numbers import flag
from quillgraph.functions.text import portable_hash

# Share of training rows, evaluation rhythm and patience in evaluations.
TRAIN_SHARE = 0.9
PATIENCE = 80
WARMUP_SHARE = 0.3
UNITS = 1_000_000_000


def split_train_val(rows: DataFrame, key: str, seed: str, share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``is_train``: true for the first floor(share * n) rows in hash order, exactly.

    The global rank is never computed. Rows are counted in 65 536 hash buckets; only the bucket
    that holds the cut is ranked to find the last training row, and that one value then decides
    every row in a narrow pass.
    """
    hashed = rows.withColumn("_h", portable_hash(F.lit(seed), F.col(key)))
    bucketed = hashed.select("_h", key, F.shiftright("_h", 16).alias("_b"))
    # At most 65 536 rows, so an unpartitioned window is small by construction.
    buckets = (
        bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.orderBy("_b")) - F.col("_n"))
        .withColumn("_cut", F.floor(F.lit(share) * F.sum("_n").over(W.partitionBy())).cast("long"))
    )
    edge = buckets.filter("_before < _cut AND _before + _n >= _cut").withColumn("_take", F.col("_cut") - F.col("_before"))
    last = (
        bucketed.join(F.broadcast(edge.select("_b", "_take")), "_b")
        .withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h", key)))
        .filter("_r = _take")
        .agg(F.max(F.struct("_h", key)))
    )
    return (
        hashed.withColumn("_last", last.scalar())
        .withColumn("is_train", F.coalesce(F.struct("_h", key) <= F.col("_last"), F.lit(False)))
        .drop("_h", "_last")
    )


def label_index(label: Column, catalogue: list[str]) -> Column:
    """Position in the catalogue order, -1 when absent."""
    index = F.array(*[F.lit(x) for x in catalogue])
    return (F.array_position(index, label) - 1).cast("long")


def cross_entropy(states: DataFrame) -> DataFrame:
    """Mean of -log softmax(logits)[label] over rows with the ``peak``, ``mass`` and ``target`` of ``score_states``."""
    return states.select((F.col("peak") + F.ln("mass") - F.col("target")).alias("_l")).agg(
        F.round(F.avg("_l"), 6).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    hit = flag(F.col(label) == F.col(predicted))
    return rows.agg(F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def epoch_metrics(steps: DataFrame, evaluations: DataFrame) -> DataFrame:
    """History per (run, epoch): mean of batch means, and the last known validation value.

    ``steps`` has run, epoch, batch, loss, acc; ``evaluations`` has run, epoch, val and may lack
    epochs. Windows run over one row per epoch. Batch means are counted in units of 1e-9, so means of them are exact
    and ties round up whatever the order of the rows.
    """
    units = lambda c: F.round(F.avg(c) * UNITS).cast("long").alias(c)
    batches = steps.groupBy("run", "epoch", "batch").agg(units("loss"), units("acc"))

    def mean(c: str, parts: int) -> Column:
        """The mean of a column of units, half up in so many parts of one."""
        over, under = F.sum(c) * (2 * parts) + F.count(c) * UNITS, F.count(c) * (2 * UNITS)
        return (over - F.pmod(over, under)) / under / parts

    epochs = batches.groupBy("run", "epoch").agg(mean("loss", 10_000).alias("loss"), (F.round(mean("acc", 1000) * 1000) / 10).alias("acc"))
    carried = F.last("val", ignorenulls=True).over(
        W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow))
    return epochs.join(evaluations, ["run", "epoch"], "left").select(
        "run", "epoch", "loss", "acc", F.round(F.coalesce(carried, F.lit(0.0)) * 100, 1).alias("val"))


def best_and_patience(evaluations: DataFrame) -> DataFrame:
    """Running best and evaluations since the last strict improvement, per (run, epoch)."""
    order = W.partitionBy("run").orderBy("epoch")
    before = F.max("val").over(order.rowsBetween(W.unboundedPreceding, -1))
    improved = evaluations.withColumn("_up", flag(F.col("val") > F.greatest(F.coalesce(before, F.lit(0.0)), F.lit(0.0))))
    runs = improved.withColumn("_island", F.sum("_up").over(order))
    place = F.row_number().over(W.partitionBy("run", "_island").orderBy("epoch"))
    return runs.select(
        "run", "epoch", "val",
        F.greatest(F.max("val").over(order), F.lit(0.0)).alias("best"),
        (place - F.when(F.col("_island") > 0, 1).otherwise(0)).cast("long").alias("patience"))


def early_stop(tracked: DataFrame, total_epochs: int, patience: int = PATIENCE, warmup: float = WARMUP_SHARE) -> DataFrame:
    """First epoch per run where patience ran out after the warm-up; runs that never stop are absent."""
    return tracked.filter((F.col("patience") >= patience) & (F.col("epoch") > total_epochs * warmup)).groupBy("run").agg(
        F.min("epoch").alias("stop_epoch"))


def train_classifier(rows: DataFrame, text: str, label: str, n_features: int = 4096, max_iter: int = 15):
    """Multinomial logistic regression on hashed token counts; returns a fitted, savable model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer

    stages = [
        StringIndexer(inputCol=label, outputCol="label_id", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern="[^\\p{L}\\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=n_features),
        LogisticRegression(featuresCol="_features", labelCol="label_id", predictionCol="predicted_id",
                           family="multinomial", maxIter=max_iter, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)
