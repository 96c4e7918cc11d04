"""Class scores, probabilities, ranking and the out-of-distribution flag.

Classes are cut into blocks of a fixed size, so a model of any number of classes is scored one way. An item visits
every block once; a visit leaves a state of fixed size (maximum, sum of exponentials, their weighted sum, best classes),
and states of one item merge in any order. With one block the model is a small table and the visits are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.functions.numbers import count_where, round_half_up
from quillgraph.functions.rows import settle
from quillgraph.functions.vectors import dot, norm, shannon_entropy, squared_distance, total

# Ranking and flag limits.
MAX_TOP_K = 10
DEFAULT_TOP_K = 3
OOD_LIMIT = 0.55
PROBABILITY_FLOOR = 1e-12
CLASSES_PER_BLOCK = 1024
SALTS = 16


def class_centroids(items: DataFrame, vector: str, label: str, dim: int) -> DataFrame:
    """Mean vector per label: one shuffle of per-task partial sums, never of the vectors."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dim)]
    grouped = items.groupBy(F.col(label).alias("class_id")).agg(*means)
    return grouped.select("class_id", F.array(*[f"d{i}" for i in range(dim)]).alias("center"))


def _scorer(kind: str, scale: float):
    def score(v: Column, center: Column) -> Column:
        if kind == "dot":
            return F.lit(scale) * dot(v, center)
        if kind == "scaled_dot":
            return F.lit(scale) * dot(v, center) / norm(center)
        if kind == "cosine":
            return F.lit(scale) * dot(v, center) / (norm(center) * norm(v))
        if kind == "neg_l2":
            return F.lit(-scale) * F.sqrt(squared_distance(v, center))
        raise ValueError(f"unknown scorer: {kind}")

    return score


def class_blocks(centroids: DataFrame, per_block: int = CLASSES_PER_BLOCK) -> tuple[DataFrame, Column]:
    """Rows (_block, _salt, _model) of about `per_block` classes each, and their number as a scalar.

    Rows of ``centroids`` are (class_id, center) and may have a ``bias``. Each block is there once per salt, so that
    many tasks read it where it does not travel to all of them.
    """
    n_blocks = centroids.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(per_block)).cast("int")).alias("n")).scalar()
    bias = F.col("bias").cast("double") if "bias" in centroids.columns else F.lit(0.0)
    member = F.struct("class_id", "center", bias.alias("bias"))
    blocks = (centroids.withColumn("_n", n_blocks).withColumn("_block", F.pmod(F.hash("class_id"), F.col("_n")))
              .groupBy("_block").agg(F.collect_list(member).alias("_model"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return blocks, n_blocks


def block_logits(items: DataFrame, centroids: DataFrame, key: str, vector: str, kind: str = "scaled_dot", scale: float = 20.0,
                 per_block: int = CLASSES_PER_BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, carried columns, scores): an item's scores in one block as structs (class_id, logit)."""
    score = _scorer(kind, scale)
    blocks, n_blocks = class_blocks(centroids, per_block)
    visits = (items.select(key, *carry, F.col(vector).cast("array<double>").alias("_v"))
              .withColumn("_n", n_blocks).withColumn("_salt", F.pmod(F.hash(key), F.lit(SALTS)))
              .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    scores = F.transform("_model", lambda c: F.struct(
        c["class_id"].alias("class_id"), (score(F.col("_v"), c["center"]) + c["bias"]).alias("logit")))
    return settle(visits.join(blocks, ["_block", "_salt"]).select(key, *carry, scores.alias("scores")), "scores")


def linear_scores(items: DataFrame, centroids: DataFrame, key: str, vector: str, kind: str = "scaled_dot", scale: float = 20.0,
                  per_block: int = CLASSES_PER_BLOCK) -> DataFrame:
    """Long scores (key, class_id, logit)."""
    return block_logits(items, centroids, key, vector, kind, scale, per_block).select(key, F.inline("scores"))


def score_states(items: DataFrame, centroids: DataFrame, key: str, vector: str, kind: str = "scaled_dot", scale: float = 20.0,
                 label: str | None = None, per_block: int = CLASSES_PER_BLOCK) -> DataFrame:
    """One row per item: key, label, n_classes, peak, mass, spread, ranking (best MAX_TOP_K) and the label's logit as target.

    With d = logit - peak, mass is the sum of exp(d) and spread that of d * exp(d); both move to a larger peak by a factor.
    ``key`` names an item once. An item without classes to visit has no row.
    """
    rows = block_logits(items, centroids, key, vector, kind, scale, per_block, (label,) if label else ())
    logits = F.col("scores.logit")
    peak = F.array_max(logits)
    rows = settle(rows.withColumn("_d", F.transform(logits, lambda x: x - peak)), "_d")
    best = F.slice(F.array_sort(F.transform("scores", lambda s: F.struct((-s["logit"]).alias("neg"), s["class_id"].alias("class_id")))), 1, MAX_TOP_K)
    hit = F.array_max(F.transform(F.filter("scores", lambda s: s["class_id"] == F.col(label)), lambda s: s["logit"])) if label else F.lit(None).cast("double")
    states = settle(rows.select(
        key, *([label] if label else []), F.size("scores").alias("n"), peak.alias("peak"),
        total(F.transform("_d", F.exp)).alias("mass"), total(F.transform("_d", lambda d: F.exp(d) * d)).alias("spread"),
        best.alias("best"), hit.alias("target")), "peak", "mass", "spread", "best", "target")
    return merge_states(states, key, label)


def merge_states(states: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """States of an item's blocks as one; an item has as many as there are blocks, each of fixed size."""
    merged = states.groupBy(key).agg(
        *([F.first(label).alias(label)] if label else []),
        F.sum("n").alias("n_classes"), F.max("peak").alias("peak"), F.max("target").alias("target"),
        F.collect_list(F.struct("peak", "mass", "spread")).alias("_parts"), F.flatten(F.collect_list("best")).alias("_best"))
    shift = lambda part: part["peak"] - F.col("peak")
    mass = total(F.transform("_parts", lambda b: F.exp(shift(b)) * b["mass"]))
    spread = total(F.transform("_parts", lambda b: F.exp(shift(b)) * (b["spread"] + shift(b) * b["mass"])))
    merged = settle(merged.withColumn("mass", mass).withColumn("spread", spread).drop("_parts"), "mass", "spread")
    ranking = F.transform(F.slice(F.array_sort("_best"), 1, MAX_TOP_K), lambda b: F.struct(
        (-F.exp(-b["neg"] - F.col("peak")) / F.col("mass")).alias("neg"), b["class_id"].alias("class_id")))
    return settle(merged.withColumn("ranking", ranking).drop("_best"), "ranking")


def probabilities(scores: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Long scores with ``prob``, from the merged state of each item."""
    return scores.join(states.select(key, "peak", "mass"), key).withColumn(
        "prob", F.exp(F.col("logit") - F.col("peak")) / F.col("mass")).drop("peak", "mass")


def state_entropy(states: DataFrame, limit: float = OOD_LIMIT) -> DataFrame:
    """As ``entropy_ood``, from states: ln(mass) - spread / mass. Probabilities below the floor add less than 3e-11 each."""
    h = F.ln("mass") - F.col("spread") / F.col("mass")
    return _with_entropy(states, h, F.col("n_classes"), limit)


def softmax(scored: DataFrame) -> DataFrame:
    """Adds ``probs`` aligned with ``classes``."""
    exps = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    summed = settle(scored.withColumn("_exps", exps), "_exps")
    probs = F.transform("_exps", lambda e: e / total(F.col("_exps")))
    return settle(summed.withColumn("probs", probs).drop("_exps"), "probs")


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``ranking``: classes by falling probability, ties by class id."""
    pairs = F.zip_with("probs", "classes", lambda p, c: F.struct((-p).alias("neg"), c.alias("class_id")))
    return scored.withColumn("ranking", F.array_sort(pairs))


def percent(probability: Column) -> Column:
    return F.round(probability * 100, 2)


def top_k(ranked_rows: DataFrame, key: str, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Rows (key, rank, class_id, confidence); k never exceeds ten."""
    best = F.slice("ranking", 1, min(k, MAX_TOP_K))
    return ranked_rows.select(key, F.posexplode(best).alias("_pos", "_best")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_best.class_id").alias("class_id"),
        percent(-F.col("_best.neg")).alias("confidence"),
    )


def top_1(ranked_rows: DataFrame) -> DataFrame:
    """Adds ``class_id`` and ``confidence`` of the best class."""
    best = F.element_at("ranking", 1)
    return ranked_rows.withColumn("class_id", best["class_id"]).withColumn("confidence", percent(-best["neg"]))


def _with_entropy(rows: DataFrame, h: Column, n_classes: Column, limit: float) -> DataFrame:
    return (
        rows.withColumn("_h", h)
        .withColumn("_share", F.col("_h") / F.ln(n_classes.cast("double")))
        .withColumn("entropy", F.round("_h", 4))
        .withColumn("normalized_entropy", F.round("_share", 4))
        .withColumn("is_ood", F.col("_share") > limit)
        .drop("_h", "_share")
    )


def entropy_ood(scored: DataFrame, limit: float = OOD_LIMIT) -> DataFrame:
    """Adds entropy, its share of the maximum, and the flag taken from the unrounded share."""
    return _with_entropy(scored, shannon_entropy(F.col("probs"), PROBABILITY_FLOOR), F.size("classes"), limit)


def confidence_band(confidence: Column, bounds: tuple[float, ...] = (70, 40, 20)) -> Column:
    """Band 1 is the highest; below the last bound is the last band."""
    band = F.lit(len(bounds) + 1)
    for i in range(len(bounds), 0, -1):
        band = F.when(confidence >= bounds[i - 1], i).otherwise(band)
    return band


def score_counters(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over rows with ``error`` (null when scored) and ``is_ood``."""
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_files"),
        count_where(F.col("error").isNotNull()).alias("n_errors"),
        count_where(F.col("error").isNull()).alias("n_analysed"),
        count_where(F.col("error").isNull() & F.col("is_ood")).alias("n_ood"),
    )


def category_histogram(top_rows: DataFrame, category: str = "category", bar: int = 20) -> DataFrame:
    """Counts per category with share in percent and bar length relative to the largest."""
    counts = top_rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    # One row per catalogue category: small enough for a window without a partition.
    everything = W.partitionBy()
    return counts.select(
        category,
        "n",
        F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 1).alias("pct"),
        round_half_up(F.col("n") * F.lit(float(bar)) / F.max("n").over(everything)).alias("bar"),
    )


def top_labels_with_samples(top_rows: DataFrame, label: str, file: str, n_labels: int = 10,
                            n_samples: int = 2) -> DataFrame:
    """Most frequent labels with their first files and how many more there are.

    Samples come from a rank filter, which Spark applies inside each task before the shuffle, so a
    label holding most rows never gathers in one place.
    """
    counts = top_rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(n_labels)
    first = (
        top_rows.select(label, file)
        .withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(file)))
        .filter(F.col("_r") <= n_samples)
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(file)).alias("samples"))
    )
    return counts.join(first, label, "left").withColumn(
        "n_more", F.greatest(F.col("n") - F.lit(n_samples), F.lit(0)).cast("long"))
