"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash and queue up to three times (three epochs). The virtual finish
time of a queued document is its source's tokens so far divided by the source's target. All queued documents of
all sources, ordered by finish time, are cut where the total budget is used up.

Running sums never need one task per source or per table: sums of hash buckets (or time buckets) give each
bucket its offset, and only rows within one bucket are ordered. The number of buckets grows with the rows. The
cut falls, for each source, at one (epoch, hash) position; so documents meet one small row per source and their
texts are not shuffled. All functions are DataFrame operations.

Defined results: null text has size 0 and is never taken. Sources follow each other by code point, null last,
with weights 1, 2, 3 and again. Rows with one (source, doc_id), and null ids of one source, share a place in the
queue and are taken together. Sources without words have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import documents, word_count, written

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix-1"
BUCKET_ROWS = 4096
BUCKET_DIGITS = 7  # at most: 268 million buckets a source
STEPS = 4096  # steps of virtual time; time 1 is where a source meets its target


def _place(doc_id: Column, source: Column) -> Column:
    """Place of a document in its source's shuffled order, as 32 hex digits."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), name))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size, weight, target) from rows (source, source_size), one per source.

    The budget is the sum of all sizes. Sources are ordered by the share at which they reach EPOCHS times
    their size; the first prefix of them whose capping leaves nobody above the cap gives the water level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("full_at", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long"))
    rows = rows.withColumn("full_at", F.col("source_size") * EPOCHS / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (
        F.sum("source_size").over(everything) - EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # The level when all sources before this one are capped holds if this one is not above its cap.
    rows = rows.withColumn("water", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct(F.row_number().over(by_cap).alias("at"), "level")))
                           .over(everything)["level"])
    cap = (F.col("source_size") * EPOCHS).cast("double")
    return rows.select("source", "source_size", "weight", F.least(cap, F.coalesce(F.col("weight") * F.col("water"), cap)).alias("target"))


def _digits(rows: DataFrame) -> int:
    """Leading hex digits of the place that make buckets of about BUCKET_ROWS rows in the largest source."""
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while digits < BUCKET_DIGITS and most > BUCKET_ROWS * 16 ** digits:
        digits += 1
    return digits


def queue_positions(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (source, place, size, before, source_size, target): words of the source that queue before each place in one epoch."""
    digits = _digits(rows)
    places = written(rows.filter("size > 0").groupBy("source", "place").agg(F.sum("size").alias("size"))
                     .withColumn("bucket", F.substring("place", 1, digits)))
    sums = places.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).alias("o")
    offsets = written(offsets.join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
                      .select("o.source", "bucket", "offset", "source_size", "target")).alias("o")
    inside = Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = places.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("p")
    return (placed.join(offsets, F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.bucket") == F.col("o.bucket")))
            .select("p.source", "place", "size", (F.col("inside") + F.col("offset")).alias("before"), "source_size", "target"))


def cut_positions(positions: DataFrame, budget: int) -> DataFrame:
    """Rows (source, epoch, place): the last place of each source's queue that the budget reaches.

    Time is cut into STEPS, so only the rows of the one step in which the budget ends are put in order. The last
    step holds all later times; it matters only where single documents outweigh their source's target.
    """
    queued = positions.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(EPOCHS)])))
    finish = (F.col("epoch") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    queued = written(queued.select("source", "epoch", "place", "size", finish.alias("finish"))
                     .withColumn("step", F.least(F.floor(F.col("finish") * (STEPS // 2)), F.lit(STEPS))))
    earlier = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = (queued.groupBy("step").agg(F.sum("size").alias("in_step"))
             .withColumn("offset", F.coalesce(F.sum("in_step").over(earlier), F.lit(0))))
    end = steps.filter(F.col("offset") + F.col("in_step") > budget).orderBy("step").first()
    taken = queued.filter(F.col("step") < end["step"]) if end else queued
    columns = ("source", "epoch", "place")
    taken = taken.select(*columns)
    if end:
        in_time = Window.orderBy("finish", F.col("source").isNull(), "source", "epoch", "place")
        last = (queued.filter(F.col("step") == end["step"])
                .withColumn("so_far", F.sum("size").over(in_time.rowsBetween(Window.unboundedPreceding, 0)) + end["offset"]))
        taken = taken.unionByName(last.filter(F.col("so_far") <= budget).select(*columns))
    return taken.groupBy("source").agg(F.max(F.struct("epoch", "place")).alias("cut")).select("source", "cut.epoch", "cut.place")


def mixing_plan(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, weight, target, and the (epoch, place) at which its queue is cut (null: nothing is taken)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(written(sizes)))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    cuts = written(cut_positions(queue_positions(rows, targets), budget)).alias("c")
    return written(targets.alias("t").join(cuts, F.col("t.source").eqNullSafe(F.col("c.source")), "left")
                   .select("t.source", "source_size", "weight", "target", "epoch", F.col("place").alias("cut_place")))


def _rows(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       _place(F.col(doc_id), F.col(source)).alias("place"))


def _times_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows joined with their source's plan, and how often the mix takes each. The planner broadcasts the plan where its size allows."""
    times = F.coalesce(F.col("epoch") + (F.col("r.place") <= F.col("cut_place")).cast("long"), F.lit(0).cast("long"))
    return (rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")), "left")
            .withColumn("times", F.when(F.col("r.size") > 0, times).otherwise(F.lit(0).cast("long"))))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The input rows, each as often as the mix takes it (0 to EPOCHS times), with their columns as they were."""
    plan = mixing_plan(written(_rows(docs, doc_id, source, text)))
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       _place(F.col(doc_id), F.col(source)).alias("place"))
    return (_times_taken(rows, plan).filter("times > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, beside its size and its source's size and target."""
    rows = written(_rows(documents(spark, sf_dir, "doc_id", "source", "text"), "doc_id", "source", "text"))
    return _times_taken(rows, mixing_plan(rows)).select(
        "r.doc_id", "r.size", "source_size", "target", (F.col("r.size") * F.col("times")).alias("taken"))


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce('s' || source, 'null')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s),
a AS (SELECT *, source_size * 3 / weight AS full_at FROM w),
l AS (
  SELECT *, row_number() OVER q AS nth,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM a WINDOW q AS (ORDER BY full_at, source IS NULL, source)),
water AS (SELECT min_by(level, nth) AS water FROM l WHERE full_at >= level),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, coalesce(weight * (SELECT water FROM water), source_size * 3.0::DOUBLE)) AS target FROM l),
p AS (SELECT source, place, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, place),
b AS (SELECT source, place, size, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM p),
q AS (
  SELECT b.source, e.epoch, place, size, (e.epoch * source_size + upto) / target AS finish
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e),
c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, epoch, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM q),
n AS (SELECT source, place, count(*) AS times FROM c WHERE so_far <= (SELECT sum(size) FROM d) GROUP BY source, place)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * coalesce(n.times, 0))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source AND d.place = n.place AND d.size > 0
"""
