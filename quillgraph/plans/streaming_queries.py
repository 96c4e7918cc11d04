"""Quota and incremental queries over events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.plans.registry import query
from quillgraph.session import shared_dir, table
from quillgraph.streaming.incremental import current_facts, process_arrivals
from quillgraph.streaming.quota import anchored_quota, use_state_store

DAY_MS, LIMIT = 86_400_000, 2

QUOTA_CTE = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
q AS (SELECT user_id, event_id, i, 1 AS n, ts + INTERVAL 1 DAY AS reset_at, true AS allowed FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts > q.reset_at THEN 1 WHEN q.n >= 2 THEN q.n ELSE q.n + 1 END,
    CASE WHEN e.ts > q.reset_at THEN e.ts + INTERVAL 1 DAY ELSE q.reset_at END, e.ts > q.reset_at OR q.n < 2 FROM q JOIN e ON e.user_id = q.user_id AND e.i = q.i + 1)"""
QUOTA_SQL = QUOTA_CTE + """
SELECT user_id::VARCHAR AS key, event_id, allowed, n::INTEGER AS n_in_window FROM q"""


def access_log(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("w1_anchored_quota", QUOTA_SQL)
def w1(spark, sf):
    use_state_store(spark)
    return anchored_quota(access_log(spark, sf), DAY_MS, LIMIT).filter("kind = 'verdict'").select("key", "event_id", "allowed", "n_in_window")


SLICES = 6


def quota_stream(spark, sf, order):
    """Runs the quota as a stream over SLICES arrivals of the events, cut by `order`.

    Each arrival is written by as many tasks as there are, and the stream then takes all that has come, from its checkpoint.
    """
    use_state_store(spark)
    scratch = _scratch(spark)
    log = access_log(spark, sf)
    for part in range(SLICES):
        log.filter(order == part).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{scratch}/in")
        run = (anchored_quota(stream, DAY_MS, LIMIT).writeStream.format("parquet").option("checkpointLocation", f"{scratch}/state")
               .trigger(availableNow=True).start(f"{scratch}/out"))
        run.awaitTermination()
    return spark.read.parquet(f"{scratch}/out")


def in_time(spark, sf):
    """Arrival of an event when they come in order of time: its place among SLICES equal spans."""
    ends = access_log(spark, sf).agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    span = max((ends["b"] or 0) - (ends["a"] or 0), 0) // SLICES + 1
    return F.floor((F.unix_micros("ts") - F.lit(ends["a"] or 0)) / span)


@query("w1_anchored_quota_stream", QUOTA_SQL)
def w1_stream(spark, sf):
    return quota_stream(spark, sf, in_time(spark, sf)).filter("kind = 'verdict'").select("key", "event_id", "allowed", "n_in_window")


@query("w1_quota_late_side_output", "SELECT user_id::VARCHAR AS key, event_id FROM events")
def w1_late(spark, sf):
    """Arrivals in no order: every event has a verdict or is late; none is lost, none comes twice."""
    rows = quota_stream(spark, sf, F.pmod(F.crc32(F.col("event_id").cast("string")), F.lit(SLICES)))
    return rows.filter("kind IN ('verdict', 'late')").select("key", "event_id")


@query("w2_state_expiry", QUOTA_CTE + """
SELECT user_id::VARCHAR AS key, reset_at, max(n)::INTEGER AS n_in_window FROM q
WHERE date_trunc('milliseconds', reset_at) < (SELECT date_trunc('milliseconds', max(ts)) FROM events) GROUP BY user_id, reset_at""")
def w2(spark, sf):
    """Windows that are over at the largest time of all keys: idle keys are reported by their timers, and their state goes."""
    return quota_stream(spark, sf, in_time(spark, sf)).filter("kind = 'closed'").select("key", F.col("ts").alias("reset_at"), "n_in_window")


@query("w3_incremental_corpus", """
SELECT source AS repo, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents GROUP BY 1""")
def w3(spark, sf):
    """The corpus arrives twice: an outdated half in files of its own, then all of it, which replaces those."""
    scratch = _scratch(spark)
    docs = table(spark, sf, "documents")
    facts = lambda batch: batch.select("doc_id", F.col("source").alias("repo"), "n_chars", F.size(F.split("text", "\n")).alias("n_lines"))
    arrivals = (docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).withColumn("text", F.lit("outdated")).withColumn("n_chars", F.lit(-1).cast("long")), docs)
    for rows in arrivals:
        rows.repartition("doc_id").write.mode("append").parquet(f"{scratch}/in")
        process_arrivals(spark, f"{scratch}/in", docs.schema, facts, f"{scratch}/facts", f"{scratch}/state", glob="*.parquet")
    return current_facts(spark, f"{scratch}/facts", "doc_id").groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"), F.sum("n_lines").cast("long").alias("n_lines"))
