"""Corpus facts kept up to date as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTES_PER_STEP = "8g"

SIZES = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
Facts = Callable[[DataFrame], DataFrame]


def byte_count(size: str | int) -> int:
    """Bytes of a size such as 512, "3k" or "8g"; file streams take whole bytes only."""
    text = str(size).strip().lower()
    return int(text[:-1]) * SIZES[text[-1]] if text[-1] in SIZES else int(text)


def process_arrivals(spark: SparkSession, source: str, schema: T.StructType, facts: Facts, target: str, checkpoint: str,
                     bytes_per_step: str | int = BYTES_PER_STEP, glob: str | None = None) -> DataFrame:
    """Drains the files below ``source`` in steps of about ``bytes_per_step`` and writes their facts.

    Each step overwrites its own ``step=<id>`` folder, so a repeated step after a failure leaves the
    same rows. Returns the rows of each step (step, rows), read from what was written.
    """
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(byte_count(bytes_per_step)))
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def write(batch: DataFrame, step: int) -> None:
        facts(batch).write.mode("overwrite").parquet(f"{target}/step={step}")

    stream = (
        reader.parquet(source).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()
    return spark.read.parquet(target).groupBy("step").agg(F.count("*").alias("rows"))


def current_facts(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The latest facts per key: a file that came again replaces its earlier rows."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy(key).agg(F.max("step").alias("step"))
    return rows.join(latest, [key, "step"], "left_semi").drop("step")
