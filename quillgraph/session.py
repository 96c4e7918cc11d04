"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app: str = "quillgraph", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local session without one gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder all executors share")
    made = tempfile.mkdtemp(prefix="quillgraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys to a fixed number of tasks, for work that costs far more than its rows weigh.

    A small file is one task of a scan, and exchanges are merged by their compressed size, neither of which tells what its rows cost.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared folder.

    Iterative operators stay short and survive lost executors, later reads take only the columns
    they need, and the planner sees the true size, so nothing large is broadcast by a wrong guess.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
