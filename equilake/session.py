"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sorted dates and repeated keys take up to 40 times the room in a task that they take in a shuffle, and small shuffle partitions
    # can be merged later but large ones not be cut: many, merged up to a size that leaves room for several sorts in a task.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A hot group is split during the shuffle read of AQE-inserted rebalances too.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app: str = "equilake", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> None:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data.

    Only a session on one machine (master local) may name none; a scratch folder is used then and removed at exit.
    Elsewhere executors could not see each other's files, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not one_machine(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def one_machine(master: str) -> bool:
    """Driver and executors are one process (local, local[n], but not local-cluster)."""
    return master == "local" or master.startswith("local[")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` over all shuffle partitions. Before rows are multiplied: by its size alone a short table would be merged into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table once to the shared folder and read it back as Parquet, so that readers
    still prune columns."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
