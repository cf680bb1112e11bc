"""Session settings the jobs count on. All are runtime settings; none sizes the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A receipt number that holds much of a table: split the join and shuffle once
    # more, rather than leave it to one task because the next step could reuse the
    # join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The rows of a task, whatever the size of the input: a shuffled partition of this
    # size is some hundred thousand lines, sorted and hashed by each step of a stage.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # Rows that lie by some of a join's keys stay where they are, so that numbering,
    # receipts and the join with loaded keys use one shuffle, the one by receipt number.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

# Bytes of Parquet input for a shuffle partition, before adaptive execution merges small ones.
INPUT_OF_PARTITION = 4 << 20


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Sets what the jobs count on; shuffles are divided by the size of the input, if it is given.

    Adaptive execution merges partitions, it does not divide them: with a fixed number
    a task's rows, and its memory, would grow with the input.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes // INPUT_OF_PARTITION)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return spark


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillvault")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture costs several JVM calls per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
