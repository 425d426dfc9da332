"""Session settings the jobs are meant to run with. All are plain Spark settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # dates compare the same on every machine
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: merge small shuffle partitions, split skewed join partitions, drop
    # branches that turn out empty (the hot-key branches on data without hot keys)
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join also where the rows are shuffled again afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
}


def apply(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Put the settings on a session builder. `shuffle_partitions` is the upper bound before
    merging: about input bytes / 128 MB, at least the number of cores."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder
