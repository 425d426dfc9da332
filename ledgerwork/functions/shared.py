"""Intermediate tables that outlive executors: in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names in `spark.checkpoint.dir`. A session that
    names none gets a folder in its warehouse, which driver and executors share as well."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: lineage ends here."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Numbered tables of one computation, each written once and removed when no later one needs it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{use_checkpoint_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
