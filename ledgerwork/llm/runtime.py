"""What the operators share: the shared folder, tables written there, Arrow columns in bounded slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step handles at a time; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # shuffle files go when the driver collects its garbage; the table replaces those of its plan
    spark._jvm.System.gc()
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    return kept


def release(spark: SparkSession) -> None:
    """Have the shuffle files behind tables kept so far removed now, where they are large. The driver refers to the
    last execution until another one has run."""
    spark.range(1).count()
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete a table made by `keep` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, df: DataFrame) -> str:
    """`name`, with underscores before it until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: pa.Array) -> pa.Array:
    """A text column as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def give_back() -> None:
    """Free memory of the Python process back to the system: workers and the driver live on and would hold it beside the
    JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of one piece has at most `limit` bytes, or one row.

    What a batch leaves free goes back to the system before the next one comes."""
    give_back()
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first, size = 0, 0
        for k, n in enumerate(lengths):
            if k > first and size + n > limit:
                yield batch.slice(first, k - first)
                first, size = k, 0
            size += n
        if first < len(lengths):
            yield batch.slice(first)
        del batch, lengths
        give_back()
