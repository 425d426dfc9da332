"""Reading and writing the domain tables as Parquet.

One batch is one write: nothing is inserted row by row. A table is never overwritten from
its own scan; jobs that rewrite a whole table (new column, copy) return a DataFrame that
the caller writes to a new path. Deleting rows and loading months anew rewrite only the files or
partitions concerned.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerwork.functions.text import not_a_day, to_day
from ledgerwork.sources.files import Store
from ledgerwork.sources.schemas import SCHEMAS


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan one domain table with its declared schema (no inference, no footer merge)."""
    return spark.read.schema(SCHEMAS[table]).parquet(path).select(*SCHEMAS[table].names)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the table's types and order; columns the frame lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table].fields
        ]
    )


def append(df: DataFrame, path: str, table: str) -> None:
    conform(df, table).write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, table: str) -> None:
    """Clear, then load."""
    conform(df, table).write.mode("overwrite").parquet(path)


def append_months(df: DataFrame, path: str, table: str, day: str) -> None:
    """Append to a table that has a folder per month of the column `day`."""
    _by_month(conform(df, table), day).write.mode("append").partitionBy("month_of").parquet(path)


def load_months(df: DataFrame, path: str, table: str, day: str) -> None:
    """Clear and load the months that occur in the rows; the folders of other months stay as they are."""
    rows = _by_month(conform(df, table), day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("month_of").parquet(path)


def _by_month(df: DataFrame, day: str) -> DataFrame:
    """Rows without a day go to the folder of month `none`. Rows are spread by a hash beside the month, so a
    month that holds most rows is written by many tasks."""
    month = F.coalesce(F.date_format(day, "yyyy_MM"), F.lit("none"))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    return df.withColumn("month_of", month).repartition("month_of", spread)


def delete_rows(spark: SparkSession, path: str, table: str, condition: Column) -> int:
    """Delete the rows that meet the condition and return the number of files rewritten for it.

    The files that hold such rows are found first; rows that stay in them are written next to the
    table, moved in beside the old files, and only then these are removed. All other files keep
    their names. A reader sees rows twice, never too few, while files are swapped; names of files, not
    rows, pass the driver.
    """
    store = Store(spark, path)
    rows = spark.read.schema(SCHEMAS[table]).parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    hit = [r["_file"] for r in rows.where(condition).select("_file").distinct().collect()]
    if not hit:
        return 0
    staging = f"{store.folder.rstrip('/')}-{uuid.uuid4().hex}"
    old = spark.read.schema(SCHEMAS[table]).option("basePath", path).parquet(*hit)
    stays = old.where(~F.coalesce(condition, F.lit(False)))
    parts = [c for c in old.columns if c not in SCHEMAS[table].names]
    stays.write.partitionBy(*parts).parquet(staging)
    for name in store.data_files(staging):
        store.move(f"{staging}/{name}", f"{store.folder}/{name}")
    for name in hit:
        store.remove(name)
    store.remove(staging)
    return len(hit)


def strict_days(raw: DataFrame, path: str, table: str, days: Sequence[str], key: str) -> None:
    """Append raw rows whose `days` columns are text, all of which have to be dates or empty.

    The rows are written beside the table while Spark counts the texts that are no date and keeps the
    first and last of them by `key`. With none the files are moved in; else they are removed and
    the load stops, so a table never holds part of a batch. `to_day` is the lenient form, which makes
    such a text NULL.
    """
    spark = raw.sparkSession
    store = Store(spark, path)
    staging = f"{store.folder.rstrip('/')}-{uuid.uuid4().hex}"
    seen = Observation()
    metrics = []
    for c in days:
        wrong = F.when(not_a_day(F.col(c)), F.struct(F.col(key), F.col(c)))
        metrics += [F.count(wrong).alias(f"{c} wrong"), F.min(wrong).alias(f"{c} first"), F.max(wrong).alias(f"{c} last")]
    parsed = raw.observe(seen, *metrics).withColumns({c: to_day(F.col(c)) for c in days})
    conform(parsed, table).write.parquet(staging)
    found = seen.get
    wrong = {c: found[f"{c} wrong"] for c in days if found[f"{c} wrong"]}
    if not wrong:
        for name in store.data_files(staging):
            store.move(f"{staging}/{name}", f"{store.folder}/{name}")
    store.remove(staging)
    if wrong:
        said = [f"{n} texts of {c} are no dates, such as {found[f'{c} first']} and {found[f'{c} last']}" for c, n in wrong.items()]
        raise ValueError("; ".join(said))


def without_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """The table less the rows whose text `column` equals `value`; NULLs stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def with_column_default(df: DataFrame, column: str, kind: str, default: object = None) -> DataFrame:
    """Add a column, NULL or a default in the existing rows. An existing column is an error."""
    if column in df.columns:
        raise ValueError(f"column {column} exists")
    return df.withColumn(column, F.lit(default).cast(kind))


def copy_columns(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Write the chosen columns as a new table."""
    df.select(*columns).write.mode("errorifexists").parquet(path)


def save_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def write_invoices(invoices: DataFrame, path: str) -> None:
    """One folder per month. Rows are spread over tasks by contract first, so that a month
    that holds most invoices is still written by many tasks."""
    invoices.repartition(F.col("month"), F.pmod(F.xxhash64("contract_no"), F.lit(64))).write.mode(
        "append"
    ).partitionBy("month").parquet(path)


def whole_numbers(spark: SparkSession, first: int, last: int) -> DataFrame:
    """A list of allowed values (block numbers, receipt numbers) as text rows."""
    return spark.range(first, last + 1).select(F.col("id").cast("string").alias("value"))


def in_range(value: Column, first: int, last: int) -> Column:
    """True where the text is a whole number between both ends."""
    number = value.cast("string").try_cast("long")
    return F.coalesce((number >= first) & (number <= last), F.lit(False))
