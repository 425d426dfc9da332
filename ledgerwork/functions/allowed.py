"""Values that may be entered: known keys, and whole numbers inside listed intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The choice lists of the entry forms as intervals (kind, first, last).
INTERVALS = [("block", 1, 15), ("membership receipt", 1, 2000), ("consumption receipt", 1, 200)]


def intervals(spark: SparkSession, rows: Sequence[tuple[str, int, int]] = INTERVALS) -> DataFrame:
    """A table of intervals; further rows, such as another receipt book, may be added to it."""
    return spark.createDataFrame(list(rows), "kind string, first long, last long")


def mark_known(df: DataFrame, column: str, table: DataFrame, key: str, out: str) -> DataFrame:
    """Add the boolean `out`: the value of `column` is a `key` of the table. NULL is never known."""
    keys = table.select(F.col(key).alias("_key")).distinct().withColumn("_found", F.lit(True))
    joined = df.join(keys, df[column] == keys["_key"], "left")
    return joined.select(*[df[c] for c in df.columns], F.col("_found").isNotNull().alias(out))


def mark_inside(df: DataFrame, column: str, table: DataFrame, kind: str, out: str) -> DataFrame:
    """Add the boolean `out`: `column` is a whole number inside an interval of the kind.

    The join is on bins. An interval goes into bins as wide as the power of two at or above its
    length, so it has two at most, whether it spans ten numbers or all; a number is looked up
    in one bin for every width that occurs. Only distinct numbers are looked up, so a number that
    most rows hold is one row, intervals may overlap, and no row is repeated.
    """
    mine = table.where((F.col("kind") == kind) & (F.col("first") <= F.col("last"))).select("first", "last").distinct()
    length = F.col("last").cast("decimal(20)") - F.col("first").cast("decimal(20)") + 1
    # binary digits of length - 1; a span that no long holds gets one bin for each sign
    width = F.when(length > 1 << 62, 63).otherwise(_digits((length - 1).cast("long")))
    sized = mine.withColumn("_width", width)
    bins = sized.select(
        "*", F.explode(F.array_distinct(F.array(_bin(F.col("first")), _bin(F.col("last"))))).alias("_bin")
    )
    widths = sized.agg(F.collect_set("_width").alias("w")).scalar()
    numbers = df.select(_number(F.col(column)).alias("_number")).where(F.col("_number").isNotNull()).distinct()
    looked_up = numbers.withColumn("_width", F.explode(widths)).withColumn("_bin", _bin(F.col("_number")))
    inside = F.col("_number").between(F.col("first"), F.col("last"))
    found = looked_up.join(bins, ["_width", "_bin"]).where(inside).select(F.col("_number").alias("_key")).distinct()
    flags = found.withColumn("_found", F.lit(True))
    joined = df.join(flags, _number(df[column]) == flags["_key"], "left")
    return joined.select(*[df[c] for c in df.columns], F.col("_found").isNotNull().alias(out))


def _number(value: Column) -> Column:
    return value.cast("string").try_cast("long")


def _digits(value: Column) -> Column:
    return F.when(value <= 0, 0).otherwise(F.length(F.bin(value)))


def _bin(value: Column) -> Column:
    return F.call_function("shiftright", value, F.col("_width"))
