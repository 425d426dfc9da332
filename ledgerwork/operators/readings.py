"""Meter readings: last reading, usage from the index, previous-index backfill and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwork.functions.text import month_key, month_label

PRICE_PER_M3 = 7.0


def last_reading(reading: DataFrame) -> DataFrame:
    """Latest date and index per contract. A struct max is combined on the map side, so no
    window and no sort; a NULL date counts as the earliest."""
    return _latest(reading, "contract_no")


def last_block_reading(block_reading: DataFrame) -> DataFrame:
    return _latest(block_reading, "block_no")


def _latest(df: DataFrame, key: str) -> DataFrame:
    latest = df.groupBy(key).agg(F.max(F.struct("read_on", "index_m3")).alias("last"))
    return latest.select(
        key,
        F.col("last.read_on").alias("last_read_on"),
        month_label(F.col("last.read_on")).alias("month_label"),
        F.col("last.index_m3").alias("last_index"),
    )


def previous_index(df: DataFrame, key: str) -> DataFrame:
    """Add `_previous`: the index of the row before in (month, date, index) order.

    A key may hold any share of the rows, so its days are windows of their own. The first row of
    a day is the one that has to look across: in a second window the first and last rows of a
    key's days stand together, two a day at most, and there the row before a first row is the
    last one of the latest earlier day with readings. Rows between pass that window in the
    cell of their day. One pass over the input, no join, no count of hot keys.
    """
    order = ["read_on", "index_m3"]
    day = Window.partitionBy(key, "read_on").orderBy(*order)
    inside = df.withColumns(
        {
            "_before": F.lag("index_m3").over(day),
            "_first": F.row_number().over(day) == 1,
            "_last": F.lead(F.lit(True)).over(day).isNull(),
        }
    )
    edge = F.col("_first") | F.col("_last")
    # a day of the calendar for the rows inside, none for the edges of all days
    cells = inside.withColumn("_cell", F.when(edge, F.lit(None)).otherwise(F.struct("read_on")))
    across = Window.partitionBy(key, "_cell").orderBy(*order, F.desc("_first"))
    found = cells.withColumn("_across", F.lag("index_m3").over(across))
    previous = F.when(F.col("_first"), F.col("_across")).otherwise(F.col("_before"))
    return found.select(*df.columns, previous.alias("_previous"))


def block_usage(block_reading: DataFrame) -> DataFrame:
    """Consumption per block reading; the first reading of a block counts whole."""
    return _usage_from_zero(block_reading, "block_no").select(
        "block_no", "read_on", month_label(F.col("read_on")).alias("month_label"), "index_m3", "usage_m3"
    )


def _usage_from_zero(df: DataFrame, key: str) -> DataFrame:
    usage = F.col("index_m3") - F.coalesce("_previous", F.lit(0.0))
    return previous_index(df, key).withColumn("usage_m3", usage)


def usage_by_lag(reading: DataFrame, price: float = PRICE_PER_M3) -> DataFrame:
    """Consumption and amount from the running index alone, without the stored previous index."""
    used = F.coalesce(F.col("index_m3") - F.col("_previous"), F.col("index_m3"))
    return previous_index(reading, "contract_no").select(
        "contract_no",
        month_key(F.col("read_on")).alias("month"),
        "read_on",
        "index_m3",
        used.alias("qty_m3"),
        (used * price).alias("amount"),
    )


def backfill_prev_index(reading: DataFrame) -> DataFrame:
    """Set `prev_index` to the last index of the nearest earlier month that has a reading.

    All readings of one month share that value. The window runs on one row per contract and
    month, so its partitions are bounded by the calendar however many rows a contract has.
    """
    month = F.trunc("read_on", "month")
    monthly = reading.groupBy("contract_no", month.alias("_month")).agg(
        F.max_by("index_m3", F.struct("read_on", "index_m3")).alias("_last")
    )
    by_month = Window.partitionBy("contract_no").orderBy("_month")
    earlier = (
        monthly.where(F.col("_month").isNotNull())
        .withColumn("_earlier", F.lag("_last").over(by_month))
        .select(F.col("contract_no").alias("_contract"), F.col("_month").alias("_m"), "_earlier")
    )
    rows = reading.withColumn("_month", month)
    same = (rows["contract_no"] == earlier["_contract"]) & (rows["_month"] == earlier["_m"])
    kept = [F.col("_earlier").alias(c) if c == "prev_index" else rows[c] for c in reading.columns]
    return rows.join(earlier, same, "left").select(*kept)


def apply_corrections(reading: DataFrame, fixes: DataFrame) -> DataFrame:
    """Overwrite `prev_index` where a fix names the row; of several fixes the highest `seq` wins.

    `fixes`: seq, contract_no, index_m3 or read_on (the other one NULL), prev_index. Contract
    numbers are compared as text. Each kind of fix is reduced to one row per key first, so the
    reading rows are not multiplied and need no row id. No broadcast is forced: Spark
    broadcasts the fixes as long as they are small.
    """
    rows = reading
    found = []
    for kind in ("index_m3", "read_on"):
        key = [F.col("contract_no").alias(f"_c_{kind}"), F.col(kind).alias(f"_k_{kind}")]
        newest = (
            fixes.where(F.col(kind).isNotNull())
            .groupBy(*key)
            .agg(F.max(F.struct("seq", F.col("prev_index").alias("value"))).alias(f"_fix_{kind}"))
        )
        rows = rows.join(
            newest,
            (rows["contract_no"] == newest[f"_c_{kind}"]) & (rows[kind] == newest[f"_k_{kind}"]),
            "left",
        )
        found.append(F.col(f"_fix_{kind}"))
    fix = F.greatest(*found)
    fixed = F.when(fix.isNotNull(), fix["value"]).otherwise(F.col("prev_index"))
    return rows.select(*[fixed.alias(c) if c == "prev_index" else reading[c] for c in reading.columns])
