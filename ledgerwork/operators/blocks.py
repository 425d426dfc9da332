"""Block meters against the subscriber meters behind them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.text import in_days_of, month_label
from ledgerwork.operators.readings import previous_index


class BlockCheck(NamedTuple):
    blocks: DataFrame
    subscribers: DataFrame


def block_check(
    block_reading: DataFrame,
    reading: DataFrame,
    sub: DataFrame,
    blocks: Sequence[str] = (),
    month: str | None = None,
    lag_first: bool = False,
) -> BlockCheck:
    """Block rows and subscriber rows of the chosen blocks and month (`07-2024`).

    The month is filtered before the usage is taken from the index, so that with a month the
    whole index counts as usage; `lag_first=True` takes the usage over all months first.
    Spark moves only key filters through a window, so the two placements stay distinct.
    """
    behind = sub.select("contract_no", "name", "block_no").join(
        reading.select("contract_no", "read_on", "index_m3"), "contract_no"
    )
    in_blocks = F.col("block_no").isin(list(blocks)) if blocks else F.lit(True)
    in_month = in_days_of(F.col("read_on"), int(month[3:]), int(month[:2])) if month else F.lit(True)
    before, after = (F.lit(True), in_month) if lag_first else (in_month, F.lit(True))

    def usage(df: DataFrame, key: str) -> DataFrame:
        used = F.col("index_m3") - F.coalesce("_previous", F.lit(0.0))
        rows = previous_index(df.where(in_blocks).where(before), key).where(after)
        return rows.withColumn("usage_m3", used).withColumn("month_label", month_label(F.col("read_on")))

    return BlockCheck(
        usage(block_reading, "block_no").select("block_no", "month_label", "index_m3", "usage_m3"),
        usage(behind, "contract_no").select(
            "contract_no", "name", "block_no", "month_label", "index_m3", "usage_m3"
        ),
    )


def block_check_totals(check: BlockCheck) -> DataFrame:
    """Per block: the sum of the block meter's indexes and of the subscribers' usage, 0 if none."""
    return _side_by_side(check, ["block_no"], "index_m3", "block_index_m3")


def block_gap(block_reading: DataFrame, reading: DataFrame, sub: DataFrame) -> DataFrame:
    """Per block and month: block usage, subscriber usage and the difference."""
    check = block_check(block_reading, reading, sub)
    sides = _side_by_side(check, ["block_no", "month_label"], "usage_m3", "block_usage_m3")
    return sides.withColumn("gap_m3", F.col("block_usage_m3") - F.col("subscriber_usage_m3"))


def _side_by_side(check: BlockCheck, keys: list[str], block_measure: str, name: str) -> DataFrame:
    none = F.lit(None).cast("double")
    both = check.blocks.select(*keys, F.col(block_measure).alias(name), none.alias("subscriber_usage_m3")).unionByName(
        check.subscribers.select(*keys, none.alias(name), F.col("usage_m3").alias("subscriber_usage_m3"))
    )
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in (name, "subscriber_usage_m3")]
    return both.groupBy(*keys).agg(*sums)
