"""Monthly amounts and consumption series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.operators.ledger import monthly_balance
from ledgerwork.operators.readings import PRICE_PER_M3

AMOUNTS = ["base_amount", "mgmt_fee", "loss_fee", "paid", "credit"]


def _label(month: Column) -> Column:
    """`2024-03` to `03-2024`."""
    return F.concat(F.substring(month, 6, 2), F.lit("-"), F.substring(month, 1, 4))


def _sum_by_month(df: DataFrame, key: Column) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in AMOUNTS]
    grouped = df.where(F.col("month").isNotNull()).groupBy(key).agg(*sums)
    return grouped.withColumn("due", F.col("base_amount") + F.col("mgmt_fee") + F.col("loss_fee"))


def monthly_amounts(ledger_rows: DataFrame) -> DataFrame:
    """Row grain, by display month: a bill counts once per payment, sorted by month number."""
    paid = ledger_rows.withColumn("paid", F.col("amount"))
    return _sum_by_month(paid, _label(F.col("month")).alias("month_label")).orderBy("month_label")


def monthly_amounts_net(reading: DataFrame, cpay: DataFrame, price: float = PRICE_PER_M3) -> DataFrame:
    """Net grain, in time order. Only payments of a billed month count."""
    return _sum_by_month(monthly_balance(reading, cpay, price), F.col("month")).orderBy("month")


def usage_series(ledger_rows: DataFrame, contracts: Sequence[str] = ()) -> DataFrame:
    """Consumption per contract and month; repeated ledger rows add up, as stacked bars do."""
    if contracts:
        ledger_rows = ledger_rows.where(F.col("contract_no").isin(list(contracts)))
    return ledger_rows.groupBy("contract_no", _label(F.col("month")).alias("month_label")).agg(
        F.coalesce(F.sum("qty_m3"), F.lit(0.0)).alias("qty_m3")
    )


def contracts(reading: DataFrame) -> DataFrame:
    return reading.select("contract_no").distinct()
