"""The bulk supplier's account: monthly bills and the payments against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.skew import SALT_ROWS, left_join_salted
from ledgerwork.functions.text import month_name


def supplier_account(bill: DataFrame, payment: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per payment of a bill's month, each against the whole bill."""
    owed = bill.select("month", "index_m3", "amount_due", "invoice_no")
    # a NULL month pays no bill
    paid = payment.where(F.col("month").isNotNull()).select("month", "paid_on", "receipt_no", "amount")
    joined = left_join_salted(owed, paid, ["month"], salt_rows)
    return joined.select(
        "month",
        month_name(F.col("month")).alias("month_name"),
        "index_m3",
        "amount_due",
        "invoice_no",
        "paid_on",
        "receipt_no",
        (F.col("amount_due") - F.coalesce("amount", F.lit(0.0))).alias("credit"),
    )


def supplier_totals(account: DataFrame) -> DataFrame:
    """Total credit, and rows without a receipt as months not paid."""
    return account.agg(
        F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit_total"),
        F.count_if(F.col("receipt_no").isNull()).alias("months_unpaid"),
    )


def supplier_account_net(bill: DataFrame, payment: DataFrame) -> DataFrame:
    """One row per month: bills and payments summed first, in one pass over their union."""
    none = F.lit(None).cast("double")
    owed = bill.select("month", "amount_due", none.alias("paid"), F.lit(1).alias("n"))
    paid = payment.select("month", none.alias("amount_due"), F.col("amount").alias("paid"), F.lit(0).alias("n"))
    return (
        owed.unionByName(paid)
        .groupBy("month")
        .agg(
            F.sum("amount_due").alias("amount_due"),
            F.coalesce(F.sum("paid"), F.lit(0.0)).alias("paid"),
            F.sum("n").alias("n"),
        )
        .where(F.col("n") > 0)
        .select("month", "amount_due", "paid", (F.col("amount_due") - F.col("paid")).alias("credit"))
    )
