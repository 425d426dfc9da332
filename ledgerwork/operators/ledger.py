"""Bills, payments and what is left to pay.

Row grain: one row per payment of a bill, each with credit against the whole bill.
Net grain (`*_net`): one row per contract and month, payments summed first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.shared import checkpoint
from ledgerwork.functions.skew import SALT_ROWS, left_join_salted
from ledgerwork.functions.text import month_key
from ledgerwork.operators.readings import PRICE_PER_M3

BILL_KEY = ["contract_no", "month"]


def bills(reading: DataFrame, price: float = PRICE_PER_M3) -> DataFrame:
    """One bill per reading. A NULL index or fee gives a NULL total."""
    qty = F.col("index_m3") - F.col("prev_index")
    base = qty * price
    return reading.select(
        "contract_no",
        month_key(F.col("read_on")).alias("month"),
        "read_on",
        "index_m3",
        qty.alias("qty_m3"),
        base.alias("base_amount"),
        "mgmt_fee",
        "loss_fee",
        (base + F.col("mgmt_fee") + F.col("loss_fee")).alias("total"),
    )


def dated_payments(cpay: DataFrame) -> DataFrame:
    """Payments that carry a settlement date, keyed by the month they pay."""
    return cpay.where(F.col("settled_on").isNotNull()).select(
        "contract_no", month_key(F.col("due_on")).alias("month"), "settled_on", "receipt_no", "amount"
    )


def ledger(
    reading: DataFrame,
    cpay: DataFrame,
    price: float = PRICE_PER_M3,
    contracts: Sequence[str] = (),
    salt_rows: int = SALT_ROWS,
    match_null: bool = True,
) -> DataFrame:
    """Bills with their payments; every payment keeps its own row.

    Keys match NULL to NULL, as the original rule has it: every bill without a month or contract
    with every such payment. `match_null=False` leaves those bills without payments.
    `contracts` is applied to both scans, which Spark would not infer from a NULL-safe join.
    """
    if contracts:
        reading, cpay = [df.where(F.col("contract_no").isin(list(contracts))) for df in (reading, cpay)]
    joined = left_join_salted(bills(reading, price), dated_payments(cpay), BILL_KEY, salt_rows, match_null)
    return joined.select(
        "contract_no",
        "month",
        "settled_on",
        "receipt_no",
        "index_m3",
        "qty_m3",
        "base_amount",
        "mgmt_fee",
        "loss_fee",
        "total",
        "amount",
        (F.col("total") - F.coalesce("amount", F.lit(0.0))).alias("credit"),
    )


def filter_ledger(
    df: DataFrame,
    contracts: Sequence[str] = (),
    month: str | None = None,
    receipts: Sequence[str] = (),
    qty: str = "all",
    credit: str = "all",
) -> DataFrame:
    """Ledger rows that meet all given conditions; `qty` and `credit` are all, zero or nonzero."""
    if contracts:
        df = df.where(F.col("contract_no").isin(list(contracts)))
    if month is not None:
        df = df.where(F.col("month") == month)
    if receipts:
        df = df.where(F.col("receipt_no").isin(list(receipts)))
    for column, choice in (("qty_m3", qty), ("credit", credit)):
        if choice == "zero":
            df = df.where(F.col(column) == 0)
        elif choice == "nonzero":
            df = df.where(_not_zero(column))
        elif choice != "all":
            raise ValueError(f"unknown choice {choice!r}")
    return df


def _not_zero(column: str):
    """`!= 0` that also keeps NULL."""
    return (F.col(column) != 0) | F.col(column).isNull()


def unpaid_bills(ledger_rows: DataFrame, contracts: Sequence[str] = ()) -> DataFrame:
    """Row grain: ledger rows with credit left, each with what remains of its bill.

    Rows whose own credit is zero leave before payments are summed, and bills without a
    total or month drop out of the sums. The open rows are checkpointed, as they are both summed and
    returned: the tables are read and joined once, also where the result is used several times.
    """
    open_rows = filter_ledger(ledger_rows, contracts=contracts).where(_not_zero("credit"))
    open_rows = checkpoint(open_rows.select(*BILL_KEY, "index_m3", "qty_m3", "total", "amount"))
    keyed = open_rows.where(
        F.col("contract_no").isNotNull() & F.col("month").isNotNull() & F.col("total").isNotNull()
    )
    remaining = (
        keyed.groupBy("contract_no", "month", "total")
        .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("paid"))
        .select(*BILL_KEY, (F.col("total") - F.col("paid")).alias("remaining"))
        .where(F.col("remaining") != 0)
    )
    return open_rows.join(remaining, BILL_KEY).select(
        *BILL_KEY, "index_m3", "qty_m3", "total", "amount", "remaining"
    )


def unpaid_totals(unpaid: DataFrame) -> DataFrame:
    """Sum of what remains and number of months per contract, on either grain.

    Summed per month first, so a hot contract reaches the second shuffle as one row a month.
    """
    monthly = unpaid.groupBy(*BILL_KEY).agg(F.sum("remaining").alias("remaining"))
    return monthly.groupBy("contract_no").agg(
        F.coalesce(F.sum("remaining"), F.lit(0.0)).alias("credit_total"), F.count("month").alias("months_unpaid")
    )


def monthly_balance(reading: DataFrame, cpay: DataFrame, price: float = PRICE_PER_M3) -> DataFrame:
    """Net grain: per contract and month the summed bill, the summed dated payments, the credit.

    Both sides are aggregated in one pass over their union: one shuffle, no join, and hot
    keys are combined before it. Months with payments but no bill are left out.
    """
    none = F.lit(None).cast("double")
    billed = bills(reading, price).select(
        *BILL_KEY, "qty_m3", "base_amount", "mgmt_fee", "loss_fee", "total", none.alias("paid"), F.lit(1).alias("n")
    )
    paid = dated_payments(cpay).select(
        *BILL_KEY,
        *[none.alias(c) for c in ("qty_m3", "base_amount", "mgmt_fee", "loss_fee", "total")],
        F.col("amount").alias("paid"),
        F.lit(0).alias("n"),
    )
    measures = ("qty_m3", "base_amount", "mgmt_fee", "loss_fee", "total")
    return (
        billed.unionByName(paid)
        .groupBy(*BILL_KEY)
        .agg(
            *[F.sum(c).alias(c) for c in measures],
            F.coalesce(F.sum("paid"), F.lit(0.0)).alias("paid"),
            F.sum("n").alias("n"),
        )
        .where(F.col("n") > 0)
        .select(*BILL_KEY, *measures, "paid", (F.col("total") - F.col("paid")).alias("credit"))
    )


def unpaid_bills_net(reading: DataFrame, cpay: DataFrame, price: float = PRICE_PER_M3) -> DataFrame:
    """Net grain: one row per contract and month that is not settled (or is overpaid) by a cent or more."""
    balance = monthly_balance(reading, cpay, price)
    keyed = balance.where(F.col("contract_no").isNotNull() & F.col("month").isNotNull())
    # sums of cents in doubles differ from zero by less than a cent where a month is settled
    return keyed.where(F.round("credit", 2) != 0).select(
        *BILL_KEY, "qty_m3", "total", "paid", F.col("credit").alias("remaining")
    )
