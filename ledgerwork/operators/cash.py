"""The cash book: every money movement in one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.text import in_days_of, money_text

MEMBERSHIP = "membership"
CONSUMPTION = "consumption"
SUPPLIER = "supplier"
MAINTENANCE = "maintenance"
MATERIAL = "material"
INCOME = [MEMBERSHIP, CONSUMPTION]
BOOK_ORDER = ["moved_on", "reason", "id", "debit", "credit"]


def cash_book(
    mpay: DataFrame,
    cpay: DataFrame,
    spay: DataFrame,
    job: DataFrame,
    purchase: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """Union of the five sources with income as debit and spending as credit, by date.

    Filters on date and reason reach the five scans: the reason is a constant per branch.
    """
    none = F.lit(None).cast("double")
    movements = [
        _movement(mpay, "contract_no", "paid_on", MEMBERSHIP, F.col("amount"), none, none),
        _movement(
            cpay, "contract_no", "settled_on", CONSUMPTION, F.col("amount"), F.col("mgmt_fee"), F.col("loss_fee")
        ),
        _movement(spay, "payment_id", "paid_on", SUPPLIER, F.col("amount"), none, none),
        _movement(job, "job_id", "done_on", MAINTENANCE, F.col("worker_pay"), none, none),
        _movement(
            purchase, "purchase_id", "bought_on", MATERIAL, F.abs(F.col("qty") * F.col("unit_price")), none, none
        ),
    ]
    book = reduce(DataFrame.unionByName, movements)
    return book.orderBy(*BOOK_ORDER) if ordered else book


def _movement(
    df: DataFrame, id_column: str, day: str, reason: str, amount: Column, mgmt: Column, loss: Column
) -> DataFrame:
    none = F.lit(None).cast("double")
    debit, credit = (amount, none) if reason in INCOME else (none, F.abs(amount))
    return df.select(
        F.col(id_column).cast("string").alias("id"),
        F.col(day).alias("moved_on"),
        F.lit(reason).alias("reason"),
        mgmt.alias("mgmt_fee"),
        loss.alias("loss_fee"),
        debit.alias("debit"),
        credit.alias("credit"),
    )


def cash_totals(book: DataFrame) -> DataFrame:
    """Fees, income without fees, spending and balance; one row, zeros for an empty book."""
    zero = F.lit(0.0)
    net = F.col("debit") - F.coalesce("mgmt_fee", zero) - F.coalesce("loss_fee", zero)
    sums = book.agg(
        F.coalesce(F.sum("mgmt_fee"), zero).alias("mgmt_total"),
        F.coalesce(F.sum("loss_fee"), zero).alias("loss_total"),
        F.coalesce(F.sum(net), zero).alias("debit_total"),
        F.coalesce(F.sum("credit"), zero).alias("credit_total"),
    )
    balance = F.col("debit_total") + F.col("mgmt_total") + F.col("loss_total") - F.col("credit_total")
    return sums.withColumn("balance", balance)


def cash_totals_text(totals: DataFrame) -> DataFrame:
    """The totals as display text."""
    return totals.select(*[money_text(F.col(c)).alias(c) for c in totals.columns])


def filter_cash(book: DataFrame, year: int, month: int | None = None, reason: str | None = None) -> DataFrame:
    """Movements of a year, optionally one month and one reason.

    The day range is a plain comparison, so the scans can skip row groups by it.
    """
    book = book.where(in_days_of(F.col("moved_on"), year, month))
    return book if reason is None else book.where(F.col("reason") == reason)


def cash_years(book: DataFrame) -> DataFrame:
    """The years to choose from, sorted."""
    return book.select(F.year("moved_on").alias("year")).distinct().orderBy("year")


def cash_reasons(book: DataFrame) -> DataFrame:
    return book.select("reason").distinct()
