"""Subscribers and their membership fees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.text import to_day


def _with_credit(sub: DataFrame, mpay: DataFrame) -> DataFrame:
    """Fee less payments. Payments are summed per contract before the join."""
    paid = mpay.groupBy("contract_no").agg(F.sum("amount").alias("_paid"))
    credit = F.coalesce(F.col("joining_fee") - F.col("_paid"), F.col("joining_fee"))
    return sub.join(paid, "contract_no", "left").withColumn("credit", credit)


def subscriber_credit(sub: DataFrame, mpay: DataFrame, ordered: bool = True) -> DataFrame:
    """All subscribers with the fee still owed, sorted by contract number as text."""
    listed = _with_credit(sub, mpay).select(
        "contract_no", "block_no", "meter_no", "name", "joining_fee", "credit", "joined_on", "address"
    )
    return listed.orderBy("contract_no") if ordered else listed


def filter_subscribers(
    df: DataFrame, contracts: Sequence[str] = (), blocks: Sequence[str] = (), credit: str = "all"
) -> DataFrame:
    """`credit` is all, zero or positive; a NULL credit passes neither of the last two."""
    if contracts:
        df = df.where(F.col("contract_no").isin(list(contracts)))
    if blocks:
        df = df.where(F.col("block_no").isin(list(blocks)))
    if credit == "zero":
        return df.where(F.col("credit") == 0)
    if credit == "positive":
        return df.where(F.col("credit") > 0)
    if credit != "all":
        raise ValueError(f"unknown choice {credit!r}")
    return df


def membership_credit(sub: DataFrame, mpay: DataFrame, contracts: Sequence[str] = ()) -> DataFrame:
    """Short form; with `contracts`, the name and credit of these only."""
    if contracts:
        sub = sub.where(F.col("contract_no").isin(list(contracts)))
    return _with_credit(sub, mpay).select("contract_no", "name", "joining_fee", "credit")


def membership_history(mpay: DataFrame, contracts: Sequence[str] = ()) -> DataFrame:
    """Payments of the given contracts; a date that does not parse becomes NULL."""
    if contracts:
        mpay = mpay.where(F.col("contract_no").isin(list(contracts)))
    paid_on = F.col("paid_on") if dict(mpay.dtypes)["paid_on"] == "date" else to_day(F.col("paid_on"))
    return mpay.select("contract_no", "receipt_no", "amount", paid_on.alias("paid_on"))
