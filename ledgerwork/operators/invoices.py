"""Invoice rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.operators.readings import PRICE_PER_M3

# Fixed values printed on every invoice.
INVOICE_MGMT_FEE = 10.0
INVOICE_LOSS_FEE = 5.0


def invoices(unpaid: DataFrame, membership: DataFrame, requests: DataFrame, price: float = PRICE_PER_M3) -> DataFrame:
    """One row per request (contract_no, month, invoice_date, membership_to_pay, consumption_to_pay).

    The month's amount adds the fixed fees whatever the bill itself charged, and sums the
    quantity over the unpaid rows of that month. A contract that is up to date has no open sum.
    """
    monthly = unpaid.groupBy("contract_no", "month").agg(
        F.sum("remaining").alias("remaining"), F.sum("qty_m3").alias("qty_m3")
    )
    # one row per contract, so that `unpaid` is computed once; the map holds one entry per month
    per_contract = monthly.groupBy("contract_no").agg(
        F.sum("remaining").alias("consumption_credit"),
        F.map_from_entries(F.collect_list(F.struct("month", "qty_m3"))).alias("_used"),
    )
    people = membership.select("contract_no", "name", F.col("credit").alias("membership_credit"))
    zero = F.lit(0.0)
    rows = (
        requests.join(people, "contract_no")
        .join(per_contract, "contract_no", "left")
        .withColumn("consumption_credit", F.coalesce("consumption_credit", zero))
        .withColumn("qty_m3", F.coalesce(F.try_element_at("_used", F.col("month")), zero))
    )
    fees = INVOICE_MGMT_FEE + INVOICE_LOSS_FEE
    return rows.select(
        "contract_no",
        "name",
        "invoice_date",
        "month",
        F.round("membership_credit", 2).alias("membership_credit"),
        F.round("membership_to_pay", 2).alias("membership_to_pay"),
        F.round("consumption_credit", 2).alias("consumption_credit"),
        F.round("consumption_to_pay", 2).alias("consumption_to_pay"),
        F.round(F.col("membership_credit") + F.col("consumption_credit"), 2).alias("credit_total"),
        F.round(F.col("membership_to_pay") + F.col("consumption_to_pay"), 2).alias("to_pay_total"),
        "qty_m3",
        F.lit(INVOICE_MGMT_FEE).alias("mgmt_fee"),
        F.lit(INVOICE_LOSS_FEE).alias("loss_fee"),
        F.round(F.col("qty_m3") * price + fees, 2).alias("amount_due"),
        F.concat(F.lit("facture_"), "contract_no", F.lit("_"), "month").alias("file_name"),
    )
