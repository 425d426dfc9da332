"""Loads of raw sheets: all-text staging frames to domain tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.fill import forward_fill
from ledgerwork.functions.text import to_day, to_number, whole_text

# Fixed values of the 2023/24 index sheet: staging column and reading date, in month order.
INDEX_MONTHS = [
    ("dec", "2023-12-01"),
    ("jan", "2024-01-01"),
    ("feb", "2024-02-01"),
    ("mar", "2024-03-01"),
    ("apr", "2024-04-01"),
    ("may", "2024-05-01"),
    ("jun", "2024-06-01"),
    ("jul", "2024-07-01"),
    ("aug", "2024-08-01"),
    ("sep", "2024-09-01"),
    ("oct", "2024-10-01"),
]
# Fee column, amount, first month it is charged.
TARIFF = [("mgmt_fee", 10.0, "2024-03-01"), ("loss_fee", 5.0, "2024-07-01")]
# Fixed values of the quarter sheet: month paid and suffix of its three columns.
QUARTER_MONTHS = [("2024-03-01", "mar"), ("2024-04-01", "apr"), ("2024-05-01", "may"), ("2024-06-01", "jun")]
QUARTER_FEES = (10.0, 0.0)
# Fixed values of the membership sheets. The first 256 rows hold the fees of one workbook: pass it as `first_rows`.
OFFICE_ROWS = 256
OFFICE_DATE = "2024-03-01"
PREVIOUS_DATE = "2023-12-31"
NO_RECEIPT = "0"
# Fixed values of the payment sheet. The first 12 rows of one workbook are no payments: pass it as `skip_rows`.
SKIP_ROWS = 12
BAD_AMOUNTS = (-16831.0,)
DATE_MARKS = ["NR", ","]
MIN_RECEIPT_LENGTH = 4


def import_subscribers(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("contract_raw").alias("contract_no"), "name", to_number(F.col("fee_raw")).alias("joining_fee")
    )


def import_index_sheet(
    raw: DataFrame,
    months: Sequence[tuple[str, str]] = INDEX_MONTHS,
    tariff: Sequence[tuple[str, float, str]] = TARIFF,
) -> DataFrame:
    """Wide index sheet to readings; empty cells count as 0 in the whole sheet.

    The previous month of a reading is the next-left cell of its own row, so each row is
    turned into an array of months and exploded: no join, window or shuffle.
    """
    cells = [F.coalesce(to_number(F.col(column)), F.lit(0.0)) for column, _ in months]
    before = [F.lit(None).cast("double"), *cells[:-1]]
    entries = [
        F.struct(
            F.lit(day).cast("date").alias("read_on"),
            index.alias("index_m3"),
            previous.alias("prev_index"),
            *[F.lit(fee if day >= first else 0.0).alias(name) for name, fee, first in tariff],
        )
        for (_, day), index, previous in zip(months, cells, before)
    ]
    return raw.select(
        F.coalesce("contract_raw", F.lit("0")).alias("contract_no"), F.inline(F.array(*entries))
    )


class CleanPayments(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def clean_payments(
    raw: DataFrame,
    fixes: DataFrame | None = None,
    skip_rows: int = 0,
    bad_amounts: Sequence[float] = BAD_AMOUNTS,
    reject_unknown: bool = False,
    partition: Sequence[str] = (),
) -> CleanPayments:
    """Payment sheet to consumption payments; what cannot be loaded is returned with a reason.

    `raw`: row_no, contract_raw, due_raw, settled_raw, receipt_raw, mgmt_raw, loss_raw,
    amount_raw. `fixes`: row_no, settled_raw (a NULL there clears the cell). The month is
    filled down in row order after totals and empty amounts have left and before the bad
    amounts do, so a row of the latter still hands its month on. `partition` keeps the fill
    inside a contract; `reject_unknown` turns away the contract text `nan`.
    """
    rows = _skip_first(raw, skip_rows)
    if fixes is not None:
        cells = fixes.select(F.col("row_no").alias("_fix_row"), F.col("settled_raw").alias("_fix"))
        settled = F.when(F.col("_fix_row").isNotNull(), F.col("_fix")).otherwise(F.col("settled_raw"))
        rows = rows.join(cells, rows["row_no"] == cells["_fix_row"], "left").withColumn("settled_raw", settled)
    receipt_text = F.coalesce("receipt_raw", F.lit("nan"))
    typed = rows.select(
        "row_no",
        F.coalesce("contract_raw", F.lit("nan")).alias("contract_no"),
        F.when(F.length(receipt_text) >= MIN_RECEIPT_LENGTH, receipt_text).alias("receipt_text"),
        to_number(F.col("amount_raw")).alias("amount"),
        to_day(F.col("due_raw")).alias("due_on"),
        to_day(F.col("settled_raw")).alias("settled_on"),
        F.coalesce(to_number(F.col("mgmt_raw")), F.lit(0.0)).alias("mgmt_fee"),
        F.coalesce(to_number(F.col("loss_raw")), F.lit(0.0)).alias("loss_fee"),
    )
    kept = typed.where(~F.col("contract_no").startswith("Total") & (F.col("amount") != 0))
    filled = forward_fill(kept, "due_on", "row_no", partition)
    number = to_number(F.col("receipt_text")).try_cast("long").cast("string")
    receipt = F.when(F.col("receipt_text").isNull(), F.lit(NO_RECEIPT)).otherwise(number)
    reason = F.when(receipt.isNull(), F.lit("receipt is not a number"))
    if reject_unknown:
        reason = F.when(F.col("contract_no") == "nan", F.lit("no contract")).otherwise(reason)
    judged = filled.where(~F.col("amount").isin(list(bad_amounts))).select(
        "row_no",
        "contract_no",
        receipt.alias("receipt_no"),
        "amount",
        "due_on",
        "settled_on",
        "mgmt_fee",
        "loss_fee",
        reason.alias("reason"),
    )
    return CleanPayments(
        judged.where(F.col("reason").isNull()).drop("row_no", "reason"), judged.where(F.col("reason").isNotNull())
    )


def _skip_first(raw: DataFrame, rows: int) -> DataFrame:
    """Drop the first rows by position. The skipped row numbers are at most `rows` many."""
    if not rows:
        return raw
    head = raw.select("row_no").orderBy("row_no").limit(rows)
    return raw.join(F.broadcast(head), "row_no", "left_anti")


def _keep_first(raw: DataFrame, rows: int | None) -> DataFrame:
    if rows is None:
        return raw
    return raw.orderBy("row_no").limit(rows)


def import_wide_payments(
    raw: DataFrame, months: Sequence[tuple[str, str]] = QUARTER_MONTHS, iso_dates: bool = True
) -> DataFrame:
    """Quarter sheet to payments: one row per month whose amount, receipt and date are all present.

    With `iso_dates` a date that does not parse drops the entry; without, the text is kept.
    """
    mgmt, loss = QUARTER_FEES
    entries = [
        F.struct(
            F.col(f"receipt_{month}").alias("receipt_no"),
            to_number(F.regexp_replace(f"amount_{month}", ",", "")).alias("amount"),
            F.lit(day).cast("date").alias("due_on"),
            F.col(f"date_{month}").alias("date_text"),
        )
        for day, month in months
    ]
    long = raw.select("contract_no", F.inline(F.array(*entries)))
    settled = to_day(F.col("date_text")) if iso_dates else F.when(F.col("date_text") != "", F.col("date_text"))
    return (
        long.withColumn("settled_on", settled)
        .where(F.col("amount").isNotNull() & (F.col("receipt_no") != "") & F.col("settled_on").isNotNull())
        .select(
            "contract_no",
            "receipt_no",
            "amount",
            "due_on",
            "settled_on",
            F.lit(mgmt).alias("mgmt_fee"),
            F.lit(loss).alias("loss_fee"),
        )
    )


def import_membership_office(
    raw: DataFrame, default_date: str = OFFICE_DATE, first_rows: int | None = None
) -> DataFrame:
    """Fees taken by the office. A missing amount drops the row, a bad one becomes NULL."""
    rows = _keep_first(raw, first_rows).where(F.col("contract_raw").isNotNull() & F.col("amount_raw").isNotNull())
    paid_on = F.coalesce(to_day(F.col("paid_raw")), F.lit(default_date).cast("date"))
    return rows.select(*_membership(F.col("receipt_raw"), to_number(F.col("amount_raw")), paid_on))


def import_membership_collector(
    raw: DataFrame, date: str = OFFICE_DATE, first_rows: int | None = None
) -> DataFrame:
    """Fees taken by the collector, from the other amount column of the office sheet."""
    rows = _keep_first(raw, first_rows).where(
        F.col("contract_raw").isNotNull() & F.col("collector_amount_raw").isNotNull()
    )
    amount = to_number(F.col("collector_amount_raw"))
    return rows.select(*_membership(F.lit(NO_RECEIPT), amount, F.lit(date).cast("date")))


def import_membership_previous(raw: DataFrame, date: str = PREVIOUS_DATE) -> DataFrame:
    """Fees taken by the previous office. An amount that is no number stops the load."""
    rows = raw.where(F.col("contract_raw").isNotNull())
    amount = F.col("amount_raw").cast("double")
    return rows.select(*_membership(F.lit(NO_RECEIPT), amount, F.lit(date).cast("date")))


def _membership(receipt: Column, amount: Column, paid_on: Column) -> list[Column]:
    return [
        whole_text(F.col("contract_raw")).alias("contract_no"),
        receipt.alias("receipt_no"),
        amount.alias("amount"),
        paid_on.alias("paid_on"),
    ]


def load_memberships(office: DataFrame, collector: DataFrame, previous: DataFrame) -> DataFrame:
    """The whole membership table, to be written with `tables.overwrite`."""
    return office.unionByName(collector).unionByName(previous)


def profile_nulls(df: DataFrame) -> DataFrame:
    """NULL count of every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column_name", "null_count")


def rows_per_contract(raw: DataFrame) -> DataFrame:
    return raw.groupBy("contract_raw").agg(F.count(F.lit(1)).alias("row_count"))


def suspicious_rows(raw: DataFrame) -> DataFrame:
    """Payment-sheet rows worth a look, with the reasons as flags.

    `empty_row` is the meant test (no receipt, no date, no amount), not the precedence slip
    that would keep nearly every row.
    """
    settled = F.col("settled_raw")
    short = F.coalesce(F.length("receipt_raw"), F.lit(3)) < MIN_RECEIPT_LENGTH
    dated = to_day(settled).isNotNull()
    flags = {
        "short_date": F.coalesce(F.length(settled) < MIN_RECEIPT_LENGTH, F.lit(False)),
        "marked_date": F.coalesce(settled.isin(DATE_MARKS), F.lit(False)),
        "short_receipt": short,
        "empty_row": short & ~dated & F.coalesce(to_number(F.col("amount_raw")) == 0, F.lit(False)),
    }
    flagged = raw.select(
        "row_no", "contract_raw", "settled_raw", "receipt_raw", "amount_raw", *[v.alias(k) for k, v in flags.items()]
    )
    return flagged.where(F.col("short_date") | F.col("marked_date") | F.col("short_receipt") | F.col("empty_row"))
