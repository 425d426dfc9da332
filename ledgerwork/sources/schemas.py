"""Schemas of the twelve domain tables."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"str": StringType(), "dbl": DoubleType(), "long": LongType(), "date": DateType()}


def _table(columns: str) -> StructType:
    """`"name type, name type!"`; `!` marks a required column."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        fields.append(StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return StructType(fields)


SCHEMAS = {
    "subscriber": _table(
        "contract_no str!, id_card str, block_no str, meter_no str, name str!, joining_fee dbl, joined_on date, address str"
    ),
    "membership_payment": _table("contract_no str, receipt_no str, amount dbl, paid_on date"),
    "meter_reading": _table(
        "contract_no str, read_on date, index_m3 dbl, prev_index dbl, mgmt_fee dbl, loss_fee dbl"
    ),
    "consumption_payment": _table(
        "contract_no str, receipt_no str, amount dbl, due_on date, settled_on date, mgmt_fee dbl, loss_fee dbl"
    ),
    "purchase": _table(
        "purchase_id long, product str, bought_on date, qty dbl, unit_price dbl, amount dbl, receipt_no str, vendor str"
    ),
    "product": _table("product str!"),
    "product_use": _table("use_id long, product str, used_on date, qty dbl, note str"),
    "supplier_payment": _table("payment_id long, month date!, amount dbl!, receipt_no str!, paid_on date!"),
    "supplier_bill": _table("bill_id long, month date!, index_m3 dbl, amount_due dbl!, invoice_no str"),
    "maintenance": _table("job_id long, done_on date!, note str, worker str, worker_pay dbl"),
    "maintenance_detail": _table("detail_id long, job_id long, product str, qty dbl!"),
    "block_reading": _table("block_no str, index_m3 dbl!, read_on date"),
}
