"""The registered queries: each job over the whole domain tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwork.functions import allowed
from ledgerwork.functions.fill import forward_fill
from ledgerwork.functions.shared import use_checkpoint_folder
from ledgerwork.functions.text import to_number
from ledgerwork.operators import analytics, blocks, cash, checks, imports, invoices, ledger, maintenance, members, readings, stock, supplier
from ledgerwork.plans.mapping import SHEET_MONTHS, Tables
from ledgerwork.sources import defaults, sheets, tables

Job = Callable[[Tables], DataFrame]


def _ledger(t: Tables) -> DataFrame:
    return ledger.ledger(t.meter_reading, t.consumption_payment)


def _unpaid(t: Tables) -> DataFrame:
    return ledger.unpaid_bills(_ledger(t))


def _unpaid_net(t: Tables) -> DataFrame:
    return ledger.unpaid_bills_net(t.meter_reading, t.consumption_payment)


def _credit(t: Tables) -> DataFrame:
    return members.subscriber_credit(t.subscriber, t.membership_payment, ordered=False)


def _block_check(t: Tables, month: str | None = None, lag_first: bool = False) -> blocks.BlockCheck:
    return blocks.block_check(t.block_reading, t.meter_reading, t.subscriber, month=month, lag_first=lag_first)


def _both_sides(check: blocks.BlockCheck) -> DataFrame:
    columns = ["side", "contract_no", "block_no", "month_label", "index_m3", "usage_m3"]
    block = check.blocks.select("*", F.lit("block").alias("side"), F.lit(None).cast("string").alias("contract_no"))
    subscriber = check.subscribers.withColumn("side", F.lit("subscriber"))
    return block.select(*columns).unionByName(subscriber.select(*columns))


def _account(t: Tables) -> DataFrame:
    return supplier.supplier_account(t.supplier_bill, t.supplier_payment)


def _book(t: Tables, ordered: bool = False) -> DataFrame:
    return cash.cash_book(
        t.membership_payment, t.consumption_payment, t.supplier_payment, t.maintenance, t.purchase, ordered
    )


def _invoices(t: Tables) -> DataFrame:
    """One request per contract with unpaid bills: its earliest month, half of each credit to pay."""
    unpaid = _unpaid(t)
    membership = members.membership_credit(t.subscriber, t.membership_payment)
    open_sums = unpaid.groupBy("contract_no").agg(F.min("month").alias("month"), F.sum("remaining").alias("_open"))
    requests = open_sums.join(membership.select("contract_no", "credit"), "contract_no").select(
        "contract_no",
        "month",
        F.lit("2024-12-31").cast("date").alias("invoice_date"),
        (F.col("credit") / 2).alias("membership_to_pay"),
        (F.col("_open") / 2).alias("consumption_to_pay"),
    )
    return invoices.invoices(unpaid, membership, requests)


def _check_subscribers(t: Tables) -> DataFrame:
    existing = t.subscriber.where(F.col("contract_no").cast("long") % 2 == 0)
    checked = checks.check_subscribers(t.subscriber_batch, existing)
    return checked.judged.select("submitted_seq", "contract_no", "name", "joining_fee", "reason")


def _check_membership_payments(t: Tables) -> DataFrame:
    return checks.check_membership_payments(t.membership_batch, t.subscriber, t.paid_before).judged


def _check_consumption_payments(t: Tables) -> DataFrame:
    receipts = allowed.intervals(t.spark)
    return checks.check_consumption_payments(t.payment_batch, t.subscriber, receipts).judged


def _check_purchases(t: Tables) -> DataFrame:
    key = F.col("purchase_id")
    batch = t.purchase.withColumn("qty", F.when(key % 7 == 0, 0.0).otherwise(F.col("qty"))).withColumn(
        "vendor", F.when(key % 9 == 0, "").otherwise(F.col("vendor"))
    )
    # every 13th purchase names a product that is not on the list
    name = F.when(key % 13 == 0, F.concat(F.lit("odd "), "product")).otherwise(F.col("product"))
    return checks.check_purchases(batch.withColumn("product", name).drop("purchase_id"), t.product).judged


def _check_uses(t: Tables) -> DataFrame:
    key = F.col("product").cast("long")
    batch = t.product_use.withColumn("qty", F.when(key % 7 == 0, 0.0).otherwise(F.col("qty"))).withColumn(
        "note", F.when(key % 11 == 0, "").otherwise(F.col("note"))
    )
    name = F.when(key % 13 == 0, F.concat(F.lit("odd "), "product")).otherwise(F.col("product"))
    return checks.check_uses(batch.withColumn("product", name), t.product).judged


def _split_maintenance(t: Tables) -> checks.MaintenanceSplit:
    batch = t.maintenance.withColumnRenamed("job_id", "submitted_seq")
    lines = t.maintenance_detail.withColumnRenamed("job_id", "submitted_seq")
    product = t.product.where(~F.col("product").isin("7", "77"))
    return checks.split_maintenance(batch, lines, max_job_id=1000, max_detail_id=5000, product=product)


def _check_supplier_bills(t: Tables) -> DataFrame:
    empty = F.when(F.month("month") % 5 == 0, 0.0).otherwise(F.col("amount_due"))
    return checks.check_supplier_bills(t.supplier_bill.withColumn("amount_due", empty)).judged


def _check_supplier_payments(t: Tables) -> DataFrame:
    empty = F.when(F.month("month") % 7 == 0, "").otherwise(F.col("receipt_no"))
    batch = t.supplier_payment.withColumn("receipt_no", empty)
    return checks.check_supplier_payments(batch.drop("payment_id")).judged


def _office(t: Tables) -> DataFrame:
    return imports.import_membership_office(t.raw_membership)


def _collector(t: Tables) -> DataFrame:
    return imports.import_membership_collector(t.raw_membership)


def _filled(t: Tables, *partition: str) -> DataFrame:
    sheet = t.raw_payment.select("row_no", "contract_raw", F.to_date("due_raw").alias("due_on"))
    return forward_fill(sheet, "due_on", "row_no", partition)


def _folder(t: Tables, name: str) -> str:
    return f"{use_checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _payment_sheet_files(t: Tables) -> DataFrame:
    """The payment sheet as several CSV files with the source's headers, read as one sheet."""
    folder = _folder(t, "sheet")
    headers = {staged: header for header, staged in sheets.SHEETS["payments"].items()}
    ordered = t.raw_payment.repartitionByRange(4, "row_no").sortWithinPartitions("row_no")
    ordered.select(*[F.col(c).alias(h) for c, h in headers.items()]).write.option("header", True).option("escape", '"').csv(folder)
    sheet = sheets.read_sheet(t.spark, folder, "payments")
    texts = ("row_no", "contract_raw", "due_raw", "settled_raw", "receipt_raw")
    return sheet.select(*texts, to_number(F.col("amount_raw")).alias("amount"))


def _table_round_trip(t: Tables) -> DataFrame:
    """Last readings of a table by months: load, append copies, delete the older ones, load one year anew."""
    folder, year = _folder(t, "meter_reading"), F.year("read_on")
    copies = t.meter_reading.withColumn("contract_no", F.concat(F.lit("X"), "contract_no"))
    tables.load_months(t.meter_reading, folder, "meter_reading", "read_on")
    tables.append_months(copies, folder, "meter_reading", "read_on")
    tables.delete_rows(t.spark, folder, "meter_reading", F.col("contract_no").startswith("X") & (year < 1999))
    corrected = t.meter_reading.where(year == 1997).withColumn("index_m3", F.col("index_m3") + 1)
    tables.load_months(corrected, folder, "meter_reading", "read_on")
    stored = tables.load_table(t.spark, folder, "meter_reading")
    return stored.groupBy("contract_no").agg(
        F.count(F.lit(1)).alias("n_readings"), F.sum("index_m3").alias("index_sum"), F.max("read_on").alias("last_read_on")
    )


def _invoice_files(t: Tables) -> DataFrame:
    """The invoices as written, a folder for each month."""
    folder = _folder(t, "invoices")
    tables.write_invoices(_invoices(t), folder)
    return t.spark.read.parquet(folder).withColumn("month", F.col("month").cast("string"))


def _strict_reading_load(t: Tables) -> DataFrame:
    """Readings whose dates are text, loaded by the strict parse and read back."""
    folder = _folder(t, "meter_reading")
    raw = t.meter_reading.withColumn("read_on", F.date_format("read_on", "yyyy-M-d"))
    tables.strict_days(raw, folder, "meter_reading", ["read_on"], "contract_no")
    return tables.load_table(t.spark, folder, "meter_reading")


def _table_copies(t: Tables) -> DataFrame:
    """Payments with a fee column added, copied without their dates, and summed through a view."""
    folder, view = _folder(t, "payments"), f"payments_{uuid.uuid4().hex}"
    wider = tables.with_column_default(t.consumption_payment.drop("loss_fee"), "loss_fee", "double", 5.0)
    tables.copy_columns(wider, ["contract_no", "receipt_no", "amount", "mgmt_fee", "loss_fee"], folder)
    tables.save_view(t.spark.read.parquet(folder), view)
    sums = t.spark.sql(
        f"SELECT contract_no, count(*) AS payments, sum(amount) AS amount, sum(mgmt_fee + loss_fee) AS fees FROM {view} GROUP BY contract_no"
    )
    tables.drop_view(t.spark, view)
    return sums


def _stock_of_known_products(t: Tables) -> DataFrame:
    """Stock of the known product list; a part counts as one of its products."""
    names = F.array(*[F.lit(name) for name in defaults.PRODUCTS])
    place = (F.col("product").cast("long") % len(defaults.PRODUCTS) + 1).cast("int")
    bought, used = [df.withColumn("product", F.element_at(names, place)) for df in (t.purchase, t.product_use)]
    return stock.stock_on_hand(defaults.products(t.spark), bought, used)


def _supplier_totals_early(t: Tables) -> DataFrame:
    """The totals of an account that has no month yet."""
    return supplier.supplier_totals(_account(t).where(F.col("month") < F.lit("1990-01-01").cast("date")))


SOME_CONTRACTS = ["4", "7", "10", "13", "100", "1000"]


JOBS: dict[str, Job] = {
    "bills": lambda t: ledger.bills(t.meter_reading),
    "dated_payments": lambda t: ledger.dated_payments(t.consumption_payment),
    "ledger": _ledger,
    "ledger_filtered": lambda t: ledger.filter_ledger(_ledger(t), month="1998-10", qty="nonzero", credit="nonzero"),
    "unpaid_bills": _unpaid,
    "unpaid_totals": lambda t: ledger.unpaid_totals(_unpaid(t)),
    "unpaid_bills_net": _unpaid_net,
    "unpaid_totals_net": lambda t: ledger.unpaid_totals(_unpaid_net(t)),
    "subscriber_credit": lambda t: members.subscriber_credit(t.subscriber, t.membership_payment),
    "subscribers_filtered": lambda t: members.filter_subscribers(_credit(t), blocks=["3", "4", "5"], credit="positive"),
    "membership_credit": lambda t: members.membership_credit(t.subscriber, t.membership_payment),
    "membership_history": lambda t: members.membership_history(t.membership_payment),
    "last_reading": lambda t: readings.last_reading(t.meter_reading),
    "last_block_reading": lambda t: readings.last_block_reading(t.block_reading),
    "block_usage": lambda t: readings.block_usage(t.block_reading),
    "usage_by_lag": lambda t: readings.usage_by_lag(t.meter_reading),
    "block_check_month": lambda t: _both_sides(_block_check(t, "07-1997")),
    "block_check_all": lambda t: _both_sides(_block_check(t)),
    "block_check_lag_first": lambda t: _both_sides(_block_check(t, "07-1997", lag_first=True)),
    "block_check_totals": lambda t: blocks.block_check_totals(_block_check(t)),
    "block_gap": lambda t: blocks.block_gap(t.block_reading, t.meter_reading, t.subscriber),
    "stock_fanout": lambda t: stock.stock_fanout(t.product, t.purchase, t.product_use),
    "stock_on_hand": lambda t: stock.stock_on_hand(t.product, t.purchase, t.product_use),
    "stock_with_maintenance": lambda t: stock.stock_on_hand(t.product, t.purchase, t.product_use, t.maintenance_detail),
    "purchase_history": lambda t: stock.purchase_history(t.purchase),
    "use_history": lambda t: stock.use_history(t.product_use),
    "supplier_account": _account,
    "supplier_totals": lambda t: supplier.supplier_totals(_account(t)),
    "supplier_account_net": lambda t: supplier.supplier_account_net(t.supplier_bill, t.supplier_payment),
    "maintenance_history": lambda t: maintenance.maintenance_history(t.maintenance, t.maintenance_detail, 7),
    "maintenance_history_year": lambda t: maintenance.maintenance_history(t.maintenance, t.maintenance_detail, 7, 1998),
    "cash_book": lambda t: _book(t, ordered=True),
    "cash_totals": lambda t: cash.cash_totals(_book(t)),
    "cash_totals_text": lambda t: cash.cash_totals_text(cash.cash_totals(_book(t))),
    "cash_filtered": lambda t: cash.filter_cash(_book(t), 1997, 7),
    "cash_filtered_totals": lambda t: cash.cash_totals(cash.filter_cash(_book(t), 1997, reason=cash.CONSUMPTION)),
    "cash_years": lambda t: cash.cash_years(_book(t)),
    "cash_reasons": lambda t: cash.cash_reasons(_book(t)),
    "monthly_amounts": lambda t: analytics.monthly_amounts(_ledger(t)),
    "monthly_amounts_net": lambda t: analytics.monthly_amounts_net(t.meter_reading, t.consumption_payment),
    "usage_series": lambda t: analytics.usage_series(_ledger(t)),
    "contracts": lambda t: analytics.contracts(t.meter_reading),
    "invoices": _invoices,
    "import_subscribers": lambda t: imports.import_subscribers(t.raw_subscriber),
    "import_index_sheet": lambda t: imports.import_index_sheet(t.index_sheet, [*imports.INDEX_MONTHS, ("nov", "2024-11-01")]),
    "backfill_prev_index": lambda t: readings.backfill_prev_index(t.meter_reading),
    "apply_corrections": lambda t: readings.apply_corrections(t.meter_reading, t.reading_fixes),
    "clean_payments": lambda t: imports.clean_payments(t.raw_payment, t.payment_fixes).accepted,
    "forward_fill": lambda t: _filled(t),
    "forward_fill_by_contract": lambda t: _filled(t, "contract_raw"),
    "import_wide_payments": lambda t: imports.import_wide_payments(
        t.wide_payment, [(f"2024-{number:02d}-01", name) for number, name in enumerate(SHEET_MONTHS, 1)]
    ),
    "ledger_contracts": lambda t: ledger.ledger(t.meter_reading, t.consumption_payment, contracts=SOME_CONTRACTS),
    "ledger_receipts": lambda t: ledger.filter_ledger(_ledger(t), receipts=[str(n) for n in range(1, 2001)], qty="nonzero"),
    "unpaid_bills_contracts": lambda t: ledger.unpaid_bills(_ledger(t), contracts=SOME_CONTRACTS),
    "subscribers_settled": lambda t: members.filter_subscribers(_credit(t), credit="zero"),
    "subscribers_chosen": lambda t: members.filter_subscribers(_credit(t), contracts=SOME_CONTRACTS),
    "membership_history_text": lambda t: members.membership_history(
        t.membership_payment.withColumn("paid_on", F.date_format("paid_on", "yyyy-MM-dd"))
    ),
    "import_membership_first": lambda t: imports.import_membership_office(t.raw_membership, first_rows=imports.OFFICE_ROWS),
    "stock_of_known_products": _stock_of_known_products,
    "supplier_totals_early": _supplier_totals_early,
    "strict_reading_load": _strict_reading_load,
    "table_copies": _table_copies,
    "payment_sheet_files": _payment_sheet_files,
    "table_round_trip": _table_round_trip,
    "invoice_files": _invoice_files,
    "import_membership_office": _office,
    "import_membership_collector": _collector,
    "import_membership_previous": lambda t: imports.import_membership_previous(t.raw_previous),
    "load_memberships": lambda t: imports.load_memberships(
        _office(t), _collector(t), imports.import_membership_previous(t.raw_previous)
    ),
    "profile_nulls": lambda t: imports.profile_nulls(t.raw_payment),
    "rows_per_contract": lambda t: imports.rows_per_contract(t.raw_payment),
    "suspicious_rows": lambda t: imports.suspicious_rows(t.raw_payment)
    .withColumn("amount", F.col("amount_raw").cast("double"))
    .drop("amount_raw"),
    "check_subscribers": _check_subscribers,
    "check_readings": lambda t: checks.check_readings(t.reading_batch, t.older_reading, t.known_contract).judged,
    "check_membership_payments": _check_membership_payments,
    "check_consumption_payments": _check_consumption_payments,
    "check_block_readings": lambda t: checks.check_block_readings(t.block_reading).judged,
    "check_purchases": _check_purchases,
    "check_uses": _check_uses,
    "split_maintenance_jobs": lambda t: _split_maintenance(t).jobs,
    "split_maintenance_items": lambda t: _split_maintenance(t).items,
    "split_maintenance_rejected": lambda t: _split_maintenance(t).rejected,
    "check_supplier_bills": _check_supplier_bills,
    "check_supplier_payments": _check_supplier_payments,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(job: Job) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: job(Tables(spark, folder))

    return {name: bind(job) for name, job in JOBS.items()}
