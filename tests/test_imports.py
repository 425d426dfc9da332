"""Sheets, tables and batch checks."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerwork.operators import checks, imports
from ledgerwork.sources import sheets, tables
from ledgerwork.sources.schemas import SCHEMAS

D = date.fromisoformat
PAYMENT_SHEET = "row_no long, contract_raw string, due_raw string, settled_raw string, receipt_raw string, mgmt_raw string, loss_raw string, amount_raw string"


def payment_sheet(spark):
    rows = [
        (1, "1", "2023-01-01", "2024-01-05", "1111.0", "10", "5", "50"),  # skipped by position
        (5, "1", "2024-01-01 00:00:00", "2024-01-05", "1234.0", "10", None, "50"),
        (6, "1", None, "NR", "12", None, "5", "20"),  # month from above, short receipt
        (7, "Total du mois", "2024-09-01", None, "9999", None, None, "70"),
        (8, "2", "2024-02-01", ",", "nan", "10", "5", None),  # no amount: leaves before the fill
        (9, "2", None, "2024-11-4", None, "10", "5", "30"),  # month carried over from contract 1
        (10, "2", "2024-03-01", "2024-03-09", "ABCD", "10", "5", "-16831.0"),  # hands its month on
        (11, "2", None, "", "ABCD", "10", "5", "40"),
        (12, None, "2024-04-01", "2024-04-31", "4321", "10", "5", "0"),
        (13, None, "2024-04-01", "2024-04-31", "4321", "10", "5", "1"),
    ]
    return spark.createDataFrame(rows, PAYMENT_SHEET)


def test_clean_payments(spark):
    clean = imports.clean_payments(payment_sheet(spark), skip_rows=1)
    got = [tuple(r) for r in clean.accepted.orderBy("amount").collect()]
    assert got == [
        ("nan", "4321", 1.0, D("2024-04-01"), None, 10.0, 5.0),
        ("1", "0", 20.0, D("2024-01-01"), None, 0.0, 5.0),
        ("2", "0", 30.0, D("2024-01-01"), D("2024-11-04"), 10.0, 5.0),
        ("1", "1234", 50.0, D("2024-01-01"), D("2024-01-05"), 10.0, 0.0),
    ]
    rejected = clean.rejected.collect()
    assert [(r.amount, r.due_on, r.reason) for r in rejected] == [(40.0, D("2024-03-01"), "receipt is not a number")]


def test_clean_payments_options(spark):
    fixes = spark.createDataFrame([(6, "2024-11-4"), (5, None)], "row_no long, settled_raw string")
    clean = imports.clean_payments(payment_sheet(spark), fixes, 1, reject_unknown=True, partition=["contract_no"])
    got = {r.amount: (r.due_on, r.settled_on) for r in clean.accepted.collect()}
    assert got == {20.0: (D("2024-01-01"), D("2024-11-04")), 30.0: (None, D("2024-11-04")), 50.0: (D("2024-01-01"), None)}
    assert {r.reason for r in clean.rejected.collect()} == {"no contract", "receipt is not a number"}


def test_payment_fixes_by_position(spark):
    from ledgerwork.functions.fill import number_rows
    from ledgerwork.sources import defaults

    sheet = spark.range(2000).select(
        (F.col("id") * 7).alias("byte_no"), F.lit("1").alias("contract_raw"), F.lit("2024-01-01").alias("due_raw"),
        F.lit("NR").alias("settled_raw"), F.lit("1234").alias("receipt_raw"), F.lit("10").alias("mgmt_raw"),
        F.lit("5").alias("loss_raw"), F.lit("9").alias("amount_raw"),
    )
    placed = number_rows(sheet, "byte_no", -1, "row_no").drop("byte_no")
    clean = imports.clean_payments(placed, defaults.payment_fixes(spark), imports.SKIP_ROWS).accepted
    assert clean.count() == 2000 - imports.SKIP_ROWS
    settled = {r.settled_on: r["count"] for r in clean.groupBy("settled_on").count().collect()}
    assert settled == {None: 2000 - 12 - 5, D("2025-01-02"): 2, D("2024-10-11"): 1, D("2024-08-30"): 1, D("2024-11-04"): 1}


def test_index_sheet(spark):
    names = [c for c, _ in imports.INDEX_MONTHS]
    raw = spark.createDataFrame([("7", *[str(i) for i in range(1, 10)], None, "20"), (None, *["x"] * 11)], ["contract_raw", *names])
    got = imports.import_index_sheet(raw).where("contract_no = '7'").orderBy("read_on").collect()
    assert [r.index_m3 for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 20]
    assert [r.prev_index for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0]
    assert [r.mgmt_fee for r in got] == [0] * 3 + [10] * 8
    assert [r.loss_fee for r in got] == [0] * 7 + [5] * 4
    assert got[0].read_on == D("2023-12-01") and got[-1].read_on == D("2024-10-01")
    assert imports.import_index_sheet(raw).count() == 22


def test_wide_payments(spark):
    columns = ["contract_no"] + [f"{k}_{m}" for _, m in imports.QUARTER_MONTHS for k in ("amount", "receipt", "date")]
    rows = [
        ("1", " 1,250.5 ", "r1", "2024-03-05", "x", "r2", "2024-04-01", "7", None, "2024-05-01", "8", "r4", "soon"),
        ("2", "0", "r5", "2024-3-7", None, "r6", "2024-04-01", "7", "", "2024-05-01", "8", "r8", None),
    ]
    raw = spark.createDataFrame(rows, columns)
    got = sorted(tuple(r) for r in imports.import_wide_payments(raw).collect())
    assert got == [
        ("1", "r1", 1250.5, D("2024-03-01"), D("2024-03-05"), 10.0, 0.0),
        ("2", "r5", 0.0, D("2024-03-01"), D("2024-03-07"), 10.0, 0.0),
    ]
    kept = imports.import_wide_payments(raw, iso_dates=False).where("receipt_no = 'r4'").collect()
    assert [r.settled_on for r in kept] == ["soon"]


def test_memberships(spark):
    rows = [
        (1, "12.0", "2024-02-01", "r1", "100", None),
        (2, "13", "NR", "r2", "x", "50"),
        (3, None, None, "r3", "70", "60"),
        (4, "14", None, "r4", None, "80"),
        (5, "15", None, "r5", "90", None),
    ]
    raw = spark.createDataFrame(rows, "row_no long, contract_raw string, paid_raw string, receipt_raw string, amount_raw string, collector_amount_raw string")
    office = imports.import_membership_office(raw, first_rows=4)
    assert sorted(map(tuple, office.collect())) == [("12", "r1", 100.0, D("2024-02-01")), ("13", "r2", None, D("2024-03-01"))]
    collector = imports.import_membership_collector(raw)
    assert sorted(map(tuple, collector.collect())) == [("13", "0", 50.0, D("2024-03-01")), ("14", "0", 80.0, D("2024-03-01"))]
    previous = imports.import_membership_previous(spark.createDataFrame([("3.0", "5.5"), (None, "1")], "contract_raw string, amount_raw string"))
    assert [tuple(r) for r in previous.collect()] == [("3", "0", 5.5, D("2023-12-31"))]
    assert imports.load_memberships(office, collector, previous).count() == 5


def test_profile(spark):
    raw = payment_sheet(spark)
    nulls = {r.column_name: r.null_count for r in imports.profile_nulls(raw).collect()}
    assert nulls["due_raw"] == 3 and nulls["row_no"] == 0
    assert {r.contract_raw: r.row_count for r in imports.rows_per_contract(raw).collect()}["1"] == 3
    flags = {r.row_no: r for r in imports.suspicious_rows(raw).collect()}
    assert set(flags) == {6, 8, 9, 11} and flags[6].marked_date and flags[6].short_receipt
    assert flags[8].short_date and not flags[8].empty_row


def test_sheet_reading(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text("N_contrat,mois_consome,Crédit,Date encaissements,Reçu N°,FG.1,perte,Total_recettes\n1,2024-01-01,9,NR,0012,10,5,7\n2,,9,,,,,\n", encoding="utf-8")
    got = sheets.read_sheet(spark, str(path), "payments").orderBy("row_no").collect()
    assert got[0].asDict() == {
        "row_no": got[0].row_no, "contract_raw": "1", "due_raw": "2024-01-01", "settled_raw": "NR", "receipt_raw": "0012",
        "mgmt_raw": "10", "loss_raw": "5", "amount_raw": "7",
    }
    assert got[1].contract_raw == "2" and got[1].due_raw is None and got[1].row_no > got[0].row_no


def test_tables(spark, tmp_path):
    path = str(tmp_path / "product_use")
    use = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "product string, qty double")
    tables.overwrite(use, path, "product_use")
    tables.append(use, path, "product_use")
    stored = tables.load_table(spark, path, "product_use")
    assert stored.count() == 4 and stored.schema == SCHEMAS["product_use"]
    tables.overwrite(use, path, "product_use")
    assert tables.load_table(spark, path, "product_use").count() == 2
    marked = spark.createDataFrame([("4444",), (None,), ("44440",)], "receipt_no string")
    assert tables.without_rows(marked, "receipt_no", "4444").count() == 2
    wider = tables.with_column_default(use, "loss_fee", "double", 0.0)
    assert [r.loss_fee for r in wider.collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        tables.with_column_default(wider, "loss_fee", "double")
    copy = str(tmp_path / "copy")
    tables.copy_columns(use, ["product"], copy)
    assert spark.read.parquet(copy).columns == ["product"]
    tables.save_view(use, "uses_now")
    assert spark.table("uses_now").count() == 2 and tables.drop_view(spark, "uses_now")
    assert tables.whole_numbers(spark, 1, 15).count() == 15


def test_invoice_folders(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01"), ("2", "2024-01"), ("1", "2024-02")], "contract_no string, month string")
    tables.write_invoices(df, str(tmp_path / "invoices"))
    assert {p.name for p in (tmp_path / "invoices").glob("month=*")} == {"month=2024-01", "month=2024-02"}
    assert spark.read.parquet(str(tmp_path / "invoices")).count() == 3


def reasons(checked):
    return {r.submitted_seq: r.reason for r in checked.judged.collect()}


def test_check_subscribers(spark):
    rows = [
        (1, "1", "id", "3", None, "A", 10.0, D("2024-01-01"), "x"),
        (2, "9", "id", "3", None, "A", 10.0, D("2024-01-01"), "x"),
        (3, "2", "", "3", None, "A", 10.0, D("2024-01-01"), "x"),
        (4, "2", "id", "3", None, "A", 0.0, D("2024-01-01"), "x"),
        (5, "2", "id", "3", None, "A", 0.0, D("2024-01-01"), "x"),
        (6, "3", "id", "16", None, "A", 0.0, D("2024-01-01"), "x"),
        (7, "3", "id", "x", None, "A", -1.0, D("2024-01-01"), "x"),
    ]
    batch = spark.createDataFrame(
        rows, "submitted_seq long, contract_no string, id_card string, block_no string, meter_no string, name string, joining_fee double, joined_on date, address string"
    )
    sub = spark.createDataFrame([("9",)], "contract_no string")
    checked = checks.check_subscribers(batch, sub)
    assert reasons(checked) == {
        1: None, 2: "contract exists", 3: "missing field", 4: None, 5: "contract repeated in batch", 6: "unknown block", 7: "negative fee",
    }
    assert checked.accepted.count() + checked.rejected.count() == len(rows)
    assert "reason" not in checked.accepted.columns


def test_check_readings(spark):
    batch = spark.createDataFrame(
        [(1, "1", 20.0, D("2024-03-01")), (2, "1", -1.0, D("2024-04-01")), (3, "1", 25.0, D("2024-02-01")), (4, "1", 30.0, D("2024-04-01")), (5, "2", 3.0, D("2024-04-01"))],
        "submitted_seq long, contract_no string, index_m3 double, read_on date",
    )
    reading = spark.createDataFrame([("1", D("2024-01-01"), 5.0), ("1", D("2024-02-15"), 9.0)], "contract_no string, read_on date, index_m3 double")
    checked = checks.check_readings(batch, reading)
    got = {r.submitted_seq: (r.prev_index, r.reason) for r in checked.judged.collect()}
    assert got == {1: (9.0, None), 2: (20.0, "negative index"), 3: (20.0, None), 4: (20.0, None), 5: (None, "no earlier reading")}
    assert {(r.mgmt_fee, r.loss_fee) for r in checked.accepted.collect()} == {(10.0, 5.0)}


def test_check_membership_payments(spark):
    rows = [
        (1, "1", "r", 60.0, D("2024-01-01")),
        (2, "1", "r", 50.0, D("2024-01-01")),
        (3, "1", "r", 40.0, D("2024-01-01")),
        (4, "1", "", 0.0, D("2024-01-01")),
        (5, "8", "r", 1.0, D("2024-01-01")),
        (6, "1", "r", 500.0, D("2024-01-01")),
        (7, "1", "r", -1.0, D("2024-01-01")),
        (8, "2", "r", 1.0, D("2024-01-01")),
    ]
    batch = spark.createDataFrame(rows, "submitted_seq long, contract_no string, receipt_no string, amount double, paid_on date")
    sub = spark.createDataFrame([("1", "A", 150.0), ("2", "B", None)], "contract_no string, name string, joining_fee double")
    mpay = spark.createDataFrame([("1", 50.0)], "contract_no string, amount double")
    expected = {
        1: None, 2: "amount exceeds credit", 3: None, 4: "missing field", 5: "no credit known", 6: "amount exceeds credit",
        7: "negative amount", 8: "no credit known",
    }
    for fold_rows in (0, 1_000_000):
        assert reasons(checks.check_membership_payments(batch, sub, mpay, fold_rows)) == expected


def test_simple_checks(spark):
    pay = spark.createDataFrame([("1", 0.0), ("1", -1.0), ("1", None)], "contract_no string, amount double")
    checked = checks.check_consumption_payments(pay)
    assert [tuple(r) for r in checked.accepted.collect()] == [("1", 0.0, 10.0, 5.0)]
    assert checked.rejected.count() == 2
    block = spark.createDataFrame([("15", 0.0), ("0", 1.0), ("1", -1.0)], "block_no string, index_m3 double")
    assert checks.check_block_readings(block).accepted.count() == 1
    purchase = spark.createDataFrame(
        [("p", D("2024-01-01"), 2.0, 3.0, "r", "v"), ("p", D("2024-01-01"), 0.0, 3.0, "r", "v"), ("p", D("2024-01-01"), 2.0, 3.0, "", "v"), ("p", None, 2.0, 3.0, "r", "v"), ("p", D("2024-01-01"), -2.0, 3.0, "r", "v")],
        "product string, bought_on date, qty double, unit_price double, receipt_no string, vendor string",
    )
    checked = checks.check_purchases(purchase)
    assert [r.amount for r in checked.accepted.collect()] == [6.0]
    assert {r.reason for r in checked.rejected.collect()} == {"missing field", "negative qty"}
    use = spark.createDataFrame([("p", D("2024-01-01"), 1.0, "n"), ("p", D("2024-01-01"), 1.0, None)], "product string, used_on date, qty double, note string")
    assert checks.check_uses(use).accepted.count() == 1
    bill = spark.createDataFrame([(D("2024-05-17"), 5.0, ""), (D("2024-05-17"), 0.0, "f")], "month date, amount_due double, invoice_no string")
    assert [r.month for r in checks.check_supplier_bills(bill).accepted.collect()] == [D("2024-05-01")]
    spay = spark.createDataFrame([(D("2024-05-17"), 5.0, "r", D("2024-06-01")), (D("2024-05-17"), 5.0, "", D("2024-06-01"))], "month date, amount double, receipt_no string, paid_on date")
    assert checks.check_supplier_payments(spay).accepted.count() == 1


def test_split_maintenance(spark):
    rows = [
        (10, D("2024-01-01"), "n", "w", 5.0, [("a", 1.0), ("b", 2.0), ("a", 1.0)]),
        (20, D("2024-01-01"), "", "w", 5.0, [("a", 1.0)]),
        (30, D("2024-01-01"), "n", "w", 5.0, []),
        (40, D("2024-01-01"), "n", "w", -5.0, [("a", 1.0)]),
        (50, D("2024-01-01"), "n", "w", 0.0, [("c", 4.0)]),
    ]
    batch = spark.createDataFrame(
        rows, "submitted_seq long, done_on date, note string, worker string, worker_pay double, items array<struct<product string, qty double>>"
        .replace("product string", "product: string").replace("qty double", "qty: double")
    )
    lines = checks.item_lines(batch)
    split = checks.split_maintenance(batch.drop("items"), lines, max_job_id=7, max_detail_id=100)
    assert sorted((r.job_id, r.worker_pay) for r in split.jobs.collect()) == [(8, 5.0), (9, 0.0)]
    items = sorted(tuple(r) for r in split.items.collect())
    assert [i[0] for i in items] == [101, 102, 103, 104]
    assert sorted(i[1:] for i in items) == [(8, "a", 1.0), (8, "a", 1.0), (8, "b", 2.0), (9, "c", 4.0)]
    assert {r.submitted_seq: r.reason for r in split.rejected.collect()} == {20: "missing field", 30: "no material", 40: "negative pay"}
