"""Edge rows of members, readings, blocks, stock, supplier, maintenance, cash and invoices."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerwork.operators import blocks, cash, invoices, maintenance, members, readings, stock, supplier
from ledgerwork.sources import defaults

D = date.fromisoformat
READING = "contract_no string, read_on date, index_m3 double, prev_index double, mgmt_fee double, loss_fee double"


def make_readings(spark, rows):
    return spark.createDataFrame([(c, d and D(d), i, p, 0.0, 0.0) for c, d, i, p in rows], READING)


def subscriber_frame(spark):
    rows = [("1", "b1", "A", 100.0), ("2", "b1", "B", 100.0), ("3", "b2", "C", None), ("4", "b2", "D", 50.0), ("5", "b3", "E", 10.0)]
    df = spark.createDataFrame(rows, "contract_no string, block_no string, name string, joining_fee double")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("id_card", "meter_no", "address")], F.lit(None).cast("date").alias("joined_on"))


def test_subscriber_credit(spark):
    mpay = spark.createDataFrame(
        [("1", 60.0), ("1", 40.0), ("2", None), ("3", 5.0), ("4", 70.0)], "contract_no string, amount double"
    )
    df = members.subscriber_credit(subscriber_frame(spark), mpay)
    assert [(r.contract_no, r.credit) for r in df.collect()] == [("1", 0.0), ("2", 100.0), ("3", None), ("4", -20.0), ("5", 10.0)]
    assert [r.contract_no for r in members.filter_subscribers(df, credit="zero").collect()] == ["1"]
    assert [r.contract_no for r in members.filter_subscribers(df, credit="positive").collect()] == ["2", "5"]
    assert members.filter_subscribers(df, ["1", "3"], ["b2"]).count() == 1
    assert members.membership_credit(subscriber_frame(spark), mpay, ["4"]).collect()[0]["credit"] == -20.0
    with pytest.raises(ValueError):
        members.filter_subscribers(df, credit="odd")


def test_membership_history_parses_dates(spark):
    rows = [("1", "r", 1.0, "2024-11-4"), ("1", "r", 2.0, "NR"), ("2", "r", 3.0, "2024-01-01")]
    df = spark.createDataFrame(rows, "contract_no string, receipt_no string, amount double, paid_on string")
    got = members.membership_history(df, ["1"]).orderBy("amount").collect()
    assert [r.paid_on for r in got] == [date(2024, 11, 4), None]


def test_last_reading(spark):
    df = make_readings(spark, [("1", "2024-02-01", 5.0, None), ("1", "2024-03-01", 4.0, None), ("2", None, 1.0, None)])
    got = {r.contract_no: (r.last_read_on, r.last_index, r.month_label) for r in readings.last_reading(df).collect()}
    assert got == {"1": (date(2024, 3, 1), 4.0, "03-2024"), "2": (None, 1.0, None)}


def test_lag_edges(spark):
    df = make_readings(
        spark,
        [("1", "2024-01-01", 5.0, None), ("1", "2024-01-20", 7.0, None), ("1", "2024-04-01", 20.0, None), ("2", "2024-01-01", 3.0, None), ("1", None, 2.0, None)],
    )
    got = readings.usage_by_lag(df).orderBy("contract_no", "read_on").collect()
    assert [(r.contract_no, r.qty_m3) for r in got] == [("1", 2.0), ("1", 3.0), ("1", 2.0), ("1", 13.0), ("2", 3.0)]


def test_backfill_shares_the_earlier_month(spark):
    df = make_readings(
        spark,
        [("1", "2024-01-10", 5.0, None), ("1", "2024-01-20", 7.0, 1.0), ("1", "2024-03-01", 9.0, None), ("1", "2024-03-15", 11.0, None), ("2", "2024-01-01", 3.0, 8.0)],
    )
    got = {(r.contract_no, r.index_m3): r.prev_index for r in readings.backfill_prev_index(df).collect()}
    assert got == {("1", 5.0): None, ("1", 7.0): None, ("1", 9.0): 7.0, ("1", 11.0): 7.0, ("2", 3.0): None}


def test_corrections(spark):
    df = make_readings(
        spark, [("73", "2024-03-01", 1.0, 50.0), ("073", "2024-03-01", 1.0, 50.0), ("3", "2024-03-01", 9.0, 5.0), ("4", "2024-03-01", 9.0, 5.0)]
    )
    fixes = spark.createDataFrame(
        [(1, "73", 1.0, None, -4.0), (2, "3", 9.0, None, 1.0), (3, "3", None, D("2024-03-01"), 308.0), (4, "4", 9.0, None, None)],
        "seq int, contract_no string, index_m3 double, read_on date, prev_index double",
    )
    got = {r.contract_no: r.prev_index for r in readings.apply_corrections(df, fixes).collect()}
    assert got == {"73": -4.0, "073": 50.0, "3": 308.0, "4": None}


def test_known_corrections(spark):
    df = make_readings(spark, [("102", "2024-01-01", 1.0, 0.0), ("102", "2024-02-01", 1.0, 0.0), ("3", "2024-03-01", 310.0, 0.0), ("103", "2024-03-01", 1.0, 0.0)])
    got = [(r.contract_no, r.prev_index) for r in readings.apply_corrections(df, defaults.reading_fixes(spark)).orderBy("contract_no", "read_on").collect()]
    assert got == [("102", 286.0), ("102", 1.0), ("103", 0.0), ("3", 308.0)]


@pytest.fixture(scope="module")
def block_frames(spark):
    block = spark.createDataFrame(
        [("b1", D("2024-01-01"), 10.0), ("b1", D("2024-02-01"), 25.0), ("b2", D("2024-02-01"), 4.0)],
        "block_no string, read_on date, index_m3 double",
    )
    reading = make_readings(
        spark, [("1", "2024-01-01", 4.0, None), ("1", "2024-02-01", 9.0, None), ("2", "2024-02-01", 6.0, None), ("9", "2024-02-01", 6.0, None)]
    )
    return block, reading, subscriber_frame(spark)


def test_block_check_month_before_or_after_lag(block_frames):
    first = blocks.block_check(*block_frames, blocks=["b1"], month="02-2024")
    assert [r.usage_m3 for r in first.blocks.collect()] == [25.0]
    assert {r.contract_no: r.usage_m3 for r in first.subscribers.collect()} == {"1": 9.0, "2": 6.0}
    later = blocks.block_check(*block_frames, blocks=["b1"], month="02-2024", lag_first=True)
    assert [r.usage_m3 for r in later.blocks.collect()] == [15.0]
    assert {r.contract_no: r.usage_m3 for r in later.subscribers.collect()} == {"1": 5.0, "2": 6.0}


def test_block_totals_and_gap(block_frames):
    totals = blocks.block_check_totals(blocks.block_check(*block_frames)).collect()
    assert {r.block_no: tuple(r)[1:] for r in totals} == {"b1": (35.0, 15.0), "b2": (4.0, 0.0)}
    gap = {(r.block_no, r.month_label): r.gap_m3 for r in blocks.block_gap(*block_frames).collect()}
    assert gap == {("b1", "01-2024"): 6.0, ("b1", "02-2024"): 4.0, ("b2", "02-2024"): 4.0}


def test_stock(spark):
    product = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "product string")
    purchase = spark.createDataFrame([("a", 10.0), ("a", 5.0), ("b", 3.7), ("a", None)], "product string, qty double")
    use = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("c", 1.7)], "product string, qty double")
    fan = {r["product"]: r.stock for r in stock.stock_fanout(product, purchase, use).collect()}
    assert fan == {"a": 15.0 * 3 - 6.0 * 3, "b": 3.7, "c": -1.7, "d": 0.0}
    net = {r["product"]: (r.stock, r.stock_units) for r in stock.stock_on_hand(product, purchase, use).collect()}
    assert net == {"a": (9.0, 9), "b": (3.7, 3), "c": (-1.7, -1), "d": (0.0, 0)}
    detail = spark.createDataFrame([("b", 1.0)], "product string, qty double")
    less = {r["product"]: r.stock for r in stock.stock_on_hand(product, purchase, use, detail).collect()}
    assert less["b"] == pytest.approx(2.7)


@pytest.mark.parametrize("salt_rows", [1, 1_000_000])
def test_supplier(spark, salt_rows):
    bill = spark.createDataFrame(
        [(D("2024-01-01"), 5.0, 100.0, "f1"), (D("2024-02-01"), 6.0, 80.0, "f2"), (D("2024-03-01"), 6.0, 30.0, "f3")],
        "month date, index_m3 double, amount_due double, invoice_no string",
    )
    pay = spark.createDataFrame(
        [(D("2024-01-01"), 40.0, "r1", D("2024-02-01")), (D("2024-01-01"), 60.0, "r2", D("2024-02-05")), (D("2024-02-01"), 10.0, "r3", D("2024-03-01")), (D("2025-02-01"), 10.0, "r4", D("2024-03-01"))],
        "month date, amount double, receipt_no string, paid_on date",
    )
    account = supplier.supplier_account(bill, pay, salt_rows)
    assert sorted(r.credit for r in account.collect()) == [30.0, 40.0, 60.0, 70.0]
    assert {r.month_name for r in account.collect()} == {"January 2024", "February 2024", "March 2024"}
    assert tuple(supplier.supplier_totals(account).first()) == (200.0, 1)
    net = {r.month.month: r.credit for r in supplier.supplier_account_net(bill, pay).collect()}
    assert net == {1: 0.0, 2: 70.0, 3: 30.0}
    assert tuple(supplier.supplier_totals(account.limit(0)).first()) == (0.0, 0)


def test_maintenance_history(spark):
    job = spark.createDataFrame(
        [(2, D("2023-07-02"), "n", "w", 5.0), (1, D("2024-07-02"), "n", "w", 5.0), (3, D("2024-08-02"), "n", "w", 5.0), (4, D("2024-07-03"), "n", "w", 5.0)],
        "job_id long, done_on date, note string, worker string, worker_pay double",
    )
    detail = spark.createDataFrame([(1, "p", 1.0), (1, "q", 2.0), (2, "p", 3.0), (3, "p", 4.0)], "job_id long, product string, qty double")
    assert [r.job_id for r in maintenance.maintenance_history(job, detail, 7).collect()] == [1, 1, 2]
    assert [r.job_id for r in maintenance.maintenance_history(job, detail, 7, 2023).collect()] == [2]


@pytest.fixture(scope="module")
def book(spark):
    mpay = spark.createDataFrame([("1", 100.0, D("2024-01-05")), ("2", 10.0, None)], "contract_no string, amount double, paid_on date")
    cpay = spark.createDataFrame(
        [("1", 50.0, D("2024-02-05"), 10.0, 5.0), ("2", None, D("2024-02-06"), 10.0, 5.0), ("3", 20.0, D("2025-02-06"), None, None)],
        "contract_no string, amount double, settled_on date, mgmt_fee double, loss_fee double",
    )
    spay = spark.createDataFrame([(1, 30.0, D("2024-02-07"))], "payment_id long, amount double, paid_on date")
    job = spark.createDataFrame([(7, D("2024-03-01"), 8.0)], "job_id long, done_on date, worker_pay double")
    purchase = spark.createDataFrame([(9, D("2024-03-02"), -2.0, 3.0)], "purchase_id long, bought_on date, qty double, unit_price double")
    return cash.cash_book(mpay, cpay, spay, job, purchase)


def test_cash_book(book):
    rows = book.collect()
    assert rows[0].moved_on is None and len(rows) == 8
    assert [r.credit for r in rows if r.reason == cash.MATERIAL] == [6.0]
    assert all((r.debit is None) or (r.credit is None) for r in rows)
    totals = cash.cash_totals(book).first()
    assert totals.asDict() == {
        "mgmt_total": 20.0,
        "loss_total": 10.0,
        "debit_total": 110.0 + 35.0 + 20.0,  # the payment without an amount brings its fees only
        "credit_total": 44.0,
        "balance": 165.0 + 30.0 - 44.0,
    }


def test_cash_filters(book):
    assert cash.filter_cash(book, 2024).count() == 6
    assert cash.filter_cash(book, 2024, 2).count() == 3
    assert cash.filter_cash(book, 2024, 2, cash.SUPPLIER).count() == 1
    assert cash.cash_totals(cash.filter_cash(book, 1999)).first().balance == 0.0
    assert [r.year for r in cash.cash_years(book).collect()] == [None, 2024, 2025]
    assert cash.cash_reasons(book).count() == 5


def test_invoices(spark):
    unpaid = spark.createDataFrame(
        [("1", "2024-01", 3.0, 36.0), ("1", "2024-01", 3.0, 36.0), ("1", "2024-02", 1.0, 7.25)],
        "contract_no string, month string, qty_m3 double, remaining double",
    )
    membership = spark.createDataFrame([("1", "A", 10.5), ("2", "B", 0.0)], "contract_no string, name string, credit double")
    requests = spark.createDataFrame(
        [("1", "2024-01", D("2024-05-01"), 1.0, 2.0), ("2", "2024-01", D("2024-05-01"), 0.0, 0.0), ("9", "2024-01", D("2024-05-01"), 0.0, 0.0)],
        "contract_no string, month string, invoice_date date, membership_to_pay double, consumption_to_pay double",
    )
    got = {r.contract_no: r for r in invoices.invoices(unpaid, membership, requests).collect()}
    assert set(got) == {"1", "2"}
    one = got["1"]
    assert (one.consumption_credit, one.credit_total, one.to_pay_total) == (79.25, 89.75, 3.0)
    assert (one.qty_m3, one.amount_due, one.file_name) == (6.0, 57.0, "facture_1_2024-01")
    assert (got["2"].consumption_credit, got["2"].amount_due) == (0.0, 15.0)
