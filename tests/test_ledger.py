"""Edge rows of bills, ledger and unpaid bills; pandas does the same on the small frames."""

from __future__ import annotations

from datetime import date

import pandas as pd
import pytest

from ledgerwork.operators import analytics, ledger

READING = "contract_no string, read_on date, index_m3 double, prev_index double, mgmt_fee double, loss_fee double"
PAYMENT = "contract_no string, receipt_no string, amount double, due_on date, settled_on date, mgmt_fee double, loss_fee double"


def day(text):
    return date.fromisoformat(text) if text else None


ROWS = [
    ("1", "2024-01-01", 10.0, 0.0, 10.0, 5.0),  # total 85: no payment
    ("1", "2024-02-01", 20.0, 10.0, 10.0, 5.0),  # total 85: one full payment
    ("1", "2024-03-01", 30.0, 20.0, 10.0, 5.0),  # total 85: 85 + 20, the full one leaves with its row
    ("1", "2024-04-01", 40.0, 30.0, 10.0, 5.0),  # total 85: 40 + 20
    ("1", "2024-05-01", 50.0, 40.0, 10.0, 5.0),  # total 85: overpaid
    ("2", "2024-01-01", 5.0, None, 10.0, 5.0),  # no previous index
    ("2", "2024-02-01", 5.0, 5.0, 0.0, 0.0),  # total 0
    ("2", None, 9.0, 5.0, 0.0, 0.0),  # no month
    ("3", "2024-01-01", 4.0, 2.0, 0.0, 0.0),  # two readings in one month
    ("3", "2024-01-20", 9.0, 4.0, 0.0, 0.0),
    (None, "2024-01-01", 9.0, 4.0, 0.0, 0.0),
    ("4", "2024-01-01", 9.0, 4.0, None, 0.0),
]
PAID = [
    ("1", "r1", 85.0, "2024-02-01", "2024-02-10"),
    ("1", "r2", 85.0, "2024-03-01", "2024-03-10"),
    ("1", "r3", 20.0, "2024-03-01", "2024-03-11"),
    ("1", "r4", 40.0, "2024-04-05", "2024-04-10"),
    ("1", "r5", 20.0, "2024-04-09", "2024-04-11"),
    ("1", "r6", 100.0, "2024-05-01", "2024-05-11"),
    ("1", "r7", 85.0, "2024-01-01", None),  # not settled: does not count
    ("2", "r8", 3.0, None, "2024-05-11"),
    ("2", "r9", None, "2024-02-01", "2024-05-11"),
    ("3", "r10", 6.0, "2024-01-05", "2024-05-11"),
    (None, "r11", 6.0, "2024-01-05", "2024-05-11"),
    ("9", "r12", 6.0, "2024-01-05", "2024-05-11"),
]


@pytest.fixture(scope="module")
def frames(spark):
    reading = spark.createDataFrame([(c, day(d), *rest) for c, d, *rest in ROWS], READING)
    paid = [(c, r, a, day(d), day(s), 10.0, 5.0) for c, r, a, d, s in PAID]
    return reading, spark.createDataFrame(paid, PAYMENT)


def in_pandas():
    """The row-grain rules in pandas: merge, credit, filter, group, merge back."""
    bills = pd.DataFrame(ROWS, columns=["contract_no", "day", "index_m3", "prev", "mgmt", "loss"])
    bills["month"] = bills["day"].str[:7]
    bills["total"] = (bills.index_m3 - bills.prev) * 7 + bills.mgmt + bills.loss
    paid = pd.DataFrame(PAID, columns=["contract_no", "receipt_no", "amount", "due", "settled"])
    paid = paid[paid.settled.notna()].assign(month=lambda p: p.due.str[:7])
    rows = bills.merge(paid, how="left", on=["contract_no", "month"])
    rows["credit"] = rows.total - rows.amount.fillna(0)
    open_rows = rows[rows.credit != 0]
    left = open_rows.groupby(["contract_no", "month", "total"]).agg({"amount": "sum"}).reset_index()
    left["remaining"] = left.total - left.amount
    left = left[left.remaining != 0][["contract_no", "month", "remaining"]]
    return rows, open_rows.merge(left, on=["contract_no", "month"])


def as_set(rows, columns):
    clean = lambda v: None if v is None or v != v else v
    return sorted(repr(tuple(clean(r[c]) for c in columns)) for r in rows)


@pytest.mark.parametrize("salt_rows", [1, 2, 1_000_000])
def test_ledger_equals_pandas(frames, salt_rows):
    got = [r.asDict() for r in ledger.ledger(*frames, salt_rows=salt_rows).collect()]
    expected, _ = in_pandas()
    columns = ["contract_no", "month", "receipt_no", "index_m3", "total", "amount", "credit"]
    assert as_set(got, columns) == as_set(expected.to_dict("records"), columns)


def test_unpaid_equals_pandas(frames):
    got = [r.asDict() for r in ledger.unpaid_bills(ledger.ledger(*frames)).collect()]
    _, expected = in_pandas()
    columns = ["contract_no", "month", "index_m3", "total", "remaining"]
    assert as_set(got, columns) == as_set(expected.to_dict("records"), columns)


def test_quirks_by_hand(frames):
    rows = ledger.unpaid_bills(ledger.ledger(*frames), contracts=["1"]).collect()
    remaining = sorted((r.month, r.remaining) for r in rows)
    assert remaining == [
        ("2024-01", 85.0),
        ("2024-03", 65.0),  # the payment of 85 left before the sum
        ("2024-04", 25.0),
        ("2024-04", 25.0),  # repeats per payment
        ("2024-05", -15.0),
    ]
    totals = ledger.unpaid_totals(ledger.unpaid_bills(ledger.ledger(*frames), contracts=["1"])).collect()
    assert [tuple(r) for r in totals] == [("1", 185.0, 4)]


def test_net_grain(frames):
    net = ledger.unpaid_bills_net(*frames).collect()
    assert sorted((r.contract_no, r.month, r.total, r.paid, r.remaining) for r in net) == [
        ("1", "2024-01", 85.0, 0.0, 85.0),
        ("1", "2024-03", 85.0, 105.0, -20.0),
        ("1", "2024-04", 85.0, 60.0, 25.0),
        ("1", "2024-05", 85.0, 100.0, -15.0),
        ("3", "2024-01", 49.0, 6.0, 43.0),
    ]


def test_net_keeps_the_balance(frames):
    """Net remaining is bills less the payments matched to them."""
    balance = ledger.monthly_balance(*frames).where("total is not null").collect()
    assert sum(r.credit for r in balance) == sum(r.total for r in balance) - sum(r.paid for r in balance)


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({"contracts": ["1"], "month": "2024-03"}, 2),
        ({"receipts": ["r4", "r8"]}, 2),
        ({"qty": "zero"}, 1),
        ({"contracts": ["2"], "qty": "nonzero"}, 2),  # keeps the bill without a quantity
        ({"contracts": ["1"], "credit": "zero"}, 2),
        ({"contracts": ["2", "4"], "credit": "nonzero"}, 3),  # keeps the bills without a total
    ],
)
def test_filters(frames, filters, expected):
    assert ledger.filter_ledger(ledger.ledger(*frames), **filters).count() == expected


def test_contract_filter_before_the_join(frames):
    whole = ledger.filter_ledger(ledger.ledger(*frames), contracts=["1", "3"]).collect()
    early = ledger.ledger(*frames, contracts=["1", "3"]).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, early))


def test_series(frames):
    rows = ledger.ledger(*frames)
    series = {(r.contract_no, r.month_label): r.qty_m3 for r in analytics.usage_series(rows, ["1"]).collect()}
    assert series[("1", "03-2024")] == 20.0 and series[("1", "01-2024")] == 10.0
    months = [r.month_label for r in analytics.monthly_amounts(rows).collect()]
    assert months == ["01-2024", "02-2024", "03-2024", "04-2024", "05-2024"]
    assert {r.contract_no for r in analytics.contracts(frames[0]).collect()} == {"1", "2", "3", "4", None}
