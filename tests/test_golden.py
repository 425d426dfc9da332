"""Results on the sample books."""

from __future__ import annotations

import pytest
import seeds

from ledgerwork.operators import analytics, ledger, members, readings, stock
from ledgerwork.sources import defaults


def test_membership_credit(spark):
    got = members.membership_credit(seeds.subscribers(spark), seeds.membership_payments(spark)).collect()
    expected = {"01": 0, "02": 0, "03": 750.75, "04": 250, "05": 650.25, "06": 1100, "07": 950.30, "08": 0, "09": 0, "10": 0}
    assert {r.contract_no: r.credit for r in got} == pytest.approx(expected)


def test_usage_by_lag(spark):
    got = readings.usage_by_lag(seeds.readings(spark)).orderBy("contract_no", "read_on").collect()
    usage = {}
    for r in got:
        usage.setdefault(r.contract_no, []).append(r.qty_m3)
        assert r.amount == r.qty_m3 * 7
    assert usage == {
        "01": [2, 2, 1, 1, 1, 3],
        "02": [3, 6, 5, 4, 1, 3],
        "03": [1, 6, 3, 1, 4, 5],
        "04": [10, 3, 6, 3, 4, 2],
        "05": [1, 6, 2, 8, 3, 8],
    }


MONTHS = {
    "06-2024": (119, 119, 0),
    "07-2024": (161, 98, 63),
    "08-2024": (119, 63, 56),
    "09-2024": (119, 63, 56),
    "10-2024": (91, 35, 56),
    "11-2024": (147, 49, 98),
}


def test_monthly_amounts(spark):
    rows = ledger.ledger(seeds.readings(spark), seeds.consumption_payments(spark))
    got = analytics.monthly_amounts(rows).collect()
    assert [r.month_label for r in got] == sorted(MONTHS)
    assert {r.month_label: (r.due, r.paid, r.credit) for r in got} == MONTHS


def test_monthly_amounts_net(spark):
    got = analytics.monthly_amounts_net(seeds.readings(spark), seeds.consumption_payments(spark)).collect()
    assert [r.month for r in got] == [f"2024-{m:02d}" for m in range(6, 12)]
    assert [(r.due, r.paid, r.credit) for r in got] == [MONTHS[k] for k in sorted(MONTHS)]


@pytest.mark.parametrize("salt_rows", [1, 1_000_000])
def test_credit_per_contract(spark, salt_rows):
    rows = ledger.ledger(seeds.readings(spark), seeds.consumption_payments(spark), salt_rows=salt_rows)
    assert rows.count() == 30
    got = ledger.unpaid_totals(ledger.unpaid_bills(rows)).collect()
    expected = {"01": (21, 1), "02": (28, 2), "04": (91, 3), "05": (189, 5)}
    assert {r.contract_no: (r.credit_total, r.months_unpaid) for r in got} == expected
    net = ledger.unpaid_totals(ledger.unpaid_bills_net(seeds.readings(spark), seeds.consumption_payments(spark)))
    assert {r.contract_no: (r.credit_total, r.months_unpaid) for r in net.collect()} == expected


def test_products_without_movement(spark):
    product = defaults.products(spark)
    purchase = spark.createDataFrame([("Pompe", 3.0)], "product string, qty double")
    use = spark.createDataFrame([("Pompe", 1.0), ("Filtre", 2.0)], "product string, qty double")
    got = {r["product"]: r.stock for r in stock.stock_on_hand(product, purchase, use).collect()}
    assert got == {p: {"Pompe": 2.0, "Filtre": -2.0}.get(p, 0.0) for p in defaults.PRODUCTS}
