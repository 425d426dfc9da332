"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as spark_entry
from ledgerwork.plans import oracles, registry

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
QUERIES = registry.queries()
ORACLE = {name: oracles.sql(name) for name in oracles.QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], SMALL) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_all_queries_are_registered():
    assert QUERIES.keys() <= spark_entry.queries().keys() and ORACLE.items() <= spark_entry.oracle_sql().items()


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def totals(spark, name, *sums):
    row = QUERIES[name](spark, MEDIUM).selectExpr("count(*)", *[f"sum({s})" for s in sums]).first()
    return tuple(row)


def test_known_totals(spark):
    assert totals(spark, "ledger", "int(total is not null)", "int(amount is not null)") == (17118, 15257, 11810)
    assert totals(spark, "unpaid_bills", "remaining") == (13290, 4577637.0)
    assert totals(spark, "unpaid_bills_net", "remaining") == (10370, 4148359.0)
    assert totals(spark, "subscriber_credit", "int(credit = 0)", "int(credit > 0)", "int(credit is null)") == (1500, 490, 980, 30)
    assert totals(spark, "stock_fanout", "stock") == (2040, -10520.0)
    assert totals(spark, "stock_on_hand", "stock") == (2040, -1915.0)
    assert totals(spark, "supplier_account", "credit") == (111, 2098983630.0)
    assert totals(spark, "supplier_account_net", "credit") == (83, 1051166118.0)
    cash = QUERIES["cash_totals"](spark, MEDIUM).first()
    assert (cash.debit_total, cash.credit_total, cash.mgmt_total, cash.loss_total) == (1241330857.0, 29806475906.0, 147640.0, 73820.0)


def test_filters_reach_the_scan(spark, tmp_path):
    from ledgerwork.operators import blocks, cash, ledger
    from ledgerwork.sources import tables
    from ledgerwork.sources.schemas import SCHEMAS

    def scan(table):
        path = str(tmp_path / table)
        tables.append(spark.createDataFrame([], SCHEMAS[table]), path, table)
        return tables.load_table(spark, path, table)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    names = ["membership_payment", "consumption_payment", "supplier_payment", "maintenance", "purchase"]
    book = cash.cash_book(*[scan(t) for t in names], ordered=False)
    filtered = plan(cash.filter_cash(book, 1997, 7, cash.MAINTENANCE))
    assert filtered.count("FileScan") == 1 and "GreaterThanOrEqual(done_on" in filtered
    reading, cpay = scan("meter_reading"), scan("consumption_payment")
    one = plan(ledger.ledger(reading, cpay, contracts=["7"]))
    assert one.count("EqualTo(contract_no,7)") >= 2
    block, sub = scan("block_reading"), scan("subscriber")
    month = plan(blocks.block_check(block, reading, sub, month="07-1997").subscribers)
    assert "LessThanOrEqual(read_on" in month
