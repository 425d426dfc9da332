"""Sheets of several files, tables by month, strict loads and allowed values."""

from __future__ import annotations

import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerwork.functions import allowed
from ledgerwork.functions.text import not_a_day, to_day
from ledgerwork.operators import checks, imports
from ledgerwork.sources import sheets, tables

HEADER = "N_contrat,mois_consome,Crédit,Date encaissements,Reçu N°,FG.1,perte,Total_recettes\n"


def lines(first, last):
    return "".join(f"{k},{'2024-01-01' if k % 3 == 0 else ''},9,2024-02-0{k % 9 + 1},{1000 + k},10,5,{k + 1}\n" for k in range(first, last))


def test_several_files_are_one_sheet(spark, tmp_path):
    one, many = tmp_path / "one.csv", tmp_path / "many"
    many.mkdir()
    one.write_text(HEADER + lines(0, 300), encoding="utf-8")
    for name, first, last in (("a.csv", 0, 120), ("b.csv", 120, 121), ("c.csv", 121, 300)):
        (many / name).write_text(HEADER + lines(first, last), encoding="utf-8")
    sheet = sheets.read_sheet(spark, str(many), "payments")
    rows = sheet.orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(300)) and [r.contract_raw for r in rows] == [str(k) for k in range(300)]
    single = sheets.read_sheet(spark, str(one), "payments")
    assert sorted(single.columns) == sorted(sheet.columns)
    cleaned = [imports.clean_payments(s).accepted for s in (sheet, single)]
    assert cleaned[0].count() == 300 and cleaned[0].exceptAll(cleaned[1]).isEmpty()


def names(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("part-*.parquet")}


def readings(spark, rows):
    return spark.createDataFrame(rows, "contract_no string, read_on date, index_m3 double")


def test_tables_by_month(spark, tmp_path):
    path = str(tmp_path / "meter_reading")
    rows = [(f"c{k}", None if k == 7 else date(2024, 1 + k % 3, 1), float(k)) for k in range(30)]
    tables.load_months(readings(spark, rows), path, "meter_reading", "read_on")
    tables.append_months(readings(spark, [("new", date(2024, 2, 2), 1.0)]), path, "meter_reading", "read_on")
    before = names(path)
    deleted = tables.delete_rows(spark, path, "meter_reading", F.col("contract_no") == "c4")
    after = names(path)
    assert deleted == 1 and len(before - after) == 1 and {n.split("/")[0] for n in before ^ after} == {"month_of=2024_02"}
    stored = tables.load_table(spark, path, "meter_reading")
    want = {(c, d, i) for c, d, i in rows if c != "c4"} | {("new", date(2024, 2, 2), 1.0)}
    assert {(r.contract_no, r.read_on, r.index_m3) for r in stored.collect()} == want
    assert tables.delete_rows(spark, path, "meter_reading", F.col("contract_no") == "nobody") == 0 and names(path) == after
    # rows on which the condition is NULL stay
    assert tables.delete_rows(spark, path, "meter_reading", F.col("read_on") == date(2024, 3, 1)) >= 1
    tables.load_months(readings(spark, [("x", date(2024, 1, 9), 5.0)]), path, "meter_reading", "read_on")
    kept = {r for r in want if r[1] is None or r[1].month == 2} | {("x", date(2024, 1, 9), 5.0)}
    stored = tables.load_table(spark, path, "meter_reading")
    assert {(r.contract_no, r.read_on, r.index_m3) for r in stored.collect()} == kept
    assert not [p for p in tmp_path.iterdir() if p.name != "meter_reading"]


def test_delete_in_a_plain_table(spark, tmp_path):
    path = str(tmp_path / "product_use")
    for names_of in ("ab", "cd"):
        tables.append(spark.createDataFrame([(n, 1.0) for n in names_of], "product string, qty double").coalesce(1), path, "product_use")
    before = names(path)
    assert tables.delete_rows(spark, path, "product_use", F.col("product") == "c") == 1
    assert len(before & names(path)) == 1
    assert sorted(r.product for r in tables.load_table(spark, path, "product_use").collect()) == ["a", "b", "d"]


def test_strict_days(spark, tmp_path):
    path = str(tmp_path / "meter_reading")
    good = spark.createDataFrame([("a", "2024-1-5", 1.0), ("b", None, 2.0)], "contract_no string, read_on string, index_m3 double")
    tables.strict_days(good, path, "meter_reading", ["read_on"], "contract_no")
    bad = spark.createDataFrame([("k", "NR", 1.0), ("c", "2024-02-30", 2.0), ("d", "2024-01-01", 3.0)], good.schema)
    with pytest.raises(ValueError, match=r"2 texts of read_on .*2024-02-30.*NR"):
        tables.strict_days(bad, path, "meter_reading", ["read_on"], "contract_no")
    stored = tables.load_table(spark, path, "meter_reading").orderBy("contract_no").collect()
    assert [(r.contract_no, r.read_on) for r in stored] == [("a", date(2024, 1, 5)), ("b", None)]
    assert [p.name for p in tmp_path.iterdir()] == ["meter_reading"]


DAYS = {
    "2024-11-4": date(2024, 11, 4),
    " 2024-11-04 ": date(2024, 11, 4),
    "2024-11-04T12:30:00": date(2024, 11, 4),
    "2024-11-04 12:30:00.123Z": date(2024, 11, 4),
    "2024-11-04T23:30:00+01:00": date(2024, 11, 4),
    "2024-02-29": date(2024, 2, 29),
    **dict.fromkeys(["2024-11-04T12zz", "2024-11-04T25:99:99", "2024-11-04T", "2024-13-01", "2023-02-29", "2024", "NR", ","], None),
}


def test_whole_texts_are_days(spark):
    rows = spark.createDataFrame([(t,) for t in [*DAYS, None]], "t string").select("t", to_day(F.col("t")).alias("d"), not_a_day(F.col("t")).alias("n"))
    got = {r.t: (r.d, r.n) for r in rows.collect()}
    assert got == {t: (d, d is None) for t, d in DAYS.items()} | {None: (None, False)}


def test_inside_intervals(spark):
    draw = random.Random(1)
    spans = [("a", 1, 15), ("a", 10, 40), ("a", 100, 100), ("a", -50, -7), ("b", 1, 10**9), ("a", 5000, 70_000), ("a", 7, 3)]
    spans += [("a", 2**62, 2**63 - 1)]
    texts = [str(draw.choice([draw.randint(-60, 200), draw.randint(0, 100_000), 2**62 + draw.randint(-5, 5)])) for _ in range(300)]
    texts += ["x", None, "1.5", "-50", "-7", "-51", "100", "99", "70000", "70001", *["3"] * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = allowed.mark_inside(rows, "v", allowed.intervals(spark, spans), "a", "ok").collect()

    def inside(text):
        whole = text is not None and text.lstrip("-").isdigit()
        return whole and any(kind == "a" and first <= int(text) <= last for kind, first, last in spans)

    assert sorted(str(r.v) for r in got) == sorted(map(str, texts))
    assert all(r.ok == inside(r.v) for r in got)
    every = allowed.intervals(spark, [("a", -(2**63), 2**63 - 1)])
    assert {r.v for r in allowed.mark_inside(rows, "v", every, "a", "ok").where("not ok").collect()} == {"x", None, "1.5"}


def test_reasons_of_unknown_values(spark):
    sub = spark.createDataFrame([("1",), ("2",)], "contract_no string")
    pay = spark.createDataFrame([("1", "200", 1.0), ("1", "201", 1.0), ("9", "5", 1.0), (None, "5", 1.0), ("2", "5", -1.0)], "contract_no string, receipt_no string, amount double")
    judged = checks.check_consumption_payments(pay, sub, allowed.intervals(spark)).judged
    assert [r.reason for r in judged.orderBy("contract_no", "receipt_no").collect()] == [
        "unknown contract", None, "receipt out of range", "negative amount", "unknown contract",
    ]
    product = spark.createDataFrame([("p",)], "product string")
    use = spark.createDataFrame([("p", date(2024, 1, 1), 1.0, "n"), ("q", date(2024, 1, 1), 1.0, "n"), ("q", date(2024, 1, 1), 0.0, "n")], "product string, used_on date, qty double, note string")
    assert sorted(str(r.reason) for r in checks.check_uses(use, product).judged.collect()) == ["None", "missing field", "unknown product"]
    batch = spark.createDataFrame([(1, "n", "w", 1.0, None), (2, "n", "w", 1.0, None)], "submitted_seq long, note string, worker string, worker_pay double, done_on date")
    used = spark.createDataFrame([(1, "p", 1.0), (2, "p", 1.0), (2, "q", 1.0)], "submitted_seq long, product string, qty double")
    split = checks.split_maintenance(batch, used, product=product)
    assert [tuple(r) for r in split.items.collect()] == [(1, 1, "p", 1.0)]
    assert [r.reason for r in split.rejected.collect()] == ["unknown product"]
