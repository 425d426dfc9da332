"""The folds, numbers and joins that know no large key, against brute force."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerwork.functions import fill, ranges, skew
from ledgerwork.operators import checks



def keyed_rows(seed: int, n: int = 300):
    rng = random.Random(seed)
    keys = ["a"] * 6 + ["b", "c", None]
    return [
        (rng.choice(keys), i, rng.choice([None, float(rng.randint(-5, 9))])) for i in rng.sample(range(n * 3), n)
    ]


def fold(rows, how):
    """key, seq -> value folded over the earlier rows of the key"""
    result, seen = {}, {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        earlier = seen.setdefault(key, [])
        known = [v for v in earlier if v is not None]
        if how == "previous":
            result[key, seq] = earlier[-1] if earlier else None
        elif how == "last":
            result[key, seq] = known[-1] if known else None
        else:
            result[key, seq] = (sum(known) if how == "sum" else max(known)) if known else None
        earlier.append(value)
    return result


@pytest.fixture
def cut(spark):
    """Small tables in ranges of about 2 megabytes less: as many as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("fan", [2, 256])
@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("how", ["previous", "last", "sum", "max"])
def test_before(spark, cut, monkeypatch, how, keys, fan):
    monkeypatch.setattr(ranges, "FAN", fan)
    rows = [(k if keys else None, s, v) for k, s, v in keyed_rows(1)]
    df = spark.createDataFrame(rows, "key string, seq long, value double")
    ranged = ranges.in_ranges(df, [*keys, "seq"])
    assert ranged.select("_range").distinct().count() > 4
    got = ranges.before(ranged, keys, F.col("value"), how, "out")
    assert {(r.key, r.seq): r.out for r in got.collect()} == fold(rows, how)


def test_no_window_lacks_a_key(spark, cut):
    df = spark.createDataFrame(keyed_rows(2), "key string, seq long, value double")
    folded = ranges.before(ranges.in_ranges(df, ["seq"]), [], F.col("value"), "sum", "out")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("[_range#" in w or "[_node#" in w for w in windows)
    assert "SinglePartition" not in plan


def test_ranges_of_sparse_ids_are_equal(spark, cut):
    """Ids of up to 63 bits, most of them crowded at one end."""
    ids = spark.range(400_000).select(
        F.when(F.col("id") % 5 > 0, F.col("id")).otherwise(F.col("id") * 23_058_430_092_136).alias("id")
    )
    ranged = ranges.in_ranges(ids, ["id"])
    sizes = sorted(r["count"] for r in ranged.groupBy("_range").count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    numbered = ranges.numbered(ranged, 0, "n")
    assert numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 399_999, 400_000)


def test_number_all(spark, cut, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 3)
    rng = random.Random(9)
    rows = [("a", 1)] * 20 + [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None])) for _ in range(60)]
    got = ranges.number_all(spark.createDataFrame(rows, "k string, v int"), ["k", "v"], 5, "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(5, 85))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.n)] == ordered


@pytest.mark.parametrize("salt_rows", [1, 4, 1_000_000])
def test_left_join_salted(spark, salt_rows, monkeypatch):
    monkeypatch.setattr(skew, "PIECE", 2)
    rng = random.Random(3)
    keys = [("a", "x")] * 5 + [("a", None), (None, "x"), (None, None), ("b", "x"), ("c", "y")]
    left = [(*rng.choice(keys), i) for i in range(60)]
    right = [(*rng.choice(keys[:8]), 100 + i) for i in range(40)] + [("a", "x", 1)] * 7 + [("b", "x", None)] * 3
    got = skew.left_join_salted(
        spark.createDataFrame(left, "k string, m string, l long"),
        spark.createDataFrame(right, "k string, m string, r long"),
        ["k", "m"],
        salt_rows,
    ).collect()
    expected = []
    for k, m, i in left:
        found = [r for rk, rm, r in right if (rk, rm) == (k, m)]
        expected += [(k, m, i, r) for r in found or [None]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_thousands_of_large_keys(spark):
    """5,000 keys that all need several salts, without a cap on how many may."""
    left = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("l"))
    right = spark.range(25_000).select((F.col("id") % 5000).alias("k"), (F.col("id") % 10_000).alias("r"))
    joined = skew.left_join_salted(left, right, ["k"], salt_rows=2)
    assert joined.agg(F.count("r"), F.sum("l"), F.sum("r")).first()[:] == (
        25_000,
        5 * sum(range(0, 10_000, 2)),
        sum(k % 10_000 for k in range(25_000)),
    )


def test_keys_that_match_null_only_if_asked(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, l int")
    right = spark.createDataFrame([(None, 3), ("a", 4)], "k string, r int")
    joined = [{(r.l, r.r) for r in skew.left_join_salted(left, right, ["k"], match_null=m).collect()} for m in (True, False)]
    assert joined == [{(1, 3), (2, 4)}, {(1, None), (2, 4)}]


@pytest.mark.parametrize("partition", [(), ("key",)])
def test_forward_fill(spark, cut, partition):
    rows = keyed_rows(4)
    df = spark.createDataFrame(rows, "key string, seq long, value double")
    got = fill.forward_fill(df, "value", "seq", partition)
    keyed = rows if partition else [(None, s, v) for _, s, v in rows]
    seen = fold(keyed, "last")
    expected = {s: v if v is not None else seen[k if partition else None, s] for k, s, v in rows}
    assert got.columns == df.columns
    assert {r.seq: r.value for r in got.collect()} == expected


def test_number_rows(spark, cut):
    seqs = random.Random(5).sample(range(1 << 62), 120)
    df = spark.createDataFrame([(s,) for s in seqs], "seq long")
    got = fill.number_rows(df, "seq", 40, "id").collect()
    assert {r.seq: r.id for r in got} == {s: 41 + i for i, s in enumerate(sorted(seqs))}


def test_previous_index_across_days(spark):
    from ledgerwork.operators.readings import previous_index

    rng = random.Random(8)
    days = [None, *(date(2024, 1, d) for d in range(1, 9))]
    rows = [(rng.choice("aaab"), rng.choice(days), rng.choice([None, *map(float, range(9))])) for _ in range(120)]
    got = previous_index(spark.createDataFrame(rows, "k string, read_on date, index_m3 double"), "k")
    assert " Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    expected = []
    for key in "ab":
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or days[1], r[2] is not None, r[2] or 0))
        expected += [(*r, mine[i - 1][2] if i else None) for i, r in enumerate(mine)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def walk(credit, batch):
    """Accepted sequence numbers, one row at a time."""
    left, accepted = dict(credit), set()
    for contract, seq, amount in sorted(batch, key=lambda r: r[1]):
        if left.get(contract) is not None and amount <= left[contract]:
            left[contract] -= amount
            accepted.add(seq)
    return accepted


@pytest.mark.parametrize("fold_rows", [0, 12, 1_000_000])
def test_membership_payments_match_a_walk(spark, fold_rows):
    rng = random.Random(6)
    credit = {"a": 1000.0, "b": 37.0, "c": 0.0, "d": None, "e": 0.5}
    batch = [
        (rng.choice("aaaaabcde"), i, float(rng.choice([0, 1, 2, 3, 40, 90, 200, 999, 0.25, 64, 128])))
        for i in range(150)
    ]
    sub = spark.createDataFrame([(c, c, f) for c, f in credit.items()], "contract_no string, name string, joining_fee double")
    mpay = spark.createDataFrame([], "contract_no string, amount double")
    df = spark.createDataFrame(batch, "contract_no string, submitted_seq long, amount double")
    df = df.withColumn("receipt_no", F.lit("1")).withColumn("paid_on", F.lit("2024-01-01").cast("date"))
    checked = checks.check_membership_payments(df, sub, mpay, fold_rows)
    assert {r.submitted_seq for r in checked.accepted.collect()} == walk(credit, batch)
    assert checked.judged.count() == len(batch)


@pytest.mark.parametrize("fold_rows", [0, 3, 1_000_000])
def test_membership_payments_in_cents_match_a_decimal_walk(spark, fold_rows):
    rng = random.Random(16)
    names = [f"c{k}" for k in range(20)]
    credit = {c: Decimal(rng.randrange(0, 3000)) / 100 for c in names} | {"c0": Decimal("15.95")}
    fixed = "2.96 1.81 2.36 1.38 2.81 0.03 1.97 2.63 0.67 2.66 2.88 1.06 2.19 0.29".split()
    batch = [("c0", i, Decimal(a)) for i, a in enumerate(fixed)]
    batch += [(rng.choice(names[1:]), 100 + i, Decimal(rng.randrange(0, 400)) / 100) for i in range(200)]
    sub = spark.createDataFrame(
        [(c, c, float(f)) for c, f in credit.items()], "contract_no string, name string, joining_fee double"
    )
    mpay = spark.createDataFrame([], "contract_no string, amount double")
    df = spark.createDataFrame(
        [(c, s, float(a)) for c, s, a in batch], "contract_no string, submitted_seq long, amount double"
    )
    df = df.withColumn("receipt_no", F.lit("1")).withColumn("paid_on", F.lit("2024-01-01").cast("date"))
    accepted = checks.check_membership_payments(df, sub, mpay, fold_rows).accepted
    assert {r.submitted_seq for r in accepted.collect()} == walk(credit, batch)
