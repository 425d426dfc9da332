"""The domain tables, derived in full from the driver's order and customer tables.

An order month of a customer is a meter reading, a nation is a block, an order is a payment,
a line item is a purchase, a use or a material. Amounts are whole-number doubles, so sums do
not depend on order. The windows below run on one row per key and month, which bounds their
partitions by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHEET_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


class Tables:
    """Domain tables over one data folder; every property builds a fresh lazy plan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def order_usage(self) -> DataFrame:
        """Orders with their summed quantity; the lines are summed before the join."""
        lines = self.source("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
        orders = self.source("orders").select(
            "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_day"), "o_orderpriority"
        )
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")

    @property
    def subscriber(self) -> DataFrame:
        paid = (
            self.source("orders")
            .where(F.col("o_orderstatus") == "F")
            .groupBy("o_custkey")
            .agg(F.sum(F.round("o_totalprice")).alias("paid"))
        )
        fee = F.coalesce("paid", F.lit(0.0)) + (F.col("c_custkey") % 3) * 100.0
        people = self.source("customer").join(paid, F.col("o_custkey") == F.col("c_custkey"), "left")
        return people.select(
            F.col("c_custkey").cast("string").alias("contract_no"),
            F.lit(None).cast("string").alias("id_card"),
            F.col("c_nationkey").cast("string").alias("block_no"),
            F.lit(None).cast("string").alias("meter_no"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_custkey") % 50 != 49, fee).alias("joining_fee"),
            F.lit(None).cast("date").alias("joined_on"),
            F.lit(None).cast("string").alias("address"),
        )

    @property
    def membership_payment(self) -> DataFrame:
        return (
            self.source("orders")
            .where(F.col("o_orderstatus") == "F")
            .select(
                F.col("o_custkey").cast("string").alias("contract_no"),
                F.col("o_orderkey").cast("string").alias("receipt_no"),
                F.round("o_totalprice").alias("amount"),
                F.to_date("o_orderdate").alias("paid_on"),
            )
        )

    @property
    def monthly_usage(self) -> DataFrame:
        return self.order_usage.groupBy(
            F.col("o_custkey").cast("string").alias("contract_no"),
            F.trunc("order_day", "month").alias("read_on"),
        ).agg(F.sum("q").alias("used"))

    @property
    def meter_reading(self) -> DataFrame:
        by_month = Window.partitionBy("contract_no").orderBy("read_on")
        index = F.sum("used").over(by_month.rowsBetween(Window.unboundedPreceding, 0))
        return (
            self.monthly_usage.withColumn("index_m3", index)
            .withColumn("prev_index", F.lag("index_m3").over(by_month))
            .select(
                "contract_no",
                "read_on",
                "index_m3",
                "prev_index",
                F.when(F.col("read_on") >= F.lit("1996-03-01").cast("date"), 10.0).otherwise(0.0).alias("mgmt_fee"),
                F.when(F.col("read_on") >= F.lit("1996-07-01").cast("date"), 5.0).otherwise(0.0).alias("loss_fee"),
            )
        )

    @property
    def consumption_payment(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        q = F.col("q")
        amount = (
            F.when(priority == "2-HIGH", 7 * q + 15)
            .when(priority == "3-MEDIUM", 3 * q)
            .when(priority == "5-LOW", 7 * q + 20)
            .otherwise(7 * q)
        )
        copies = F.explode(F.when(priority == "3-MEDIUM", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        return (
            self.order_usage.where(priority != "1-URGENT")
            .withColumn("k", copies)
            .select(
                F.col("o_custkey").cast("string").alias("contract_no"),
                F.col("o_orderkey").cast("string").alias("receipt_no"),
                amount.alias("amount"),
                F.trunc("order_day", "month").alias("due_on"),
                F.when(priority != "4-NOT SPECIFIED", F.date_add("order_day", 10)).alias("settled_on"),
                F.lit(10.0).alias("mgmt_fee"),
                F.lit(5.0).alias("loss_fee"),
            )
        )

    @property
    def block_reading(self) -> DataFrame:
        by_month = Window.partitionBy("block_no").orderBy("read_on").rowsBetween(Window.unboundedPreceding, 0)
        blocks = self.source("customer").select(
            F.col("c_custkey").cast("string").alias("contract_no"), F.col("c_nationkey").cast("string").alias("block_no")
        )
        used = self.monthly_usage.join(blocks, "contract_no").groupBy("block_no", "read_on").agg(F.sum("used").alias("used"))
        return used.select("block_no", "read_on", F.sum(F.col("used") + 2).over(by_month).alias("index_m3"))

    @property
    def product(self) -> DataFrame:
        """The parts, and beside every fiftieth one that is neither bought nor used."""
        key = F.col("p_partkey").cast("string")
        names = F.when(F.col("p_partkey") % 50 == 0, F.array(key, F.concat(F.lit("spare "), key))).otherwise(F.array(key))
        return self.source("part").select(F.explode(names).alias("product"))

    @property
    def purchase(self) -> DataFrame:
        return (
            self.source("lineitem")
            .where(F.col("l_returnflag") == "A")
            .select(
                F.col("l_orderkey").alias("purchase_id"),
                F.col("l_partkey").cast("string").alias("product"),
                F.to_date("l_shipdate").alias("bought_on"),
                F.col("l_quantity").alias("qty"),
                F.round("l_extendedprice").alias("unit_price"),
                F.col("l_orderkey").cast("string").alias("receipt_no"),
                F.col("l_suppkey").cast("string").alias("vendor"),
            )
        )

    @property
    def product_use(self) -> DataFrame:
        return (
            self.source("lineitem")
            .where(F.col("l_returnflag") == "R")
            .select(
                F.col("l_partkey").cast("string").alias("product"),
                F.to_date("l_shipdate").alias("used_on"),
                F.col("l_quantity").alias("qty"),
                F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("note"),
            )
        )

    @property
    def supplier_bill(self) -> DataFrame:
        return (
            self.source("lineitem")
            .groupBy(F.trunc("l_shipdate", "month").alias("month"))
            .agg(F.sum("l_quantity").alias("index_m3"), F.sum(F.round("l_extendedprice")).alias("amount_due"))
            .withColumn("invoice_no", F.concat(F.lit("F"), F.date_format("month", "yyyyMM")))
        )

    @property
    def supplier_payment(self) -> DataFrame:
        part = F.month("month") % 3
        times = F.explode(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), part.cast("int")))
        stamp = F.date_format("month", "yyyyMM")
        return (
            self.supplier_bill.withColumn("k", times)
            .select(
                (stamp.cast("long") * 10 + F.col("k")).alias("payment_id"),
                "month",
                F.when(part == 1, F.col("amount_due")).otherwise(F.floor(F.col("amount_due") / 2).cast("double")).alias("amount"),
                F.concat(F.lit("R"), stamp, F.lit("-"), F.col("k").cast("string")).alias("receipt_no"),
                F.date_add("month", 20).alias("paid_on"),
            )
        )

    @property
    def maintenance(self) -> DataFrame:
        return (
            self.source("orders")
            .where(F.col("o_orderpriority") == "1-URGENT")
            .select(
                F.col("o_orderkey").alias("job_id"),
                F.to_date("o_orderdate").alias("done_on"),
                F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("note"),
                F.concat(F.lit("worker "), F.col("o_custkey").cast("string")).alias("worker"),
                F.round("o_totalprice").alias("worker_pay"),
            )
        )

    @property
    def maintenance_detail(self) -> DataFrame:
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            F.col("l_partkey").cast("string").alias("product"),
            F.col("l_quantity").alias("qty"),
        )

    @property
    def raw_payment(self) -> DataFrame:
        """A dirty payment sheet: totals, marks for dates, missing cells, second parts without month."""
        key = F.col("o_orderkey")
        copies = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        settled = (
            F.when(key % 41 == 0, "NR")
            .when(key % 43 == 0, ",")
            .when(key % 47 != 0, F.col("order_day").cast("string"))
        )
        receipt = F.when(key % 13 == 0, "nan").when(key % 29 != 0, F.concat((key + 1000).cast("string"), F.lit(".0")))
        amount = (
            F.when(key % 17 == 0, F.lit(None).cast("double"))
            .when(key % 19 == 0, 0.0)
            .when(key == 5003, -16831.0)
            .otherwise(F.col("q") * 7)
        )
        return self.order_usage.withColumn("k", F.explode(copies)).select(
            (key * 10 + F.col("k")).alias("row_no"),
            F.when(key % 97 == 0, "Total du mois").otherwise(F.col("o_custkey").cast("string")).alias("contract_raw"),
            F.when(F.col("k") == 1, F.trunc("order_day", "month").cast("string")).alias("due_raw"),
            settled.alias("settled_raw"),
            receipt.alias("receipt_raw"),
            F.when(key % 11 != 0, "10.0").alias("mgmt_raw"),
            F.when(key % 7 != 0, "5.0").alias("loss_raw"),
            amount.cast("string").alias("amount_raw"),
        )

    @property
    def payment_fixes(self) -> DataFrame:
        """Cells put right by hand: the date of every high-priority order marked with a comma."""
        return (
            self.source("orders")
            .where((F.col("o_orderkey") % 43 == 0) & (F.col("o_orderpriority") == "2-HIGH"))
            .select(
                (F.col("o_orderkey") * 10 + 1).alias("row_no"),
                F.date_format("o_orderdate", "yyyy-M-d").alias("settled_raw"),
            )
        )

    @property
    def wide_payment(self) -> DataFrame:
        """A sheet of all months with thousands commas, `n/a` cells and missing dates; a customer has as many rows
        as orders in its busiest month of the year."""
        month = F.month("order_day")
        place = Window.partitionBy("o_custkey", month).orderBy("o_orderkey")
        rows = self.order_usage.withColumn("_row", F.row_number().over(place))
        columns = []
        for number, name in enumerate(SHEET_MONTHS, 1):
            q = F.col("q").cast("int").cast("string")
            amount = q
            if name == "mar":
                amount = (
                    F.when(F.col("o_custkey") % 23 == 0, "n/a")
                    .when(F.col("q") > 100, F.concat(F.lit("1,"), q))
                    .otherwise(q)
                )
            day = F.col("order_day").cast("string")
            if name == "apr":
                day = F.when(F.col("o_custkey") % 29 != 0, day)
            # one order a cell
            columns += [
                F.max(F.when(month == number, value)).alias(f"{kind}_{name}")
                for kind, value in (("amount", amount), ("receipt", F.col("o_orderkey").cast("string")), ("date", day))
            ]
        sheet = rows.groupBy("o_custkey", "_row").agg(*columns)
        return sheet.select(F.col("o_custkey").cast("string").alias("contract_no"), *sheet.columns[2:])

    @property
    def index_sheet(self) -> DataFrame:
        """One sheet row per contract and year with the index of every month; December is that of the year before."""
        december = F.month("read_on") == 12
        sheet = F.year("read_on") + F.when(december, 1).otherwise(0)
        cells = [
            F.max(F.when(F.month("read_on") == number, F.col("index_m3"))).cast("string").alias(name)
            for number, name in enumerate(SHEET_MONTHS, 1)
        ]
        grouped = self.meter_reading.groupBy(F.col("contract_no").alias("_contract"), sheet.alias("_year")).agg(*cells)
        contract = F.concat("_contract", F.lit("/"), F.col("_year").cast("string"))
        return grouped.select(contract.alias("contract_raw"), *SHEET_MONTHS)

    @property
    def reading_fixes(self) -> DataFrame:
        """Corrections: first readings count from zero; urgent orders then set their month."""
        first = self.meter_reading.where(F.col("prev_index").isNull()).select(
            F.lit(-1).cast("long").alias("seq"),
            "contract_no",
            "index_m3",
            F.lit(None).cast("date").alias("read_on"),
            F.lit(0.0).alias("prev_index"),
        )
        urgent = (
            self.source("orders")
            .where(F.col("o_orderpriority") == "1-URGENT")
            .select(
                F.col("o_orderkey").alias("seq"),
                F.col("o_custkey").cast("string").alias("contract_no"),
                F.lit(None).cast("double").alias("index_m3"),
                F.trunc("o_orderdate", "month").alias("read_on"),
                F.round(F.col("o_totalprice") / 1000).alias("prev_index"),
            )
        )
        return first.unionByName(urgent)

    @property
    def raw_subscriber(self) -> DataFrame:
        return self.subscriber.select(
            F.col("contract_no").alias("contract_raw"), "name", F.col("joining_fee").cast("string").alias("fee_raw")
        )

    @property
    def raw_membership(self) -> DataFrame:
        """The office sheet: receipts divisible by 3 went to the office, next to the collector."""
        key = F.col("o_orderkey")
        amount = F.when(key % 31 == 0, "x").otherwise(F.round("o_totalprice").cast("string"))
        return (
            self.source("orders")
            .where(F.col("o_orderstatus") == "F")
            .select(
                key.alias("row_no"),
                F.when(key % 37 != 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("contract_raw"),
                F.when(key % 9 != 0, F.to_date("o_orderdate").cast("string")).alias("paid_raw"),
                key.cast("string").alias("receipt_raw"),
                F.when(key % 3 == 0, amount).alias("amount_raw"),
                F.when(key % 3 == 1, amount).alias("collector_amount_raw"),
            )
        )

    @property
    def raw_previous(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.source("orders")
            .where((F.col("o_orderstatus") == "F") & (key % 3 == 2))
            .select(
                F.when(key % 37 != 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("contract_raw"),
                F.round("o_totalprice").cast("string").alias("amount_raw"),
            )
        )

    @property
    def subscriber_batch(self) -> DataFrame:
        """All customers as new subscribers, some of them twice, with gaps in names and odd blocks."""
        key = F.col("c_custkey")
        once = self.source("customer").select(
            "*",
            F.explode(F.when(key % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        )
        return once.select(
            (key + F.col("again") * 1_000_000_000).alias("submitted_seq"),
            key.cast("string").alias("contract_no"),
            F.concat(F.lit("ID"), key.cast("string")).alias("id_card"),
            F.col("c_nationkey").cast("string").alias("block_no"),
            F.lit(None).cast("string").alias("meter_no"),
            F.when(key % 37 == 0, "").otherwise(F.col("c_name")).alias("name"),
            F.round("c_acctbal").alias("joining_fee"),
            F.lit("2024-01-01").cast("date").alias("joined_on"),
            F.col("c_mktsegment").alias("address"),
        )

    @property
    def reading_batch(self) -> DataFrame:
        """The readings since 2001 of every contract (see `older_reading`), with some bad indexes, and those of
        every 17th contract again as contract `N..`, which has no reading yet."""
        recent = self.meter_reading.where(F.col("read_on") >= F.lit("2001-01-01").cast("date"))
        key = F.col("contract_no").cast("long")
        months = F.year("read_on") * 12 + F.month("read_on")
        batch = recent.select(
            (months.cast("long") * 1_000_000_000 + key).alias("submitted_seq"),
            "contract_no",
            F.when((key % 13 == 0) & (F.month("read_on") == 2), F.lit(-1.0)).otherwise(F.col("index_m3")).alias("index_m3"),
            "read_on",
        )
        again = batch.where(key % 17 == 0).select(
            (F.col("submitted_seq") + 1_000_000_000_000_000).alias("submitted_seq"),
            F.concat(F.lit("N"), "contract_no").alias("contract_no"),
            "index_m3",
            "read_on",
        )
        return batch.unionByName(again)

    @property
    def older_reading(self) -> DataFrame:
        return self.meter_reading.where(F.col("read_on") < F.lit("2001-01-01").cast("date"))

    @property
    def known_contract(self) -> DataFrame:
        """The subscribers, and every second of the `N..` contracts of `reading_batch`."""
        new = self.subscriber.where(F.col("contract_no").cast("long") % 34 == 0)
        return self.subscriber.select("contract_no").unionByName(
            new.select(F.concat(F.lit("N"), "contract_no").alias("contract_no"))
        )

    @property
    def payment_batch(self) -> DataFrame:
        """The consumption payments with some negative amounts, receipts of which half are in the book, and
        those of every 23rd receipt again under a contract nobody has."""
        key = F.col("receipt_no").cast("long")
        rows = self.consumption_payment
        amount = F.when(key % 11 == 0, -F.col("amount")).otherwise(F.col("amount"))
        batch = rows.withColumns({"amount": amount, "receipt_no": (key % 400).cast("string")})
        lost = rows.where(key % 23 == 0).withColumn("contract_no", F.concat(F.lit("L"), "contract_no"))
        return batch.unionByName(lost)

    @property
    def membership_batch(self) -> DataFrame:
        """The payments with odd receipts and some cents, every third of them doubled."""
        key = F.col("receipt_no").cast("long")
        amount = F.col("amount") + (key % 100) / 100
        return self.membership_payment.where(key % 2 == 1).select(
            key.alias("submitted_seq"),
            "contract_no",
            F.when(key % 11 != 0, F.col("receipt_no")).alias("receipt_no"),
            F.when(key % 3 == 0, amount * 2).otherwise(amount).alias("amount"),
            "paid_on",
        )

    @property
    def paid_before(self) -> DataFrame:
        return self.membership_payment.where(F.col("receipt_no").cast("long") % 2 == 0)
