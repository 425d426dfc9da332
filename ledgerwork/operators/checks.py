"""Checks of submitted batches. Each function returns the judged rows (see `Checked`).

The first rule a row breaks is its reason. Rows of one batch are judged in `submitted_seq`
order where an earlier row matters; `submitted_seq` is unique within a batch.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.allowed import mark_inside, mark_known
from ledgerwork.functions.fill import number_rows
from ledgerwork.functions.ranges import before, in_ranges, number_all
from ledgerwork.functions.shared import Tables, checkpoint
from ledgerwork.functions.text import is_blank
from ledgerwork.operators.members import membership_credit
from ledgerwork.operators.readings import last_reading
from ledgerwork.sources.tables import in_range

# Fees of entered readings and payments, and the block numbers in use.
ENTRY_MGMT_FEE = 10.0
ENTRY_LOSS_FEE = 5.0
FIRST_BLOCK, LAST_BLOCK = 1, 15
# A contract with so many payments at most is settled as one array; larger ones in rounds over all rows.
FOLD_ROWS = 500


class Checked(NamedTuple):
    """All rows of a batch with `reason`, NULL where the row is accepted."""

    judged: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.judged.where(F.col("reason").isNull()).drop("reason")

    @property
    def rejected(self) -> DataFrame:
        return self.judged.where(F.col("reason").isNotNull())


def judge(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """Add `reason`: that of the first rule that is true, NULL if none is."""
    return df.withColumn("reason", F.coalesce(*[F.when(broken, F.lit(reason)) for broken, reason in rules]))


def _any(test, *columns: str) -> Column:
    broken = test(F.col(columns[0]))
    for column in columns[1:]:
        broken = broken | test(F.col(column))
    return broken


def _negative(column: str) -> Column:
    return F.coalesce(F.col(column) < 0, F.lit(True))


def check_subscribers(batch: DataFrame, sub: DataFrame) -> Checked:
    """New subscribers: fields filled (the meter number may be empty), fee not negative, known
    block, contract not in the table nor accepted earlier in the batch."""
    existing = sub.select("contract_no").distinct().withColumn("_exists", F.lit(True))
    own = judge(
        batch.join(existing, "contract_no", "left"),
        (
            _any(is_blank, "contract_no", "id_card", "block_no", "name", "joining_fee", "joined_on", "address"),
            "missing field",
        ),
        (_negative("joining_fee"), "negative fee"),
        (~in_range(F.col("block_no"), FIRST_BLOCK, LAST_BLOCK), "unknown block"),
        (F.col("_exists").isNotNull(), "contract exists"),
    )
    # the first row that passes the other rules takes the contract
    takes = F.when(F.col("reason").isNull(), F.col("submitted_seq"))
    first = own.groupBy("contract_no").agg(F.min(takes).alias("_first"))
    repeated = F.when(F.col("submitted_seq") > F.col("_first"), F.lit("contract repeated in batch"))
    judged = own.join(first, "contract_no", "left").withColumn("reason", F.coalesce("reason", repeated))
    return Checked(judged.select(*batch.columns, "reason"))


def check_readings(batch: DataFrame, reading: DataFrame, sub: DataFrame | None = None) -> Checked:
    """New readings: known contract (with `sub`), index not negative, and an earlier reading to count from.

    The previous index is that of the latest reading by date, in the table or accepted earlier
    in the batch.
    """
    last = last_reading(reading).select(
        "contract_no", F.struct(F.col("last_read_on").alias("read_on"), F.col("last_index").alias("index_m3")).alias("_last")
    )
    known = _known(batch, "contract_no", sub).join(last, "contract_no", "left")
    # rows of a contract without any reading are all turned away, so they hand nothing on
    counts = (F.col("index_m3") >= 0) & F.col("_last").isNotNull()
    entered = F.when(counts, F.struct("read_on", "index_m3"))
    seen = before(in_ranges(known, ["contract_no", "submitted_seq"]), ["contract_no"], entered, "max", "_seen")
    judged = judge(
        seen.withColumn("prev_index", F.greatest("_last", "_seen")["index_m3"])
        .withColumn("mgmt_fee", F.lit(ENTRY_MGMT_FEE))
        .withColumn("loss_fee", F.lit(ENTRY_LOSS_FEE)),
        (~F.col("_known"), "unknown contract"),
        (_negative("index_m3"), "negative index"),
        (F.col("_last").isNull(), "no earlier reading"),
    )
    return Checked(judged.select(*batch.columns, "prev_index", "mgmt_fee", "loss_fee", "reason"))


def check_membership_payments(
    batch: DataFrame,
    sub: DataFrame,
    mpay: DataFrame,
    fold_rows: int = FOLD_ROWS,
    receipts: DataFrame | None = None,
) -> Checked:
    """Membership payments: fields filled, receipt in the `receipts` intervals if these are given,
    and amount within the credit still open.

    Amounts are held against the credit in whole cents, so the answer depends neither on the size
    of a contract nor on the order in which sums are made. Accepting a payment lowers the credit
    that later payments of the contract are held against. Rows that share their entry number are
    turned away, as their order is not known.

    Most contracts need no order: all their candidates fit together. The others are folded over a
    sorted array, one expression per contract, up to `fold_rows` candidates; beyond that they go
    through `_accept_in_rounds`. The judged rows are checkpointed, so nothing before runs again.
    """
    credit = membership_credit(sub, mpay).select("contract_no", F.col("credit").alias("_credit"))
    repeated = batch.groupBy("submitted_seq").agg(F.count(F.lit(1)).alias("_entries")).where("_entries > 1")
    own = judge(
        _receipted(batch, receipts, "membership receipt")
        .join(credit, "contract_no", "left")
        .join(repeated, "submitted_seq", "left"),
        (_any(is_blank, "contract_no", "receipt_no", "amount", "paid_on"), "missing field"),
        (~F.col("_receipted"), "receipt out of range"),
        (_negative("amount"), "negative amount"),
        (F.col("_entries").isNotNull(), "entry number repeated"),
        (F.col("_credit").isNull(), "no credit known"),
        (_cents("amount") > _cents("_credit"), "amount exceeds credit"),
    )
    own = checkpoint(own.select(*batch.columns, "reason", _cents("amount").alias("_amount"), _cents("_credit").alias("_credit")))
    # credit only shrinks: an amount above the opening credit can never be taken
    candidates = own.where(F.col("reason").isNull()).select("contract_no", "submitted_seq", "_amount", "_credit")
    totals = candidates.groupBy("contract_no").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_amount").alias("_sum"), F.max("_credit").alias("_open")
    )
    fits = F.col("_sum") <= F.col("_open")
    sized = candidates.join(totals, "contract_no")
    key = ["contract_no", "submitted_seq"]
    taken = (
        sized.where(fits)
        .select(*key)
        .unionByName(_accept_in_order(sized.where(~fits & (F.col("_rows") <= fold_rows))))
        .unionByName(_accept_in_rounds(sized.where(~fits & (F.col("_rows") > fold_rows))))
        .withColumn("_taken", F.lit(True))
    )
    exceeds = F.when(F.col("_taken").isNull(), F.lit("amount exceeds credit"))
    judged = own.join(taken, key, "left").withColumn("reason", F.coalesce("reason", exceeds))
    return Checked(judged.select(*batch.columns, "reason"))


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _accept_in_order(rows: DataFrame) -> DataFrame:
    """Take a payment if it fits what is left: a fold over the contract's payments in their order."""
    batch = rows.groupBy("contract_no").agg(
        F.max("_credit").alias("_credit"), F.sort_array(F.collect_list(F.struct("submitted_seq", "_amount"))).alias("_entries")
    )
    none = F.array().cast("array<bigint>")

    def take(state: Column, entry: Column) -> Column:
        fits = entry["_amount"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - entry["_amount"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.array_append(state["taken"], entry["submitted_seq"])).otherwise(state["taken"]).alias("taken"),
        )

    start = F.struct(F.col("_credit").alias("left"), none.alias("taken"))
    return batch.select(
        "contract_no", F.explode(F.aggregate("_entries", start, take, lambda state: state["taken"])).alias("submitted_seq")
    )


def _accept_in_rounds(rows: DataFrame) -> DataFrame:
    """The same acceptance for contracts of any size, in rounds over all of them.

    Take a contract whose open credit lies in [2^k, 2^(k+1)). While it does, payments below
    2^k always fit, and those of 2^(k+1) or more never do. The first payment that leaves less
    than 2^k open is found from a running sum: a small one that brings the sum over the line,
    or one of at least 2^k that fits what the small ones before it left. Everything up to it is
    settled and the contract moves on to a lower power of two; no such payment settles it
    whole. So there are at most as many rounds as powers of two between the largest credit and
    the smallest amount, whatever the number of rows.

    The state between rounds is a table in the shared folder (contract, open credit, last settled
    entry, smallest amount); the state before it is removed. The rows are ordered once.
    """
    tables = Tables(rows.sparkSession)
    key = ["contract_no", "submitted_seq"]
    # amounts of zero always fit
    zeros = rows.where(F.col("_amount") == 0).select(*key)
    payments = in_ranges(rows.where(F.col("_amount") > 0).select(*key, "_amount", "_credit"), key)
    start = payments.groupBy("contract_no").agg(
        F.max("_credit").alias("left"), F.lit(None).cast("long").alias("after"), F.min("_amount").alias("low")
    )
    payments = payments.drop("_credit")
    state = tables.keep(start.where(F.col("left") >= F.col("low")), "state0")
    amount, line = F.col("_amount"), F.col("_line")
    taken, done = zeros, 0
    while not state.isEmpty():
        # the highest power of two that the open credit holds, exactly
        lined = state.withColumn("_line", F.expr("shiftleft(1L, length(bin(left)) - 1)"))
        live = payments.join(lined, "contract_no").where(
            (F.col("after").isNull() | (F.col("submitted_seq") > F.col("after"))) & (amount < 2 * line)
        )
        summed = before(live, ["contract_no"], F.when(amount < line, amount).otherwise(0), "sum", "_before")
        still_open = F.col("left") - F.coalesce("_before", F.lit(0))
        step = tables.keep(summed.select(*key, "_amount", "_line", "low", still_open.alias("_open")), f"step{done}")
        rest = F.col("_open") - amount
        tips = (F.col("_open") >= line) & (rest >= 0) & (rest < line)
        first = F.min(F.struct(F.col("submitted_seq").alias("after"), rest.alias("left"), "low"))
        stops = step.where(tips).groupBy("contract_no").agg(first.alias("at")).select("contract_no", "at.*")
        reached = step.join(stops.select("contract_no", "after"), "contract_no", "left").where(
            F.col("after").isNull() | (F.col("submitted_seq") <= F.col("after"))
        )
        fit = reached.where((amount < line) | (F.col("submitted_seq") == F.col("after")))
        taken = taken.unionByName(tables.keep(fit.select(*key), f"taken{done}"))
        done += 1
        state = tables.keep(stops.where(F.col("left") >= F.col("low")), f"state{done}")
        tables.remove(f"state{done - 1}")
        tables.remove(f"step{done - 1}")
    return taken


def check_consumption_payments(
    batch: DataFrame, sub: DataFrame | None = None, receipts: DataFrame | None = None
) -> Checked:
    """Consumption payments: amount not negative, and as far as the tables are given, known contract and
    receipt in the allowed intervals; the entry fees are added, no credit limit."""
    entered = batch.withColumn("mgmt_fee", F.lit(ENTRY_MGMT_FEE)).withColumn("loss_fee", F.lit(ENTRY_LOSS_FEE))
    judged = judge(
        _receipted(_known(entered, "contract_no", sub), receipts, "consumption receipt"),
        (~F.col("_known"), "unknown contract"),
        (_negative("amount"), "negative amount"),
        (~F.col("_receipted"), "receipt out of range"),
    )
    return Checked(judged.select(*entered.columns, "reason"))


def _known(batch: DataFrame, column: str, table: DataFrame | None) -> DataFrame:
    """Add `_known`: the value is in the same column of the table; true of all rows without a table."""
    if table is None:
        return batch.withColumn("_known", F.lit(True))
    return mark_known(batch, column, table, column, "_known")


def _receipted(batch: DataFrame, receipts: DataFrame | None, kind: str) -> DataFrame:
    """Add `_receipted`: the receipt is in an interval of the kind; true of all rows without intervals."""
    if receipts is None:
        return batch.withColumn("_receipted", F.lit(True))
    return mark_inside(batch, "receipt_no", receipts, kind, "_receipted")


def check_block_readings(batch: DataFrame) -> Checked:
    return Checked(
        judge(
            batch,
            (~in_range(F.col("block_no"), FIRST_BLOCK, LAST_BLOCK), "unknown block"),
            (_negative("index_m3"), "negative index"),
        )
    )


def check_purchases(batch: DataFrame, product: DataFrame | None = None) -> Checked:
    """Purchases: all six fields given and not zero, known product (with the table); the amount is added."""
    required = ("product", "bought_on", "qty", "unit_price", "receipt_no", "vendor")
    priced = batch.withColumn("amount", F.col("qty") * F.col("unit_price"))
    return _check_products(priced, product, _missing(batch, required), "qty", "unit_price")


def check_uses(batch: DataFrame, product: DataFrame | None = None) -> Checked:
    """Uses: all four fields given and not zero, known product (with the table); stock on hand is not a limit."""
    required = ("product", "used_on", "qty", "note")
    return _check_products(batch, product, _missing(batch, required), "qty")


def _check_products(batch: DataFrame, product: DataFrame | None, missing: Column, *amounts: str) -> Checked:
    unknown = (~F.col("_known"), "unknown product")
    judged = judge(_known(batch, "product", product), (missing, "missing field"), unknown, *_not_below_zero(*amounts))
    return Checked(judged.select(*batch.columns, "reason"))


def check_supplier_bills(batch: DataFrame) -> Checked:
    """Supplier bills: month and amount given; the month is kept as its first day."""
    monthly = batch.withColumn("month", F.trunc("month", "month").cast("date"))
    return Checked(
        judge(monthly, (_missing(batch, ("month", "amount_due")), "missing field"), *_not_below_zero("amount_due"))
    )


def check_supplier_payments(batch: DataFrame) -> Checked:
    monthly = batch.withColumn("month", F.trunc("month", "month").cast("date"))
    required = ("month", "amount", "receipt_no", "paid_on")
    return Checked(judge(monthly, (_missing(batch, required), "missing field"), *_not_below_zero("amount")))


def _missing(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """Numbers may not be zero, text may not be empty, nothing may be NULL."""
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer")}
    broken = F.lit(False)
    for name in columns:
        column = F.col(name)
        broken = broken | column.isNull() | (column == 0 if name in numbers else column.cast("string") == "")
    return broken


def _not_below_zero(*columns: str) -> list[tuple[Column, str]]:
    return [(F.col(c) < 0, f"negative {c}") for c in columns]


class MaintenanceSplit:
    """Judged entries and their lines; ids are given when `jobs` or `items` are first read."""

    def __init__(self, judged: DataFrame, lines: DataFrame, max_job_id: int, max_detail_id: int) -> None:
        self.judged, self.lines = judged, lines
        self.max_job_id, self.max_detail_id = max_job_id, max_detail_id

    @cached_property
    def _numbered(self) -> DataFrame:
        good = self.judged.where(F.col("reason").isNull())
        entries = good.select("submitted_seq", "done_on", "note", "worker", "worker_pay")
        return number_rows(entries, "submitted_seq", self.max_job_id, "job_id")

    @property
    def jobs(self) -> DataFrame:
        return self._numbered.select("job_id", "done_on", "note", "worker", "worker_pay")

    @cached_property
    def items(self) -> DataFrame:
        ids = self._numbered.select("submitted_seq", "job_id")
        placed = self.lines.join(ids, "submitted_seq").select("job_id", "product", "qty")
        numbered = number_all(placed, ["job_id", "product", "qty"], self.max_detail_id + 1, "detail_id")
        return numbered.select("detail_id", "job_id", "product", "qty")

    @property
    def rejected(self) -> DataFrame:
        return self.judged.where(F.col("reason").isNotNull())


def item_lines(batch: DataFrame) -> DataFrame:
    """The item lists of a batch (array of product, qty) as lines keyed by submitted_seq."""
    return batch.select("submitted_seq", F.inline("items"))


def split_maintenance(
    batch: DataFrame, lines: DataFrame, max_job_id: int = 0, max_detail_id: int = 0, product: DataFrame | None = None
) -> MaintenanceSplit:
    """Maintenance entries to job rows and detail rows that share the new job id.

    `batch`: submitted_seq, done_on, note, worker, worker_pay; `lines`: submitted_seq,
    product, qty (see `item_lines`). A job needs a note, a worker, pay not below zero and at
    least one line, all of them with a known product if the table is given. Job ids follow `submitted_seq`, detail ids job, product and quantity, both without
    gaps, numbered over ranges of equal row count: a job may have any number of lines.
    """
    counted = (
        _known(lines, "product", product)
        .groupBy("submitted_seq")
        .agg(F.count(F.lit(1)).alias("_lines"), F.count_if(~F.col("_known")).alias("_unknown"))
    )
    judged = judge(
        batch.join(counted, "submitted_seq", "left"),
        (_any(is_blank, "note", "worker"), "missing field"),
        (_negative("worker_pay"), "negative pay"),
        (F.col("_lines").isNull(), "no material"),
        (F.col("_unknown") > 0, "unknown product"),
    )
    return MaintenanceSplit(judged.select(*batch.columns, "reason"), lines, max_job_id, max_detail_id)
