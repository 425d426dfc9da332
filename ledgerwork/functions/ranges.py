"""Folds and numbers along an order over tables of any size.

`in_ranges` has Spark cut the rows into ranges of about equal row count, by split points it samples
from the order columns themselves, so sparse or crowded values make no difference. What came
before a range is folded from one summary row per range, in a tree with at most FAN children a
node. No task sees more than a range of rows or FAN summaries, and no window lacks a partition key.

The split points must be the same for rows and summaries, hence the ranges are written once, to
the checkpoint folder, when `in_ranges` is called.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwork.functions.shared import checkpoint

#: Children of a node of the fold tree.
FAN = 256
#: Equal rows are numbered in pieces of so many.
PIECE = 4096


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with `_range`, which grows along `order`, and `_place`, from 0 in each range.

    Rows equal in all order columns stay in one range: where very many may be, see `number_all`.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts the rows of a task in its low 33 bits
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return checkpoint(spread.select("*", F.spark_partition_id().alias("_range"), place.alias("_place")))


def before(ranged: DataFrame, keys: Sequence[str], value: Column, how: str, out: str) -> DataFrame:
    """Fold `value` over the earlier rows, or over those of the same `keys`.

    `ranged` comes from `in_ranges` with an order that starts with `keys`. `how` is "previous"
    (value of the row just before, NULL included), "last" (latest value that is not NULL), "sum" or
    "max"; NULL where nothing came before.
    """
    # the struct tells "no earlier row" from "earlier row holds NULL"
    rows = ranged.withColumn("_value", F.struct(value.alias("v")) if how == "previous" else value)
    cell = Window.partitionBy("_range", *keys).orderBy("_place")
    here = rows.withColumn("_here", _earlier(how, "_value", cell))
    totals = rows.groupBy(*keys, "_range").agg(_total(how, "_value", "_place").alias("_total"))
    # a key has one total in every range it reaches into, and all but the first take something over:
    # fewer rows than there are ranges, hence the broadcast
    carried = _fold(totals, keys, how, _levels(ranged)).where(F.col("_carry").isNotNull())
    marks = carried.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_range").alias("_c_range"), "_carry")
    same = [here[k].eqNullSafe(marks[f"_c_{k}"]) for k in keys] + [here["_range"] == marks["_c_range"]]
    folded = here.join(F.broadcast(marks), reduce(and_, same), "left")
    result = _combine(how, F.col("_here"), F.col("_carry"))
    return folded.select(*ranged.columns, (result["v"] if how == "previous" else result).alias(out))


def numbered(ranged: DataFrame, start: int, out: str) -> DataFrame:
    """The rows of `in_ranges` numbered `start, start + 1, ...` in their order."""
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_total"))
    carried = _fold(counts, [], "sum", _levels(ranged)).select(F.col("_range").alias("_c_range"), "_carry")
    # one row per range, hence the broadcast
    placed = ranged.join(F.broadcast(carried), F.col("_range") == F.col("_c_range"))
    number = F.lit(start) + F.coalesce("_carry", F.lit(0)) + F.col("_place")
    return placed.select(*ranged.columns, number.alias(out))


def number_all(df: DataFrame, order: Sequence[str], start: int, out: str) -> DataFrame:
    """Number any rows `start, start + 1, ...` along `order`, gap-free and the same in every run.

    Rows with equal order columns follow a hash of the whole row. Wholly equal rows may trade
    places, so they are counted before the shuffle, numbered in pieces, and repeated at the end:
    however many copies a row has, they neither meet in one task nor in one range.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_tie", F.xxhash64(*columns))
    last = F.floor((F.col("_copies") - 1) / PIECE)
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
        "_copies", F.least(F.lit(PIECE), F.col("_copies") - F.col("_piece") * PIECE)
    )
    ranged = in_ranges(pieces, [*order, "_tie", "_piece"])
    first = F.lit(start) + F.coalesce("_before", F.lit(0))
    firsts = before(ranged, [], F.col("_copies"), "sum", "_before").withColumn("_first", first)
    return firsts.repartition("_first").select(
        *columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias(out)
    )


def _levels(ranged: DataFrame) -> int:
    """Levels of a tree over the ranges, of which there are at most as many as shuffle partitions."""
    levels, reach = 1, FAN
    while reach < int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        levels, reach = levels + 1, reach * FAN
    return levels


def _fold(totals: DataFrame, keys: Sequence[str], how: str, levels: int) -> DataFrame:
    """`_carry`, the fold of `_total` over the earlier ranges of the same keys."""
    node = F.floor(F.col("_range") / FAN)
    inside = totals.withColumn("_node", node).withColumn(
        "_carry", _earlier(how, "_total", Window.partitionBy(*keys, "_node").orderBy("_range"))
    )
    if levels == 1:
        return inside
    nodes = totals.groupBy(*keys, node.alias("_range")).agg(_total(how, "_total", "_range").alias("_total"))
    above = _fold(nodes, keys, how, levels - 1).select(
        *[F.col(k).alias(f"_a_{k}") for k in keys], F.col("_range").alias("_a_node"), F.col("_carry").alias("_above")
    )
    same = [inside[k].eqNullSafe(above[f"_a_{k}"]) for k in keys] + [inside["_node"] == above["_a_node"]]
    joined = inside.join(above, reduce(and_, same), "left")
    return joined.select(*keys, "_range", _combine(how, F.col("_carry"), F.col("_above")).alias("_carry"))


def _earlier(how: str, value: str, window) -> Column:
    if how == "previous":
        return F.lag(value).over(window)
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    if how == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max}[how](value).over(frame)


def _total(how: str, value: str, order: str) -> Column:
    if how == "previous":
        return F.max_by(value, order)
    if how == "last":
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return {"sum": F.sum, "max": F.max}[how](value)


def _combine(how: str, here: Column, carry: Column) -> Column:
    if how == "sum":
        return F.coalesce(here + carry, here, carry)
    if how == "max":
        return F.greatest(here, carry)
    return F.coalesce(here, carry)
