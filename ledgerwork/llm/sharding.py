"""Shards by a Feistel permutation of global row numbers, in DataFrame functions only.

The rows are numbered 0 to n - 1 in the order of their ids. A Feistel network over the grid of
a x b cells, the smallest near-square one that holds n, permutes the numbers; a result of n or more is
permuted again until it is less than n (cycle walking), which makes it a permutation of 0 to n - 1. The
remainder of the permuted number by the shard count is the shard, the quotient the slot, so shards differ
by one row at most and their slots have no gaps (law `rows`). Both follow from the row number, n and the seed
alone, and `row_at` gives the row number of a slot, so a reader finds any row without an index.

Growing by a shard moves nearly all rows; the law `rows` has no grown shard. Equal texts are not kept
together: each row goes where its number says.

Cycle walking ends: at most a - 1 cells of the grid are not numbers, so a walk is at most a steps
long. A walk of more than SHORT steps is as rare as n ** -(SHORT / 2).

Defined cases: null text is empty; null ids come first; rows with the same id are ordered by a hash of the row,
wholly equal rows in any order; very long texts are read by size and checksum only; an empty table gives no
rows; columns of the input named as an output column keep their name, the output column gets an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.ranges import number_all
from ledgerwork.llm import runtime

ROUNDS = 6
SHORT = 8
SEED = 12


class Layout(NamedTuple):
    """All that places a row: number of rows, number of shards, seed."""

    rows: int
    shards: int
    seed: int = SEED

    @property
    def grid(self) -> tuple[int, int]:
        """a and b with a * b >= rows and a * b - rows < a."""
        b = isqrt(max(self.rows, 1) - 1) + 1
        return -(-max(self.rows, 1) // b), b

    def shard_and_slot(self, row: Column) -> tuple[Column, Column]:
        """Where the row with this number goes."""
        place = self._walk(row, range(ROUNDS))
        return (place % self.shards).cast("int"), F.floor(place / self.shards)

    def row_at(self, shard: Column, slot: Column) -> Column:
        """The number of the row that is in a slot."""
        return self._walk(slot.cast("long") * self.shards + shard, range(ROUNDS - 1, -1, -1))

    def _walk(self, number: Column, rounds: Sequence[int]) -> Column:
        a, b = self.grid
        outside = a * b - self.rows

        def steps(start: Column, count: int) -> Column:
            return F.aggregate(
                F.sequence(F.lit(1), F.lit(count)),
                start,
                lambda at, _: F.when(at < self.rows, at).otherwise(self._permuted(at, rounds)),
            )

        def settled(at: Column, count: int) -> Column:
            # branches are evaluated for the rows that need them
            return F.when(at < self.rows, at).otherwise(steps(at, count))

        first = F.transform(F.array(number.cast("long")), lambda x: self._permuted(x, rounds))
        for count in (SHORT, outside) if outside > SHORT else (max(outside, 1),):
            first = F.transform(first, lambda at, count=count: settled(at, count))
        return first[0]

    def _permuted(self, number: Column, rounds: Sequence[int]) -> Column:
        """One Feistel pass over the grid: each round shifts one coordinate by a hash of the other."""
        a, b = self.grid
        sign = 1 if list(rounds)[0] == 0 else -1
        cell = F.struct(F.floor(number / b).alias("x"), (number % b).alias("y"))

        def step(at: Column, k: Column) -> Column:
            x, y = at["x"], at["y"]
            moved_x = F.pmod(x + sign * F.pmod(F.xxhash64(F.lit(self.seed), k, y), F.lit(a)), F.lit(a))
            moved_y = F.pmod(y + sign * F.pmod(F.xxhash64(F.lit(self.seed), k, x), F.lit(b)), F.lit(b))
            even = k % 2 == 0
            return F.struct(
                F.when(even, moved_x).otherwise(x).cast("long").alias("x"),
                F.when(even, y).otherwise(moved_y).cast("long").alias("y"),
            )

        end = F.aggregate(F.array(*[F.lit(k) for k in rounds]), cell, step)
        return F.transform(F.array(end), lambda c: c["x"] * b + c["y"])[0]


def shard(rows: DataFrame, shards: int, order: Sequence[str] = ("doc_id",), seed: int = SEED) -> tuple[DataFrame, Layout]:
    """The rows with `row_no`, `shard` and `slot` (or these names with an underscore), and their layout."""
    number, shard_name, slot_name = (runtime.free_name(n, rows) for n in ("row_no", "shard", "slot"))
    numbered = number_all(rows, order, 0, number)
    layout = Layout(numbered.count(), shards, seed)
    at, slot = layout.shard_and_slot(F.col(f"`{number}`"))
    return numbered.withColumns({shard_name: at, slot_name: slot}), layout


def write(placed: DataFrame, layout: Layout, path: str, files: int = 8) -> None:
    """What `shard` placed, as one folder per shard; its `files` files hold runs of slots in order."""
    per_shard = -(-max(layout.rows, 1) // layout.shards)
    part = F.floor(F.col("slot") * files / per_shard)
    ordered = placed.repartition("shard", part).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def documents(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed, _ = shard(sized, shards, seed=seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
