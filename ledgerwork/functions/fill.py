"""Forward fill and gap-free numbering by row order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.ranges import before, in_ranges, numbered


def forward_fill(df: DataFrame, column: str, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Replace NULLs of `column` by the latest earlier value in the order of the column `order`,
    over the whole sheet or within `partition`."""
    filled = before(in_ranges(df, [*partition, order]), partition, F.col(column), "last", "_filled")
    value = F.coalesce(column, "_filled")
    return filled.select(*[value.alias(c) if c == column else c for c in df.columns])


def number_rows(df: DataFrame, order: str, start: int, out: str) -> DataFrame:
    """Number the rows `start + 1, start + 2, ...` in the order of the unique column `order`."""
    return numbered(in_ranges(df, [order]), start + 1, out).select(*df.columns, out)
