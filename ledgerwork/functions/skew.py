"""A NULL-safe left join that stays parallel when one key holds a large share of the rows.

Spark's adaptive execution splits a skewed probe side of a join. It cannot split the
NULL-supplying side of an outer join; `left_join_salted` does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the right side that one salt of a key is meant to hold.
SALT_ROWS = 1_000_000
#: Equal rows of the right side go in pieces of at most so many.
PIECE = 4096


def left_join_salted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salt_rows: int = SALT_ROWS, match_null: bool = True
) -> DataFrame:
    """NULL-safe left join that keeps every pair and splits the large keys of the right side.

    A key gets as many salts as its right rows need at `salt_rows` each: the rows are counted, the
    counts of all keys with more than one salt are an ordinary table that both sides join, however
    many keys that are. Left rows are repeated once per salt of their key, so their copies follow the size
    of the key. Equal right rows are counted before and repeated after the join; in between they
    go in pieces, so that the salt, a hash of row and piece, spreads them as well and is the same
    when a task is run again.

    A large key has right rows in all but a few of its salts; those that find no partner are
    dropped, all other keys keep left-join rules. Without `match_null` a NULL in a key finds no
    partner. Columns of `right` other than the keys must not occur in `left`.
    """
    if not match_null:
        right = right.dropna(subset=list(keys))
    values = [c for c in right.columns if c not in keys]
    counted = right.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_copies"))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.sum("_copies") / salt_rows).alias("_salts"))
    wide = sizes.where(F.col("_salts") > 1).select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_salts")
    pieces = counted.select(
        *keys,
        *values,
        "_copies",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / PIECE))).alias("_piece"),
    )
    salt = F.pmod(F.xxhash64(*values, "_piece"), F.coalesce("_salts", F.lit(1)))
    salted = pieces.join(wide, _null_safe(pieces, keys, wide, "_w_"), "left").select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *values,
        salt.alias("_r_salt"),
        F.least(F.lit(PIECE), F.col("_copies") - F.col("_piece") * PIECE).alias("_repeat"),
    )
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
    spread = left.join(wide, _null_safe(left, keys, wide, "_w_"), "left").select(
        *left.columns, F.col("_salts").isNotNull().alias("_wide"), F.explode(salts).alias("_salt")
    )
    same = _null_safe(spread, keys, salted, "_r_") & (spread["_salt"] == salted["_r_salt"])
    pairs = spread.join(salted, same, "left").where(F.col("_repeat").isNotNull() | ~F.col("_wide"))
    repeats = F.explode(F.array_repeat(F.lit(True), F.coalesce("_repeat", F.lit(1)).cast("int")))
    return pairs.withColumn("_again", repeats).select(*left.columns, *values)


def _null_safe(left: DataFrame, keys: Sequence[str], right: DataFrame, prefix: str) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys])
