"""Stock: purchases, uses and what is on hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_product(df: DataFrame, total: str, rows: str) -> DataFrame:
    return df.groupBy("product").agg(F.sum("qty").alias(total), F.count(F.lit(1)).alias(rows))


def _movements(product: DataFrame, purchase: DataFrame, use: DataFrame) -> DataFrame:
    bought = _per_product(purchase, "bought", "n_bought")
    used = _per_product(use, "used", "n_used")
    zero = F.lit(0)
    return (
        product.select("product")
        .join(bought, "product", "left")
        .join(used, "product", "left")
        .select("product", *[F.coalesce(c, zero).alias(c) for c in ("bought", "used", "n_bought", "n_used")])
    )


def stock_fanout(product: DataFrame, purchase: DataFrame, use: DataFrame) -> DataFrame:
    """Bought less used over the double left join, where each side repeats the other's rows.

    A side's sum is repeated once per row of the other side (once if it has none), so the
    join of n purchases with m uses per product never has to be built.
    """
    repeated = F.col("bought") * F.greatest("n_used", F.lit(1)) - F.col("used") * F.greatest("n_bought", F.lit(1))
    return _movements(product, purchase, use).select("product", repeated.alias("stock"))


def stock_on_hand(
    product: DataFrame, purchase: DataFrame, use: DataFrame, maintenance_detail: DataFrame | None = None
) -> DataFrame:
    """Bought less used, each counted once; optionally also less maintenance materials.
    `stock_units` is the whole-number display, cut toward zero."""
    if maintenance_detail is not None:
        use = use.select("product", "qty").unionByName(maintenance_detail.select("product", "qty"))
    stock = F.col("bought") - F.col("used")
    return _movements(product, purchase, use).select(
        "product", stock.alias("stock"), stock.cast("long").alias("stock_units")
    )


def purchase_history(purchase: DataFrame, ordered: bool = True) -> DataFrame:
    """Purchases with their amount, newest first; the other sort columns spread a busy day."""
    rows = purchase.select(
        "product",
        "bought_on",
        "qty",
        "unit_price",
        (F.col("qty") * F.col("unit_price")).alias("amount"),
        "receipt_no",
        "vendor",
    )
    return rows.orderBy(F.desc("bought_on"), "product", "receipt_no", "vendor", "qty") if ordered else rows


def use_history(use: DataFrame, ordered: bool = True) -> DataFrame:
    rows = use.select("product", "used_on", "qty", "note")
    return rows.orderBy(F.desc("used_on"), "product", "qty", "note") if ordered else rows
