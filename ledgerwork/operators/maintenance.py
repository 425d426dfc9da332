"""Maintenance jobs and their materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwork.functions.text import in_days_of


def maintenance_history(
    job: DataFrame, detail: DataFrame, month: int, year: int | None = None, ordered: bool = True
) -> DataFrame:
    """Jobs with their materials for one calendar month, of any year unless `year` is given."""
    any_year = F.month("done_on") == month
    chosen = job.where(any_year if year is None else in_days_of(F.col("done_on"), year, month))
    rows = chosen.join(detail.select("job_id", "product", "qty"), "job_id").select(
        "job_id", "done_on", "note", "worker", "worker_pay", "product", "qty"
    )
    return rows.orderBy("job_id", "product", "qty") if ordered else rows
