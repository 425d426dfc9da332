"""Month keys and lenient date / number parsing."""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A whole text that is a day, alone or with a time of day and an offset behind it.
DAY = (
    r"^\d{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])"
    r"([T ]([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d(\.\d{1,9})?)?( ?(Z|UTC|[+-](0?\d|1[0-8])(:?[0-5]\d)?))?)?$"
)


def month_key(day: Column) -> Column:
    """Sortable month text, `2024-03`."""
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    """Display month text, `03-2024`."""
    return F.date_format(day, "MM-yyyy")


def month_name(day: Column) -> Column:
    """Long month text, `March 2024`."""
    return F.date_format(day, "MMMM yyyy")


def money_text(amount: Column) -> Column:
    """Display text with thousands commas and two decimals, `1,234.50`."""
    return F.format_number(amount, 2)


def in_days_of(day: Column, year: int, month: int | None = None) -> Column:
    """True inside the year or month. A plain range, so that Parquet scans can skip by it."""
    first, last = (1, 12) if month is None else (month, month)
    end = monthrange(year, last)[1]
    return day.between(
        F.lit(f"{year:04d}-{first:02d}-01").cast("date"), F.lit(f"{year:04d}-{last:02d}-{end:02d}").cast("date")
    )


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a finite decimal number, with exponent or not, gives NULL."""
    trimmed = F.trim(text.cast("string"))
    # a cast alone would also take type suffixes (`12d`) and hexadecimal numbers
    number = F.when(trimmed.rlike(DECIMAL), trimmed).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def to_day(text: Column) -> Column:
    """Text to date; accepts `2024-11-4` and ISO timestamps, anything else gives NULL."""
    trimmed = F.trim(text.cast("string"))
    # a cast alone ignores whatever stands behind the day
    return F.when(trimmed.rlike(DAY), F.try_to_date(F.regexp_extract(trimmed, r"^\d+-\d+-\d+", 0)))


def not_a_day(text: Column) -> Column:
    """True where a text is given that `to_day` does not take: what a strict load stops at."""
    return text.isNotNull() & to_day(text).isNull()


def whole_text(text: Column) -> Column:
    """`'12.0'` to `'12'`; text that is no number raises, as the sheet loads do."""
    return text.cast("double").cast("long").cast("string")


def is_blank(value: Column) -> Column:
    """NULL or empty text. Zero counts as filled in."""
    return value.isNull() | (value.cast("string") == "")
