"""Date parsing and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# year, separator ('/', '_', '-' or none), month, the same separator, day;
# month and day may have one digit.
DATE_PATTERN = (
    r"^(\d{4})([/_-]?)(1[0-2]|0[1-9]|[1-9])\2(3[01]|[12]\d|0[1-9]|[1-9])$"
)


def parse_date(col: Column, layout: str = "yyyy/MM/dd") -> Column:
    """Date from ``layout``, yyyyMMdd, yyyy_MM_dd or yyyy-MM-dd text; NULL if none fits.

    All built-in layouts differ only in the separator, so one pattern covers them.
    """
    text = col.cast("string")
    plain = F.when(
        text.rlike(DATE_PATTERN), F.regexp_replace(text, DATE_PATTERN, "$1-$3-$4")
    )
    parsed = F.try_to_date(plain, "yyyy-M-d")
    if layout == "yyyy/MM/dd":
        return parsed
    return F.coalesce(F.try_to_date(text, layout), parsed)


def normalize_date(col: Column, layout: str = "yyyy/MM/dd") -> Column:
    """Date text in any accepted layout, rewritten in ``layout``."""
    return F.date_format(parse_date(col, layout), layout)


def day_of_year_text(col: Column) -> Column:
    """Day of the year as three digits, '001' to '366'."""
    return F.date_format(col, "DDD")


def continuous_week(year: Column, week: Column, base: int = 2018) -> Column:
    """Running week number with 52 weeks a year; week 53 meets the next year's week 1."""
    return (year - F.lit(base)) * F.lit(52) + week
