"""Panel audits: completeness and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_zone_count(panel: DataFrame, by: str | None = None, zone: str = "zone_id") -> DataFrame:
    """Distinct zones overall or per ``by`` (date); missing zone ids do not count."""
    n = F.count_distinct(zone).alias("n_zones")
    return panel.agg(n) if by is None else panel.where(F.col(by).isNotNull()).groupBy(by).agg(n)


def incomplete_dates(panel: DataFrame, expected: int = 444, date: str = "date", zone: str = "zone_id") -> DataFrame:
    """Dates whose number of distinct zones is not the expected one."""
    return distinct_zone_count(panel, date, zone).where(F.col("n_zones") != expected)


def _nulls(cols: Sequence[str], suffix: str) -> list[Column]:
    return [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_{suffix}") for c in cols]


def null_count_by_date(panel: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Missing values per column, year and date."""
    return (
        panel.where(F.col(date).isNotNull())
        .groupBy(F.year(date).alias("year"), date)
        .agg(*_nulls(cols, "nulls"))
    )


def null_count_by_zone(panel: DataFrame, cols: Sequence[str], date: str = "date", zone: str = "zone_id") -> DataFrame:
    """Missing values per column, year and zone, all columns in one pass."""
    return (
        panel.where(F.col(date).isNotNull() & F.col(zone).isNotNull())
        .groupBy(F.year(date).alias("year"), zone)
        .agg(*_nulls(cols, "nulls"))
    )


def null_pct_by_date(panel: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Missing values per column and date in percent of the date's rows."""
    return (
        panel.where(F.col(date).isNotNull())
        .groupBy(date)
        .agg(
            *[
                (F.sum(F.col(c).isNull().cast("long")) * 100.0 / F.count(F.lit(1))).alias(f"{c}_pct")
                for c in cols
            ]
        )
    )


def null_overlap(null_pct: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``overlap``: all columns miss the same share on that date."""
    same = F.lit(True)
    for c in cols[1:]:
        same = same & (F.col(f"{cols[0]}_pct") == F.col(f"{c}_pct"))
    return null_pct.withColumn("overlap", same)


def rolling_mean(daily: DataFrame, cols: Sequence[str], n: int = 7, date: str = "date") -> DataFrame:
    """Mean of the current and n - 1 earlier days with rows, skipping missing values.

    The input is reduced to one row per calendar day before the window, which is what
    bounds the window: a century of days is 36,525 rows however large the panel is.
    Years are not separated.
    """
    per_day = (
        daily.groupBy(F.to_date(date).alias(date))
        .agg(*[F.avg(c).alias(c) for c in cols])
        .where(F.col(date).isNotNull())
    )
    frame = Window.orderBy(date).rowsBetween(-(n - 1), Window.currentRow)
    return per_day.withColumns({f"{c}_smooth": F.avg(c).over(frame) for c in cols})
