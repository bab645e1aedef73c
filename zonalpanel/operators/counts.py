"""Case counts and trap sums by zone, week and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import calendar_parts, continuous_week
from .filters import year_window
from .spatial import spatial_join_points


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with a missing key are left out, as in the reported tables."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def count_cases(cases: DataFrame, keys: Sequence[str] = ("year", "zone_id"), out: str = "infections") -> DataFrame:
    """Rows per zone and year."""
    return _known(cases, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def weekly_counts(cases: DataFrame, onset: str, out: str = "cases") -> DataFrame:
    """Cases per calendar year and ISO week."""
    return count_cases(calendar_parts(cases, onset), ("year", "week"), out)


def _sum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _known(df, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias(value)
    )


def weekly_sum(traps: DataFrame, value: str) -> DataFrame:
    """Sum per year and week; all-missing weeks give 0."""
    return _sum(traps, ("year", "week"), value)


def continuous_weekly_sum(traps: DataFrame, value: str, base: int = 2018) -> DataFrame:
    """Sum per running week from the base year on."""
    return _sum(continuous_week(year_window(traps, base), base), ("continuous_week",), value)


def yearly_sum(traps: DataFrame, value: str, first: int = 2016, last: int = 2024) -> DataFrame:
    """Sum per year in a range of years."""
    return _sum(year_window(traps, first, last), ("year",), value)


def eggs_by_zone_year(
    traps: DataFrame, zones: DataFrame, value: str, cell: float | None = None, zone: str = "zone_id"
) -> DataFrame:
    """Sum per year and the zone the trap stands in."""
    return _sum(spatial_join_points(traps, zones, cell, zone=zone), ("year", zone), value)


def weekly_entries_by_year(traps: DataFrame, years: Sequence[int]) -> DataFrame:
    """Rows per week (down) and year (across); no rows stay NULL."""
    return _known(traps, ("year", "week")).groupBy("week").pivot("year", [int(y) for y in years]).count()
