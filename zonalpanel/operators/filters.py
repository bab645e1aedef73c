"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_cases(cases: DataFrame, col: str = "imported", local_value: str = "否") -> DataFrame:
    """Cases not brought in from abroad."""
    return cases.where(F.col(col) == local_value)


def cases_in_area(
    cases: DataFrame,
    county: str | None = None,
    districts: Sequence[str] | None = None,
    first_year: int = 2015,
    last_year: int = 2023,
    county_col: str = "county",
    district_col: str = "town",
    year_col: str = "year",
) -> DataFrame:
    """Cases of a county, a set of districts and a range of years (both ends in)."""
    kept = cases.where(F.col(year_col).between(first_year, last_year))
    if county is not None:
        kept = kept.where(F.col(county_col) == county)
    if districts is not None:
        kept = kept.where(F.col(district_col).isin(*districts))
    return kept


def _inside(lon: str, lat: str, lon_range, lat_range) -> Column:
    return F.coalesce(
        F.col(lon).between(*lon_range) & F.col(lat).between(*lat_range), F.lit(False)
    )


def split_outliers(
    points: DataFrame,
    lon: str = "lon",
    lat: str = "lat",
    lon_range: tuple[float, float] = (120.0, 121.0),
    lat_range: tuple[float, float] = (20.0, 25.0),
) -> tuple[DataFrame, DataFrame]:
    """(valid, outliers) by an inclusive box; missing coordinates are outliers."""
    ok = _inside(lon, lat, lon_range, lat_range)
    return points.where(ok), points.where(~ok)


def correct_outliers(
    points: DataFrame,
    raw_x: str = "x",
    raw_y: str = "y",
    lon: str = "lon",
    lat: str = "lat",
    lon_range: tuple[float, float] = (120.0, 121.0),
    lat_range: tuple[float, float] = (20.0, 25.0),
) -> DataFrame:
    """Outliers take their raw coordinates as longitude and latitude; all rows stay."""
    ok = _inside(lon, lat, lon_range, lat_range)
    return points.withColumns(
        {
            lon: F.when(ok, F.col(lon)).otherwise(F.col(raw_x)),
            lat: F.when(ok, F.col(lat)).otherwise(F.col(raw_y)),
        }
    )


def year_window(
    df: DataFrame, first: int | None = None, last: int | None = None, year: str = "year"
) -> DataFrame:
    """Rows with first <= year <= last; an open end is None."""
    if first is not None:
        df = df.where(F.col(year) >= first)
    if last is not None:
        df = df.where(F.col(year) <= last)
    return df


def exclude_high_incidence(
    df: DataFrame, col: str = "incidence_rate", limit: float = 1000.0
) -> tuple[DataFrame, DataFrame]:
    """(kept, high): rates up to the limit and above it; a missing rate is in neither."""
    return df.where(F.col(col) <= limit), df.where(F.col(col) > limit)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of the columns."""
    return df.na.drop(subset=list(cols))


def zones_by_id(
    zones: DataFrame, ids: Sequence, keep: bool = True, zone: str = "zone_id"
) -> DataFrame:
    """Keep (or leave out) the zones with the given ids."""
    listed = F.col(zone).isin(*ids)
    return zones.where(listed if keep else ~listed)


def weeks_from_first_case(
    weekly: DataFrame, cases: str = "cases", last_week: int = 40
) -> DataFrame:
    """Weeks from the year's first with cases up to ``last_week``.

    ``weekly`` has one row per year and week, so a year's window holds at most 53 rows.
    """
    first = F.min(F.when(F.col(cases) > 0, F.col("week"))).over(Window.partitionBy("year"))
    return (
        weekly.withColumn("_first", first)
        .where(F.col("week").between(F.col("_first"), F.lit(last_week)))
        .drop("_first")
    )
