"""Column work on whole DataFrames: names, numbers, dates, fills."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, lookups, nulls, projection, stats


def rename_by_position(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """New names for the columns at the given positions; the others keep theirs."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns)])


def rename_regex(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Regex replacement in every column name."""
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def suffix_bands(df: DataFrame, bands: Sequence[str], stat: str) -> DataFrame:
    """Append ``_<stat>`` to the band columns that are present."""
    return df.withColumnsRenamed({b: f"{b}_{stat}" for b in bands if b in df.columns})


def coerce_numeric(
    df: DataFrame, cols: Sequence[str], fill: float | None = None
) -> DataFrame:
    """Text to double; what is not a number becomes NULL, or ``fill`` when given."""

    def as_number(c: str) -> Column:
        number = nulls.number_or_null(F.col(c))
        return number if fill is None else F.coalesce(number, F.lit(float(fill)))

    return df.withColumns({c: as_number(c) for c in cols})


def normalize_dates(df: DataFrame, col: str, layout: str = "yyyy/MM/dd") -> DataFrame:
    """Date text of any accepted layout rewritten in one layout."""
    return df.withColumn(col, dates.normalize_date(F.col(col), layout))


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add calendar ``year``, ISO ``week`` and three-digit ``doy``."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "week": F.weekofyear(ts),
            "doy": dates.day_of_year_text(F.col(ts)),
        }
    )


def continuous_week(df: DataFrame, base: int = 2018) -> DataFrame:
    """Add ``continuous_week`` from ``year`` and ``week``."""
    return df.withColumn(
        "continuous_week", dates.continuous_week(F.col("year"), F.col("week"), base)
    )


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL with a constant per column."""
    return df.na.fill(dict(values))


def prefer_left(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``c`` from ``c_x`` if present, else ``c_y``; the suffixed pair is dropped."""
    merged = df.withColumns({c: F.coalesce(F.col(f"{c}_x"), F.col(f"{c}_y")) for c in cols})
    return merged.drop(*[f"{c}_{s}" for c in cols for s in "xy"])


def drop_columns(
    df: DataFrame, cols: Sequence[str] = (), suffix: str | None = None
) -> DataFrame:
    """Drop the named columns and those ending in ``suffix``."""
    ending = [c for c in df.columns if suffix and c.endswith(suffix)]
    return df.drop(*cols, *ending)


def tm_to_lonlat(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``lon`` and ``lat`` from EPSG:3826 coordinates."""
    lon, lat = projection.tm2_to_lonlat(F.col(x), F.col(y))
    return df.withColumns({"lon": lon, "lat": lat})


def lonlat_to_mercator(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``mx`` and ``my`` in EPSG:3857 metres."""
    mx, my = projection.lonlat_to_mercator(F.col(lon), F.col(lat))
    return df.withColumns({"mx": mx, "my": my})


def make_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``point``, a struct of x and y."""
    return df.withColumn("point", F.struct(F.col(lon).alias("x"), F.col(lat).alias("y")))


def map_region(
    df: DataFrame,
    province: str = "NAME_1",
    mapping: Mapping[str, str] | None = None,
    out: str = "Region",
) -> DataFrame:
    """Island group of a province, 'Unknown' when it is in no list."""
    known = mapping if mapping is not None else lookups.province_regions()
    return df.withColumn(
        out, F.coalesce(lookups.look_up(known, F.col(province)), F.lit("Unknown"))
    )


def incidence_rate(
    df: DataFrame,
    infections: str = "infections",
    population: str = "population",
    out: str = "incidence_rate",
) -> DataFrame:
    """Add cases per thousand people."""
    return df.withColumn(out, stats.incidence_rate(F.col(infections), F.col(population)))


def cap_incidence(
    df: DataFrame, col: str = "incidence_rate", limit: float = 1000.0, cap: float = 1100.0
) -> DataFrame:
    """Rates above the limit become the cap."""
    return df.withColumn(col, F.when(F.col(col) > limit, F.lit(cap)).otherwise(F.col(col)))


def month_chunks(df: DataFrame, begin: str = "begin", end: str = "end") -> DataFrame:
    """One row per calendar month touched by [begin, end]: ``chunk_begin, chunk_end``."""
    starts = F.sequence(F.trunc(begin, "MM"), F.col(end), F.expr("interval 1 month"))
    month = F.col("_month")
    return (
        df.withColumn("_month", F.explode(starts))
        .withColumn("chunk_begin", F.greatest(month, F.col(begin)))
        .withColumn("chunk_end", F.least(F.last_day(month), F.col(end)))
        .drop("_month")
    )
