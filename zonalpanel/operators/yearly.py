"""Yearly, regional, stability and trend statistics of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import slope_p_value


def _with_year(panel: DataFrame, date: str) -> DataFrame:
    return panel if "year" in panel.columns else panel.withColumn("year", F.year(date))


def yearly_zone_stats(panel: DataFrame, cols: Sequence[str], date: str = "date", zone: str = "zone_id") -> DataFrame:
    """Mean and sample standard deviation per year and zone: ``<c>_mean, <c>_std``."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    rows = _with_year(panel, date).where(F.col("year").isNotNull() & F.col(zone).isNotNull())
    return rows.groupBy("year", zone).agg(*aggs)


def _per_zone_moments(panel: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, mean and squared deviation of each column, before zones meet regions."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.sum(c).alias(f"{c}_sum"),
            (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"),
        ]
    return panel.groupBy(*keys).agg(*aggs)


def _weighted_mean(c: str) -> Column:
    return F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))


def _region_of(zones: DataFrame, zone: str, region: str) -> DataFrame:
    return zones.select(zone, region).where(F.col(region).isNotNull())


def region_mean(panel: DataFrame, zones: DataFrame, cols: Sequence[str], zone: str = "zone_id", region: str = "Region") -> DataFrame:
    """Mean per region, every zone-day row with the same weight.

    The panel is reduced to one row per zone before it meets the zone attributes.
    """
    sums = _per_zone_moments(panel, [zone], cols).join(_region_of(zones, zone, region), zone)
    return sums.groupBy(region).agg(*[_weighted_mean(c).alias(f"{c}_mean") for c in cols])


def region_year_mean(panel: DataFrame, zones: DataFrame, cols: Sequence[str], date: str = "date", zone: str = "zone_id", region: str = "Region") -> DataFrame:
    """Mean per year and region, every zone-day row with the same weight."""
    rows = _with_year(panel, date).where(F.col("year").isNotNull())
    sums = _per_zone_moments(rows, ["year", zone], cols).join(_region_of(zones, zone, region), zone)
    return sums.groupBy("year", region).agg(*[_weighted_mean(c).alias(f"{c}_mean") for c in cols])


def region_year_std(panel: DataFrame, zones: DataFrame, cols: Sequence[str], date: str = "date", zone: str = "zone_id", region: str = "Region") -> DataFrame:
    """Sample standard deviation over the zone-day rows of each year and region.

    Zone moments are combined around the region mean; the window that supplies it runs
    over one row per zone.
    """
    rows = _with_year(panel, date).where(F.col("year").isNotNull())
    parts = _per_zone_moments(rows, ["year", zone], cols).join(_region_of(zones, zone, region), zone)
    group = Window.partitionBy("year", region)
    centred = parts.withColumns(
        {
            f"{c}_mu": F.try_divide(F.sum(f"{c}_sum").over(group), F.sum(f"{c}_n").over(group))
            for c in cols
        }
    )

    def std(c: str) -> Column:
        n = F.col(f"{c}_n")
        between = n * F.pow(F.try_divide(F.col(f"{c}_sum"), n) - F.col(f"{c}_mu"), F.lit(2.0))
        spread = F.sum(F.col(f"{c}_m2") + between)
        total = F.sum(n)
        return F.when(total > 1, F.sqrt(F.try_divide(spread, total - 1))).alias(f"{c}_std")

    return centred.groupBy("year", region).agg(*[std(c) for c in cols])


def _named(col: str | Sequence[str]) -> list[tuple[str, str]]:
    """Each column and the prefix of its results: none for a single column, its name in a list."""
    return [(col, "")] if isinstance(col, str) else [(c, f"{c}_") for c in col]


def stability_stats(yearly: DataFrame, col: str | Sequence[str], zone: str = "zone_id") -> DataFrame:
    """How steady a zone's yearly means and deviations are over the years.

    A list of columns is done in one aggregation, its results named ``<column>_<statistic>``.
    """
    named = _named(col)
    aggs = []
    for c, p in named:
        aggs += [
            F.avg(f"{c}_mean").alias(f"{p}mean_over_years"),
            F.stddev_samp(f"{c}_mean").alias(f"{p}std_over_years"),
            F.avg(f"{c}_std").alias(f"{p}mean_std_over_years"),
            F.stddev_samp(f"{c}_std").alias(f"{p}std_std_over_years"),
        ]
    ratios = {f"{p}mean_CV": F.try_divide(f"{p}std_over_years", f"{p}mean_over_years") for _, p in named}
    return yearly.groupBy(zone).agg(*aggs).withColumns(ratios)


def stability_trend(
    yearly: DataFrame, col: str | Sequence[str], strict: bool = True, zone: str = "zone_id"
) -> DataFrame:
    """Slope of a zone's yearly deviation over the years, and its two-sided p-value.

    A year without a deviation makes the zone's result NULL; with ``strict=False`` such
    years are skipped. A list of columns is done in one aggregation, its results named
    ``<column>_stability_trend`` and ``<column>_p_value``.
    """
    x = F.col("year").cast("double")
    aggs, results = [], []
    for c, p in _named(col):
        y = F.col(f"{c}_std")
        flat = F.regr_syy(y, x) == 0
        aggs += [
            F.regr_slope(y, x).alias(f"_{p}slope"),
            F.when(flat, F.lit(0.0)).otherwise(F.regr_r2(y, x)).alias(f"_{p}r2"),
            F.regr_count(y, x).alias(f"_{p}n"),
            F.bool_or(y.isNull()).alias(f"_{p}gap"),
        ]
        usable = ~F.col(f"_{p}gap") if strict else F.lit(True)
        slope = F.col(f"_{p}slope")
        results += [
            F.when(usable, slope).alias(f"{p}stability_trend"),
            F.when(usable & slope.isNotNull(), slope_p_value(F.col(f"_{p}r2"), F.col(f"_{p}n"))).alias(f"{p}p_value"),
        ]
    return yearly.groupBy(zone).agg(*aggs).select(zone, *results)
