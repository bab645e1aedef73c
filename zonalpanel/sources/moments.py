"""Yearly moments of a panel, kept by period, so that a further period file is added alone.

A period's folder holds one row per year and zone with the number of values, their mean and
their squared deviations for each column. Moments add up, so statistics over all periods need
the folders only, never the panels behind them. A period that is written again, because rows
came late or a run is repeated, replaces its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_period(
    panel: DataFrame, path: str, period: str, cols: Sequence[str], date: str = "date", zone: str = "zone_id"
) -> None:
    """Add a period's panel to the moments at ``path``, or put it in the place of the period's earlier one.

    ``period`` names a folder. Missing values do not count; rows without a date or a zone are
    left out. A year may be spread over several periods, a row must be in one.
    """
    if not period or any(c in period for c in "/=:\\"):
        raise ValueError(f"{period!r} can't name a folder")
    rows = panel.select(F.year(date).alias("year"), zone, *cols).where(F.col("year").isNotNull() & F.col(zone).isNotNull())
    moments = [
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")).alias(c)
        for c in cols
    ]
    rows.groupBy("year", zone).agg(*moments).write.mode("overwrite").parquet(f"{path}/period={period}")


def yearly_zone_stats(spark: SparkSession, path: str, cols: Sequence[str], zone: str = "zone_id") -> DataFrame:
    """Mean and sample standard deviation per year and zone over all periods: ``<c>_mean, <c>_std``.

    Equal to ``yearly.yearly_zone_stats`` of the whole panel. Deviations are taken from the
    common mean, so that large means cost no digits.
    """
    some = [F.filter(F.collect_list(c), lambda x: x["n"] > 0).alias(c) for c in cols]
    merged = spark.read.parquet(path).groupBy("year", zone).agg(*some)

    def total(c: str, part: str) -> Column:
        return F.expr(f"aggregate(`{c}`, 0D, (s, x) -> s + {part})")

    sums = merged.select(
        "*",
        *[total(c, "x.n").alias(f"{c}_n") for c in cols],
        *[F.try_divide(total(c, "x.n * x.mean"), total(c, "x.n")).alias(f"{c}_mean") for c in cols],
    )

    def deviation(c: str) -> Column:
        apart = total(c, f"x.m2 + x.n * (x.mean - `{c}_mean`) * (x.mean - `{c}_mean`)")
        return F.when(F.col(f"{c}_n") > 1, F.sqrt(apart / (F.col(f"{c}_n") - 1))).alias(f"{c}_std")

    return sums.select("year", zone, *[x for c in cols for x in (F.col(f"{c}_mean"), deviation(c))])
