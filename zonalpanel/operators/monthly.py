"""Monthly case sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import number_or_null

MONTHS = range(1, 13)


def _months(value) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("month"), value(m).alias("total")) for m in MONTHS])


def _need_months(sheets: DataFrame, prefix: str) -> None:
    absent = [f"{prefix}_{m}" for m in MONTHS if f"{prefix}_{m}" not in sheets.columns]
    if absent:
        raise ValueError(f"month columns are missing: {', '.join(absent)}")


def sheet_to_long(sheet: DataFrame, keys=("year", "Province", "City")) -> DataFrame:
    """One row per sheet row and month: keys, ``month, infections, deaths``."""
    _need_months(sheet, "Infection")
    _need_months(sheet, "Death")
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("month"),
                number_or_null(F.col(f"Infection_{m}")).alias("infections"),
                number_or_null(F.col(f"Death_{m}")).alias("deaths"),
            )
            for m in MONTHS
        ]
    )
    return sheet.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def monthly_totals(sheets: DataFrame, skip_rows: int = 2, row_no: str = "row_no") -> DataFrame:
    """Infections per year and month; text that is no number counts 0.

    The twelve sums of a year come from one aggregation of the wide sheet and only
    then become rows. ``skip_rows`` leading rows of each sheet are headings.
    """
    _need_months(sheets, "Infection")

    def month_sum(m: int) -> Column:
        return F.sum(F.coalesce(number_or_null(F.col(f"Infection_{m}")), F.lit(0.0))).alias(f"_{m}")

    sums = sheets.where(F.col(row_no) > skip_rows).groupBy("year").agg(*[month_sum(m) for m in MONTHS])
    return sums.select("year", F.inline(_months(lambda m: F.col(f"_{m}"))))


def multi_year_monthly_series(monthly: DataFrame) -> DataFrame:
    """One ordered series over all years: ``position, label, total, year_end``.

    One row per month, so its windowless order is bounded by the calendar.
    """
    year_index = F.dense_rank().over(Window.orderBy("year")) - 1
    month_name = F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMMM")
    return monthly.select(
        "year",
        "month",
        (year_index * 12 + F.col("month")).alias("position"),
        F.concat_ws(" ", month_name, F.col("year").cast("string")).alias("label"),
        "total",
        (F.col("month") == 12).alias("year_end"),
    ).orderBy("position")


def year_boundaries(series: DataFrame, position: str = "position") -> DataFrame:
    """First and last position of each year."""
    return series.groupBy("year").agg(
        F.min(position).alias("first_position"), F.max(position).alias("last_position")
    )


def year_start_weeks(years: DataFrame, base: int = 2018) -> DataFrame:
    """Running week at which each year starts."""
    return years.select("year", ((F.col("year") - base) * 52 + 1).alias("start_week"))
