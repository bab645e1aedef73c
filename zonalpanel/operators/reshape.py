"""Unions, set differences, reshaping, sorting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date

# Date token, underscore, band name.
WIDE_NAME = re.compile(r"^(\d{8}|\d{4}_\d{2}_\d{2})_(.+)$")


def union_panels(*panels: DataFrame) -> DataFrame:
    """All rows of all panels, columns by name; a column absent from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()


def missing_zone_ids(a: DataFrame, b: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Ids in ``a`` and not in ``b``."""
    return a.select(zone).distinct().join(b.select(zone).distinct(), zone, "left_anti")


def wide_zonal_to_long(
    wide: DataFrame, bands: Sequence[str], zone: str = "zone_id", layout: str = "yyyy/MM/dd"
) -> DataFrame:
    """``<date>_<band>`` columns to one row per zone and date: ``Date, Doy, bands, zone``.

    Every row is turned in place (no shuffle): the dates are known from the names.
    """
    by_date: dict[str, dict[str, str]] = {}
    for name in wide.columns:
        found = WIDE_NAME.match(name)
        if found and found.group(2) in bands:
            by_date.setdefault(found.group(1).replace("_", ""), {})[found.group(2)] = name
    if not by_date:
        raise ValueError("no <date>_<band> columns found")

    def cell(token: str, names: dict[str, str]):
        # The token is a literal, so both date columns fold to constants.
        day = parse_date(F.lit(token))
        values = [
            (F.col(f"`{names[b]}`") if b in names else F.lit(None)).cast("double").alias(b)
            for b in bands
        ]
        return F.struct(
            F.date_format(day, layout).alias("Date"), F.date_format(day, "DDD").alias("Doy"), *values
        )

    cells = F.array(*[cell(t, by_date[t]) for t in sorted(by_date)])
    return wide.select(zone, F.inline(cells)).select("Date", "Doy", *bands, zone)


def sort_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ordered by the keys (a range-partitioned sort)."""
    return df.orderBy(*keys)


def head(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in the order of the keys."""
    return df.orderBy(*keys).limit(n)
