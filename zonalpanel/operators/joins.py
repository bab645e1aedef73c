"""Equi-joins between zones, panels, counts and populations.

None carries a broadcast hint: Catalyst uses file statistics and AQE the measured
size, and AQE splits a hot key of the large side where the join stays shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import incidence_rate
from ..functions import nulls
from ..session import written


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def cases_with_population(
    counts: DataFrame, population: DataFrame, keys: Sequence[str] = ("year", "zone_id")
) -> DataFrame:
    """Counts per zone and year with the population beside them; counts are kept."""
    return counts.join(population, list(keys), "left")


def zones_left_join_stat(
    zones: DataFrame, stat: DataFrame, key: str = "zone_id", fill: float | None = 0
) -> DataFrame:
    """All zones with a statistic; zones without one get ``fill``."""
    joined = zones.join(stat, key, "left")
    if fill is None:
        return joined
    return joined.na.fill(fill, [c for c in stat.columns if c != key])


def zones_inner_join_panel(
    zones: DataFrame, panel: DataFrame, key: str = "zone_id"
) -> DataFrame:
    """Panel or summary rows with the attributes of their zone (or region)."""
    return panel.join(zones, key, "inner")


def zones_left_join_cases(
    zones: DataFrame,
    sheet: DataFrame,
    left_keys: Sequence[str] = ("NAME_1", "NAME_2", "ENGTYPE_2"),
    right_keys: Sequence[str] = ("Province", "City", "City/Regency"),
) -> DataFrame:
    """All zones with the sheet rows of the same place; missing names match each other."""
    return zones.join(
        sheet, _null_safe(zones, sheet, list(zip(left_keys, right_keys))), "left"
    )


def merge_panels_outer(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("date", "zone_id", "doy"),
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Full outer join of two panels; shared columns take ``a`` where it has a value."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    if cols is not None:
        shared = [c for c in shared if c in cols]
        b = b.select(*keys, *[c for c in b.columns if c in cols])
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in b.columns})
    joined = a.join(right, _null_safe(a, right, [(k, f"_b_{k}") for k in keys]), "full_outer")
    picked = []
    for c in a.columns:
        both = c in keys or c in shared
        picked.append(F.coalesce(a[c], right[f"_b_{c}"]).alias(c) if both else a[c])
    picked += [right[f"_b_{c}"].alias(c) for c in b.columns if c not in a.columns]
    return joined.select(*picked)


def year_zone_template(
    zones: DataFrame,
    years: Sequence[int],
    agg: DataFrame,
    values: Sequence[str],
    key: str = "zone_id",
) -> DataFrame:
    """Every zone in every year with its aggregate, 0 where there is none."""
    every = zones.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return every.join(agg, ["year", key], "left").na.fill(0, list(values))


def impute_from_donor(
    panel: DataFrame,
    donor_map: DataFrame,
    zone: str = "zone_id",
    date: str = "date",
) -> DataFrame:
    """Fill zones without data from their donors and append the new rows.

    ``donor_map`` has ``missing_id`` and ``donor_id``. A missing zone gets a row for
    each date it lacks and its donor has; of several donor rows on a date the smallest
    (by its values) is taken, so reruns agree. A second run adds nothing. The map, which may
    be a search of its own, is computed once and written.
    """
    donor_map = written(donor_map.select("missing_id", "donor_id"), "donor-map")
    rest = [c for c in panel.columns if c not in (zone, date)]
    row = F.struct(*[F.col(c) for c in rest])
    donors = donor_map.select(F.col("donor_id").alias(zone)).distinct()
    donor_rows = (
        panel.join(donors, zone, "left_semi")
        .groupBy(F.col(zone).alias("donor_id"), date)
        .agg(F.min(row).alias("_row"))
    )
    lacking = donor_map.select("missing_id").distinct()
    have = panel.select(F.col(zone).alias("missing_id"), date).join(lacking, "missing_id", "left_semi")
    added = (
        donor_rows.join(donor_map.select("missing_id", "donor_id"), "donor_id", "inner")
        .join(have, ["missing_id", date], "left_anti")
        .select(F.col("missing_id").alias(zone), date, "_row.*")
    )
    return panel.unionByName(added.select(*panel.columns))


def align_weekly_series(case_weeks: DataFrame, egg_weeks: DataFrame) -> DataFrame:
    """Weekly cases and weekly egg sums side by side, weeks of either kept."""
    return case_weeks.join(egg_weeks, ["year", "week"], "full_outer")


def join_classes_on_zone(a: DataFrame, b: DataFrame, key: str = "zone_id") -> DataFrame:
    """Two classified layers of the same areas, areas in both."""
    return a.join(b, key, "inner")


def wide_incidence_by_year(
    zones: DataFrame,
    counts: DataFrame,
    population: DataFrame,
    years: Sequence[int],
    key: str = "zone_id",
    fill_zero: bool = True,
) -> DataFrame:
    """Zones with ``Inf_<y>, Pop_<y>, IR_<y>, M_<y>, F_<y>`` for each year.

    All years go through one join and one pivot. Of several population rows of a zone and
    year the one with the largest population counts (then that with the largest other
    values), so that all its numbers come from one row. A zone counts in a year only when it
    has cases then; with ``fill_zero`` its missing population becomes 0 (and its rate,
    a division by zero, NULL).
    """

    def number(c: str) -> Column:
        value = nulls.number_or_null(F.col(c))
        return F.coalesce(value, F.lit(0.0)) if fill_zero else value

    other = [c for c in population.columns if c not in ("year", key)]
    largest = F.max(F.struct(nulls.number_or_null(F.col("p_cnt")).alias("_n"), *other)).alias("_row")
    single = population.groupBy("year", key).agg(largest).select("year", key, *[f"_row.{c}" for c in other])
    rates = incidence_rate(
        cases_with_population(counts, single, ("year", key))
        .where(F.col("year").isin(*[int(y) for y in years]))
        .withColumns({"infections": number("infections"), "p_cnt": number("p_cnt")}),
        population="p_cnt",
    )
    names = {
        "infections": "Inf", "p_cnt": "Pop", "incidence_rate": "IR", "m_cnt": "M", "f_cnt": "F",
    }
    wide = (
        rates.groupBy(key)
        .pivot("year", [int(y) for y in years])
        .agg(*[F.first(c, ignorenulls=True).alias(n) for c, n in names.items()])
    )
    wide = wide.withColumnsRenamed(
        {f"{y}_{n}": f"{n}_{y}" for y in years for n in names.values()}
    )
    return zones.join(wide, key, "left")
