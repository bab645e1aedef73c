"""Counts, sums, audits and yearly statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as K
from ..operators import distribution as D
from ..operators import monthly as M
from ..operators import pixels as X
from ..operators import quality as Q
from ..operators import yearly as Y
from ..operators.columns import calendar_parts
from ..session import scratch_dir
from ..sources import moments as MO
from .inputs import MONTHS, Inputs, r, rd, text_date
from .registry import query

STATS = ["price_MEAN", "price_min_MEAN", "price_max_MEAN"]


# ---------------------------------------------------------------- counts and sums


@query("cases", """
SELECT CAST(year AS INTEGER) AS year, zone_id, count(*) AS infections FROM cases
WHERE zone_id IS NOT NULL GROUP BY year, zone_id""")
def count_cases(t: Inputs):
    return K.count_cases(t.cases)


@query("", """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(weekofyear(ts) AS INTEGER) AS week, count(*) AS cases
FROM events GROUP BY ALL""")
def weekly_counts(t: Inputs):
    return K.weekly_counts(t.table("events"), "ts")


@query("traps", """
SELECT CAST(year(start_time) AS INTEGER) AS year, CAST(weekofyear(start_time) AS INTEGER) AS week,
       sum(avg_eggs) AS avg_eggs
FROM traps GROUP BY year(start_time), weekofyear(start_time)""")
def weekly_sum(t: Inputs):
    return K.weekly_sum(calendar_parts(t.traps, "start_time"), "avg_eggs")


@query("traps", """
SELECT CAST((year(start_time) - 1997) * 52 + weekofyear(start_time) AS INTEGER) AS continuous_week,
       sum(avg_eggs) AS avg_eggs
FROM traps WHERE year(start_time) >= 1997 GROUP BY 1""")
def continuous_weekly_sum(t: Inputs):
    return K.continuous_weekly_sum(calendar_parts(t.traps, "start_time"), "avg_eggs", base=1997)


@query("traps", """
SELECT CAST(year(start_time) AS INTEGER) AS year, sum(avg_eggs) AS avg_eggs
FROM traps WHERE year(start_time) BETWEEN 1996 AND 2000 GROUP BY 1""")
def yearly_sum(t: Inputs):
    return K.yearly_sum(calendar_parts(t.traps, "start_time"), "avg_eggs", 1996, 2000)


@query("traps", "SELECT CAST(year(start_time) AS INTEGER) AS year, count(*) AS n FROM traps GROUP BY 1 ORDER BY 1")
def rows_per_year(t: Inputs):
    return D.rows_per_year(calendar_parts(t.traps, "start_time"))


@query("", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_quantity")
def value_counts(t: Inputs):
    return D.value_counts(t.table("lineitem"), "l_quantity")


# ---------------------------------------------------------------- audits


@query("panel", "SELECT CAST(date AS VARCHAR) AS date, count(DISTINCT zone_id) AS n_zones FROM panel GROUP BY date")
def distinct_zone_count(t: Inputs):
    return Q.distinct_zone_count(t.panel, "date").select(text_date("date").alias("date"), "n_zones")


@query("panel", "SELECT count(DISTINCT zone_id) AS n_zones FROM panel")
def distinct_zone_total(t: Inputs):
    return Q.distinct_zone_count(t.panel)


@query("panel", """
SELECT CAST(date AS VARCHAR) AS date, count(DISTINCT zone_id) AS n_zones FROM panel
GROUP BY date HAVING count(DISTINCT zone_id) <> 6""")
def incomplete_dates(t: Inputs):
    return Q.incomplete_dates(t.panel, expected=6).select(text_date("date").alias("date"), "n_zones")


_NULLS = ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_nulls" for c in STATS)
_PCT = ", ".join(rd(f"count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*)") + f" AS {c}_pct" for c in STATS)


@query("full_panel", f"""
SELECT CAST(year(date) AS INTEGER) AS year, CAST(date AS VARCHAR) AS date, {_NULLS} FROM full_panel
GROUP BY year(date), date""")
def null_count_by_date(t: Inputs):
    return Q.null_count_by_date(t.full_panel, STATS).withColumn("date", text_date("date"))


@query("full_panel", f"""
SELECT CAST(year(date) AS INTEGER) AS year, zone_id, {_NULLS} FROM full_panel GROUP BY year(date), zone_id""")
def null_count_by_zone(t: Inputs):
    return Q.null_count_by_zone(t.full_panel, STATS)


def _pct(t: Inputs):
    return Q.null_pct_by_date(t.full_panel, STATS)


@query("full_panel", f"SELECT CAST(date AS VARCHAR) AS date, {_PCT} FROM full_panel GROUP BY date")
def null_pct_by_date(t: Inputs):
    return _pct(t).select(text_date("date").alias("date"), *[r(F.col(f"{c}_pct")).alias(f"{c}_pct") for c in STATS])


@query("full_panel", """
SELECT CAST(date AS VARCHAR) AS date,
       count(price_MEAN) = count(price_min_MEAN) AND count(price_MEAN) = count(price_max_MEAN) AS overlap
FROM full_panel GROUP BY date""")
def null_overlap(t: Inputs):
    return Q.null_overlap(_pct(t), STATS).select(text_date("date").alias("date"), "overlap")


@query("full_panel", f"""
SELECT CAST(date AS VARCHAR) AS date,
       {rd('avg(a) OVER w')} AS price_smooth, {rd('avg(b) OVER w')} AS max_smooth
FROM (SELECT date, count(*) FILTER (price_MEAN IS NULL) * 100.0::DOUBLE / count(*) AS a,
             count(*) FILTER (price_max_MEAN IS NULL) * 100.0::DOUBLE / count(*) AS b FROM full_panel GROUP BY date)
WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_mean_7(t: Inputs):
    smooth = Q.rolling_mean(_pct(t), ["price_MEAN_pct", "price_max_MEAN_pct"])
    return smooth.select(
        text_date("date").alias("date"),
        r(F.col("price_MEAN_pct_smooth")).alias("price_smooth"),
        r(F.col("price_max_MEAN_pct_smooth")).alias("max_smooth"),
    )


# ---------------------------------------------------------------- yearly and regional

_YEARLY = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in STATS)
_YEARLY_SQL = f"SELECT year(date) AS year, zone_id, {_YEARLY} FROM panel GROUP BY year(date), zone_id"
_YEARLY_COLS = [f"{c}_{s}" for c in STATS for s in ("mean", "std")]


def _yearly(t: Inputs):
    return Y.yearly_zone_stats(t.panel, STATS)


@query("panel", f"""
SELECT CAST(year AS INTEGER) AS year, zone_id, {', '.join(rd(c, 6) + f' AS {c}' for c in _YEARLY_COLS)}
FROM ({_YEARLY_SQL})""")
def yearly_zone_stats(t: Inputs):
    return _yearly(t).select("year", "zone_id", *[r(F.col(c), 6).alias(c) for c in _YEARLY_COLS])


@query("panel", f"""
SELECT CAST(year AS INTEGER) AS year, zone_id, {', '.join(rd(c, 6) + f' AS {c}' for c in _YEARLY_COLS)}
FROM ({_YEARLY_SQL})""")
def yearly_stats_from_periods(t: Inputs):
    """The panel in three files that meet within years, the second one first short of its late rows."""
    root, date = scratch_dir(t.spark, "moments"), F.col("date")
    first, second = F.lit("1997-06-01").cast("date"), F.lit("1999-03-01").cast("date")
    middle = t.panel.where((date >= first) & (date < second))
    MO.write_period(middle.where(F.dayofmonth("date") < 20), root, "b", STATS)
    MO.write_period(t.panel.where(date < first), root, "a", STATS)
    MO.write_period(t.panel.where(date >= second), root, "c", STATS)
    MO.write_period(middle, root, "b", STATS)
    stats = MO.yearly_zone_stats(t.spark, root, STATS)
    return stats.select("year", "zone_id", *[r(F.col(c), 6).alias(c) for c in _YEARLY_COLS])


_BY_REGION = "FROM panel p JOIN zones z ON p.zone_id = z.zone_id GROUP BY"


@query("panel zones", f'SELECT "Region", {rd("avg(price_MEAN)", 6)} AS price_MEAN_mean {_BY_REGION} "Region"')
def region_mean(t: Inputs):
    means = Y.region_mean(t.panel, t.zone_facts, ["price_MEAN"])
    return means.select("Region", r(F.col("price_MEAN_mean"), 6).alias("price_MEAN_mean"))


@query("panel zones", f"""
SELECT CAST(year(date) AS INTEGER) AS year, "Region", {', '.join(rd(f'avg({c})', 6) + f' AS {c}_mean' for c in STATS)}
{_BY_REGION} year(date), "Region" """)
def region_year_mean(t: Inputs):
    means = Y.region_year_mean(t.panel, t.zone_facts, STATS)
    return means.select("year", "Region", *[r(F.col(f"{c}_mean"), 6).alias(f"{c}_mean") for c in STATS])


@query("full_panel zones", f"""
SELECT CAST(year(date) AS INTEGER) AS year, "Region", {rd('stddev_samp(price_MEAN)', 6)} AS price_MEAN_std,
       {rd('stddev_samp(price_max_MEAN)', 6)} AS price_max_MEAN_std
FROM full_panel p JOIN zones z ON p.zone_id = z.zone_id GROUP BY year(date), "Region" """)
def region_year_std(t: Inputs):
    cols = ["price_MEAN", "price_max_MEAN"]
    std = Y.region_year_std(t.full_panel, t.zone_facts, cols)
    return std.select("year", "Region", *[r(F.col(f"{c}_std"), 6).alias(f"{c}_std") for c in cols])


_STABLE = ["mean_over_years", "std_over_years", "mean_std_over_years", "std_std_over_years", "mean_CV"]


@query("panel", f"""
SELECT zone_id, {', '.join(rd(c, 6) + f' AS {c}' for c in _STABLE[:4])}, {rd('std_over_years / mean_over_years', 8)} AS mean_CV
FROM (SELECT zone_id, avg(price_MEAN_mean) AS mean_over_years, stddev_samp(price_MEAN_mean) AS std_over_years,
             avg(price_MEAN_std) AS mean_std_over_years, stddev_samp(price_MEAN_std) AS std_std_over_years
      FROM ({_YEARLY_SQL}) GROUP BY zone_id)""")
def stability_stats(t: Inputs):
    stats = Y.stability_stats(_yearly(t), "price_MEAN")
    return stats.select(
        "zone_id", *[r(F.col(c), 6).alias(c) for c in _STABLE[:4]], r(F.col("mean_CV"), 8).alias("mean_CV")
    )


# The t distribution in closed form for 1 to 5 degrees of freedom; s = |r|, c = sqrt(1 - r^2).
_P_VALUE = """CASE WHEN n < 2 OR slope IS NULL THEN NULL
     WHEN n = 2 THEN CASE WHEN r2 > 0 THEN 0 ELSE 1 END
     WHEN r2 >= 1 THEN 0
     WHEN n = 3 THEN 1 - 2 / pi() * asin(s)
     WHEN n = 4 THEN 1 - s
     WHEN n = 5 THEN 1 - 2 / pi() * (asin(s) + s * c)
     WHEN n = 6 THEN 1 - s * (1 + c * c / 2)
     WHEN n = 7 THEN 1 - 2 / pi() * (asin(s) + s * c * (1 + 2.0 / 3 * c * c)) END"""


_FIT = f"""
SELECT *, sqrt(r2) AS s, sqrt(1 - r2) AS c FROM (
    SELECT zone_id, bool_or(price_MEAN_std IS NULL) AS gap, regr_slope(price_MEAN_std, CAST(year AS DOUBLE)) AS slope,
           regr_count(price_MEAN_std, CAST(year AS DOUBLE)) AS n,
           CASE WHEN regr_syy(price_MEAN_std, CAST(year AS DOUBLE)) = 0 THEN 0
                ELSE least(regr_r2(price_MEAN_std, CAST(year AS DOUBLE)), 1) END AS r2
    FROM ({_YEARLY_SQL}) GROUP BY zone_id)"""


@query("panel", f"""
SELECT zone_id, {rd('CASE WHEN NOT gap THEN slope END', 6)} AS stability_trend,
       {rd('CASE WHEN NOT gap THEN ' + _P_VALUE + ' END', 8)} AS p_value FROM ({_FIT})""")
def stability_trend(t: Inputs):
    return _trend(t, strict=True)


@query("panel", f"""
SELECT zone_id, {rd('slope', 6)} AS stability_trend, {rd(_P_VALUE, 8)} AS p_value FROM ({_FIT})""")
def stability_trend_lenient(t: Inputs):
    return _trend(t, strict=False)


def _trend(t: Inputs, strict: bool):
    trend = Y.stability_trend(_yearly(t), "price_MEAN", strict)
    return trend.select(
        "zone_id", r(F.col("stability_trend"), 6).alias("stability_trend"), r(F.col("p_value"), 8).alias("p_value")
    )


# ---------------------------------------------------------------- monthly sheets

_TOTALS = " UNION ALL ".join(
    f"SELECT year, {m} AS month, sum(coalesce(TRY_CAST(Infection_{m} AS DOUBLE), 0)) AS total "
    f"FROM sheets WHERE row_no > 2 GROUP BY year"
    for m in MONTHS
)
_NAMES = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_SERIES = f"""
SELECT year, month, (dense_rank() OVER (ORDER BY year) - 1) * 12 + month AS position,
       ({_NAMES})[month] || ' ' || year AS label, total, month = 12 AS year_end FROM ({_TOTALS})"""


@query("sheets", f"SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, total FROM ({_TOTALS})")
def monthly_totals(t: Inputs):
    return M.monthly_totals(t.sheets)


@query("sheets", f"""
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(position AS INTEGER) AS position, label, total, year_end
FROM ({_SERIES}) ORDER BY position""")
def multi_year_monthly_series(t: Inputs):
    return M.multi_year_monthly_series(M.monthly_totals(t.sheets))


@query("sheets", f"""
SELECT CAST(year AS INTEGER) AS year, CAST(min(position) AS INTEGER) AS first_position,
       CAST(max(position) AS INTEGER) AS last_position FROM ({_SERIES}) GROUP BY year""")
def year_boundaries(t: Inputs):
    return M.year_boundaries(M.multi_year_monthly_series(M.monthly_totals(t.sheets)))


# ---------------------------------------------------------------- one-column summaries


def _hist_sql(table: str, col: str, bins: int) -> str:
    edge = f"CASE WHEN {{0}} = {bins} THEN hi ELSE lo + {{0}} * w END"
    return f"""
WITH lim AS (SELECT lo, hi, (hi - lo) / {bins} AS w FROM (SELECT min({col}) AS lo, max({col}) AS hi FROM {table})),
     g AS (SELECT {col} AS x, lo, hi, w, CAST(least(floor(({col} - lo) / w), {bins - 1}) AS INTEGER) AS b FROM {table}, lim),
     s AS (SELECT CASE WHEN x < {edge.format('b')} THEN b - 1
                       WHEN x >= {edge.format('(b + 1)')} AND b < {bins - 1} THEN b + 1 ELSE b END AS b FROM g)
SELECT CAST(i AS INTEGER) AS bin, {rd(edge.format('i'))} AS bin_left, {rd(edge.format('(i + 1)'))} AS bin_right,
       (SELECT count(*) FROM s WHERE b = i) AS n
FROM (SELECT unnest(range({bins})) AS i), lim"""


@query("", _hist_sql("lineitem", "l_extendedprice", 20))
def histogram(t: Inputs):
    bins = D.histogram(t.table("lineitem"), "l_extendedprice", 20)
    return bins.withColumns({c: r(F.col(c)) for c in ("bin_left", "bin_right")})


@query("", f"""
SELECT count(c_acctbal) AS count, {rd('avg(c_acctbal)')} AS mean, {rd('stddev_samp(c_acctbal)')} AS std,
       min(c_acctbal) AS min, {rd('quantile_cont(c_acctbal, 0.25)')} AS q25, {rd('quantile_cont(c_acctbal, 0.5)')} AS q50,
       {rd('quantile_cont(c_acctbal, 0.75)')} AS q75, max(c_acctbal) AS max
FROM customer""")
def describe(t: Inputs):
    row = D.describe(t.table("customer"), "c_acctbal")
    return row.withColumns({c: r(F.col(c)) for c in ("mean", "std", "q25", "q50", "q75")})


@query("", """
SELECT min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
       min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem""")
def value_range(t: Inputs):
    return D.value_range(t.table("lineitem"), ["l_quantity", "l_extendedprice"])


# ---------------------------------------------------------------- land cover by group

_SHARE = "SELECT zone_id, class_code, sum(area) AS a, sum(sum(area)) OVER (PARTITION BY zone_id) AS total FROM land_pixels GROUP BY zone_id, class_code"


@query("land_pixels", f"""
SELECT CAST(zone_id AS BIGINT) AS zone_id, class_code, round(CAST(a AS DOUBLE) * 100 / CAST(total AS DOUBLE), 2) AS value
FROM ({_SHARE})""")
def zonal_statistics_by_group(t: Inputs):
    pixels = t.land_pixels.withColumn("area", F.col("area").cast("double"))
    return X.zonal_statistics_by_group(pixels)


@query("land_pixels", """
SELECT CAST(zone_id AS BIGINT) AS zone_id, class_code, round(CAST(sum(area) AS DOUBLE), 2) AS value
FROM land_pixels GROUP BY zone_id, class_code""")
def zonal_statistics_by_group_sum(t: Inputs):
    sums = X.zonal_statistics_by_group(t.land_pixels, mode="SUM")
    return sums.withColumn("value", F.col("value").cast("double"))
