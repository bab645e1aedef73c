"""Joins, imputation, reshaping and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as K
from ..operators import filters as L
from ..operators import joins as J
from ..operators import monthly as M
from ..operators import ordered as O
from ..operators import pixels as X
from ..operators import reshape as R
from ..operators import spatial as S
from .inputs import MONTHS, POPULATION_YEARS, Inputs, r, rd, text_date
from .registry import query

MONTH_COLUMNS = [f"{kind}_{m}" for kind in ("Infection", "Death") for m in MONTHS]


@query("local_counts population", """
SELECT c.year, c.zone_id, c.infections, p.p_cnt, p.m_cnt, p.f_cnt
FROM local_counts c LEFT JOIN population p ON c.year = p.year AND c.zone_id = p.zone_id""")
def cases_with_population(t: Inputs):
    return J.cases_with_population(t.local_counts, t.population)


@query("zones", f"""
SELECT z.zone_id, z.zone_name, {rd('coalesce(s.credit, 0)', 2)} AS credit
FROM zones z LEFT JOIN (SELECT s_nationkey AS zone_id, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS credit
                        FROM supplier GROUP BY s_nationkey) s
ON z.zone_id = s.zone_id""")
def zones_left_join_stat(t: Inputs):
    stat = t.table("supplier").groupBy(F.col("s_nationkey").alias("zone_id")).agg(
        F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("credit")
    )
    joined = J.zones_left_join_stat(t.zone_facts.select("zone_id", "zone_name"), stat)
    return joined.withColumn("credit", r(F.col("credit"), 2))


@query("zones panel", f"""
SELECT p.zone_id, CAST(p.date AS VARCHAR) AS date, z."Region", {rd('p.price_MEAN')} AS price_MEAN
FROM panel p JOIN zones z ON p.zone_id = z.zone_id""")
def zones_inner_join_panel(t: Inputs):
    joined = J.zones_inner_join_panel(t.zone_facts, t.panel)
    return joined.select("zone_id", text_date("date").alias("date"), "Region", r(F.col("price_MEAN")).alias("price_MEAN"))


_PLACES = """
SELECT n_nationkey AS zone_id, 'Province ' || (n_nationkey % 5) AS p,
       CASE WHEN n_nationkey % 6 <> 0 THEN 'City ' || n_nationkey END AS c FROM nation"""


@query("sheets", f"""
SELECT z.zone_id, s.year, s.row_no, s.* EXCLUDE (year, row_no, Province, City, c2)
FROM ({_PLACES}) z LEFT JOIN
     (SELECT *, CASE WHEN (row_no - 1) % 6 <> 0 THEN City END AS c2 FROM sheets) s
ON z.p IS NOT DISTINCT FROM s.Province AND z.c IS NOT DISTINCT FROM s.c2""")
def zones_left_join_cases(t: Inputs):
    key = F.col("zone_id")
    city = F.concat(F.lit("City "), key.cast("string"))
    zones = t.zone_facts.select(
        "zone_id",
        F.concat(F.lit("Province "), (key % 5).cast("string")).alias("NAME_1"),
        F.when(key % 6 != 0, city).alias("NAME_2"),
    )
    sheet = t.sheets.select(
        "year", "row_no", *MONTH_COLUMNS, "Province",
        F.when((F.col("row_no") - 1) % 6 != 0, F.col("City")).alias("City"),
    )
    joined = J.zones_left_join_cases(zones, sheet, ("NAME_1", "NAME_2"), ("Province", "City"))
    return joined.select("zone_id", "year", "row_no", *MONTH_COLUMNS)


_A = "SELECT zone_id, date, price_MEAN, CASE WHEN price_min_MEAN > 100 THEN price_min_MEAN END AS low FROM panel WHERE year(date) <= 1998"
_B = "SELECT zone_id, date, price_min_MEAN AS low, price_max_MEAN AS high FROM panel WHERE year(date) >= 1997"


def _two_panels(t: Inputs):
    year = F.year("date")
    a = t.panel.where(year <= 1998).select(
        "zone_id", "date", F.dayofyear("date").alias("doy"), "price_MEAN",
        F.when(F.col("price_min_MEAN") > 100, F.col("price_min_MEAN")).alias("low"),
    )
    b = t.panel.where(year >= 1997).select(
        "zone_id", "date", F.dayofyear("date").alias("doy"),
        F.col("price_min_MEAN").alias("low"), F.col("price_max_MEAN").alias("high"),
    )
    return a, b


@query("panel", f"""
SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, CAST(coalesce(a.date, b.date) AS VARCHAR) AS date,
       CAST(dayofyear(coalesce(a.date, b.date)) AS INTEGER) AS doy,
       {rd('a.price_MEAN')} AS price_MEAN, {rd('coalesce(a.low, b.low)')} AS low, {rd('b.high')} AS high
FROM ({_A}) a FULL OUTER JOIN ({_B}) b ON a.zone_id = b.zone_id AND a.date = b.date""")
def merge_panels_outer(t: Inputs):
    merged = J.merge_panels_outer(*_two_panels(t))
    return merged.select(
        "zone_id", text_date("date").alias("date"), "doy",
        *[r(F.col(c)).alias(c) for c in ("price_MEAN", "low", "high")],
    )


@query("zones traps", f"""
SELECT CAST(y.year AS INTEGER) AS year, z.zone_id, z.zone_name, {rd('coalesce(s.avg_eggs, 0)', 2)} AS avg_eggs
FROM zones z, (SELECT unnest(range(1992, 2003)) AS year) y LEFT JOIN
     (SELECT year(start_time) AS year, zone_id, sum(avg_eggs) AS avg_eggs FROM traps
      GROUP BY ALL) s
ON s.year = y.year AND s.zone_id = z.zone_id""")
def year_zone_template(t: Inputs):
    sums = (
        t.traps.withColumn("year", F.year("start_time"))
        .groupBy("year", "zone_id")
        .agg(F.sum("avg_eggs").alias("avg_eggs"))
    )
    filled = J.year_zone_template(
        t.zone_facts.select("zone_id", "zone_name"), range(1992, 2003), sums, ["avg_eggs"]
    )
    return filled.withColumn("avg_eggs", r(F.col("avg_eggs"), 2))


@query("panel zones", f"""
WITH donors AS (SELECT missing_id, donor_id FROM (
         SELECT m.zone_id AS missing_id, d.zone_id AS donor_id, row_number() OVER (PARTITION BY m.zone_id ORDER BY
                (m.x0 - d.x0) * (m.x0 - d.x0) + (m.y0 - d.y0) * (m.y0 - d.y0), d.zone_id) AS place
         FROM zones m JOIN zones d ON m.zone_id IN (3, 8, 14) AND d.zone_id NOT IN (3, 8, 14)) WHERE place = 1),
     added AS (SELECT d.missing_id AS zone_id, g.date, g.price_MEAN
               FROM donors d JOIN panel g ON g.zone_id = d.donor_id
               WHERE NOT EXISTS (SELECT 1 FROM panel h WHERE h.zone_id = d.missing_id AND h.date = g.date))
SELECT zone_id, CAST(date AS VARCHAR) AS date, {rd('price_MEAN')} AS price_MEAN
FROM (SELECT zone_id, date, price_MEAN FROM panel UNION ALL SELECT * FROM added)""")
def impute_from_donor(t: Inputs):
    """Days that three zones lack, from the zones nearest to them."""
    donors = S.nearest_donor_zone(S.polygon_centroid(t.zones), [3, 8, 14])
    filled = J.impute_from_donor(t.panel.select("zone_id", "date", "price_MEAN"), donors)
    return filled.select("zone_id", text_date("date").alias("date"), r(F.col("price_MEAN")).alias("price_MEAN"))


_WEEKS = """
SELECT coalesce(c.year, e.year) AS year, coalesce(c.week, e.week) AS week, c.cases, e.avg_eggs
FROM (SELECT year(onset) AS year, weekofyear(onset) AS week, count(*) AS cases FROM cases GROUP BY ALL) c
FULL OUTER JOIN (SELECT year(start_time) AS year, weekofyear(start_time) AS week, sum(avg_eggs) AS avg_eggs
                 FROM traps GROUP BY ALL) e ON c.year = e.year AND c.week = e.week"""


def _aligned(t: Inputs):
    from ..operators.columns import calendar_parts

    weeks = K.weekly_counts(t.cases.drop("year"), "onset")
    eggs = K.weekly_sum(calendar_parts(t.traps, "start_time"), "avg_eggs")
    return J.align_weekly_series(weeks, eggs)


@query("cases traps", f"""
SELECT CAST(year AS INTEGER) AS year, CAST(week AS INTEGER) AS week, cases, {rd('avg_eggs', 2)} AS avg_eggs
FROM ({_WEEKS})""")
def align_weekly_series(t: Inputs):
    return _aligned(t).withColumn("avg_eggs", r(F.col("avg_eggs"), 2))


@query("cases traps", f"""
SELECT CAST(year AS INTEGER) AS year, CAST(week AS INTEGER) AS week, cases, {rd('avg_eggs', 2)} AS avg_eggs
FROM ({_WEEKS}) w WHERE week <= 40 AND week >= (
     SELECT min(v.week) FROM ({_WEEKS}) v WHERE v.year = w.year AND v.cases > 0)""")
def weeks_from_first_case(t: Inputs):
    return L.weeks_from_first_case(_aligned(t)).withColumn("avg_eggs", r(F.col("avg_eggs"), 2))


@query("customer_counts", """
SELECT a.zone_id, a.deaths % 3 AS a_code, b.infections % 4 AS b_code
FROM customer_counts a JOIN customer_counts b ON a.zone_id = b.zone_id""")
def join_classes_on_zone(t: Inputs):
    base = t.customer_counts
    a = base.select("zone_id", (F.col("deaths") % 3).alias("a_code"))
    b = base.select("zone_id", (F.col("infections") % 4).alias("b_code"))
    return J.join_classes_on_zone(a, b)


def _wide_sql() -> str:
    cols, joins = [], []
    for y in POPULATION_YEARS:
        cols += [
            f"CAST(c{y}.infections AS DOUBLE) AS Inf_{y}",
            f"CASE WHEN c{y}.infections IS NOT NULL THEN coalesce(TRY_CAST(p{y}.p_cnt AS DOUBLE), 0) END AS Pop_{y}",
            rd(f"c{y}.infections / nullif(TRY_CAST(p{y}.p_cnt AS DOUBLE), 0) * 1000") + f" AS IR_{y}",
            f"CASE WHEN c{y}.infections IS NOT NULL THEN p{y}.m_cnt END AS M_{y}",
            f"CASE WHEN c{y}.infections IS NOT NULL THEN p{y}.f_cnt END AS F_{y}",
        ]
        joins += [
            f"LEFT JOIN local_counts c{y} ON c{y}.zone_id = z.zone_id AND c{y}.year = {y}",
            f"LEFT JOIN population p{y} ON p{y}.zone_id = z.zone_id AND p{y}.year = {y}",
        ]
    return f"SELECT z.zone_id, z.zone_name, {', '.join(cols)} FROM zones z {' '.join(joins)}"


@query("zones local_counts population", _wide_sql())
def wide_incidence_by_year(t: Inputs):
    wide = J.wide_incidence_by_year(
        t.zone_facts.select("zone_id", "zone_name"), t.local_counts, t.population, POPULATION_YEARS
    )
    return wide.withColumns({f"IR_{y}": r(F.col(f"IR_{y}")) for y in POPULATION_YEARS})


# ---------------------------------------------------------------- unions and reshaping


@query("panel", f"""
SELECT zone_id, CAST(date AS VARCHAR) AS date, {rd('low')} AS low, {rd('price_MEAN')} AS price_MEAN, {rd('high')} AS high
FROM (SELECT zone_id, date, low, price_MEAN, NULL AS high FROM ({_A})
      UNION ALL SELECT zone_id, date, low, NULL, high FROM ({_B}))""")
def union_panels(t: Inputs):
    union = R.union_panels(*_two_panels(t))
    return union.select(
        "zone_id", text_date("date").alias("date"), *[r(F.col(c)).alias(c) for c in ("low", "price_MEAN", "high")]
    )


@query("panel", "SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM panel")
def distinct_values(t: Inputs):
    return R.distinct_values(t.panel, "date").select(text_date("date").alias("date"))


@query("", """
SELECT DISTINCT c_custkey AS zone_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_zone_ids(t: Inputs):
    every = t.table("customer").select(F.col("c_custkey").alias("zone_id"))
    seen = t.table("orders").select(F.col("o_custkey").alias("zone_id"))
    return R.missing_zone_ids(every, seen)


def _wide_zonal(t: Inputs):
    """Daily sums per customer in the wide export layout, both date spellings."""
    months = [(y, m) for y in range(1995, 2002) for m in MONTHS]
    tokens = [f"{y}{m:02d}01" if m % 2 else f"{y}_{m:02d}_01" for y, m in months]
    spelling = F.when(F.month("o_orderdate") % 2 == 1, F.date_format("o_orderdate", "yyyyMM'01'")).otherwise(
        F.date_format("o_orderdate", "yyyy'_'MM'_01'")
    )
    orders = t.table("orders").select(F.col("o_custkey").alias("zone_id"), spelling.alias("token"), "o_totalprice")
    # a customer's months first, then their columns
    wide = orders.groupBy("zone_id").pivot("token", tokens).agg(
        F.max("o_totalprice").alias("NDVI"), F.min("o_totalprice").alias("EVI")
    )
    return R.wide_zonal_to_long(wide, ["NDVI", "EVI"])


@query("", """
WITH zone_list AS (SELECT DISTINCT o_custkey AS zone_id FROM orders),
     months AS (SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS d)),
     sums AS (SELECT o_custkey AS zone_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS d,
                     max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY ALL)
SELECT strftime(m.d, '%Y/%m/%d') AS "Date", strftime(m.d, '%j') AS "Doy", s.hi AS "NDVI", s.lo AS "EVI", z.zone_id
FROM zone_list z CROSS JOIN months m LEFT JOIN sums s ON s.zone_id = z.zone_id AND s.d = m.d""")
def wide_zonal_to_long(t: Inputs):
    return _wide_zonal(t)


_YEARS = list(range(1995, 2003))


@query("traps", f"""
SELECT CAST(weekofyear(start_time) AS INTEGER) AS week, {', '.join(
    f'nullif(count(*) FILTER (year(start_time) = {y}), 0) AS "{y}"' for y in _YEARS)}
FROM traps GROUP BY weekofyear(start_time)""")
def weekly_entries_by_year(t: Inputs):
    from ..operators.columns import calendar_parts

    return K.weekly_entries_by_year(calendar_parts(t.traps, "start_time"), _YEARS)


@query("land_pixels", f"""
SELECT CAST(zone_id AS BIGINT) AS zone_id, {', '.join(
    f'round(CAST(sum(area) FILTER (class_code = {c}) AS DOUBLE), 2) AS "Class_{c}"' for c in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95))}
FROM land_pixels GROUP BY zone_id""")
def landcover_composition(t: Inputs):
    from ..functions.lookups import LAND_COVER_CLASSES

    long = t.land_pixels.groupBy("zone_id", "class_code").agg(
        F.sum("area").cast("double").alias("value")
    )
    wide = X.landcover_composition(long, LAND_COVER_CLASSES)
    return wide.select("zone_id", *[F.round(f"Class_{c}", 2).alias(f"Class_{c}") for c in LAND_COVER_CLASSES])


_LONG_SQL = " UNION ALL ".join(
    f'SELECT year, "Province", "City", {m} AS month, TRY_CAST(Infection_{m} AS DOUBLE) AS infections, '
    f"TRY_CAST(Death_{m} AS DOUBLE) AS deaths FROM sheets"
    for m in MONTHS
)


@query("sheets", f'SELECT CAST(year AS INTEGER) AS year, "Province", "City", month, infections, deaths FROM ({_LONG_SQL})')
def sheet_to_long(t: Inputs):
    return M.sheet_to_long(t.sheets)


@query("panel", f"""
SELECT zone_id, CAST(date AS VARCHAR) AS date, {rd('price_MEAN')} AS price_MEAN FROM panel ORDER BY date, zone_id""")
def sort_by_key(t: Inputs):
    ordered = R.sort_by_key(t.panel, ["date", "zone_id"])
    return ordered.select("zone_id", text_date("date").alias("date"), r(F.col("price_MEAN")).alias("price_MEAN"))


@query("", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def head(t: Inputs):
    return R.head(t.table("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query("", """
SELECT l_quantity, l_orderkey FROM (
    SELECT l_quantity, l_orderkey, row_number() OVER (ORDER BY l_quantity, l_orderkey) - 1 AS pos FROM lineitem)
WHERE pos % 5 = 0""")
def every_nth(t: Inputs):
    rows = t.table("lineitem").select("l_quantity", "l_orderkey")
    return O.every_nth(rows, ["l_quantity", "l_orderkey"], 5)


@query("points", f"""
WITH gap AS (SELECT * FROM points WHERE value < 0), known AS (SELECT * FROM points WHERE value >= 0)
SELECT missing_id, donor_id, {rd('d')} AS distance FROM (
    SELECT g.point_id AS missing_id, k.point_id AS donor_id,
           sqrt((g.x - k.x) * (g.x - k.x) + (g.y - k.y) * (g.y - k.y)) AS d,
           row_number() OVER (PARTITION BY g.point_id ORDER BY
               sqrt((g.x - k.x) * (g.x - k.x) + (g.y - k.y) * (g.y - k.y)), k.point_id) AS place
    FROM gap g, known k) WHERE place = 1""")
def nearest_donor_zone(t: Inputs):
    centres = t.points.select(F.col("point_id").alias("zone_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), "value")
    found = S.nearest_donor_zone(centres, F.col("value") < 0)
    return found.withColumn("distance", r(F.col("distance")))
