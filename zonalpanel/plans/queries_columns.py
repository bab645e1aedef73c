"""Column work and row filters over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions.lookups import ISLAND_GROUPS
from ..operators import columns as C
from ..operators import filters as L
from ..operators import pixels as X
from ..operators import spatial as S
from .inputs import PROVINCES, Inputs, r, rd, text_date
from .registry import query

# ---------------------------------------------------------------- names and numbers


@query("panel", f"""
SELECT zone_id AS zone, CAST(date AS VARCHAR) AS day, {rd('price_MEAN')} AS price_MEAN,
       {rd('price_min_MEAN')} AS price_min_MEAN, {rd('price_max_MEAN')} AS price_max_MEAN
FROM panel""")
def rename_by_position(t: Inputs):
    renamed = C.rename_by_position(t.panel, {0: "zone", 1: "day"})
    return renamed.select(
        "zone", text_date("day").alias("day"), *[r(F.col(c)).alias(c) for c in renamed.columns[2:]]
    )


@query("panel", f"""
SELECT zone_id, CAST(date AS VARCHAR) AS date, {rd('price_MEAN')} AS price_AVERAGE,
       {rd('price_min_MEAN')} AS price_min_AVERAGE, {rd('price_max_MEAN')} AS price_max_AVERAGE
FROM panel""")
def rename_regex(t: Inputs):
    renamed = C.rename_regex(t.panel, r"_MEAN$", "_AVERAGE")
    return renamed.select(
        "zone_id", text_date("date").alias("date"), *[r(F.col(c)).alias(c) for c in renamed.columns[2:]]
    )


@query("pixels", """
SELECT dataset, x, y, NDVI AS NDVI_MEAN, EVI AS EVI_MEAN FROM pixels""")
def suffix_bands(t: Inputs):
    return C.suffix_bands(t.pixels, ["NDVI", "EVI"], "MEAN").select(
        "dataset", "x", "y", "NDVI_MEAN", "EVI_MEAN"
    )


@query("sheets", """
SELECT year, row_no, TRY_CAST(Infection_3 AS DOUBLE) AS march,
       coalesce(TRY_CAST(Infection_3 AS DOUBLE), 0) AS march_filled
FROM sheets""")
def coerce_numeric(t: Inputs):
    text = t.sheets.select(
        "year", "row_no", F.col("Infection_3").alias("march"), F.col("Infection_3").alias("march_filled")
    )
    return C.coerce_numeric(C.coerce_numeric(text, ["march"]), ["march_filled"], fill=0)


@query("", """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y/%m/%d') END AS date,
       CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y/%m/%d') END AS parsed_one_digit
FROM orders""")
def normalize_date(t: Inputs):
    k = F.col("o_orderkey") % 5
    day = F.col("o_orderdate")
    layouts = ["yyyy/MM/dd", "yyyyMMdd", "yyyy_MM_dd", "yyyy-MM-dd"]
    text = F.when(k == 4, F.concat(F.lit("week "), F.date_format(day, "yyyy-MM")))
    short = F.when(k == 4, F.date_format(day, "yyyy/MM-dd"))
    for i, layout in enumerate(layouts):
        text = text.when(k == i, F.date_format(day, layout))
        one = layout.replace("MM", "M").replace("dd", "d") if i != 1 else layout
        short = short.when(k == i, F.date_format(day, one))
    raw = t.table("orders").select("o_orderkey", text.alias("date"), short.alias("parsed_one_digit"))
    return C.normalize_dates(C.normalize_dates(raw, "date"), "parsed_one_digit")


@query("", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(weekofyear(o_orderdate) AS INTEGER) AS week,
       strftime(o_orderdate, '%j') AS doy
FROM orders""")
def calendar_parts(t: Inputs):
    return C.calendar_parts(t.table("orders"), "o_orderdate").select("o_orderkey", "year", "week", "doy")


@query("", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST((year(l_shipdate) - 1995) * 52 + weekofyear(l_shipdate) AS INTEGER) AS continuous_week
FROM lineitem""")
def continuous_week(t: Inputs):
    parts = C.calendar_parts(t.table("lineitem"), "l_shipdate")
    return C.continuous_week(parts, base=1995).select(
        "l_orderkey", "l_linenumber", "l_partkey", "continuous_week"
    )


@query("full_panel", f"""
SELECT zone_id, CAST(date AS VARCHAR) AS date, {rd('coalesce(price_MEAN, 0)')} AS price_MEAN,
       {rd('coalesce(price_max_MEAN, 0)')} AS price_max_MEAN
FROM full_panel""")
def fill_missing(t: Inputs):
    filled = C.fill_missing(t.full_panel, {"price_MEAN": 0, "price_max_MEAN": 0})
    return filled.select(
        "zone_id", text_date("date").alias("date"),
        r(F.col("price_MEAN")).alias("price_MEAN"), r(F.col("price_max_MEAN")).alias("price_max_MEAN"),
    )


@query("full_panel", f"""
SELECT zone_id, CAST(date AS VARCHAR) AS date,
       {rd('coalesce(price_max_MEAN, price_min_MEAN)')} AS price
FROM full_panel""")
def prefer_left(t: Inputs):
    pair = t.full_panel.withColumnsRenamed({"price_max_MEAN": "price_x", "price_min_MEAN": "price_y"})
    return C.prefer_left(pair, ["price"]).select(
        "zone_id", text_date("date").alias("date"), r(F.col("price")).alias("price")
    )


@query("cases", "SELECT case_id, county FROM cases")
def drop_columns(t: Inputs):
    extra = t.cases.withColumn("county_dup", F.col("county"))
    return C.drop_columns(extra, ["onset", "imported", "town", "zone_id", "year"], suffix="_dup")


# ---------------------------------------------------------------- projections

_TM_X = "(150000.0::DOUBLE + c_custkey * 7919 % 200000)"
_TM_Y = "(2450000.0::DOUBLE + c_custkey * 104729 % 350000)"
# The forward projection undoes the inverse, so the check projects the exact inputs of a
# longitude / latitude grid forward and expects that grid back from the operator.
_N = P._N
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _forward_tm2(lon, lat):
    """Forward series with its own coefficients, for making grid coordinates."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(P.TM2_LON0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        k = F.lit(2.0 * j)
        x = x + F.lit(a) * F.cos(k * xi) * F.sinh(k * eta)
        y = y + F.lit(a) * F.sin(k * xi) * F.cosh(k * eta)
    scale = F.lit(P.TM2_K0 * P._A)
    return F.lit(P.TM2_FALSE_EASTING) + scale * x, scale * y


@query("", f"""
SELECT c_custkey, {rd('119.5 + (c_custkey * 7919 % 2500) / 1000.0::DOUBLE', 6)} AS lon,
       {rd('21.5 + (c_custkey * 104729 % 4000) / 1000.0::DOUBLE', 6)} AS lat
FROM customer""")
def tm_to_lonlat(t: Inputs):
    lon = F.lit(119.5) + (F.col("c_custkey") * 7919 % 2500) / F.lit(1000.0)
    lat = F.lit(21.5) + (F.col("c_custkey") * 104729 % 4000) / F.lit(1000.0)
    x, y = _forward_tm2(lon, lat)
    grid = t.table("customer").select("c_custkey", x.alias("x"), y.alias("y"))
    back = C.tm_to_lonlat(grid)
    return back.select("c_custkey", r(F.col("lon"), 6).alias("lon"), r(F.col("lat"), 6).alias("lat"))


@query("points", f"""
SELECT point_id, {rd('6378137.0::DOUBLE * radians(x + 118)', 4)} AS mx,
       {rd('6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y + 20) / 2))', 4)} AS my
FROM points""")
def lonlat_to_mercator(t: Inputs):
    lonlat = t.points.select("point_id", (F.col("x") + 118).alias("lon"), (F.col("y") + 20).alias("lat"))
    return C.lonlat_to_mercator(lonlat).select(
        "point_id", r(F.col("mx"), 4).alias("mx"), r(F.col("my"), 4).alias("my")
    )


@query("zones", f"""
SELECT zone_id, CAST(seq AS INTEGER) AS seq,
       {rd("6378137.0::DOUBLE * radians(x0 + CASE WHEN seq IN (1, 2) THEN 1 ELSE 0 END)", 4)} AS x,
       {rd("6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y0 + CASE WHEN seq IN (2, 3) THEN 1 ELSE 0 END) / 2))", 4)} AS y
FROM zones, (SELECT unnest([0, 1, 2, 3, 4]) AS seq)""")
def reproject_layer(t: Inputs):
    moved = S.reproject_layer(t.zones, 4326, 3857)
    vertices = moved.select("zone_id", F.posexplode(F.col("rings")[0]).alias("seq", "v"))
    return vertices.select(
        "zone_id", "seq", r(F.col("v.x"), 4).alias("x"), r(F.col("v.y"), 4).alias("y")
    )


@query("points", "SELECT point_id, x AS point_x, y AS point_y FROM points")
def make_points(t: Inputs):
    made = C.make_points(t.points, "x", "y")
    return made.select("point_id", F.col("point.x").alias("point_x"), F.col("point.y").alias("point_y"))


# ---------------------------------------------------------------- lookups and rates

_REGION_OF = {p: g for g, names in ISLAND_GROUPS.items() for p in names}
_CASES_SQL = " ".join(f"WHEN '{p}' THEN '{g}'" for p, g in _REGION_OF.items())
_LIST_SQL = "[" + ", ".join(f"'{p}'" for p in PROVINCES) + "]"


@query("", f"""
SELECT c_custkey, name AS "NAME_1", CASE name {_CASES_SQL} ELSE 'Unknown' END AS "Region"
FROM (SELECT c_custkey, ({_LIST_SQL})[c_custkey % {len(PROVINCES)} + 1] AS name FROM customer)""")
def map_region(t: Inputs):
    names = F.array(*[F.lit(p) for p in PROVINCES])
    placed = t.table("customer").select(
        "c_custkey", F.get(names, F.col("c_custkey") % len(PROVINCES)).alias("NAME_1")
    )
    return C.map_region(placed)


_RATES = """
SELECT c.year, c.zone_id, c.infections, TRY_CAST(p.p_cnt AS DOUBLE) AS population,
       c.infections / nullif(TRY_CAST(p.p_cnt AS DOUBLE), 0) * 1000 AS rate
FROM local_counts c LEFT JOIN population p ON c.year = p.year AND c.zone_id = p.zone_id"""


def _rates(t: Inputs):
    people = C.coerce_numeric(
        t.population.select("year", "zone_id", F.col("p_cnt").alias("population")), ["population"]
    )
    return C.incidence_rate(t.local_counts.join(people, ["year", "zone_id"], "left"))


@query("local_counts population", f"""
SELECT year, zone_id, infections, {rd('rate')} AS incidence_rate FROM ({_RATES})""")
def incidence_rate(t: Inputs):
    return _rates(t).select("year", "zone_id", "infections", r(F.col("incidence_rate")).alias("incidence_rate"))


@query("local_counts population", f"""
SELECT year, zone_id, {rd('CASE WHEN rate > 1000 THEN 1100 ELSE rate END')} AS incidence_rate
FROM ({_RATES})""")
def cap_incidence(t: Inputs):
    capped = C.cap_incidence(_rates(t))
    return capped.select("year", "zone_id", r(F.col("incidence_rate")).alias("incidence_rate"))


@query("local_counts population", f"""
SELECT year, zone_id, CASE WHEN rate > 1000 THEN 'high' ELSE 'kept' END AS part,
       {rd('rate')} AS incidence_rate
FROM ({_RATES}) WHERE rate IS NOT NULL""")
def exclude_high_incidence(t: Inputs):
    kept, high = L.exclude_high_incidence(_rates(t))
    both = kept.withColumn("part", F.lit("kept")).unionByName(high.withColumn("part", F.lit("high")))
    return both.select("year", "zone_id", "part", r(F.col("incidence_rate")).alias("incidence_rate"))


# ---------------------------------------------------------------- pixel bands

_MASKED = "CASE WHEN SummaryQA & 2 = 0 THEN {0} / 10000 END"
_DAY_OK = "CASE WHEN QC_Day >> 6 <= 2 THEN NDVI END"
_NIGHT_OK = "CASE WHEN QC_Night >> 6 <= 2 THEN EVI END"


@query("pixels", f"""
SELECT x, y, SummaryQA AS qa, {rd(_MASKED.format('NDVI'), 8)} AS "NDVI", {rd(_MASKED.format('EVI'), 8)} AS "EVI"
FROM pixels""")
def mask_qa_bit(t: Inputs):
    masked = X.mask_qa_bit(t.pixels, ["NDVI", "EVI"])
    return masked.select(
        "x", "y", F.col("SummaryQA").alias("qa"), r(F.col("NDVI"), 8).alias("NDVI"), r(F.col("EVI"), 8).alias("EVI")
    )


@query("pixels", f"""
SELECT x, y, QC_Day AS qc_day, QC_Night AS qc_night, {_DAY_OK} AS day, {_NIGHT_OK} AS night FROM pixels""")
def mask_lst_qc(t: Inputs):
    masked = X.mask_lst_qc(t.pixels, "NDVI", "EVI")
    return masked.select(
        "x", "y", F.col("QC_Day").alias("qc_day"), F.col("QC_Night").alias("qc_night"),
        F.col("NDVI").alias("day"), F.col("EVI").alias("night"),
    )


@query("pixels", f"""
SELECT x, y, {rd('NDVI * 0.02::DOUBLE - 273.15::DOUBLE', 4)} AS "LST_Day",
       {rd('EVI * 0.02::DOUBLE - 273.15::DOUBLE', 4)} AS "LST_Night",
       {rd('((NDVI * 0.02::DOUBLE - 273.15::DOUBLE) + (EVI * 0.02::DOUBLE - 273.15::DOUBLE)) / 2', 4)} AS "LST_Mean"
FROM pixels""")
def lst_celsius(t: Inputs):
    warm = X.lst_celsius(t.pixels, "NDVI", "EVI")
    return warm.select("x", "y", *[r(F.col(c), 4).alias(c) for c in ("LST_Day", "LST_Night", "LST_Mean")])


_RH = "100 * exp(17.625::DOUBLE * d / (243.04::DOUBLE + d)) / exp(17.625::DOUBLE * t / (243.04::DOUBLE + t))"


@query("points", f"""
SELECT point_id, {rd(_RH, 4)} AS rh FROM (SELECT point_id, x + 15 AS d, y + 18 AS t FROM points)""")
def relative_humidity(t: Inputs):
    kelvin = t.points.select(
        "point_id", (F.col("x") + 288.15).alias("dew"), (F.col("y") + 291.15).alias("temp")
    )
    wet = X.relative_humidity(kelvin, "dew", "temp", unit="K", out="rh")
    return wet.select("point_id", r(F.col("rh"), 4).alias("rh"))


@query("", """
SELECT c_custkey, CAST(greatest(m, b) AS VARCHAR) AS chunk_begin, CAST(least(last_day(m), e) AS VARCHAR) AS chunk_end
FROM (SELECT c_custkey, b, e, CAST(unnest(generate_series(date_trunc('month', b), e, INTERVAL 1 MONTH)) AS DATE) AS m
      FROM (SELECT o_custkey AS c_custkey, CAST(min(o_orderdate) AS DATE) AS b, CAST(max(o_orderdate) AS DATE) AS e
            FROM orders GROUP BY o_custkey))""")
def month_chunks(t: Inputs):
    spans = t.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.to_date(F.min("o_orderdate")).alias("begin"), F.to_date(F.max("o_orderdate")).alias("end")
    )
    return C.month_chunks(spans).select(
        "c_custkey", text_date("chunk_begin").alias("chunk_begin"), text_date("chunk_end").alias("chunk_end")
    )


# ---------------------------------------------------------------- filters


@query("cases", "SELECT case_id, CAST(onset AS VARCHAR) AS onset, zone_id FROM cases WHERE imported = '否'")
def local_cases(t: Inputs):
    return L.local_cases(t.cases).select("case_id", text_date("onset").alias("onset"), "zone_id")


@query("cases", """
SELECT case_id, town, CAST(year AS INTEGER) AS year FROM cases
WHERE county = 'BUILDING' AND town IN ('1-URGENT', '2-HIGH') AND year BETWEEN 1996 AND 1999""")
def cases_in_area(t: Inputs):
    kept = L.cases_in_area(t.cases, "BUILDING", ["1-URGENT", "2-HIGH"], 1996, 1999)
    return kept.select("case_id", "town", "year")


_LON = "CASE WHEN value >= -500 THEN x + 118 END"


def _lonlat(t: Inputs):
    return t.points.select(
        "point_id", "x", "y",
        F.when(F.col("value") >= -500, F.col("x") + 118).alias("lon"),
        (F.col("y") + 19).alias("lat"),
    )


@query("points", f"""
SELECT point_id, coalesce(({_LON}) BETWEEN 120 AND 121 AND y + 19 BETWEEN 20 AND 25, false) AS valid
FROM points""")
def split_outliers(t: Inputs):
    valid, outliers = L.split_outliers(_lonlat(t))
    both = valid.withColumn("valid", F.lit(True)).unionByName(outliers.withColumn("valid", F.lit(False)))
    return both.select("point_id", "valid")


@query("points", f"""
SELECT point_id, CASE WHEN ok THEN lon ELSE x END AS lon, CASE WHEN ok THEN lat ELSE y END AS lat
FROM (SELECT point_id, x, y, {_LON} AS lon, y + 19 AS lat,
             coalesce(({_LON}) BETWEEN 120 AND 121 AND y + 19 BETWEEN 20 AND 25, false) AS ok
      FROM points)""")
def correct_outliers(t: Inputs):
    return L.correct_outliers(_lonlat(t)).select("point_id", "lon", "lat")


@query("cases", "SELECT case_id, CAST(year AS INTEGER) AS year FROM cases WHERE year >= 1997 AND year <= 2000")
def year_window(t: Inputs):
    return L.year_window(t.cases, 1997, 2000).select("case_id", "year")


@query("full_panel", """
SELECT zone_id, CAST(date AS VARCHAR) AS date FROM full_panel
WHERE price_MEAN IS NOT NULL AND price_max_MEAN IS NOT NULL""")
def drop_missing(t: Inputs):
    return L.drop_missing(t.full_panel, ["price_MEAN", "price_max_MEAN"]).select(
        "zone_id", text_date("date").alias("date")
    )


@query("zones panel", """
SELECT p.zone_id, zone_name, CAST(date AS VARCHAR) AS date FROM panel p JOIN zones z ON p.zone_id = z.zone_id
WHERE p.zone_id NOT IN (3, 8, 14)""")
def zones_by_id(t: Inputs):
    kept = L.zones_by_id(t.zone_facts, [3, 8, 14], keep=False)
    return t.panel.join(kept, "zone_id").select("zone_id", "zone_name", text_date("date").alias("date"))
