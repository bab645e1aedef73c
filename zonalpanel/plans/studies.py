"""The reference's three end-to-end analyses as chains of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as B
from ..operators import columns as C
from ..operators import counts as K
from ..operators import filters as L
from ..operators import joins as J
from ..operators import pixels as X
from ..operators import quality as Q
from ..operators import reshape as R
from ..operators import spatial as S
from ..operators import yearly as Y
from ..session import scratch_dir, written
from ..sources.pixels import scan_pixels, write_pixels
from ..sources.sinks import write_panel
from .inputs import Inputs, r, rd, text_date
from .queries_statistics import _P_VALUE
from .registry import query


def zonal_extraction(
    pixels: DataFrame, zones: DataFrame, bands: Sequence[str], stat: str, start: str, end: str
) -> DataFrame:
    """Masked pixels of a date range to a panel: Date, Doy, zone and one statistic per band."""
    dated = pixels.where(F.col("image_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    masked = X.mask_qa_bit(dated, bands)
    stats = X.zonal_statistics(masked, zones, bands, stat)
    return stats.select(
        F.date_format("image_date", "yyyy/MM/dd").alias("Date"),
        F.date_format("image_date", "DDD").alias("Doy"),
        *[f"{b}_{stat}" for b in bands],
        "zone_id",
    )


def temperature_extraction(
    spark: SparkSession, folder: str, out: str, dataset: str, zones: DataFrame, start: str, end: str
) -> DataFrame:
    """A folder of surface temperature images to a written panel, read back: Date, Doy, zone_id, means in degrees.

    Only the folders of the dataset and the dates are read, poor pixels masked by their quality
    words, numbers turned to degrees and averaged over each zone.
    """
    bands = ["LST_Day", "LST_Night", "LST_Mean"]
    needed = ["LST_Day_1km", "LST_Night_1km", "QC_Day", "QC_Night"]
    images = scan_pixels(spark, folder, dataset, start, end, needed)
    degrees = X.lst_celsius(X.mask_lst_qc(images)).select("image_date", "x", "y", *bands)
    means = X.zonal_statistics(degrees, zones, bands, "MEAN")
    panel = means.select(
        F.date_format("image_date", "yyyy/MM/dd").alias("Date"),
        F.date_format("image_date", "DDD").alias("Doy"),
        "zone_id",
        *[f"{b}_MEAN" for b in bands],
    )
    write_panel(panel, out)
    return spark.read.schema(panel.schema).option("header", True).csv(out)


def rainfall_extraction(
    spark: SparkSession, folder: str, out: str, dataset: str, zones: DataFrame, start: str, end: str, band: str
) -> DataFrame:
    """A folder of rainfall images to a panel written by year, read back: zone_id, Date, year, sum per zone and image."""
    images = scan_pixels(spark, folder, dataset, start, end, [band])
    placed = S.spatial_join_points(images.select("image_date", "x", "y", band), zones.select("zone_id", "rings"))
    sums = placed.groupBy("zone_id", F.col("image_date").alias("Date")).agg(F.sum(band).alias(band))
    panel = C.suffix_bands(sums, [band], "SUM").withColumn("year", F.year("Date"))
    write_panel(panel, out, fmt="parquet", partition_by=["year"])
    return spark.read.parquet(out).select(*panel.columns)


def climate_panel(parts: Sequence[DataFrame], zones: DataFrame, lacking: Sequence[int]) -> DataFrame:
    """Period files to one panel, zones without data filled from the nearest zone."""
    panel = written(R.union_panels(*parts), "panel")
    metres = S.reproject_layer(zones, 4326, 3857)
    donors = written(S.nearest_donor_zone(S.polygon_centroid(metres), lacking), "donors")
    return J.impute_from_donor(panel, donors)


def case_incidence(
    cases: DataFrame, population: DataFrame, county: str, first_year: int, last_year: int
) -> DataFrame:
    """Local cases of an area to yearly rates per zone, implausibly high ones left out."""
    local = L.cases_in_area(L.local_cases(cases), county, None, first_year, last_year)
    people = C.coerce_numeric(
        population.select("year", "zone_id", F.col("p_cnt").alias("population")), ["population"]
    )
    rates = C.incidence_rate(J.cases_with_population(K.count_cases(local), people))
    kept, _ = L.exclude_high_incidence(rates)
    return kept


def bivariate_map(
    points: DataFrame, zones: DataFrame, rates: DataFrame, year: int, value: str
) -> DataFrame:
    """Trap sums and case rates of one year as a 3 x 3 map."""
    eggs = J.year_zone_template(
        zones.select("zone_id"), [year], K.eggs_by_zone_year(points, zones, value), [value]
    )
    filled = J.zones_left_join_stat(zones.select("zone_id"), rates.select("zone_id", "incidence_rate"))
    return B.bivariate_class_3x3(eggs.select("zone_id", value), filled, value, "incidence_rate")


# ---------------------------------------------------------------- registered


_OK = "CASE WHEN SummaryQA & 2 = 0 THEN {0} / 10000 END"


@query("placed_pixels", f"""
SELECT strftime(image_date, '%Y/%m/%d') AS "Date", strftime(image_date, '%j') AS "Doy", zone_id,
       {rd('avg(' + _OK.format('NDVI') + ')', 9)} AS "NDVI_MEAN", {rd('avg(' + _OK.format('EVI') + ')', 11)} AS "EVI_MEAN"
FROM placed_pixels WHERE image_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY image_date, zone_id""")
def study_zonal_extraction(t: Inputs):
    panel = zonal_extraction(t.pixels, t.zones, ["NDVI", "EVI"], "MEAN", "1996-01-01", "2000-12-31")
    return panel.withColumns({"NDVI_MEAN": r(F.col("NDVI_MEAN"), 9), "EVI_MEAN": r(F.col("EVI_MEAN"), 11)})


# Northing of a zone's middle in units of one degree at the equator.
_NORTH = "(ln(tan(pi() / 4 + radians({0}.y0) / 2)) + ln(tan(pi() / 4 + radians({0}.y0 + 1) / 2))) / 2 * 180 / pi()"
_FILLED = f"""
WITH gappy AS (SELECT zone_id, date, price_MEAN FROM panel),
     donors AS (SELECT missing_id, donor_id FROM (
         SELECT m.zone_id AS missing_id, d.zone_id AS donor_id, row_number() OVER (PARTITION BY m.zone_id ORDER BY
                pow(m.x0 - d.x0, 2) + pow({_NORTH.format('m')} - {_NORTH.format('d')}, 2), d.zone_id) AS place
         FROM zones m JOIN zones d ON m.zone_id IN (0, 24) AND d.zone_id NOT IN (0, 24)) WHERE place = 1),
     filled AS (SELECT * FROM gappy UNION ALL
                SELECT d.missing_id, g.date, g.price_MEAN FROM donors d JOIN gappy g ON g.zone_id = d.donor_id
                WHERE NOT EXISTS (SELECT 1 FROM gappy h WHERE h.zone_id = d.missing_id AND h.date = g.date)),
     yearly AS (SELECT year(date) AS year, zone_id, stddev_samp(price_MEAN) AS price_MEAN_std FROM filled GROUP BY 1, 2),
     fit AS (SELECT zone_id, bool_or(price_MEAN_std IS NULL) AS gap, regr_slope(price_MEAN_std, CAST(year AS DOUBLE)) AS slope,
                    regr_count(price_MEAN_std, CAST(year AS DOUBLE)) AS n,
                    CASE WHEN regr_syy(price_MEAN_std, CAST(year AS DOUBLE)) = 0 THEN 0
                         ELSE least(regr_r2(price_MEAN_std, CAST(year AS DOUBLE)), 1) END AS r2
             FROM yearly GROUP BY zone_id)
"""


def _filled_panel(t: Inputs) -> DataFrame:
    kept = t.panel.select("zone_id", "date", "price_MEAN")
    early = L.drop_missing(kept, ["date"]).where(F.year("date") <= 1997)
    late = kept.where(F.year("date") > 1997)
    return climate_panel([early, late], t.zones, [0, 24])


@query("panel zones", f"""{_FILLED}
SELECT f.zone_id, z.zone_name, z."Region", {rd('CASE WHEN NOT gap THEN slope END', 6)} AS stability_trend,
       {rd('CASE WHEN NOT gap THEN ' + _P_VALUE + ' END', 8)} AS p_value
FROM (SELECT *, sqrt(r2) AS s, sqrt(1 - r2) AS c FROM fit) f JOIN zones z ON f.zone_id = z.zone_id""")
def study_climate_trend(t: Inputs):
    yearly = Y.yearly_zone_stats(_filled_panel(t), ["price_MEAN"])
    trend = J.zones_inner_join_panel(t.zone_facts, Y.stability_trend(yearly, "price_MEAN"))
    return trend.select(
        "zone_id", "zone_name", "Region",
        r(F.col("stability_trend"), 6).alias("stability_trend"), r(F.col("p_value"), 8).alias("p_value"),
    )


@query("panel zones", f"""{_FILLED}
SELECT CAST(date AS VARCHAR) AS date, count(DISTINCT zone_id) AS n_zones FROM filled GROUP BY date HAVING count(DISTINCT zone_id) <> 25""")
def study_panel_audit(t: Inputs):
    return Q.incomplete_dates(_filled_panel(t), 25).withColumn("date", text_date("date"))


_AREA = """
WITH area AS (SELECT year, zone_id, count(*) AS infections FROM cases
              WHERE imported = '否' AND county = 'BUILDING' AND year BETWEEN 1996 AND 2000 AND zone_id IS NOT NULL GROUP BY 1, 2),
     rates AS (SELECT a.year, a.zone_id, infections, infections / nullif(TRY_CAST(p_cnt AS DOUBLE), 0) * 1000 AS rate
               FROM area a LEFT JOIN population p ON a.year = p.year AND a.zone_id = p.zone_id)
"""


@query("cases population", f"""{_AREA}
SELECT CAST(year AS INTEGER) AS year, zone_id, infections, {rd('rate')} AS incidence_rate FROM rates WHERE rate <= 1000""")
def study_case_incidence(t: Inputs):
    rates = case_incidence(t.cases, t.population, "BUILDING", 1996, 2000)
    return rates.select("year", "zone_id", "infections", r(F.col("incidence_rate")).alias("incidence_rate"))


@query("cases population placed_points", f"""{_AREA},
     eggs AS (SELECT z.zone_id, coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS value FROM zones z
              LEFT JOIN placed_points p ON p.zone_id = z.zone_id AND p.year = 2016 GROUP BY z.zone_id),
     full_rates AS (SELECT z.zone_id, coalesce(r.rate, 0) AS rate FROM zones z
                    LEFT JOIN (SELECT * FROM rates WHERE year = 1998 AND rate <= 1000) r ON r.zone_id = z.zone_id),
     a AS (SELECT zone_id, row_number() OVER (ORDER BY value, zone_id) AS rk, count(*) OVER () AS n FROM eggs),
     b AS (SELECT zone_id, row_number() OVER (ORDER BY rate, zone_id) AS rk, count(*) OVER () AS n FROM full_rates)
SELECT a.zone_id, CAST(a.rk > 1 + (a.n - 1) / 3.0::DOUBLE AS INTEGER) + CAST(a.rk > 1 + (a.n - 1) * 2 / 3.0::DOUBLE AS INTEGER) AS egg_code,
       CAST(b.rk > 1 + (b.n - 1) / 3.0::DOUBLE AS INTEGER) + CAST(b.rk > 1 + (b.n - 1) * 2 / 3.0::DOUBLE AS INTEGER) AS rate_code
FROM a JOIN b ON a.zone_id = b.zone_id""")
def study_bivariate_map(t: Inputs):
    rates = case_incidence(t.cases, t.population, "BUILDING", 1996, 2000).where("year = 1998")
    points = t.points.withColumn("value", F.col("value").cast("decimal(18,2)"))
    return bivariate_map(points, t.zones, rates, 2016, "value").select("zone_id", "egg_code", "rate_code")


def _image_folder(t: Inputs) -> str:
    """The pixels as a folder of surface temperature images."""
    folder = scratch_dir(t.spark, "temperature-images")
    numbers = {"LST_Day_1km": F.col("SummaryQA") * 10 + 13000, "LST_Night_1km": F.col("QC_Night") * 8 + 12800}
    write_pixels(t.pixels.withColumns({c: n.cast("double") for c, n in numbers.items()}), folder)
    return folder


@query("placed_pixels", f"""
WITH degrees AS (
    SELECT zone_id, image_date, CASE WHEN QC_Day >> 6 <= 2 THEN (SummaryQA * 10 + 13000) * 0.02::DOUBLE - 273.15 END AS d,
           CASE WHEN QC_Night >> 6 <= 2 THEN (QC_Night * 8 + 12800) * 0.02::DOUBLE - 273.15 END AS n
    FROM placed_pixels WHERE dataset = 'B' AND image_date BETWEEN DATE '1994-01-01' AND DATE '1999-12-31')
SELECT strftime(image_date, '%Y/%m/%d') AS Date, strftime(image_date, '%j') AS Doy, zone_id,
       {rd('avg(d)')} AS LST_Day_MEAN, {rd('avg(n)')} AS LST_Night_MEAN, {rd('avg((d + n) / 2)')} AS LST_Mean_MEAN
FROM degrees GROUP BY image_date, zone_id""")
def study_temperature_extraction(t: Inputs):
    out = scratch_dir(t.spark, "temperature-panel")
    panel = temperature_extraction(t.spark, _image_folder(t), out, "B", t.zones, "1994-01-01", "1999-12-31")
    means = ("LST_Day_MEAN", "LST_Night_MEAN", "LST_Mean_MEAN")
    return panel.withColumns({c: r(F.col(c)) for c in means})


@query("placed_pixels", f"""
SELECT zone_id, CAST(image_date AS VARCHAR) AS Date, {rd('sum(EVI)')} AS EVI_SUM, CAST(year(image_date) AS INTEGER) AS year
FROM placed_pixels WHERE dataset = 'B' AND image_date BETWEEN DATE '1995-02-01' AND DATE '2001-12-31'
GROUP BY zone_id, image_date""")
def study_rainfall_extraction(t: Inputs):
    out = scratch_dir(t.spark, "rainfall-panel")
    panel = rainfall_extraction(t.spark, _image_folder(t), out, "B", t.zones, "1995-02-01", "2001-12-31", "EVI")
    return panel.select("zone_id", text_date("Date").alias("Date"), r(F.col("EVI_SUM")).alias("EVI_SUM"), "year")
