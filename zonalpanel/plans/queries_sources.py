"""Readers and writers: tables go out in the library's formats and come back.

Each query writes to a fresh folder under the session's shared scratch path, reads it
with the reader under test and returns what came back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import pixels as PX
from ..sources import sinks as W
from ..sources import tables as T
from ..sources import zones as Z
from .inputs import MONTHS, POPULATION_YEARS, Inputs, r, rd, text_date
from .registry import query


@query("panel", f"""
SELECT CASE WHEN year(date) <= 1997 THEN 'era_1995_1997' ELSE 'era_1998_2001' END AS source_name, zone_id,
       CAST(date AS VARCHAR) AS date, {rd('CASE WHEN price_MEAN > 50 THEN price_MEAN END', 4)} AS "price_MEAN"
FROM panel""")
def read_table_dir(t: Inputs):
    root = scratch_dir(t.spark, "tables")
    value = F.when(F.col("price_MEAN") > 50, F.col("price_MEAN")).otherwise(F.lit(float("nan")))
    rows = t.panel.select("zone_id", text_date("date").alias("date"), value.alias("price_MEAN"))
    early = F.year(F.to_date("date")) <= 1997
    W.write_panel(rows.where(early), f"{root}/ERA_1995_1997.csv")
    late = rows.where(~early).withColumn("extra", F.lit("x"))
    W.write_panel(late.select("extra", "price_MEAN", "date", "zone_id"), f"{root}/ERA_1998_2001.csv")
    back = T.read_table_dir(t.spark, root, "zone_id int, date string, price_MEAN double")
    return back.select("source_name", "zone_id", "date", r(F.col("price_MEAN"), 4).alias("price_MEAN"))


@query("population", """
SELECT CAST(year AS INTEGER) AS year, '東區-' || zone_id AS zone_id, p_cnt, CAST(m_cnt AS VARCHAR) AS m_cnt, CAST(f_cnt AS VARCHAR) AS f_cnt
FROM population""")
def read_population_by_year(t: Inputs):
    root = scratch_dir(t.spark, "population")
    for i, year in enumerate(POPULATION_YEARS):
        rows = t.population.where(F.col("year") == year).select(
            F.concat(F.lit("東區-"), F.col("zone_id").cast("string")).alias("CODEBASE"),
            F.col("p_cnt").alias("P_CNT"), F.col("m_cnt").alias("M_CNT"), F.col("f_cnt").alias("F_CNT"),
        )
        writer = rows.write.option("header", True).option("encoding", "big5" if i % 2 else "utf-8")
        writer.csv(f"{root}/nested/{year - T.ROC_OFFSET}年_population.csv")
    return T.read_population_by_year(t.spark, root)


@query("cases", """
SELECT CASE WHEN case_id % 50 = 0 THEN NULL ELSE CAST(onset AS VARCHAR) END AS onset, imported, county, town, CAST(zone_id AS VARCHAR) AS zone_id
FROM cases""")
def read_cases(t: Inputs):
    root = scratch_dir(t.spark, "cases")
    onset = F.when(F.col("case_id") % 50 == 0, "unknown").otherwise(F.date_format("onset", "yyyy/M/d"))
    rows = t.cases.select("case_id", "zone_id", "town", "county", F.col("imported").alias("是否境外移入"), onset.alias("發病日"))
    W.write_panel(rows, root)
    names = {"發病日": "onset", "是否境外移入": "imported", "county": "county", "town": "town", "zone_id": "zone_id"}
    return T.read_cases(t.spark, root, names).withColumn("onset", text_date("onset"))


@query("", """
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS start_day, l_partkey * 1.0::DOUBLE AS x, l_suppkey * 1.0::DOUBLE AS y,
       l_returnflag AS district, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS avg_eggs
FROM lineitem""")
def read_traps(t: Inputs):
    root = scratch_dir(t.spark, "traps")
    rows = t.table("lineitem").select(
        F.col("l_linestatus").alias("Status"),
        F.col("l_suppkey").cast("double").alias("Y"),
        F.col("l_partkey").cast("double").alias("X"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("StartTime"),
        F.col("l_returnflag").alias("District"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("AvgEggs"),
    )
    W.write_panel(rows, root)
    back = T.read_traps(t.spark, root)
    return back.select(text_date("start_time").alias("start_day"), "x", "y", "district", "avg_eggs")


@query("sheets", """
SELECT CAST(year AS INTEGER) AS year, CAST(row_no AS INTEGER) AS row_no, * EXCLUDE (year, row_no), '31' AS "Population"
FROM sheets WHERE row_no > 1 AND year BETWEEN 1995 AND 2001""")
def read_yearly_sheets(t: Inputs):
    root = scratch_dir(t.spark, "sheets")
    months = [c for m in MONTHS for c in (f"Infection_{m}", f"Death_{m}")]
    years = range(1995, 2002)
    for year in years:
        columns = [
            F.col("row_no"), F.col("Province"), F.col("City"), F.lit("Kota").alias("City/Regency"),
            *[F.col(c).alias(f"Unnamed: {i + 3}") for i, c in enumerate(months)],
            *[F.lit(str(i)).alias(f"Unnamed: {i}") for i in range(27, 32)],
        ]
        W.write_panel(t.sheets.where(F.col("year") == year).select(*columns), f"{root}/{year}.csv")
    back = T.read_yearly_sheets(t.spark, {y: f"{root}/{y}.csv" for y in years})
    return back.select("year", "row_no", "Province", "City", *months, "Population")


_RING = """
SELECT zone_id, zone_name, "Region", CAST(i AS INTEGER) AS seq,
       x0 + CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END AS x, y0 + CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END AS y
FROM zones, (SELECT unnest([0, 1, 2, 3, 4]) AS i)"""


def _ring_rows(zones):
    return zones.select(
        "zone_id", "zone_name", "Region", F.posexplode(F.col("rings")[0]).alias("seq", "v")
    ).select("zone_id", "zone_name", "Region", "seq", F.col("v.x").alias("x"), F.col("v.y").alias("y"))


@query("zones", _RING)
def read_zones(t: Inputs):
    root = scratch_dir(t.spark, "vertices")
    rows = _ring_rows(t.zones).withColumns({"part": F.lit(0), "ring": F.lit(0)})
    W.write_panel(rows, root, fmt="parquet")
    back = Z.read_zones(t.spark, root, "zone_id int, zone_name string, Region string", form="vertices")
    return _ring_rows(back)


@query("zones", _RING)
def write_zone_layer(t: Inputs):
    root = scratch_dir(t.spark, "layer")
    Z.write_zone_layer(t.zones, root)
    return _ring_rows(Z.read_zones(t.spark, root, "zone_id int, zone_name string, Region string"))


def _pixel_folder(t: Inputs) -> str:
    root = scratch_dir(t.spark, "pixels")
    PX.write_pixels(t.pixels, root)
    return root


@query("pixels", """
SELECT dataset, CAST(image_date AS VARCHAR) AS image_date, x, y, EVI AS "EVI" FROM pixels
WHERE dataset = 'B' AND image_date BETWEEN DATE '1996-03-01' AND DATE '1998-02-01'""")
def scan_pixels(t: Inputs):
    back = PX.scan_pixels(t.spark, _pixel_folder(t), "B", "1996-03-01", "1998-02-01", ["EVI"])
    return back.withColumn("image_date", text_date("image_date"))


@query("pixels", """
SELECT dataset, CAST(image_date AS VARCHAR) AS image_date, x, y, NDVI AS "NDVI" FROM pixels
WHERE image_date = (SELECT min(image_date) FROM pixels)""")
def first_image(t: Inputs):
    return PX.first_image(t.spark.read.parquet(_pixel_folder(t))).select(
        "dataset", text_date("image_date").alias("image_date"), "x", "y", "NDVI"
    )


@query("panel", f"""
SELECT zone_id, CAST(date AS VARCHAR) AS date, CAST(year(date) AS INTEGER) AS year, {rd('price_MEAN', 4)} AS price_MEAN
FROM panel""")
def write_panel(t: Inputs):
    root = scratch_dir(t.spark, "panel")
    W.write_panel(t.panel.withColumn("year", F.year("date")), root, fmt="parquet", partition_by=["year"])
    back = t.spark.read.parquet(root)
    return back.select("zone_id", text_date("date").alias("date"), "year", r(F.col("price_MEAN"), 4).alias("price_MEAN"))
