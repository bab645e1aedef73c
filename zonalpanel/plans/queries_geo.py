"""Spatial joins, zonal statistics, grids and surfaces over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import LAND_COVER_CLASSES, STATISTICS
from ..operators import counts as K
from ..operators import pixels as X
from ..operators import spatial as S
from ..operators import surface as U
from .inputs import Inputs, r, rd, text_date
from .registry import query


@query("placed_points", "SELECT point_id, zone_id FROM placed_points")
def spatial_join_points(t: Inputs):
    return S.spatial_join_points(t.points, t.zones).select("point_id", "zone_id")


@query("points", """
WITH boxes AS (SELECT p_partkey AS zone_id, (p_partkey * 37 % 500) / 100.0::DOUBLE AS x0, (p_partkey * 91 % 500) / 100.0::DOUBLE AS y0,
                      p_size * p_size / 5000.0::DOUBLE AS side FROM part)
SELECT zone_id, count(*) AS points FROM points JOIN boxes
ON x BETWEEN x0 AND x0 + side AND y BETWEEN y0 AND y0 + side GROUP BY zone_id""")
def spatial_join_many_zones(t: Inputs):
    """Overlapping boxes of very different size, one per part."""
    side = F.col("p_size") * F.col("p_size") / F.lit(5000.0)
    x0 = (F.col("p_partkey") * 37 % 500) / F.lit(100.0)
    y0 = (F.col("p_partkey") * 91 % 500) / F.lit(100.0)
    corners = [(x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    boxes = t.table("part").select(F.col("p_partkey").alias("zone_id"), F.array(ring).alias("rings"))
    placed = S.spatial_join_points(t.points, boxes)
    return placed.groupBy("zone_id").agg(F.count(F.lit(1)).alias("points"))


@query("placed_pixels", """
SELECT dataset, CAST(image_date AS VARCHAR) AS image_date, x, y, NDVI AS ndvi FROM pixels
WHERE EXISTS (SELECT 1 FROM zones z WHERE x BETWEEN z.x0 AND z.x0 + 0.5 AND y BETWEEN z.y0 AND z.y0 + 0.5)""")
def clip_to_zones(t: Inputs):
    """To the lower left quarters of the zones, so that something is cut off."""
    corner = F.col("rings")[0][0]
    halved = F.transform(
        "rings",
        lambda ring: F.transform(
            ring,
            lambda v: F.struct(
                (corner["x"] + (v["x"] - corner["x"]) / 2).alias("x"), (corner["y"] + (v["y"] - corner["y"]) / 2).alias("y")
            ),
        ),
    )
    return S.clip_to_zones(t.pixels, t.zones.withColumn("rings", halved)).select(
        "dataset", text_date("image_date").alias("image_date"), "x", "y", F.col("NDVI").alias("ndvi")
    )


_CLASS = f"({LAND_COVER_CLASSES})[SummaryQA % 10 + 1]"
_AREAS = f"""
SELECT zone_id, {_CLASS} AS class_code, sum(pow(radians(0.25) * 6378137, 2) * cos(radians(y))) AS area
FROM placed_pixels GROUP BY zone_id, {_CLASS}"""


def _class_pixels(t: Inputs):
    codes = F.array(*[F.lit(c) for c in LAND_COVER_CLASSES])
    return t.pixels.select("x", "y", F.get(codes, F.col("SummaryQA") % 10).alias("class_code"))


@query("placed_pixels", f"SELECT zone_id, class_code, {rd('area / 1e6', 3)} AS square_km FROM ({_AREAS})")
def zonal_area_by_class(t: Inputs):
    """Area per zone and class from polygons and classified pixels a quarter of a degree wide."""
    areas = X.zonal_area_by_class(_class_pixels(t), t.zones, 0.25, mode="SUM", decimals=6)
    return areas.select("zone_id", "class_code", r(F.col("value") / 1e6, 3).alias("square_km"))


@query("placed_pixels", f"""
SELECT zone_id, {', '.join(f'round(max(share) FILTER (class_code = {c}), 4) AS "Class_{c}"' for c in LAND_COVER_CLASSES)}
FROM (SELECT zone_id, class_code, area * 100 / sum(area) OVER (PARTITION BY zone_id) AS share FROM ({_AREAS})) GROUP BY zone_id""")
def zonal_area_by_class_share(t: Inputs):
    return X.zonal_area_by_class(_class_pixels(t), t.zones, 0.25, decimals=4, classes=LAND_COVER_CLASSES)


@query("zones", "SELECT zone_id, x0 + 0.5 AS cx, y0 + 0.5 AS cy FROM zones")
def polygon_centroid(t: Inputs):
    c = S.polygon_centroid(t.zones)
    return c.select("zone_id", r(F.col("cx")).alias("cx"), r(F.col("cy")).alias("cy"))


@query("", f"""
SELECT c_custkey AS zone_id, {rd('c_custkey % 977 + (c_acctbal + 1000) * 2.0 / 3')} AS cx,
       {rd('c_custkey % 613 + (c_acctbal + 1000) / 3')} AS cy
FROM customer""")
def polygon_centroid_triangles(t: Inputs):
    x0, y0, w = F.col("c_custkey") % 977, F.col("c_custkey") % 613, F.col("c_acctbal") + 1000
    corners = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + w)]
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    zones = t.table("customer").select(F.col("c_custkey").alias("zone_id"), F.array(ring).alias("rings"))
    c = S.polygon_centroid(zones)
    return c.select("zone_id", r(F.col("cx")).alias("cx"), r(F.col("cy")).alias("cy"))


@query("zones", f"""
SELECT CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy,
       {rd('minx + gx * (maxx - minx) / 100')} AS x, {rd('miny + gy * (maxy - miny) / 100')} AS y
FROM (SELECT min(x0) AS minx, max(x0 + 1) AS maxx, min(y0) AS miny, max(y0 + 1) AS maxy FROM zones),
     (SELECT unnest(range(101)) AS gx), (SELECT unnest(range(101)) AS gy)""")
def grid_coordinates(t: Inputs):
    grid = S.grid_coordinates(t.zones, 101)
    return grid.select("gx", "gy", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


@query("zones", "SELECT min(x0) AS minx, min(y0) AS miny, max(x0 + 1) AS maxx, max(y0 + 1) AS maxy FROM zones")
def layer_bounds(t: Inputs):
    return S.layer_bounds(t.zones)


# ---------------------------------------------------------------- zonal statistics

_SQL_STAT = {
    "MEAN": "avg({0})",
    "MAXIMUM": "max({0})",
    "MINIMUM": "min({0})",
    "MEDIAN": "quantile_cont({0}, 0.5)",
    "STD": "stddev_pop({0})",
    "VARIANCE": "var_pop({0})",
    "SUM": "sum({0})",
}


def _register(stat: str) -> None:
    bands = ("NDVI", "EVI")
    digits = 6
    cols = ", ".join(f"{rd(_SQL_STAT[stat].format(b), digits)} AS {b}_{stat}" for b in bands)

    def plan(t: Inputs):
        out = X.zonal_statistics(t.pixels, t.zones, bands, stat)
        return out.select(
            "zone_id", text_date("image_date").alias("image_date"),
            *[r(F.col(f"{b}_{stat}"), digits).alias(f"{b}_{stat}") for b in bands],
        )

    plan.__name__ = f"zonal_statistics_{stat.lower()}"
    query("placed_pixels", f"""
SELECT zone_id, CAST(image_date AS VARCHAR) AS image_date, {cols}
FROM placed_pixels GROUP BY zone_id, image_date""")(plan)


for _stat in STATISTICS:
    _register(_stat)


@query("placed_points", f"""
SELECT year, zone_id, {rd('sum(CAST(value AS DECIMAL(18,2)))', 2)} AS value FROM placed_points GROUP BY year, zone_id""")
def eggs_by_zone_year(t: Inputs):
    points = t.points.withColumn("value", F.col("value").cast("decimal(18,2)"))
    sums = K.eggs_by_zone_year(points, t.zones, "value")
    return sums.withColumn("value", r(F.col("value"), 2))


# ---------------------------------------------------------------- surfaces

_GRID = 31


@query("points zones", f"""
WITH b AS (SELECT min(x0) AS minx, max(x0 + 1) AS maxx, min(y0) AS miny, max(y0 + 1) AS maxy FROM zones),
     nodes AS (SELECT gx, gy, minx + gx * ((maxx - minx) / {_GRID - 1}) AS nx, miny + gy * ((maxy - miny) / {_GRID - 1}) AS ny
               FROM b, (SELECT unnest(range({_GRID})) AS gx), (SELECT unnest(range({_GRID})) AS gy)),
     w AS (SELECT year, gx, gy, value, greatest(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)), 1e-10) AS d FROM points, nodes)
SELECT year, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, {rd('sum(value / (d * d)) / sum(1 / (d * d))', 4)} AS value
FROM w GROUP BY year, gx, gy""")
def idw_surface(t: Inputs):
    surface = U.idw_surface(t.points, t.zones, "value", n=_GRID)
    return surface.withColumn("value", r(F.col("value"), 4))


_PAIRS = """
WITH pairs AS (
    SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.value - b.value AS dv
    FROM points a JOIN points b ON a.point_id < b.point_id
    AND abs(a.x - b.x) < 0.5 AND abs(a.y - b.y) < 0.5),
lags AS (SELECT CAST(floor(d / 0.05) AS INTEGER) AS lag, count(*) AS pairs, avg(d) AS reach, avg(dv * dv) / 2 AS half
         FROM pairs WHERE d < 0.5 GROUP BY 1)
"""


@query("points", f"""{_PAIRS}
SELECT lag, pairs, {rd('reach')} AS mean_distance, {rd('half', 2)} AS semivariance FROM lags""")
def semivariogram(t: Inputs):
    lags = U.semivariogram(t.points, "value", lag=0.05, max_dist=0.5)
    return lags.select(
        "lag", "pairs", r(F.col("mean_distance")).alias("mean_distance"), r(F.col("semivariance"), 2).alias("semivariance")
    )


@query("points", f"""{_PAIRS}
SELECT {rd('regr_slope(half, reach)', 1)} AS slope, {rd('regr_intercept(half, reach)', 1)} AS nugget FROM lags""")
def linear_variogram(t: Inputs):
    line = U.linear_variogram(U.semivariogram(t.points, "value", lag=0.05, max_dist=0.5))
    return line.select(r(F.col("slope"), 1).alias("slope"), r(F.col("nugget"), 1).alias("nugget"))
