"""Pixel band work and zonal statistics.

A pixel row is one pixel of one image: ``dataset, image_date, x, y``, its bands and
quality words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import STATISTICS
from ..session import written
from .ordered import value_positions
from .spatial import spatial_join_points

# Bins of a factor of two in the histograms that say where a median is; a double's logarithm
# is within +-_LOG_RANGE.
OCTAVE_BINS = 128
_LOG_RANGE = 1100

EARTH_RADIUS = 6378137.0


def mask_qa_bit(
    pixels: DataFrame, bands: Sequence[str], qa: str = "SummaryQA", bit: int = 1, scale: float = 10000.0
) -> DataFrame:
    """Bands divided by the scale where the quality bit is clear, NULL elsewhere."""
    clear = F.col(qa).bitwiseAND(F.lit(1 << bit)) == 0
    return pixels.withColumns({b: F.when(clear, F.col(b) / scale) for b in bands})


def mask_lst_qc(
    pixels: DataFrame,
    day: str = "LST_Day_1km",
    night: str = "LST_Night_1km",
    qc_day: str = "QC_Day",
    qc_night: str = "QC_Night",
) -> DataFrame:
    """Day and night values kept where bits 6 and up of their quality word are at most 2."""

    def good(qc: str) -> Column:
        return F.shiftrightunsigned(F.col(qc), 6) <= 2

    return pixels.withColumns(
        {day: F.when(good(qc_day), F.col(day)), night: F.when(good(qc_night), F.col(night))}
    )


def lst_celsius(
    pixels: DataFrame, day: str = "LST_Day_1km", night: str = "LST_Night_1km"
) -> DataFrame:
    """Add ``LST_Day, LST_Night, LST_Mean`` in degrees; the mean needs both."""
    celsius = {
        "LST_Day": F.col(day) * 0.02 - 273.15,
        "LST_Night": F.col(night) * 0.02 - 273.15,
    }
    return pixels.withColumns(celsius).withColumn(
        "LST_Mean", (F.col("LST_Day") + F.col("LST_Night")) / 2
    )


def relative_humidity(
    df: DataFrame,
    dew_point: str = "dewpoint_temperature_2m",
    temperature: str = "temperature_2m",
    unit: str = "C",
    out: str = "Relative_Humidity",
) -> DataFrame:
    """Relative humidity in percent; ``unit`` is 'C' or 'K'."""
    offset = {"C": 0.0, "K": 273.15}[unit]

    def saturation(name: str) -> Column:
        t = F.col(name) - offset
        return F.exp(F.lit(17.625) * t / (F.lit(243.04) + t))

    return df.withColumn(out, F.lit(100.0) * saturation(dew_point) / saturation(temperature))


def _aggregate(stat: str, band: str) -> Column:
    return {
        "MEAN": F.avg,
        "MAXIMUM": F.max,
        "MINIMUM": F.min,
        "STD": F.stddev_pop,
        "VARIANCE": F.var_pop,
        "SUM": F.sum,
    }[stat](band)


def zone_image_statistics(
    pixels: DataFrame,
    bands: Sequence[str],
    stat: str = "MEAN",
    keys: Sequence[str] = ("zone_id", "image_date"),
) -> DataFrame:
    """One statistic of every band per zone and image, for pixels that know their zone.

    Columns ``<band>_<stat>``. All but MEDIAN combine before the shuffle. MEDIAN is
    exact, see ``_medians``.
    """
    if stat not in STATISTICS:
        raise ValueError(f"unknown statistic {stat}")
    keys = list(keys)
    pixels = pixels.na.drop(subset=keys)
    if stat != "MEDIAN":
        return pixels.groupBy(*keys).agg(
            *[_aggregate(stat, b).alias(f"{b}_{stat}") for b in bands]
        )
    return _medians(pixels, list(bands), keys)


def _octave_bin(v: Column) -> Column:
    """A bin number that grows with the value and whose bins are some thousandths of it wide."""

    def size(w: Column) -> Column:
        return F.floor(F.least(F.log2(w), F.lit(float(_LOG_RANGE))) * OCTAVE_BINS) + 2 * _LOG_RANGE * OCTAVE_BINS

    return F.when(v > 0, size(v)).when(v < 0, -size(-v)).when(v == 0, F.lit(0)).cast("int")


def _medians(pixels: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """Exact medians without moving every pixel.

    Pixels are written once and read twice. The first time each group and band gets a
    histogram of bins that are the same for all groups, so that it is counted before it is
    shuffled, like a sum. It says which bin, or which two, hold the middle positions and how
    many values come before. The second time only values in those bins go on to the exact
    search, which cuts a group of any size into value ranges.
    """
    values = [F.col(b).cast("double").alias(f"_v{i}") for i, b in enumerate(bands)]
    placed = written(pixels.select(*keys, *values), "median-pixels")

    def cell(i: int) -> Column:
        v = F.col(f"_v{i}")
        return F.struct(F.lit(i).alias("_band"), v.alias("_value"), _octave_bin(v).alias("_bin"))

    cells = F.explode(F.array(*[cell(i) for i in range(len(bands))])).alias("_c")
    long = placed.select(*keys, cells).select(*keys, "_c.*")
    counted = written(long.groupBy(*keys, "_band", "_bin").agg(F.count(F.lit(1)).alias("_n")), "median-counts")

    group = Window.partitionBy(*keys, "_band")  # as many rows as there are bins
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    middle = (
        counted.where("_bin is not null")
        .withColumns({"_total": F.sum("_n").over(group), "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
        .withColumns({"_lo": F.expr("(_total - 1) div 2"), "_hi": F.expr("_total div 2")})
        .where("(_lo >= _before and _lo < _before + _n) or (_hi >= _before and _hi < _before + _n)")
        .withColumn("_base", F.min("_before").over(group))
    )
    middle = written(
        middle.select(
            *keys, "_band", "_bin", (F.col("_lo") - F.col("_base")).alias("_lo"), (F.col("_hi") - F.col("_base")).alias("_hi")
        ),
        "median-bins",
    )
    by = [*keys, "_band"]
    chosen = long.join(middle.select(*by, "_bin"), [*by, "_bin"]).select(*by, "_value")
    places = middle.select(*by, "_lo", "_hi").distinct()
    found = value_positions(chosen, F.col("_value"), by).join(places, by)
    at = [F.expr(f"max(if({p} >= _before and {p} < _before + _n, _v, null))") for p in ("_lo", "_hi")]
    medians = found.groupBy(*by).agg((at[0] + (at[1] - at[0]) * 0.5).alias("_median"))
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_band") == i, F.col("_median"))).alias(f"{b}_MEDIAN") for i, b in enumerate(bands)]
    )
    return counted.select(*keys).distinct().join(wide, keys, "left")


def zonal_statistics(
    pixels: DataFrame,
    zones: DataFrame,
    bands: Sequence[str],
    stat: str = "MEAN",
    cell: float | None = None,
    zone: str = "zone_id",
    image: str = "image_date",
) -> DataFrame:
    """One statistic of every band over the pixels of each zone in each image."""
    placed = spatial_join_points(
        pixels.select(image, "x", "y", *bands), zones.select(zone, "rings"), cell, zone=zone
    )
    return zone_image_statistics(placed, bands, stat, (zone, image))


def pixel_area(size: float, y: Column) -> Column:
    """Square metres of a pixel ``size`` degrees wide and high whose centre is at latitude ``y``."""
    side = math.radians(size) * EARTH_RADIUS
    return F.lit(side * side) * F.cos(F.radians(y))


def zonal_area_by_class(
    pixels: DataFrame,
    zones: DataFrame,
    size: float,
    mode: str = "PERCENTAGE",
    decimals: int = 2,
    scale: float = 100.0,
    classes: Sequence[int] | None = None,
    cell: float | None = None,
    zone: str = "zone_id",
    class_col: str = "class_code",
) -> DataFrame:
    """Area per zone and class from classified pixels (``x, y`` in degrees) and polygons.

    Pixels belong to the zones that their centres touch; results as in ``zonal_statistics_by_group``.
    """
    placed = spatial_join_points(pixels.select("x", "y", class_col), zones.select(zone, "rings"), cell, zone=zone)
    areas = placed.select(zone, class_col, pixel_area(size, F.col("y")).alias("_pixel_area"))
    return zonal_statistics_by_group(areas, mode, decimals, scale, classes, zone, class_col, "_pixel_area")


def zonal_statistics_by_group(
    pixels: DataFrame,
    mode: str = "PERCENTAGE",
    decimals: int = 2,
    scale: float = 100.0,
    classes: Sequence[int] | None = None,
    zone: str = "zone_id",
    class_col: str = "class_code",
    area: str = "area",
) -> DataFrame:
    """Area per zone and class, as a sum or a share of the zone's area.

    Long result ``zone, class_code, value``; with ``classes`` one ``Class_<c>`` column
    each. The share's window runs over at most one row per class.
    """
    per_class = pixels.groupBy(zone, class_col).agg(F.sum(area).alias("_area"))
    if mode == "PERCENTAGE":
        total = F.sum("_area").over(Window.partitionBy(zone))
        value = F.try_divide(F.col("_area") * scale, total)
    elif mode == "SUM":
        value = F.col("_area")
    else:
        raise ValueError(f"unknown mode {mode}")
    long = per_class.select(zone, class_col, F.round(value, decimals).alias("value"))
    return long if classes is None else landcover_composition(long, classes, zone, class_col)


def landcover_composition(
    landcover: DataFrame,
    classes: Sequence[int],
    zone: str = "zone_id",
    class_col: str = "class_code",
) -> DataFrame:
    """Classes as columns ``Class_<c>``, one row per zone."""
    wide = landcover.groupBy(zone).pivot(class_col, list(classes)).agg(F.first("value", ignorenulls=True))
    return wide.withColumnsRenamed({str(c): f"Class_{c}" for c in classes})
