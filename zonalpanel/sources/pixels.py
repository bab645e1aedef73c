"""Dated raster collections kept as a pixel table partitioned by dataset and image date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import nan_to_null


def scan_pixels(
    spark: SparkSession, path: str, dataset: str, start: str, end: str, bands: Sequence[str]
) -> DataFrame:
    """Pixels of a dataset from ``start`` to ``end`` (both days in), chosen bands only.

    Dataset and date are partition columns: the filters select folders, not rows.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return nan_to_null(
        spark.read.parquet(path)
        .where(F.col("dataset") == dataset)
        .where((F.col("image_date") >= first) & (F.col("image_date") < F.date_add(last, 1)))
        .select("dataset", "image_date", "x", "y", *bands)
    )


def first_image(pixels: DataFrame, image: str = "image_date") -> DataFrame:
    """Pixels of the earliest image.

    Its date is looked up at once, which reads no column but ``image``, or only folder names
    where that is a partition column; the filter is then a constant, so that Spark lists the
    one folder when it plans.
    """
    earliest = pixels.agg(F.min(image)).first()[0]
    return pixels.where(F.col(image) == F.lit(earliest))


def write_pixels(pixels: DataFrame, path: str) -> None:
    """The pixel table, one folder per dataset and image date.

    The rebalance hint gathers an image into few files and lets AQE split a large one.
    """
    (
        pixels.hint("rebalance", "dataset", "image_date")
        .write.partitionBy("dataset", "image_date")
        .parquet(path)
    )
