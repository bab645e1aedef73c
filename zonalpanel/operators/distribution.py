"""One-column summaries: range, histogram, describe, value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles


def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``<c>_min`` and ``<c>_max`` of each column."""
    return df.agg(
        *[f(c).alias(f"{c}_{s}") for c in cols for s, f in (("min", F.min), ("max", F.max))]
    )


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bin counts: ``bin, bin_left, bin_right, n``; the last bin is closed.

    All equal values get a range of half a unit to either side.
    """
    x = F.col("_x")
    limits = df.agg(
        F.struct(
            F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")
        ).alias("limits")
    ).scalar()

    def with_limits(frame: DataFrame) -> DataFrame:
        flat = F.col("_r.lo") == F.col("_r.hi")
        return (
            frame.withColumn("_r", limits)
            .withColumn("_lo", F.when(flat, F.col("_r.lo") - 0.5).otherwise(F.col("_r.lo")))
            .withColumn("_hi", F.when(flat, F.col("_r.hi") + 0.5).otherwise(F.col("_r.hi")))
            .withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
        )

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_hi")).otherwise(F.col("_lo") + i * F.col("_w"))

    guess = F.least(
        F.floor((x - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)
    ).cast("int")
    # A value one rounding step off its edge moves to the bin the edges say.
    settled = (
        F.when(x < edge(guess), guess - 1)
        .when((x >= edge(guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counts = (
        with_limits(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x")))
        .groupBy(settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = with_limits(frame).select(
        "bin", edge(F.col("bin")).alias("bin_left"), edge(F.col("bin") + 1).alias("bin_right")
    )
    return edges.join(counts, "bin", "left").na.fill(0, ["n"])


def describe(df: DataFrame, col: str) -> DataFrame:
    """One row: count, mean, std, min, quartiles and max of a column."""
    x = F.col(col).cast("double")
    quartiles = exact_quantiles(df, col, (0.25, 0.5, 0.75)).select("quantiles").scalar()
    return (
        df.agg(
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )
        .withColumn("_q", quartiles)
        .select(
            "count",
            "mean",
            "std",
            "min",
            F.get("_q", F.lit(0)).alias("q25"),
            F.get("_q", F.lit(1)).alias("q50"),
            F.get("_q", F.lit(2)).alias("q75"),
            "max",
        )
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per non-NULL value, most frequent first."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
    )


def rows_per_year(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows per year, in year order."""
    return value_counts(df, year).orderBy(year)
