"""Statistical expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def slope_p_value(r2: Column, n: Column) -> Column:
    """Two-sided p-value of a simple regression slope, from r squared and pair count.

    Student's t distribution with v = n - 2 degrees of freedom has a finite
    trigonometric series for whole v; with th = atan(t / sqrt(v)) here,
    sin(th)^2 = r^2 and cos(th)^2 = 1 - r^2. Two points fit exactly: the value is
    then 0, or 1 for a flat line. Fewer give NULL.
    """
    r2 = F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0))
    v = n.cast("int") - 2
    odd = v % 2 == 1
    c2 = F.lit(1.0) - r2
    sin_th, cos_th = F.sqrt(r2), F.sqrt(c2)
    terms = F.when(odd, (v - 1) / 2).otherwise(v / 2).cast("int")

    def step(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        return F.struct(
            (acc["s"] + acc["t"]).alias("s"), (acc["t"] * ratio * c2).alias("t")
        )

    series = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(
            F.lit(0.0).alias("s"), F.when(odd, cos_th).otherwise(F.lit(1.0)).alias("t")
        ),
        step,
    )["s"]
    p_odd = 1 - (F.lit(2 / math.pi)) * (F.asin(sin_th) + sin_th * series)
    p_even = 1 - sin_th * series
    return (
        F.when((n < 2) | r2.isNull(), F.lit(None).cast("double"))
        .when(n == 2, F.when(r2 > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
        .when(r2 >= 1, F.lit(0.0))
        .otherwise(F.greatest(F.when(odd, p_odd).otherwise(p_even), F.lit(0.0)))
    )


def incidence_rate(infections: Column, population: Column) -> Column:
    """Cases per thousand people; no population gives NULL."""
    return F.try_divide(infections.cast("double"), population.cast("double")) * 1000
