"""Global order statistics without a single-task sort: ranks, positions, quantiles.

The idea is one prefix sum over value ranges. Rows are first reduced to distinct values
with counts, so a value shared by a third of the rows is one row. The counts are range
partitioned by (group, value) and written with their partition number, which fixes the
ranges for everything that follows. Totals per range give each range its starting
position; inside a range a window finishes the count. A group or a value range of any
size is spread over as many ranges as its share of the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

def _value_counts(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Rows ``_n`` per group and distinct value ``_v``, and the range ``_b`` they are in.

    Ranges ascend with (group, value). A group's NULLs are one row with count 0; rows
    with a missing group key are left out. Written once, because range totals and
    positions both read the counts and must see the same ranges.
    """
    counts = (
        df.select(*by, value.alias("_v"))
        .na.drop(subset=list(by))
        .groupBy(*by, "_v")
        .agg(F.count("_v").alias("_n"))
    )
    ranged = counts.repartitionByRange(*by, "_v").select("*", F.spark_partition_id().alias("_b"))
    return written(ranged, "value-counts")


def _range_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each range (``_base``) and in its group (``_total``).

    A group has at most one row per shuffle partition here, so the windows are small.
    """
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
    return sums.select(
        "*",
        F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_bn").over(group).alias("_total"),
    )


def _counted_before(counts: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``_before``; the join and the window share one shuffle on (by, range)."""
    keys = [*by, "_b"]
    running = (
        Window.partitionBy(*keys)
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.col("_base") + F.sum("_n").over(running) - F.col("_n")
    return counts.join(totals, keys).select(*by, "_v", "_n", "_total", before.alias("_before"))


def value_positions(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct non-NULL value: its count and the number of rows before it.

    Columns: ``by``, ``_v`` (value), ``_n`` (count), ``_before``, ``_total``.
    """
    counts = _value_counts(df.where(value.isNotNull()), value, by)
    return _counted_before(counts, _range_totals(counts, by), by)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, per group: ``by`` + ``quantiles`` array.

    Missing values are skipped; a group of nothing else has NULL quantiles. Only the
    value ranges that hold a wanted position reach the second shuffle.
    """
    by = list(by)
    counts = _value_counts(df, F.col(value).cast("double"), by)
    # Wanted positions, 0-based and fractional; a quantile lies between the values at
    # the whole positions to either side.
    at = [f"((_total - 1) * {float(p)!r}D)" for p in probs]
    spots = {f"_{end}{i}": f"{f}({a})" for i, a in enumerate(at) for end, f in (("lo", "floor"), ("hi", "ceil"))}
    wanted = " or ".join(f"({t} >= _base and {t} < _base + _bn)" for t in spots.values())
    totals = _range_totals(counts, by).where(F.expr(f"_total = 0 or {wanted}"))
    picks = [
        F.expr(f"max(if({t} >= _before and {t} < _before + _n, _v, null)) as {name}")
        for name, t in spots.items()
    ]
    found = (
        _counted_before(counts, totals, by)
        .groupBy(*by)
        .agg(*picks, F.max("_total").alias("_total"))
    )
    between = [f"_lo{i} + (_hi{i} - _lo{i}) * ({a} - floor({a}))" for i, a in enumerate(at)]
    return found.select(*by, F.expr(f"array({', '.join(between)})").alias("quantiles"))


def _average_rank(descending: bool) -> Column:
    if descending:
        return F.col("_total") - F.col("_before") - (F.col("_n") - 1) / 2
    return F.col("_before") + (F.col("_n") + 1) / 2


def _rank_average(df: DataFrame, col: str, out: str, descending: bool) -> DataFrame:
    ranks = value_positions(df, F.col(col)).select(
        F.col("_v"), _average_rank(descending).cast("double").alias(out)
    )
    return df.join(ranks, df[col] == ranks["_v"], "left").drop("_v")


def rank_average_desc(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Rank from the largest value; ties share their mean rank, NULL stays unranked."""
    return _rank_average(df, col, out, descending=True)


def rank_average_asc(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Rank from the smallest value; ties share their mean rank, NULL stays unranked."""
    return _rank_average(df, col, out, descending=False)


def ordered_positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows in the order of ``keys`` (other columns break ties).

    Adds ``_n`` (copies of the row) and ``_before`` (rows ahead of the first copy).
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*keys, *rest)
    return value_positions(df, row).select("_v.*", "_n", "_before", "_total")


def numbered(df: DataFrame, keys: Sequence[str], number: str = "_number") -> DataFrame:
    """Rows with their place, from 0, in the order of ``keys`` (other columns break ties).

    One shuffle: rows are cut into ranges, sorted and written with their place in the range;
    how many rows each range has, one number for each shuffle partition, then shifts the
    places where the rows are. Copies of a row have different places and are spread over
    ranges like other rows.
    """
    rest = [c for c in df.columns if c not in keys]
    drawn = df.withColumn("_draw", F.xxhash64(F.monotonically_increasing_id()))
    order = [*keys, *rest, "_draw"]
    ranged = drawn.repartitionByRange(*order).sortWithinPartitions(*order)
    # partition and place in one number, the place in its lower 33 bits
    placed = written(ranged.select(*df.columns, F.monotonically_increasing_id().alias("_id")), "numbered-rows")
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for k in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    start = F.element_at(F.lit(starts).cast("array<bigint>"), part + 1)
    return placed.select(*df.columns, (start + place).alias(number))


def every_nth(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Rows 0, n, 2n, ... in the order of ``keys``; copies of a row count one by one."""
    return numbered(df, keys).where(F.col("_number") % n == 0).drop("_number")
