"""Quantile bins, rank comparison and bivariate classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import COLOURS_3X3, COLOURS_4X4, look_up
from .ordered import exact_quantiles, ordered_positions

# Every edge that 1 to 4 quantile bins can need.
_QUARTER_PROBS = (0.0, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0)
_EDGES_OF = {1: (0, 6), 2: (0, 3, 6), 3: (0, 2, 4, 6), 4: (0, 1, 3, 5, 6)}


def bin_sql(x: str, edges: str) -> str:
    """Right-closed bin of a value; the lowest edge belongs to the first bin."""
    return f"if({x} is null, null, greatest(size(filter({edges}, edge -> edge < {x})) - 1, 0))"


def quantile_edges(df: DataFrame, col: str, q: int) -> DataFrame:
    """One row: ``quantiles``, the q + 1 interpolated edges."""
    return exact_quantiles(df, col, [i / q for i in range(q + 1)])


def quantile_bins(
    df: DataFrame, col: str, q: int, drop_repeated: bool = True, out: str = "bin"
) -> DataFrame:
    """Quantile bin 0 .. q-1 of each value; NULL stays NULL.

    Repeated edges are merged, which leaves fewer bins; with ``drop_repeated`` off they
    are an error.
    """
    quantiles = quantile_edges(df, col, q).select("quantiles").scalar()
    edges = "array_distinct(_q)"
    if not drop_repeated:
        edges = f"if(size({edges}) = {q + 1}, _q, raise_error('quantile edges repeat'))"
    return (
        df.withColumn("_q", quantiles)
        .withColumn(out, F.expr(bin_sql(f"cast(`{col}` as double)", edges)))
        .drop("_q")
    )


def _edges_for(quantiles: str, bins: str) -> str:
    """Edges of 1 to 4 bins out of the quantiles at ``_QUARTER_PROBS``."""
    cases = " ".join(
        f"when {n} then array({', '.join(f'{quantiles}[{i}]' for i in places)})"
        for n, places in _EDGES_OF.items()
    )
    return f"case {bins} {cases} end"


def _quarter_facts(df: DataFrame, cols: Sequence[str]) -> Column:
    """Map from column to distinct values ``k`` and quantiles ``q``, as one row."""
    cells = ", ".join(f"struct('{c}', cast(`{c}` as double))" for c in cols)
    long = df.select(F.expr(f"inline(array({cells}))").alias("_col", "_x"))
    spread = exact_quantiles(long, "_x", _QUARTER_PROBS, ["_col"])
    sizes = long.groupBy("_col").agg(F.count_distinct("_x").alias("k"))
    pairs = F.expr("map_from_entries(collect_list(struct(_col, struct(k, quantiles as q))))")
    return sizes.join(spread, "_col").agg(pairs).scalar()


def _quarter_code(df: DataFrame, col: str, out: str, fallback: str = "null") -> DataFrame:
    """Add the code of a column, given the facts about it in ``_facts``.

    The number of bins is min(4, distinct values); repeated edges are merged and the
    values binned again with as many bins as were left. If edges still repeat, the code
    is the fallback expression.
    """
    k, q = f"_facts['{col}'].k", f"_facts['{col}'].q"
    merged = f"array_distinct({_edges_for(q, f'least({k}, 4)')})"
    code = f"""case when {k} = 1 then 0
        when size(array_distinct(_edges)) = size(_edges) then {bin_sql(f"cast(`{col}` as double)", "_edges")}
        else {fallback} end"""
    return (
        df.withColumn("_edges", F.expr(_edges_for(q, f"size({merged}) - 1")))
        .withColumn(out, F.expr(code))
        .drop("_edges")
    )


def bivariate_class_4x4(df: DataFrame, death: str, infection: str) -> DataFrame:
    """Add ``death_code, infection_code, bivariate_class, color``.

    Deaths whose edges still repeat fall back to 0 / 1 to 10 / anything else.
    """
    manual = f"case when `{death}` = 0 then 0 when `{death}` between 1 and 10 then 1 else 2 end"
    coded = df.withColumn("_facts", _quarter_facts(df, [death, infection]))
    coded = _quarter_code(coded, death, "death_code", manual)
    coded = _quarter_code(coded, infection, "infection_code").drop("_facts")
    return coded.withColumn(
        "bivariate_class", F.expr("cast(death_code as string) || cast(infection_code as string)")
    ).withColumn("color", look_up(COLOURS_4X4, F.col("bivariate_class")))


def tercile_by_rank(df: DataFrame, col: str, zone: str = "zone_id", out: str = "tercile") -> DataFrame:
    """Tercile 0, 1, 2 of each zone by the rank of its value, ties ordered by zone id."""
    placed = ordered_positions(df.where(F.col(col).isNotNull()).select(col, zone), [col])
    # Copies of one (value, zone) row share the mean of their ranks.
    rank = F.col("_before") + (F.col("_n") + 1) / 2
    edge = [1 + (F.col("_total") - 1) * i / 3 for i in (1, 2)]
    code = (rank > edge[0]).cast("int") + (rank > edge[1]).cast("int")
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(
        zone, col, code.alias(out)
    )


def bivariate_class_3x3(
    eggs: DataFrame,
    rates: DataFrame,
    egg_col: str = "avg_eggs",
    rate_col: str = "incidence_rate",
    zone: str = "zone_id",
) -> DataFrame:
    """Zones in both layers with their terciles and map colour."""
    a = tercile_by_rank(eggs, egg_col, zone, "egg_code")
    b = tercile_by_rank(rates, rate_col, zone, "rate_code")
    colours = {f"{i}{j}": c for i, row in enumerate(COLOURS_3X3) for j, c in enumerate(row)}
    pair = F.concat(F.col("rate_code").cast("string"), F.col("egg_code").cast("string"))
    return a.join(b, zone, "inner").withColumn("color", look_up(colours, pair))


def rank_comparison(
    a: DataFrame, b: DataFrame, a_rank: str = "case_rank", b_rank: str = "egg_rank", zone: str = "zone_id"
) -> DataFrame:
    """'blue' where the first rank is smaller, 'red' otherwise or where one is missing."""
    return a.join(b, zone, "left").withColumn(
        "color", F.when(F.col(a_rank) < F.col(b_rank), F.lit("blue")).otherwise(F.lit("red"))
    )


def case_change(counts: DataFrame, first_year: int, last_year: int, zone: str = "zone_id") -> DataFrame:
    """Change in cases per zone between two years, a year without cases being 0."""

    def in_year(y: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("year") == y, F.col("infections"))), F.lit(0))

    kept = counts.where(F.col("year").isin(first_year, last_year))
    return kept.groupBy(zone).agg((in_year(last_year) - in_year(first_year)).alias("change"))


__all__: Sequence[str] = [
    "quantile_edges", "quantile_bins", "bivariate_class_4x4", "tercile_by_rank",
    "bivariate_class_3x3", "rank_comparison", "case_change",
]
