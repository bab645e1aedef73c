"""Interpolated surfaces and the empirical semivariogram.

Both are sums over pairs by definition. No pair becomes a row: observations at one
site are added up first, and the pair arithmetic runs in numpy over blocks that Spark
has spread out, each task returning only sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .spatial import layer_bounds

# Grid nodes handled together, and sites of one year that a part takes: a year has as many
# parts as its sites need.
NODE_TILE = 16384
PART_SITES = 2048

# Sites weighted against a tile at a time, which bounds the matrix in memory, and nodes of
# all years together that a task holds before it returns their sums.
SITE_STEP = 256
GRID_NODES = 4_000_000

# Most sites in one semivariogram block. A meeting of two blocks is one row with both, and
# Arrow sends such rows by the thousand, so blocks are kept small.
SITE_BLOCK = 128


def _sites(points: DataFrame, keys: list[str], x: str, y: str, value: str) -> DataFrame:
    """Observations with coordinates and a value, reduced to moments per distinct site."""
    v = F.col(value).cast("double")
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & v.isNotNull())
    return known.groupBy(
        *keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(v).alias("m"),
        (F.var_pop(v) * F.count(F.lit(1))).alias("ss"),
    )


def idw_surface(
    points: DataFrame,
    zones: DataFrame,
    value: str,
    n: int = 500,
    power: float = 2.0,
    key: str = "year",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Inverse-distance-weighted mean of all points at each node of an n x n grid, per year.

    The grid spans the bounds of ``zones`` as in ``grid_coordinates``. Sites are spread by
    (year, part), no row more than once; a small job counts the sites of each year first. A
    task adds its sites into a whole grid of (weighted value, weight) pairs per year, tile
    by tile, and returns those sums, which are added up per node. A node on a site counts that
    distance as 1e-10.
    """
    spark = points.sparkSession
    rows_per_tile = max(1, NODE_TILE // n)
    bounds = layer_bounds(zones).select(F.struct("minx", "miny", "maxx", "maxy")).scalar()
    key_type = points.schema[key].dataType.simpleString()

    sites = written(_sites(points.where(F.col(key).isNotNull()), [key], x, y, value), "year-sites")
    parts = sites.groupBy(key).agg(F.ceil(F.count("*") / PART_SITES).cast("int").alias("parts"))
    work = (
        sites.join(written(parts, "site-parts"), key)
        .select(F.col(key).alias("k"), F.pmod(F.xxhash64("x", "y"), "parts").alias("part"), "x", "y", "n", "m", bounds.alias("b"))
        .select("k", "part", "x", "y", "n", "m", "b.*")
        # The number is given so that AQE, which goes by bytes, keeps the tasks apart.
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k", "part")
    )

    def nodes_along(low: float, high: float) -> np.ndarray:
        at = low + np.arange(n) * ((high - low) / max(n - 1, 1))
        at[n - 1] = high if n > 1 else low
        return at

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        spot = np.arange(n * n)

        def release() -> Iterator[pd.DataFrame]:
            for k, (num, den) in sums.items():
                gx, gy = (spot % n).astype("int32"), (spot // n).astype("int32")
                yield pd.DataFrame({"k": k, "gx": gx, "gy": gy, "num": num.ravel(), "den": den.ravel()})
            sums.clear()

        for batch in batches:
            for k, part in batch.groupby("k", sort=False):
                box = part.iloc[0]
                gx, gy = nodes_along(box.minx, box.maxx), nodes_along(box.miny, box.maxy)
                num, den = sums.setdefault(k, (np.zeros((n, n)), np.zeros((n, n))))
                px, py = part["x"].to_numpy(), part["y"].to_numpy()
                count, mean = part["n"].to_numpy()[:, None, None], part["m"].to_numpy()[:, None, None]
                for i in range(0, len(part), SITE_STEP):
                    cut = slice(i, i + SITE_STEP)
                    dx2 = (px[cut, None] - gx[None, :]) ** 2
                    for first in range(0, n, rows_per_tile):
                        tile = slice(first, first + rows_per_tile)
                        dy2 = (py[cut, None] - gy[None, tile]) ** 2
                        dist = np.sqrt(dy2[:, :, None] + dx2[:, None, :])
                        dist[dist == 0] = 1e-10
                        weight = count[cut] / dist**power
                        num[tile] += (weight * mean[cut]).sum(axis=0)
                        den[tile] += weight.sum(axis=0)
            if len(sums) * n * n > GRID_NODES:
                yield from release()
        yield from release()

    partial = work.mapInPandas(add_up, f"k {key_type}, gx int, gy int, num double, den double")
    return (
        partial.groupBy(F.col("k").alias(key), "gx", "gy")
        .agg((F.sum("num") / F.sum("den")).alias("value"))
    )


# Blocks of a cell that one part takes; a cell with more is met in as many parts as it needs.
PART_BLOCKS = 1024

# Half of the 3 x 3 cells around a cell: with the cell itself, each pair of cells once.
_HALF = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))

# Halvings of a cell's sides along which its sites are sorted.
_FINE = 10
_SITE = ("x", "y", "n", "m", "ss")


def _blocks(sites: DataFrame, max_dist: float) -> DataFrame:
    """Runs of up to ``SITE_BLOCK`` sites of a cell that lie close together, with their bounding boxes, as a table.

    Sites are sorted by cell (``max_dist`` wide) and, in a cell, along a space-filling curve, in ranges
    that Spark cuts where it likes, so a crowded cell is many ranges.
    """

    def fine(c: str) -> str:
        return f"least(cast(({c} / {max_dist!r}D - c{c}) * {1 << _FINE} as bigint), {(1 << _FINE) - 1})"

    bits = [f"shiftleft(shiftright({fine(c)}, {i}) & 1, {2 * i + k})" for i in range(_FINE) for k, c in enumerate("xy")]
    cells = sites.withColumns({f"c{c}": F.expr(f"floor({c} / {max_dist!r}D)") for c in "xy"})
    curve = cells.withColumn("z", F.expr(" | ".join(bits)))
    order = ["cx", "cy", "z", "x", "y"]
    ranged = curve.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    most = SITE_BLOCK

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rest = 0, None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            cell = rows[["cx", "cy"]].to_numpy()
            starts = np.append(0, 1 + np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(rows))
            runs = [(i, min(i + most, b)) for a, b in zip(starts, ends) for i in range(a, b, most)]
            done = len(runs) - 1  # the last run may go on in the next batch
            yield from _rows(rows, runs[:done], number)
            number += done
            rest = rows.iloc[runs[-1][0] :]
        if rest is not None and len(rest):
            yield from _rows(rest, [(0, len(rest))], number)

    def _rows(rows: pd.DataFrame, runs: list[tuple[int, int]], number: int) -> Iterator[pd.DataFrame]:
        if runs:
            found = []
            for k, (a, b) in enumerate(runs):
                part = rows.iloc[a:b]
                box = [part["x"].min(), part["x"].max(), part["y"].min(), part["y"].max()]
                key = int(part["range"].iloc[0]) << 40 | number + k
                found.append([key, part["cx"].iloc[0], part["cy"].iloc[0], *box, *(part[c].to_numpy() for c in _SITE)])
            yield pd.DataFrame(found, columns=["block", "cx", "cy", "x0", "x1", "y0", "y1", *_SITE])

    arrays = ", ".join(f"{c} array<double>" for c in _SITE)
    schema = f"block long, cx long, cy long, x0 double, x1 double, y0 double, y1 double, {arrays}"
    return written(ranged.mapInPandas(cut, schema), "site-blocks")


def _meetings(blocks: DataFrame, max_dist: float) -> DataFrame:
    """(a, b) of the blocks whose boxes are nearer than ``max_dist``, each pair once, also a = b: ids only."""
    boxes = blocks.select("block", "cx", "cy", "x0", "x1", "y0", "y1")
    count = boxes.groupBy("cx", "cy").agg(F.ceil(F.count("*") / PART_BLOCKS).cast("int").alias("parts"))
    count = written(count, "block-cells")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _HALF])
    left = (
        boxes.withColumn("o", F.explode(offsets))
        .select(
            (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"),
            ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("same"),
            *[F.col(c).alias(f"a_{c}") for c in ("block", "x0", "x1", "y0", "y1")],
        )
        .join(count, ["cx", "cy"])
        .withColumn("salt", F.pmod(F.xxhash64("a_block"), "parts").cast("int"))
    )
    right = boxes.join(count, ["cx", "cy"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    gaps = [F.greatest(F.col(f"a_{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"a_{c}1"), F.lit(0.0)) for c in "xy"]
    near = gaps[0] * gaps[0] + gaps[1] * gaps[1] <= F.lit(max_dist) * max_dist * (1 + 1e-12)
    once = ~F.col("same") | (F.col("a_block") <= F.col("block"))
    pairs = left.drop("parts").join(right.drop("parts"), ["cx", "cy", "salt"]).where(once & near)
    return pairs.select(F.col("a_block").alias("a"), F.col("block").alias("b"))


def semivariogram(
    points: DataFrame,
    value: str,
    lag: float,
    max_dist: float,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Half the mean squared difference of values by distance lag, up to ``max_dist``.

    Columns ``lag, pairs, mean_distance, semivariance``; every pair nearer than
    ``max_dist`` counts once. Sites are cut into blocks of neighbours; blocks whose boxes are
    near enough are paired as ids, then joined with their sites, and each meeting returns its
    sums per lag.
    """
    n_lags = int(np.ceil(max_dist / lag))
    sites = written(_sites(points, [], x, y, value), "sites")
    blocks = _blocks(sites, max_dist)
    pairs = written(_meetings(blocks, max_dist), "block-pairs")
    a = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in _SITE])
    b = blocks.select(F.col("block").alias("b"), *_SITE)
    meetings = pairs.join(a, "a").join(b, "b").select(
        (F.col("a") == F.col("b")).alias("same"), *[f"a_{c}" for c in _SITE], *_SITE
    )

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, reach, spread = (np.zeros(n_lags) for _ in range(3))
        for batch in batches:
            for r in batch.itertuples(index=False):
                dist = np.sqrt(
                    (r.a_x[:, None] - r.x[None, :]) ** 2 + (r.a_y[:, None] - r.y[None, :]) ** 2
                )
                near = dist < max_dist
                if r.same:
                    near &= np.triu(np.ones(near.shape, dtype=bool), k=1)
                i, j = np.nonzero(near)
                d = dist[i, j]
                at = np.minimum(np.floor(d / lag).astype(int), n_lags - 1)
                count = r.a_n[i] * r.n[j]
                squares = (
                    count * (r.a_m[i] - r.m[j]) ** 2 + r.n[j] * r.a_ss[i] + r.a_n[i] * r.ss[j]
                )
                pairs += np.bincount(at, count, n_lags)
                reach += np.bincount(at, count * d, n_lags)
                spread += np.bincount(at, squares, n_lags)
        yield pd.DataFrame(
            {"lag": np.arange(n_lags, dtype="int32"), "pairs": pairs, "reach": reach, "spread": spread}
        )

    between = meetings.mapInPandas(add_up, "lag int, pairs double, reach double, spread double")
    # Pairs at one and the same site: n (n - 1) / 2 of them, at distance 0.
    within = sites.where("n > 1").select(
        F.lit(0).alias("lag"),
        (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        F.lit(0.0).alias("reach"),
        (F.col("n") * F.col("ss")).alias("spread"),
    )
    return (
        between.unionByName(within)
        .where("pairs > 0")
        .groupBy("lag")
        .agg(
            F.sum("pairs").cast("long").alias("pairs"),
            (F.sum("reach") / F.sum("pairs")).alias("mean_distance"),
            (F.sum("spread") / F.sum("pairs") / 2).alias("semivariance"),
        )
    )


def linear_variogram(variogram: DataFrame) -> DataFrame:
    """One row: ``slope`` and ``nugget`` of the line through the lags."""
    y, x = F.col("semivariance"), F.col("mean_distance")
    return variogram.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("nugget")
    )
