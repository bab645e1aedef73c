"""A layer of polygons as the leaves of one quadtree over all its edges.

The layer is cut into square cells. A cell with more than ``LEAF_VERTICES`` different vertices,
of whichever zones, is cut into ``FAN`` by ``FAN`` smaller ones, and so on; each vertex is in one
cell of a level, so the number of cells that are cut is bounded by the vertices, however many
zones share an outline. A zone's row for a cell
carries the edges that touch the cell, and one bit for all others: whether the cell's upper
right corner lies in the zone. A point is in the zone if that bit and the number of edges
that the way from the point to the corner crosses say so: first to the right as far as the
corner, then up. The way stays in the cell, so no edge elsewhere matters.

Corners are found like points, from the corner of the larger cell, so each step needs only
the edges of the cells being cut. Unless a place must have one leaf for all zones, only rows with
short or many edges are cut: a zone that is large beside the cell would be in a good part of the smaller
cells, and stays with its row of the larger one. Ties are broken as if every point lay a little to the
right and, much less, above where it is; the same test of a side is used for points and
corners, and cell sides are powers of two, so that both agree to the last bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..session import written

#: A cell with more different vertices is cut.
LEAF_VERTICES = 48
#: Cells along a side of the layer, and of a cell that is cut (powers of two).
BASE, FAN = 64, 16
#: Cuts below the first cells, whose sides are then less than a billionth of the layer's.
CUTS = 6
#: Edges that are tested in generated code; a row with no more, one of them at least a side / ``WIDE`` long, gains little by a cut.
FEW, WIDE = 4, 4

_EDGE = "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2)"


@dataclass(frozen=True)
class Quadtree:
    """``leaves``: zone, _level, _cx, _cy, _inside (the whole cell is), _corner, _edges, _xr, _yt (the corner).

    ``cut`` names the levels of the leaves below each first cell that was cut (_bx, _by, _levels); it is
    None where none was. Cells of level k are ``size`` / ``FAN``**k wide.
    """

    leaves: DataFrame
    cut: DataFrame | None
    size: float

    def side(self, level: int) -> float:
        return self.size / FAN**level


def right_of(px: str, py: str, e: str = "") -> str:
    """Whether a point lies to the right of an edge's line or on it (above, for a level edge)."""
    x1, y1, x2, y2 = (f"{e}{c}" for c in ("x1", "y1", "x2", "y2"))
    side = f"(({x2} - {x1}) * ({py} - {y1}) - ({px} - {x1}) * ({y2} - {y1}))"
    return f"if({y1} = {y2}, {py} >= {y1}, if({y2} > {y1}, {side} <= 0, {side} >= 0))"


def inside_sql(edges: str, corner: str, px: str, py: str, xr: str = "_xr", yt: str = "_yt") -> str:
    """Whether a point of a cell with these edges is in the zone; ``corner`` says it of (xr, yt)."""
    across = f"((e.y1 > {py}) != (e.y2 > {py}) and ({right_of(px, py, 'e.')}) != ({right_of(xr, py, 'e.')}))"
    up = f"((e.x1 > {xr}) != (e.x2 > {xr}) and ({right_of(xr, py, 'e.')}) != ({right_of(xr, yt, 'e.')}))"
    return f"{corner} != (size(filter({edges}, e -> {across} != {up})) % 2 = 1)"


def touches_sql(edges: str, corner: str, px: str, py: str) -> str:
    """Point in the zone or on its boundary."""
    return f"({geometry.on_edge_sql(edges, px, py)} or {inside_sql(edges, corner, px, py)})"


def few_edges(which: range, xr: str = "_xr", yt: str = "_yt") -> list[Column]:
    """Some of the at most ``FEW`` edges of a row as plain columns; what is missing is NaN and touches nothing.

    The start, the direction turned upwards (a level edge counts points above it as right of it), the box,
    and for the way up to the corner whether the edge spans its line (_u) and has the corner on its right (_k).
    """
    columns = []
    for i in which:
        e = f"get(_edges, {i})"
        turn = f"if({e}.y2 > {e}.y1, 1D, -1D)"
        parts = {
            "x": f"{e}.x1", "y": f"{e}.y1",
            "dx": f"if({e}.y1 = {e}.y2, -1D, {turn} * ({e}.x2 - {e}.x1))", "dy": f"abs({e}.y2 - {e}.y1)",
            "lx": f"least({e}.x1, {e}.x2)", "hx": f"greatest({e}.x1, {e}.x2)",
            "ly": f"least({e}.y1, {e}.y2)", "hy": f"greatest({e}.y1, {e}.y2)",
        }
        columns += [F.expr(f"coalesce({v}, double('NaN'))").alias(f"_{n}{i}") for n, v in parts.items()]
        flags = {"u": f"({e}.x1 > {xr}) != ({e}.x2 > {xr})", "k": right_of(xr, yt, f"{e}.")}
        columns += [F.expr(f"coalesce({v}, false)").alias(f"_{n}{i}") for n, v in flags.items()]
    return columns


def touches_few_sql(corner: str, px: str, py: str, xr: str = "_xr") -> str:
    """``touches_sql`` by the columns of ``few_edges``: short and without lambdas, so that Spark compiles it into the join."""
    on, turns = [], corner
    for i in range(FEW):
        across = f"_dx{i} * ({py} - _y{i})"
        point, end = (f"{across} - ({at} - _x{i}) * _dy{i}" for at in (px, xr))
        on.append(f"({py} >= _ly{i} and {py} <= _hy{i} and {px} >= _lx{i} and {px} <= _hx{i} and {point} = 0)")
        crossed = f"({py} >= _ly{i} and {py} < _hy{i} and ({point} <= 0) != ({end} <= 0))"
        turns = f"({turns} != ({crossed} != (_u{i} and ({end} <= 0) != _k{i})))"
    return f"({' or '.join(on)} or {turns})"


def _range(low: str, high: str, first: str, count: str) -> str:
    """The numbers from low to high that are among ``count`` ones from ``first`` on."""
    low, high = f"greatest(cast({low} as bigint), {first})", f"least(cast({high} as bigint), {first} + {count} - 1)"
    return f"explode(if({low} <= {high}, sequence({low}, {high}), cast(array() as array<bigint>)))"


def _touched(edges: DataFrame, zone: str, size: float) -> DataFrame:
    """(zone, _cx, _cy, _edge) for each cell of a parent that an edge touches, sides and corners included.

    ``edges`` has the parent's first column and row of cells (_c0, _r0) and how many it has (_n).
    """
    s = f"{size!r}D"
    rows = edges.select(
        "*", F.expr(_range(f"ceil(least(y1, y2) / {s}) - 1", f"floor(greatest(y1, y2) / {s})", "_r0", "_n")).alias("_cy")
    )
    # where the edge is when it enters and leaves the row, with a cell to spare for rounding

    def at(y: str) -> str:
        part = f"greatest(0D, least(1D, ({y} - y1) / (y2 - y1)))"
        return f"x1 + {part} * (x2 - x1)"

    a, b = at(f"_cy * {s}"), at(f"(_cy + 1) * {s}")
    ends = rows.select(
        "*",
        F.expr(f"if(y1 = y2, least(x1, x2), least({a}, {b}))").alias("_low"),
        F.expr(f"if(y1 = y2, greatest(x1, x2), greatest({a}, {b}))").alias("_high"),
    )
    low = f"greatest(ceil(least(x1, x2) / {s}) - 1, ceil(_low / {s}) - 2)"
    high = f"least(floor(greatest(x1, x2) / {s}), floor(_high / {s}) + 1)"
    cells = ends.select("*", F.expr(_range(low, high, "_c0", "_n")).alias("_cx"))
    corners = [(f"(_cx + {i}) * {s}", f"(_cy + {j}) * {s}") for i in (0, 1) for j in (0, 1)]
    sides = [f"((x2 - x1) * ({py} - y1) - ({px} - x1) * (y2 - y1))" for px, py in corners]
    passes = F.expr(f"least({', '.join(sides)}) <= 0 and greatest({', '.join(sides)}) >= 0")
    return cells.where(passes).select(zone, "_cx", "_cy", F.expr(_EDGE).alias("_edge"))


def _corners(edges: DataFrame, parents: DataFrame, zone: str, size: float, first: bool) -> DataFrame:
    """(zone, _cx, _cy) of the cells whose upper right corner is in the zone.

    A row of corners is right of none, one, two ... crossings of the zone's outline with the row's
    upper side, as far as the parent reaches; crossings of the way up from there to the
    parent's own corner, and that corner's bit in ``parents``, turn the whole row.
    """
    s = f"{size!r}D"
    parent = [zone, "_c0", "_r0", "_n"]
    y, last = f"((_cy + 1) * {s})", f"((_c0 + _n) * {s})"
    crossed = edges.select(
        "*", F.expr(_range(f"ceil(least(y1, y2) / {s}) - 1", f"ceil(greatest(y1, y2) / {s}) - 2", "_r0", "_n")).alias("_cy")
    ).where(F.expr(right_of(last, y)))
    left = f"size(filter(sequence(0L, _n - 1), i -> not ({right_of(f'((_c0 + i + 1) * {s})', y)})))"
    events = crossed.select(*parent, "_cy", F.expr(left).cast("long").alias("_k"))
    if not first:
        every = F.explode(F.sequence(F.col("_r0"), F.col("_r0") + F.col("_n") - 1)).alias("_cy")
        top = f"((_r0 + _n) * {s})"
        up = (
            edges.where(F.expr(f"(x1 > {last}) != (x2 > {last})"))
            .select("*", every)
            .where(F.expr(f"({right_of(last, y)}) != ({right_of(last, top)})"))
        )
        whole = F.col("_n").alias("_k")
        events = events.unionByName(up.select(*parent, "_cy", whole))
        events = events.unionByName(parents.where("_corner").select(*parent, every, whole))
    runs = events.groupBy(*parent, "_cy").agg(F.collect_list("_k").alias("_ks"))
    inside = "explode(filter(sequence(0L, _n - 1), i -> size(filter(_ks, k -> k > i)) % 2 = 1))"
    return runs.select(zone, "_c0", "_cy", F.expr(inside).alias("_i")).select(
        zone, (F.col("_c0") + F.col("_i")).alias("_cx"), "_cy"
    )


def _cut(edges: DataFrame, parents: DataFrame, zone: str, size: float, level: int) -> DataFrame:
    """(zone, _cx, _cy, _corner, _edges) of the cells of this level within their parents, as a table."""
    touched = _touched(edges, zone, size).withColumn("_in", F.lit(False))
    corners = _corners(edges, parents, zone, size, level == 0)
    none = F.lit(None).cast(touched.schema["_edge"].dataType)
    rows = touched.unionByName(corners.select("*", none.alias("_edge"), F.lit(True).alias("_in")))
    cells = rows.groupBy(zone, "_cx", "_cy").agg(F.max("_in").alias("_corner"), F.collect_list("_edge").alias("_edges"))
    return written(cells, f"cells-{level}")


def _full(vertices: DataFrame, size: float, leaf_vertices: int) -> DataFrame:
    """(_cx, _cy) of the cells with too many vertices."""
    cell = [F.expr(f"floor({c}1 / {size!r}D)").alias(f"_c{c}") for c in "xy"]
    counts = vertices.groupBy(*cell).agg(F.count("*").alias("_vertices"))
    return counts.where(F.col("_vertices") > leaf_vertices).select("_cx", "_cy")


def _stays(side: float) -> Column:
    """Whether a row has no edges, or few and a long one."""
    long = f"exists(_edges, e -> greatest(abs(e.x2 - e.x1), abs(e.y2 - e.y1)) >= {side / WIDE!r}D)"
    return F.expr(f"size(_edges) = 0 or (size(_edges) <= {FEW} and {long})")


def build(
    zones: DataFrame,
    zone: str = "zone_id",
    cell: float | None = None,
    one_leaf: bool = True,
    leaf_vertices: int = LEAF_VERTICES,
) -> Quadtree:
    """The quadtree of a layer; ``cell`` is about the side of its first cells.

    With ``one_leaf`` all zones of a place have their rows in the same leaf. Runs a few jobs over the edges of the layer for each level. A zone without area has the
    cells that its edges touch; zones without rings have none.
    """
    edges = zones.select(zone, F.expr(f"inline({geometry.polygon_edges_sql('rings')})")).where(
        "x1 is not null and y1 is not null and x2 is not null and y2 is not null"
    )
    # a small file of many zones is one task, whatever its edges cost: as a table of their own they are dealt out
    edges = written(edges.repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "edges")
    reach = [(f, F.least, "low") if f is F.min else (f, F.greatest, "high") for f in (F.min, F.max)]
    extent = edges.agg(*[f(g(f"{c}1", f"{c}2")).alias(c + end) for c in "xy" for f, g, end in reach]).first()
    if extent["xlow"] is None:
        extent = {"xlow": 0.0, "ylow": 0.0, "xhigh": 0.0, "yhigh": 0.0}
    width = max(extent["xhigh"] - extent["xlow"], extent["yhigh"] - extent["ylow"])
    side = cell if cell is not None else width / BASE
    size = 2.0 ** (round(math.log2(side)) if cell is not None else math.ceil(math.log2(side))) if side > 0 else 1.0
    c0, r0 = (math.ceil(extent[c + "low"] / size) - 1 for c in "xy")
    n = max(math.floor(extent["xhigh"] / size) - c0, math.floor(extent["yhigh"] / size) - r0) + 1

    where = {"_c0": F.lit(c0).cast("long"), "_r0": F.lit(r0).cast("long"), "_n": F.lit(n).cast("long")}
    parents = zones.select(zone).withColumns(where)
    edges = edges.withColumns(where)
    vertices = written(edges.select("x1", "y1").distinct(), "vertices")
    leaves, below = [], []
    for level in range(CUTS + 1):
        side = size / FAN**level
        cells = _cut(edges, parents, zone, side, level)
        full = _full(vertices, side, leaf_vertices)
        going = cells if one_leaf else cells.where(~_stays(side))
        if not one_leaf:
            full = full.join(going.select("_cx", "_cy").distinct(), ["_cx", "_cy"], "left_semi")
        full = written(full, f"full-cells-{level}")
        last = level == CUTS or full.isEmpty()
        done = cells if last else going.join(full, ["_cx", "_cy"], "left_anti")
        if not (last or one_leaf):
            done = done.unionByName(cells.where(_stays(side)))
        leaves.append(
            done.select(
                zone, F.lit(level).alias("_level"), "_cx", "_cy", (F.size("_edges") == 0).alias("_inside"), "_corner",
                F.when(F.size("_edges") > 0, F.col("_edges")).alias("_edges"),
                ((F.col("_cx") + 1) * F.lit(side)).alias("_xr"), ((F.col("_cy") + 1) * F.lit(side)).alias("_yt"),
            )
        )
        if level or not one_leaf:
            base = [F.shiftright(c, level * (FAN.bit_length() - 1)).alias(b) for c, b in (("_cx", "_bx"), ("_cy", "_by"))]
            below.append(done.select(*base, F.lit(level).alias("_level")))
        if last:
            break
        within = {"_c0": F.col("_cx") * FAN, "_r0": F.col("_cy") * FAN, "_n": F.lit(FAN).cast("long")}
        parents = going.join(full, ["_cx", "_cy"], "left_semi").withColumns(within)
        edges = parents.select(zone, *within, F.expr("inline(_edges)"))
    tree = leaves[0]
    for more in leaves[1:]:
        tree = tree.unionByName(more)
    if len(leaves) == 1:
        return Quadtree(tree, None, size)
    cut = below[0]
    for more in below[1:]:
        cut = cut.unionByName(more)
    levels = cut.groupBy("_bx", "_by").agg(F.collect_set("_level").alias("_levels")).where(F.array_max("_levels") > 0)
    return Quadtree(tree, written(levels, "cut-cells"), size)


def placed(points: DataFrame, tree: Quadtree, x: str, y: str) -> DataFrame:
    """Points with the cells they may have a leaf in (_level, _px, _py): one cell, and one for each level below a cut one."""
    base = points.select("*", *[F.expr(f"floor(`{c}` / {tree.size!r}D)").alias(b) for c, b in ((x, "_bx"), (y, "_by"))])
    if tree.cut is None:
        return base.withColumnsRenamed({"_bx": "_px", "_by": "_py"}).withColumn("_level", F.lit(0))
    found = base.join(tree.cut, ["_bx", "_by"], "left").withColumn(
        "_level", F.explode(F.coalesce("_levels", F.array(F.lit(0))))
    )
    return found.select(*points.columns, "_level", _cell(x, tree).alias("_px"), _cell(y, tree).alias("_py"))


def _cell(c: str, tree: Quadtree) -> Column:
    return F.expr(f"floor(`{c}` / ({tree.size!r}D / pow({FAN}D, _level)))")
