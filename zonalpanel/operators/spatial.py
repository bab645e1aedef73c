"""Point-in-polygon joins, centroids, nearest donors, grids.

The layer is a quadtree over its edges. A leaf's row for a zone carries only the edges that
touch the leaf, or none at all when the leaf lies inside the polygon, so matching is an
equi-join on the leaf followed by a short test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, projection
from ..session import written
from . import quadtree

# Points of a leaf that one part takes. A leaf with more is split into as many parts as its
# points need, and only then are its rows copied.
PART_POINTS = 100_000

# Sites of a cell that a zone is compared with one by one.
LEAF_SITES = 64
# Halvings of the extent down to the finest cells, and of a cell at each step of the search.
FINEST, STEP = 26, 2


def _located(points: DataFrame, tree: quadtree.Quadtree, x: str, y: str) -> DataFrame:
    """Points with the cells they may have a leaf in, and a number that differs between equal points."""
    numbered = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        "*", F.xxhash64(F.monotonically_increasing_id(), x, y).alias("_draw")
    )
    return quadtree.placed(numbered, tree, x, y)


def _crowds(placed: DataFrame, part_points: int) -> DataFrame:
    """Cells with more points than a part takes, and how many parts they need.

    Counts are aggregated before they are shuffled; the few rows that remain are written, so
    that Catalyst knows their size.
    """
    counts = placed.groupBy("_level", "_px", "_py").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / part_points).cast("int").alias("_parts")
    crowded = counts.where(F.col("_n") > part_points).select(
        F.col("_level").alias("_glevel"), F.col("_px").alias("_gx"), F.col("_py").alias("_gy"), parts
    )
    return written(crowded, "crowded-cells")


def _in_crowd(df: DataFrame, crowds: DataFrame, cx: str, cy: str) -> DataFrame:
    same = (df["_level"] == crowds["_glevel"]) & (df[cx] == crowds["_gx"]) & (df[cy] == crowds["_gy"])
    return df.join(crowds, same, "left").drop("_glevel", "_gx", "_gy")


def _salted_points(placed: DataFrame, crowds: DataFrame) -> DataFrame:
    """Points with their part of a crowded cell, 0 in all other cells."""
    part = F.pmod("_draw", F.coalesce("_parts", F.lit(1))).cast("int")
    return _in_crowd(placed, crowds, "_px", "_py").withColumn("_salt", part).drop("_draw", "_parts")


def _salted_leaves(leaves: DataFrame, crowds: DataFrame) -> DataFrame:
    """Leaf rows, once for each part of their cell."""
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    salted = _in_crowd(leaves, crowds, "_cx", "_cy").withColumn("_zsalt", copies).drop("_parts")
    return salted.withColumnRenamed("_level", "_zlevel")


def _same_leaf(points: DataFrame, leaves: DataFrame) -> Column:
    return (
        (points["_level"] == leaves["_zlevel"])
        & (points["_px"] == leaves["_cx"])
        & (points["_py"] == leaves["_cy"])
        & (points["_salt"] == leaves["_zsalt"])
    )


def spatial_join_points(
    points: DataFrame,
    zones: DataFrame,
    cell: float | None = None,
    x: str = "x",
    y: str = "y",
    zone: str = "zone_id",
    part_points: int = PART_POINTS,
) -> DataFrame:
    """Points with the zone they touch, inner; a shared boundary matches every zone on it.

    Points of a leaf with more than ``part_points`` of them are spread over parts, equal
    points too; a small job counts the points of each leaf first. Others build the quadtree;
    ``cell`` is about the side of its first cells.
    """
    tree = quadtree.build(zones, zone, cell, False)
    placed = _located(points, tree, x, y)
    crowds = _crowds(placed, part_points)
    few = F.col("_inside") | (F.size("_edges") <= quadtree.FEW)
    # in two steps: Java does not compile the generated code of one that makes all columns
    half, at = quadtree.FEW // 2, ("_corner", f"`{x}`", f"`{y}`")
    flat = _salted_leaves(tree.leaves.where(few).select("*", *quadtree.few_edges(range(half))), crowds)
    flat = flat.select("*", *quadtree.few_edges(range(half, quadtree.FEW))).drop("_edges")
    kinds, many = [(flat, quadtree.touches_few_sql(*at))], tree.leaves.where(~few)
    if not many.isEmpty():  # else the points are read and shuffled once
        kinds.append((_salted_leaves(many, crowds), quadtree.touches_sql("_edges", *at)))
    found = []
    for c, test in kinds:
        p = _salted_points(placed, crowds)
        # leaves first: a row of theirs is read once, and a zone's matches come one after another
        joined = c.join(p, _same_leaf(p, c) & (c["_inside"] | F.expr(test)), "inner")
        found.append(joined.select(*[p[n] for n in points.columns], c[zone]))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def clip_to_zones(
    pixels: DataFrame,
    zones: DataFrame,
    cell: float | None = None,
    x: str = "x",
    y: str = "y",
    zone: str = "zone_id",
    part_points: int = PART_POINTS,
) -> DataFrame:
    """Pixels whose centre touches some zone, each once.

    A place has one leaf, so with a row for each leaf, whichever its zones, the join finds a
    pixel at most once: one join for zones of any sizes.
    """
    tree = quadtree.build(zones, zone, cell)
    placed = _located(pixels, tree, x, y)
    crowds = _crowds(placed, part_points)
    partly = F.collect_list(F.when(~F.col("_inside"), F.struct("_corner", "_edges")))
    leaves = tree.leaves.groupBy("_level", "_cx", "_cy", "_xr", "_yt").agg(
        F.max("_inside").alias("_inside"), partly.alias("_zones")
    )
    p = _salted_points(placed, crowds)
    c = _salted_leaves(leaves, crowds)
    test = F.expr(f"exists(_zones, z -> {quadtree.touches_sql('z._edges', 'z._corner', f'`{x}`', f'`{y}`')})")
    return p.join(c, _same_leaf(p, c) & (c["_inside"] | test), "inner").select(*pixels.columns)


def polygon_centroid(zones: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Area-weighted centroid of each zone: ``zone, cx, cy``."""
    cx, cy = geometry.centroid("rings")
    return zones.select(zone, cx.alias("cx"), cy.alias("cy"))


def reproject_layer(zones: DataFrame, src: int, dst: int) -> DataFrame:
    """All vertices of a layer in another coordinate system."""

    def moved(v: Column) -> Column:
        x, y = projection.reproject_xy(v["x"], v["y"], src, dst)
        return F.struct(x.alias("x"), y.alias("y"))

    return zones.withColumn("rings", F.transform("rings", lambda r: F.transform(r, moved)))


def layer_bounds(zones: DataFrame) -> DataFrame:
    """One row: ``minx, miny, maxx, maxy`` of a layer."""
    vertices = zones.select(F.explode(F.flatten("rings")).alias("v"))
    return vertices.agg(
        F.min("v.x").alias("minx"),
        F.min("v.y").alias("miny"),
        F.max("v.x").alias("maxx"),
        F.max("v.y").alias("maxy"),
    )


def grid_coordinates(zones: DataFrame, n: int) -> DataFrame:
    """Regular n x n grid over the layer's bounds, both ends included: ``gx, gy, x, y``."""
    bounds = layer_bounds(zones).select(F.struct("minx", "miny", "maxx", "maxy")).scalar()

    def at(i: Column, low: str, high: str) -> Column:
        step = (F.col(f"_b.{high}") - F.col(f"_b.{low}")) / max(n - 1, 1)
        inner = F.col(f"_b.{low}") + i * step
        return F.when(i == n - 1, F.col(f"_b.{high}")).otherwise(inner) if n > 1 else inner

    return (
        zones.sparkSession.range(n * n)
        .select((F.col("id") % n).cast("int").alias("gx"), F.floor(F.col("id") / n).cast("int").alias("gy"))
        .withColumn("_b", bounds)
        .select("gx", "gy", at(F.col("gx"), "minx", "maxx").alias("x"), at(F.col("gy"), "miny", "maxy").alias("y"))
    )


def _sites(donors: DataFrame, extent: dict) -> DataFrame:
    """Places of donors with their finest cell and the smallest id there."""
    places = donors.groupBy("_x", "_y").agg(F.min("_id").alias("donor_id"))

    def cell(c: str) -> Column:
        share = (F.col(f"_{c}") - F.lit(extent[f"{c}0"])) / F.lit(extent["w"])
        return F.least(F.floor(share * 2.0**FINEST), F.lit(2**FINEST - 1)).cast("long")

    return places.select(
        "donor_id", F.col("_x").alias("_dx"), F.col("_y").alias("_dy"), cell("x").alias("_ix"), cell("y").alias("_iy")
    )


def _at(level: int, up: str = "_cx", right: str = "_cy") -> list[Column]:
    return [F.shiftright(i, FINEST - level).alias(c) for i, c in (("_ix", up), ("_iy", right))]


def _closer(frontier: DataFrame, sites: DataFrame, level: int) -> DataFrame:
    """The frontier one step down: children whose box is no further than some donor of the best child can be."""
    parent = ["_px", "_py"]
    held = sites.select("*", *_at(level), *_at(level - STEP, *parent))
    held = held.join(frontier.select(*parent).distinct(), parent, "left_semi")
    children = held.groupBy(*parent, "_cx", "_cy").agg(
        F.count("*").alias("_sites"),
        *[f(c).alias(f"{c}{n}") for c in ("_dx", "_dy") for n, f in ((0, F.min), (1, F.max))],
    )
    reached = frontier.drop("_sites").join(children, parent)

    def along(how: str) -> list[Column]:
        return [F.expr(how.format(p=f"_{c}", a=f"_d{c}0", b=f"_d{c}1")) for c in "xy"]

    def distance(x: Column, y: Column) -> Column:
        return F.sqrt(x * x + y * y)

    near = distance(*along("greatest({a} - {p}, {p} - {b}, 0D)"))
    # each side of a box has a donor on it, so some donor is on the nearer one of two opposite sides
    (x, y), (far_x, far_y) = along("least(abs({a} - {p}), abs({b} - {p}))"), along("greatest(abs({a} - {p}), abs({b} - {p}))")
    far = F.least(distance(x, far_y), distance(far_x, y))
    one = Window.partitionBy("_id", "_x", "_y")
    bounded = reached.select("*", near.alias("_near"), F.min(far).over(one).alias("_best"))
    kept = bounded.where(F.col("_near") <= F.col("_best") * (1 + 1e-12))
    return kept.select("_id", "_x", "_y", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"), "_sites")


def nearest_donor_zone(
    centroids: DataFrame,
    missing: Sequence | Column,
    zone: str = "zone_id",
    x: str = "cx",
    y: str = "cy",
) -> DataFrame:
    """For each missing zone the nearest other zone: ``missing_id, donor_id, distance``.

    ``missing`` lists the ids, or is a condition on the columns of ``centroids``; zones without a
    centroid take no part. Branch and bound down a pyramid of grid cells: each step
    counts the donors in the children of the cells still in question and bounds their boxes,
    and a missing zone goes on only into children that can hold its nearest donor, until no
    such cell has more than ``LEAF_SITES`` places. Only then are distances taken, to the
    donors of those cells. Donors on one place count as one. Ties go to the smaller id.
    """
    listed = missing if isinstance(missing, Column) else F.col(zone).isin(*missing)
    placed = centroids.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(zone).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
        F.coalesce(listed, F.lit(False)).alias("_missing"),
    )
    placed = written(placed, "centroids")
    donors = placed.where(~F.col("_missing"))
    width = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")) + 1e-9
    extent = donors.agg(
        F.min("_x").alias("x0"), F.min("_y").alias("y0"), width.alias("w"), F.count("*").alias("n")
    ).first().asDict()
    frontier = placed.where("_missing").select(
        "_id", "_x", "_y", F.lit(0).cast("long").alias("_px"), F.lit(0).cast("long").alias("_py"), F.lit(0).alias("_sites")
    )
    sites = _sites(donors, extent if extent["n"] else {"x0": 0.0, "y0": 0.0, "w": 1.0})
    level, most = 0, extent["n"]
    if most > LEAF_SITES:
        sites = written(sites, "sites")
    while most > LEAF_SITES and level < FINEST:
        level += STEP
        frontier = written(_closer(frontier, sites, level), f"frontier-{level}")
        most = frontier.agg(F.coalesce(F.max("_sites"), F.lit(0))).first()[0]
    dx, dy = F.col("_x") - F.col("_dx"), F.col("_y") - F.col("_dy")
    best = F.min(F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), F.col("donor_id").alias("donor_id")))
    return (
        frontier.join(sites.select("*", *_at(level, "_px", "_py")), ["_px", "_py"])
        .groupBy(F.col("_id").alias("missing_id"))
        .agg(best.alias("_best"))
        .select("missing_id", "_best.donor_id", "_best.distance")
    )
