"""Geometry, spatial joins, donors and surfaces against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonalpanel.operators import columns as C
from zonalpanel.operators import pixels as X
from zonalpanel.operators import quadtree as Q
from zonalpanel.operators import spatial as S
from zonalpanel.operators import surface as U
from zonalpanel.sources import pixels as P
from zonalpanel.sources import zones as Z

LAYER = "zone_id int, rings array<array<struct<x:double,y:double>>>"


def layer(spark, zones):
    return spark.createDataFrame([(z, [[tuple(map(float, p)) for p in ring] for ring in rings]) for z, rings in zones], LAYER)


def touches(rings, px, py):
    """Plain even-odd test with the boundary counted in."""
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            cross = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            if cross == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return True
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def star(rng, cx, cy, size, n):
    """A jagged ring on whole and half coordinates, so that edges pass through points."""
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    radius = rng.uniform(0.3, 1.0, n) * size
    return [(round((cx + r * math.cos(a)) * 2) / 2, round((cy + r * math.sin(a)) * 2) / 2) for a, r in zip(angles, radius)]


NOTCHED = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]


@pytest.mark.parametrize("cell", [None, 0.7, 10.0])
def test_concave_ring(spark, cell):
    zones = layer(spark, [(1, [NOTCHED])])
    points = [(1, 1), (2, 3), (0, 2), (4, 4), (5, 1), (2, 0)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    hit = {r.i for r in S.spatial_join_points(df, zones, cell).collect()}
    assert hit == {0, 2, 3, 5}


@pytest.mark.parametrize("cell", [None, 0.9, 25.0])
@pytest.mark.parametrize("broadcast", [True, False])
def test_join_against_brute_force(spark, cell, broadcast):
    """Jagged zones with holes and negative coordinates; a third of the points on one spot."""
    rng = np.random.default_rng(11)
    zones = []
    for z in range(12):
        cx, cy = rng.uniform(-15, 15, 2)
        zones.append((z, [star(rng, cx, cy, 8, 14), star(rng, cx, cy, 2, 6)]))
    zones.append((99, [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)], [(10, 10), (12, 10), (12, 12)]]))
    grid = [(x / 2, y / 2) for x in range(-30, 31, 2) for y in range(-30, 31)]
    points = grid + [(3.0, 5.0)] * (len(grid) // 2)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double").repartition(8)
    want = {(i, z) for i, (x, y) in enumerate(points) for z, rings in zones if touches(rings, x, y)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        zone_df = layer(spark, zones)
        got = [(r.i, r.zone_id) for r in S.spatial_join_points(df, zone_df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        clipped = sorted(r.i for r in S.clip_to_zones(df, zone_df, cell).collect())
        assert clipped == sorted({i for i, _ in want})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_inner_cells_carry_no_edges(spark):
    tree = Q.build(layer(spark, [(1, [[(0, 0), (10, 0), (10, 10), (0, 10)]])]), cell=1.0)
    inside = tree.leaves.where("_inside")
    assert inside.count() == 64  # the outline touches the cells on both of its sides
    assert inside.where("_edges is not null").count() == 0


@pytest.mark.parametrize(("cell", "leaf_vertices"), [(8.0, 1), (64.0, 3), (None, 1)])
def test_cut_cells_against_brute_force(spark, monkeypatch, cell, leaf_vertices):
    """Small leaves, so that cells are cut more than once, with points and corners on edges and vertices."""
    monkeypatch.setattr(Q, "build", lambda *a, real=Q.build: real(*a, leaf_vertices=leaf_vertices))
    rng = np.random.default_rng(leaf_vertices)
    zones = [(z, [star(rng, *rng.uniform(-6, 6, 2), 5, 25), star(rng, *rng.uniform(-6, 6, 2), 1, 5)]) for z in range(8)]
    zones += [(20, [NOTCHED]), (21, [[(-8, -8), (8, -8), (8, 8), (-8, 8)]]), (22, [[(1, 1), (1, 1)]])]
    zones += [(23, [[(0, 0), (3, 0), (3, 1), (6, 1), (6, 0), (7, 0), (7, 3), (0, 3)]])]
    points = [(x / 4, y / 4) for x in range(-36, 37) for y in range(-36, 37)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    want = {(i, z) for i, (x, y) in enumerate(points) for z, rings in zones if touches(rings, x, y)}
    got = [(r.i, r.zone_id) for r in S.spatial_join_points(df, layer(spark, zones), cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    clipped = sorted(r.i for r in S.clip_to_zones(df, layer(spark, zones), cell).collect())
    assert clipped == sorted({i for i, _ in want})


def test_one_huge_zone_does_not_multiply_cells(spark):
    """Zones of very different size have leaves of their own size; points still meet all of them once."""
    small = [(i, [[(i, 0), (i + 1, 0), (i + 1, 1), (i, 1)]]) for i in range(20)]
    huge = (100, [[(-40000, -40000), (40000, -40000), (0, 60000)]])
    zones = layer(spark, [*small, huge, (101, [[(3, 3), (3, 3), (3, 3)]])])
    tree = Q.build(zones, leaf_vertices=10)
    assert tree.cut is not None and tree.leaves.count() < 10_000
    points = [(x / 2, y / 2) for x in range(-4, 46) for y in range(-3, 9)] + [(-30000.0, -39000.0), (0.0, 59999.0), (39999.0, 0.0)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    every = [*small, huge, (101, [[(3, 3), (3, 3), (3, 3)]])]
    want = sorted((i, z) for i, (x, y) in enumerate(points) for z, rings in every if touches(rings, x, y))
    assert sorted((r.i, r.zone_id) for r in S.spatial_join_points(df, zones).collect()) == want
    assert sorted(r.i for r in S.clip_to_zones(df, zones).collect()) == sorted({i for i, _ in want})


def test_centroid_with_hole_and_parts(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (2, 4), (4, 4), (4, 2)]
    rows = [(1, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(reversed(outer))]
    rows += [(1, 0, 1, i, float(x), float(y)) for i, (x, y) in enumerate(reversed(hole))]
    rows += [(1, 1, 0, i, float(x) + 10, float(y)) for i, (x, y) in enumerate(outer)]
    zones = Z.zones_from_vertices(spark.createDataFrame(rows, "zone_id int, part int, ring int, seq int, x double, y double"))
    row = S.polygon_centroid(zones).first()
    area = [16.0, -4.0, 16.0]
    xs, ys = [2.0, 3.0, 12.0], [2.0, 3.0, 2.0]
    assert row.cx == pytest.approx(np.dot(area, xs) / 28)
    assert row.cy == pytest.approx(np.dot(area, ys) / 28)


def test_projection(spark):
    df = spark.createDataFrame([(250000.0, 2655023.12495)], "x double, y double")
    row = C.tm_to_lonlat(df).first()
    assert row.lon == pytest.approx(121, abs=1e-9)
    assert row.lat == pytest.approx(24, abs=1e-7)
    m = C.lonlat_to_mercator(spark.createDataFrame([(180.0, 0.0)], "lon double, lat double")).first()
    assert m.mx == pytest.approx(20037508.342789244)
    assert m.my == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_donor(spark, seed):
    """Clusters far apart, lattice ties and lone zones."""
    rng = np.random.default_rng(seed)
    pts = [(float(x), float(y)) for x, y in rng.integers(0, 40, (150, 2))]
    pts += [(1000.0 + float(x), 1000.0 + float(y)) for x, y in rng.normal(0, 0.01, (60, 2))]
    pts += [(-5000.0, 3.0), (500.0, -700.0)]
    missing = set(rng.choice(len(pts) - 2, 50, replace=False).tolist()) | {len(pts) - 1}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "zone_id int, cx double, cy double")
    want = {}
    for m in missing:
        want[m] = min((math.sqrt((pts[m][0] - x) ** 2 + (pts[m][1] - y) ** 2), d) for d, (x, y) in enumerate(pts) if d not in missing)
    rows = S.nearest_donor_zone(df, sorted(missing)).collect()
    assert {r.missing_id: (pytest.approx(r.distance), r.donor_id) for r in rows} == want


def test_far_cluster_of_donors(spark, monkeypatch):
    """Cells are counted, not their donors compared, until few are left."""
    rng = np.random.default_rng(12)
    crowd = 1000 + rng.normal(0, 1, (100_000, 2))
    lone = rng.uniform(-10, 10, (100, 2))
    frame = pd.DataFrame(np.vstack([crowd, crowd[:50], lone]), columns=["cx", "cy"]).assign(zone_id=lambda d: d.index)
    df = spark.createDataFrame(frame)
    frontiers, real = [], S.written

    def kept(table, label):
        result = real(table, label)
        if label.startswith("frontier"):
            frontiers.append(result.count())
        return result

    monkeypatch.setattr(S, "written", kept)
    rows = S.nearest_donor_zone(df, F.col("zone_id") >= 100_050).collect()
    assert len(rows) == 100 and len(frontiers) >= 2 and max(frontiers) < 2_000
    for r in rows:
        d = np.hypot(*(frame[["cx", "cy"]].values[:100_050] - lone[r.missing_id - 100_050]).T)
        assert (r.donor_id, r.distance) == (int(d.argmin()), pytest.approx(d.min()))


def test_donors_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0)], "zone_id int, cx double, cy double")
    assert S.nearest_donor_zone(df, [1, 2]).count() == 0
    assert S.nearest_donor_zone(df, []).count() == 0
    assert [tuple(r) for r in S.nearest_donor_zone(df, [1, 3]).collect()] == [(1, 2, 1.0)]


def test_idw(spark):
    zones = layer(spark, [(1, [[(0, 0), (2, 0), (2, 2), (0, 2)]])])
    df = spark.createDataFrame([(2020, 0.0, 0.0, 0.0), (2020, 2.0, 0.0, 10.0)], "year int, x double, y double, v double")
    got = {(r.gx, r.gy): r.value for r in U.idw_surface(df, zones, "v", n=3).collect()}
    assert got[(1, 0)] == pytest.approx(5.0)
    assert got[(0, 0)] == pytest.approx(0.0, abs=1e-9)
    assert len(got) == 9


@pytest.mark.parametrize("tile", [7, 16384])
def test_idw_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(U, "NODE_TILE", tile)
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"year": rng.integers(2015, 2018, 400), "x": rng.integers(0, 9, 400) / 2.0, "y": rng.uniform(0, 4, 400), "v": rng.normal(5, 2, 400)})
    zones = layer(spark, [(1, [[(0, 0), (4, 0), (4, 4), (0, 4)]])])
    got = U.idw_surface(spark.createDataFrame(pts), zones, "v", n=5, power=3.0).toPandas()
    assert len(got) == 75
    for r in got.itertuples():
        part = pts[pts.year == r.year]
        d = np.hypot(part.x - r.gx, part.y - r.gy)
        w = np.where(d == 0, 1e-10, d) ** -3.0
        assert r.value == pytest.approx((w * part.v).sum() / w.sum(), rel=1e-9)


@pytest.mark.parametrize("block", [3, 512])
def test_semivariogram(spark, monkeypatch, block):
    """A third of the points share one site and one cell is crowded."""
    monkeypatch.setattr(U, "SITE_BLOCK", block)
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.uniform(-3, 3, (120, 2)), np.tile([0.5, 0.5], (80, 1)), rng.normal(1, 0.05, (60, 2))])
    v = rng.normal(10, 3, len(xy))
    df = spark.createDataFrame([(float(x), float(y), float(z)) for (x, y), z in zip(xy, v)], "x double, y double, v double")
    i, j = np.triu_indices(len(xy), 1)
    d = np.hypot(*(xy[i] - xy[j]).T)
    near = d < 1.0
    lag = np.floor(d[near] / 0.25).astype(int)
    half = 0.5 * (v[i] - v[j])[near] ** 2
    for r in U.semivariogram(df, "v", 0.25, 1.0).collect():
        assert r.pairs == (lag == r.lag).sum()
        assert r.semivariance == pytest.approx(half[lag == r.lag].mean())
        assert r.mean_distance == pytest.approx(d[near][lag == r.lag].mean())


def test_blocks_of_far_sites_do_not_meet(spark, monkeypatch):
    """Clusters in one cell and its neighbours: only blocks within reach are paired, each pair once."""
    monkeypatch.setattr(U, "SITE_BLOCK", 20)
    rng = np.random.default_rng(2)
    centres = [(0.05, 0.05), (0.95, 0.95), (1.95, 0.05), (1.9, 1.9), (-0.5, 0.5)]
    xy = np.vstack([rng.normal(c, 0.01, (200, 2)) for c in centres])
    sites = spark.createDataFrame([(float(x), float(y), 1.0, 0.0, 0.0) for x, y in xy], "x double, y double, n double, m double, ss double")
    blocks = U._blocks(sites, 1.0)
    rows = blocks.collect()
    assert sum(len(r.x) for r in rows) == 1000 and max(len(r.x) for r in rows) <= 20
    got = [frozenset((r.a, r.b)) for r in U._meetings(blocks, 1.0).collect()]
    assert len(got) == len(set(got))
    near = {frozenset((p.block, q.block)) for p in rows for q in rows
            if np.hypot(np.subtract.outer(p.x, q.x), np.subtract.outer(p.y, q.y)).min() < 1}
    assert near <= set(got) and len(got) < 0.5 * len(rows) * (len(rows) + 1) / 2


@pytest.mark.parametrize("sites", [5, 2048])
def test_years_are_spread_by_their_sites(spark, monkeypatch, sites):
    """One year has nearly all sites; the surface does not depend on how they are spread."""
    monkeypatch.setattr(U, "PART_SITES", sites)
    rng = np.random.default_rng(5)
    pts = pd.DataFrame({"year": np.where(np.arange(300) < 290, 2001, 2002), "x": rng.uniform(0, 4, 300), "y": rng.uniform(0, 4, 300), "v": rng.normal(5, 2, 300)})
    zones = layer(spark, [(1, [[(0, 0), (4, 0), (4, 4), (0, 4)]])])
    surface = U.idw_surface(spark.createDataFrame(pts), zones, "v", n=4)
    assert "Expand" not in surface._jdf.queryExecution().optimizedPlan().toString()
    got = surface.toPandas()
    assert len(got) == 32
    for r in got.itertuples():
        part = pts[pts.year == r.year]
        w = 1 / ((part.x - r.gx * 4 / 3) ** 2 + (part.y - r.gy * 4 / 3) ** 2)
        assert r.value == pytest.approx((w * part.v).sum() / w.sum(), rel=1e-9)


def test_zone_statistics_with_missing_pixels(spark):
    rows = [(1, "2020-01-01", v, None) for v in (1.0, 2.0, 4.0, None)] + [(2, "2020-01-01", None, 3.0)]
    df = spark.createDataFrame(rows, "zone_id int, image_date string, a double, b double")
    got = {}
    for stat in ("MEAN", "MEDIAN", "STD", "SUM"):
        for r in X.zone_image_statistics(df, ["a", "b"], stat).collect():
            got[(stat, r.zone_id)] = (r[f"a_{stat}"], r[f"b_{stat}"])
    assert got[("MEDIAN", 1)] == (2.0, None)
    assert got[("MEDIAN", 2)] == (None, 3.0)
    assert got[("MEAN", 1)][0] == pytest.approx(7 / 3)
    assert got[("STD", 1)][0] == pytest.approx(np.std([1, 2, 4]))
    assert got[("SUM", 2)] == (None, 3.0)


def test_medians_of_any_values(spark):
    """Signs, zeros, extremes, values that nearly agree, one group with most rows; pixels meet the bins in one join."""
    rng = np.random.default_rng(1)
    kinds = {
        1: rng.normal(0, 5, 401), 2: 101_325 + rng.normal(0, 1e-3, 300), 3: np.array([0.0, -0.0, 5e-324, -5e-324]), 4: rng.integers(-2, 3, 5000).astype(float),
        5: np.array([1e308, -1e308, 1e-308, 7.0]), 6: np.repeat(3.25, 50), 7: -np.exp(rng.uniform(-300, 300, 99)), 8: np.array([1.0, np.inf, 2.0]),
    }
    rows = [(z, "2020-01-01", float(v), None if i % 3 else float(-v)) for z, vs in kinds.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "zone_id int, image_date string, a double, b double").repartition(7)
    got = {r.zone_id: r for r in X.zone_image_statistics(df, ["a", "b"], "MEDIAN").collect()}
    for z, vs in kinds.items():
        for band, values in (("a", vs), ("b", -vs[::3])):
            low, high = np.sort(values)[[(len(values) - 1) // 2, len(values) // 2]]
            assert got[z][f"{band}_MEDIAN"] == low + (high - low) * 0.5, (z, band)


def _square(x0, y0, side):
    corners = [(x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side)]
    return [[{"x": float(a), "y": float(b)} for a, b in corners]]


def test_many_zones_with_one_crowded_spot(spark):
    """5,625 zones; 20,000 equal points, in a table with a map column, are spread over parts."""
    zones = spark.createDataFrame(
        [(i, _square(i % 75, i // 75, 1)) for i in range(5625)], "zone_id int, rings array<array<struct<x:double,y:double>>>"
    )
    grid = spark.range(5625).select((F.col("id") % 75 + 0.5).alias("x"), (F.floor(F.col("id") / 75) + 0.5).alias("y"))
    spot = spark.range(20_000).select(F.lit(10.25).alias("x"), F.lit(20.25).alias("y"))
    points = grid.unionByName(spot).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    placed = S.spatial_join_points(points, zones, part_points=500)
    counts = {r["zone_id"]: r["count"] for r in placed.groupBy("zone_id").count().collect()}
    assert counts.pop(20 * 75 + 10) == 20_001 and len(counts) == 5624 and set(counts.values()) == {1}
    placed = S._located(points, Q.build(zones, cell=1.0), "x", "y")
    parts = S._salted_points(placed, S._crowds(placed, 500)).where("_px = 10 and _py = 20").groupBy("_salt").count().collect()
    assert len(parts) == 41 and max(p["count"] for p in parts) < 1000
    assert S.clip_to_zones(points, zones, part_points=500).count() == 25_625


def test_polygon_with_very_many_vertices(spark):
    angles = np.linspace(0, 2 * np.pi, 100_001)[:-1]
    ring = [{"x": float(np.cos(a)), "y": float(np.sin(a))} for a in angles]
    zones = spark.createDataFrame([(1, [ring])], "zone_id int, rings array<array<struct<x:double,y:double>>>")
    rng = np.random.default_rng(0)
    spots = rng.uniform(-1.2, 1.2, (300, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "i int, x double, y double")
    tree = Q.build(zones)
    most = tree.leaves.agg(F.max(F.size("_edges")), F.count_if("_inside"), F.count("*")).first()
    assert most[0] <= 64 and most[1] > 2000 and most[2] < 100_000
    inside = {r.i for r in S.spatial_join_points(points, zones).collect()}
    assert inside == {i for i, (x, y) in enumerate(spots) if np.hypot(x, y) < 1}


def test_plan_of_clip_joins_pixels_once(spark):
    """Zones in four size classes: one join of the pixels with the leaves, of any level."""
    rng = np.random.default_rng(4)
    zones = []
    for i in range(5000):
        side = [0.01, 0.4, 9.0, 300.0][i % 4 if i % 400 else 3] if i % 4 < 3 or i % 400 == 3 else 0.4
        x, y = rng.uniform(0, 1000, 2)
        zones.append((i, _square(x, y, side)))
    table = spark.createDataFrame(zones, "zone_id int, rings array<array<struct<x:double,y:double>>>")
    spots = rng.uniform(0, 1300, (2000, 2))
    pixels = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "i int, x double, y double")
    clipped = S.clip_to_zones(pixels, table)
    plan = clipped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "LeftSemi" not in plan and "LeftAnti" in plan
    corners = np.array([[r[0][0]["x"], r[0][0]["y"], r[0][2]["x"], r[0][2]["y"]] for _, r in zones])
    want = [i for i, (x, y) in enumerate(spots) if ((corners[:, 0] <= x) & (corners[:, 1] <= y) & (x <= corners[:, 2]) & (y <= corners[:, 3])).any()]
    assert sorted(r.i for r in clipped.collect()) == want and 0 < len(want) < 2000


def test_many_zones_with_one_outline(spark):
    """The same vertices over and over do not cut cells."""
    rng = np.random.default_rng(6)
    ring = star(rng, 0, 0, 50, 200)
    zones = layer(spark, [(i, [ring]) for i in range(100)])
    tree = Q.build(zones)
    assert tree.cut is None and tree.leaves.count() <= 100 * 66 * 66
    points = [(x / 2, y / 2) for x in range(-9, 10) for y in range(-9, 10)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    inside = sum(touches([ring], x, y) for x, y in points)
    assert S.spatial_join_points(df, zones).count() == 100 * inside


def test_large_overlapping_zones_are_not_cut_small(spark, monkeypatch):
    """400 overlapping boxes with different corners: few rows for each, tested in compiled code, equal to brute force."""
    rng = np.random.default_rng(8)
    zones = [(i, [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]) for i, (x, y, w) in enumerate(rng.integers(1, 100, (400, 3)) / 4)]
    zones += [(500 + i, [[(x, y), (x + w, y + 1), (x, y + w)]]) for i, (x, y, w) in enumerate(rng.integers(1, 100, (40, 3)) / 4)]
    zones += [(600 + i, [star(rng, *rng.uniform(0, 40, 2), 6, 30)]) for i in range(5)]
    built = []
    monkeypatch.setattr(Q, "build", lambda *a, real=Q.build: built.append(real(*a, leaf_vertices=4)) or built[-1])
    spots = np.concatenate([rng.integers(0, 200, (600, 2)) / 4, rng.uniform(0, 50, (600, 2))])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "i int, x double, y double")
    placed = S.spatial_join_points(points, layer(spark, zones), 8.0)
    want = sorted((i, z) for i, (x, y) in enumerate(spots) for z, rings in zones if touches(rings, x, y))
    assert sorted((r.i, r.zone_id) for r in placed.collect()) == want
    assert built[0].cut is not None and built[0].leaves.where("zone_id < 400").count() < 400 * 20


def test_first_image_reads_one_folder(spark, tmp_path):
    rows = [("A", f"2020-0{m}-01", float(i), 0.0, 1.0) for m in range(1, 7) for i in range(3)]
    df = spark.createDataFrame(rows, "dataset string, image_date string, x double, y double, v double")
    folder = f"{tmp_path}/pixels"
    P.write_pixels(df.withColumn("image_date", F.col("image_date").cast("date")), folder)
    first = P.first_image(spark.read.parquet(folder))
    assert first.count() == 3
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_date" in plan and "subquery" not in plan
    scan = first._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.selectedPartitions().partitionCount() == 1
