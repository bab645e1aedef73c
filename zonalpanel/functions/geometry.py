"""Polygon expressions over rings: ARRAY<ARRAY<STRUCT<x, y>>>.

Outer rings run counter-clockwise and holes clockwise (the reader sees to it), so
signed areas add up over rings and parts. Arguments are column names or SQL
expressions, which keeps the nested lambdas readable and cheap to build.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges_sql(ring: str) -> str:
    """Edges of one ring, closing it if the last vertex is not the first."""
    nxt = f"get({ring}, (i + 1) % size({ring}))"
    return (
        f"transform({ring}, (v, i) -> named_struct('x1', v.x, 'y1', v.y, "
        f"'x2', {nxt}.x, 'y2', {nxt}.y))"
    )


def polygon_edges_sql(rings: str) -> str:
    """Edges of all rings in one array."""
    return f"flatten(transform({rings}, r -> {ring_edges_sql('r')}))"


def on_edge_sql(edges: str, px: str, py: str) -> str:
    """Whether the point lies on some edge."""
    side = f"((e.x2 - e.x1) * ({py} - e.y1) - ({px} - e.x1) * (e.y2 - e.y1))"
    return (
        f"exists({edges}, e -> {side} = 0 and {px} between least(e.x1, e.x2) and greatest(e.x1, e.x2) "
        f"and {py} between least(e.y1, e.y2) and greatest(e.y1, e.y2))"
    )


def signed_area2_sql(ring: str) -> str:
    """Twice the signed area of a ring; positive when it runs counter-clockwise."""
    return (
        f"aggregate({ring_edges_sql(ring)}, 0D, (acc, e) -> acc + (e.x1 * e.y2 - e.x2 * e.y1))"
    )


def oriented_sql(ring: str, hole: str) -> str:
    """The ring turned so that outer rings are counter-clockwise and holes clockwise."""
    return f"if(({signed_area2_sql(ring)} < 0) = ({hole}), {ring}, reverse({ring}))"


def centroid(rings: str) -> tuple[Column, Column]:
    """Area-weighted centroid over all rings, as an (x, y) pair of columns.

    Sums are taken relative to the first vertex, which keeps metre coordinates exact.
    """
    ox, oy = f"{rings}[0][0].x", f"{rings}[0][0].y"
    moved = (
        f"transform({polygon_edges_sql(rings)}, e -> named_struct("
        f"'x1', e.x1 - {ox}, 'y1', e.y1 - {oy}, 'x2', e.x2 - {ox}, 'y2', e.y2 - {oy}))"
    )
    cross = "(e.x1 * e.y2 - e.x2 * e.y1)"
    sums = (
        f"aggregate({moved}, named_struct('a', 0D, 'sx', 0D, 'sy', 0D), (acc, e) -> named_struct("
        f"'a', acc.a + {cross}, 'sx', acc.sx + (e.x1 + e.x2) * {cross}, "
        f"'sy', acc.sy + (e.y1 + e.y2) * {cross}))"
    )
    return (
        F.expr(f"{ox} + try_divide({sums}.sx, {sums}.a * 3)"),
        F.expr(f"{oy} + try_divide({sums}.sy, {sums}.a * 3)"),
    )
