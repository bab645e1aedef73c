"""Zone layers: polygons with attributes, read from vertex rows or GeoJSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import oriented_sql, signed_area2_sql

_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def zones_from_vertices(vertices: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Polygons from rows ``zone, part, ring, seq, x, y``; ring 0 of a part is its outline.

    Vertices are gathered ring by ring and then zone by zone: one row holds one polygon.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    rings = vertices.groupBy(zone, "part", "ring").agg(
        F.transform(ordered, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("_ring")
    )
    turned = rings.withColumn("_ring", F.expr(oriented_sql("_ring", "ring > 0")))
    collected = F.sort_array(F.collect_list(F.struct("part", "ring", "_ring")))
    return turned.groupBy(zone).agg(F.transform(collected, lambda r: r["_ring"]).alias("rings"))


def read_zones(
    spark: SparkSession, path: str, attributes: str, form: str = "geojson", zone: str = "zone_id"
) -> DataFrame:
    """A layer with its attributes and ``rings``.

    ``form`` 'geojson' reads one feature per line with the attributes (a DDL string,
    ``zone`` among them) as properties; 'vertices' reads a parquet table of vertex rows
    beside which the attributes stand on every row.
    """
    fields = T.StructType.fromDDL(attributes).fields
    if form == "vertices":
        rows = spark.read.parquet(path)
        extra = [f.name for f in fields if f.name != zone]
        rings = zones_from_vertices(rows, zone)
        if not extra:
            return rings
        # the attributes of one row, where the rows of a zone differ: the largest set of them
        facts = rows.groupBy(zone).agg(F.max(F.struct(*extra)).alias("_facts")).select(zone, "_facts.*")
        return facts.join(rings, zone)
    geometry = T.StructType().add("type", "string").add("coordinates", "string")
    schema = T.StructType().add("type", "string").add("properties", T.StructType(fields)).add("geometry", geometry)
    features = spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    text = F.col("f.geometry.coordinates")
    parts = F.when(
        F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, _MULTI)
    ).otherwise(F.array(F.from_json(text, _POLYGON)))
    # The first ring of a part is its outline, the others are holes.
    points = "transform(ring, v -> named_struct('x', v[0], 'y', v[1]))"
    rings = f"flatten(transform(_parts, p -> transform(p, (ring, i) -> {points})))"
    holes = "flatten(transform(_parts, p -> transform(p, (ring, i) -> i > 0)))"
    turned = f"transform(arrays_zip(_rings, _holes), z -> {oriented_sql('z._rings', 'z._holes')})"
    return (
        features.select("f.properties.*", parts.alias("_parts"))
        .withColumns({"_rings": F.expr(rings), "_holes": F.expr(holes)})
        .withColumn("rings", F.expr(turned))
        .drop("_parts", "_rings", "_holes")
    )


def write_zone_layer(
    zones: DataFrame, path: str, attributes: Sequence[str] | None = None
) -> None:
    """GeoJSON lines: one feature per zone, its rings written as polygons.

    A counter-clockwise ring opens a polygon and the clockwise rings after it are its holes.
    """
    names = list(attributes) if attributes is not None else [c for c in zones.columns if c != "rings"]
    closed = """transform(rings, r -> transform(if(r[0] = element_at(r, -1), r, concat(r, array(r[0]))),
        v -> array(v.x, v.y)))"""
    outer = f"transform(rings, r -> {signed_area2_sql('r')} >= 0)"
    # A new polygon for each outline; a hole joins the last polygon.
    grouped = f"""aggregate(arrays_zip(_closed, _outer), cast(array() as {_MULTI}), (acc, r) ->
        if(r._outer or size(acc) = 0, concat(acc, array(array(r._closed))),
           concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), array(r._closed))))))"""
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*names).alias("properties"),
            F.struct(F.lit("MultiPolygon").alias("type"), F.col("_multi").alias("coordinates")).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )
    (
        zones.withColumns({"_closed": F.expr(closed), "_outer": F.expr(outer)})
        .withColumn("_multi", F.expr(grouped))
        .select(feature.alias("value"))
        .write.text(path)
    )
