"""Connected components of link tables, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalpanel.session import discard

from .common import settled


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix, the smallest row of their component (all have links)."""
    rows = np.arange(linked.shape[0])
    while True:
        columns = np.where(linked, rows[:, None], linked.shape[0]).min(axis=0)
        lower = np.where(linked, columns[None, :], linked.shape[0]).min(axis=1)
        if (lower == rows).all():
            return rows, columns
        rows = lower


def _minima(edges: DataFrame) -> DataFrame:
    return settled(edges.groupBy("u").agg(F.min("v").alias("low")), "star-minima")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (u, v); a component is its smallest node.

    Large stars hang every larger neighbour of a node on the smallest node it knows, small
    stars every smaller one, until each node hangs on one root (Kiveris et al., 2014); the
    number of rounds grows with the logarithm of the graph. Each round is written, so that
    lineage stays short. Minima are aggregated before the shuffle and joined back to plain
    rows, so that Spark can split the neighbours of a very busy node. Nulls are left out.
    """
    ends = [F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")]
    edges = links.select(*ends).where("u is not null and v is not null and u != v")
    edges = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # every u hangs on one v, and no v hangs on anything: stars around the roots
        several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").select("u").limit(1)
        if not several.select("u").union(chained).take(1):
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        minima = _minima(both)
        low = minima.select("u", F.least("u", "low").alias("low"))
        large = settled(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large-stars")
        discard(edges, minima)
        minima = _minima(large)
        joined = large.join(minima, "u").select("u", "v", "low")
        small = joined.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = settled(small.unionByName(joined.select("u", F.col("low").alias("v"))).distinct(), "small-stars")
        discard(large, minima)
    raise RuntimeError(f"no stars after {rounds} rounds")
