"""Near-equal vectors by an epsilon grid order join.

Unit vectors with a cosine of t or more are at most eps = sqrt(2 - 2 t) apart, and so are
their projections. Vectors are sorted by the cells (eps wide) of their projections on the
leading principal directions, the sorted sequence is cut into blocks, and intervals of blocks
are joined recursively: starting with the whole sequence against itself, a pair of intervals
whose bounding boxes are further apart than eps is dropped, any other is replaced by the pairs
of their parts. Spark does so down to blocks of ``BLOCK`` vectors, and a task that has two
blocks goes on down to leaves of ``LEAF``. There a pair of vectors is left out if the product of
their projections and of the lengths of what is left of them together stay under t, which
bounds their cosine; only rows and columns of a leaf pair with some pair left are multiplied
in full, in double precision.

Equal vectors are one row with a count before they are compared. A block pair gives counts and
a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled
from .components import components, stars

THRESHOLD = 0.95
DIRECTIONS = 6
#: Directions by which pairs of vectors are bounded.
BOUND_DIRECTIONS = 16
#: Vectors of a block, and the bytes of a vector for which that many are sent.
BLOCK, BLOCK_BYTES = 8192, 2 << 20
LEAF = 512
FANOUT = 8
SLACK = 1e-9

_BLOCKS = (
    "part int, number int, dim int, low array<double>, high array<double>, "
    "ids binary, copies binary, vectors binary"
)
_LINKS = "class_id long, n_links long, root long"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows; all have ``dim`` numbers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; large and tiny numbers neither overflow nor vanish."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sum of x x^T over unit vectors x of each dimension, flattened."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, rows in _by_dim(batch):
            unit = _unit(_matrix(rows))
            copies = rows.column("copies").to_numpy()
            sums[dim] = sums.get(dim, 0) + (unit * copies[:, None]).T @ unit
    for dim, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim * dim, dim, np.int32)), pa.array(np.arange(dim * dim)), pa.array(total.ravel())],
            names=["dim", "cell", "value"],
        )


def _directions(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """The leading principal directions for each dimension of vectors (dim x count).

    The driver gets dim * dim sums for each dimension that occurs, however many vectors there are.
    """
    sums = classes.mapInArrow(_moments, "dim int, cell long, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row["dim"], np.zeros(row["dim"] ** 2))[row["cell"]] = row["value"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1][:, :count] for d, m in found.items()}


def _projected(batches: Iterator[pa.RecordBatch], directions: dict[int, np.ndarray], count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows in _by_dim(batch):
            places = np.zeros((rows.num_rows, count))
            axes = directions[dim]
            places[:, : axes.shape[1]] = _unit(_matrix(rows)) @ axes
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(list(places), pa.list_(pa.float64()))], names=[*rows.schema.names, "place"]
            )


def _block_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to ``size`` vectors that follow one another in the task's sorted rows."""
    part = TaskContext.get().partitionId()
    number = 0
    held: list[pa.RecordBatch] = []

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal number, held
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = []
        places = rows.column("place").flatten().to_numpy().reshape(rows.num_rows, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int32()),
                rows.column("dim").slice(0, 1),
                pa.array([places.min(axis=0)], pa.list_(pa.float64())),
                pa.array([places.max(axis=0)], pa.list_(pa.float64())),
                pa.array([rows.column("class_id").to_numpy().tobytes()], pa.binary()),
                pa.array([rows.column("copies").to_numpy().tobytes()], pa.binary()),
                pa.array([_matrix(rows).tobytes()], pa.binary()),
            ],
            names=["part", "number", "dim", "low", "high", "ids", "copies", "vectors"],
        )
        number += 1

    for batch in batches:
        for dim, rows in _by_dim(batch):
            if held and held[0].column("dim")[0].as_py() != dim:
                yield from block()
            most = max(1, min(size, BLOCK_BYTES // (8 * dim)))
            while rows.num_rows:
                room = most - sum(h.num_rows for h in held)
                held.append(rows.slice(0, room))
                rows = rows.slice(room)
                if sum(h.num_rows for h in held) == most:
                    yield from block()
    if held:
        yield from block()


def _near(a: str, b: str, eps: float) -> F.Column:
    """Boxes of the same dimension that are at most ``eps`` apart."""
    gap = F.zip_with(
        F.zip_with(f"{a}.low", f"{b}.high", lambda x, y: x - y),
        F.zip_with(f"{b}.low", f"{a}.high", lambda x, y: x - y),
        lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), F.lit(2)),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x)
    dims = (F.col(f"{a}.dim_low") <= F.col(f"{b}.dim_high")) & (F.col(f"{b}.dim_low") <= F.col(f"{a}.dim_high"))
    return dims & (apart <= eps * eps + SLACK)


def _block_pairs(boxes: DataFrame, eps: float, fanout: int, count: int) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks that may hold a link, by recursion over intervals.

    ``boxes`` has seq, dim_low, dim_high, low and high of each block.
    """
    levels = [boxes]
    while (top := levels[-1].agg(F.max("seq").alias("n")).first()["n"] or 0) > 0:
        assert len(levels) < 64, top
        merged = levels[-1].groupBy((F.col("seq") / fanout).cast("long").alias("seq")).agg(
            F.min("dim_low").alias("dim_low"),
            F.max("dim_high").alias("dim_high"),
            *[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(count)],
            *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(count)],
        )
        levels.append(
            settled(
                merged.select(
                    "seq",
                    "dim_low",
                    "dim_high",
                    F.array(*[f"l{i}" for i in range(count)]).alias("low"),
                    F.array(*[f"h{i}" for i in range(count)]).alias("high"),
                ),
                "intervals",
            )
        )
    pairs = levels[-1].select(F.col("seq").alias("a"), F.col("seq").alias("b"))
    for level in reversed(levels[:-1]):
        parent = (F.col("seq") / fanout).cast("long")
        left = level.select(parent.alias("a"), F.struct("*").alias("x"))
        right = level.select(parent.alias("b"), F.struct("*").alias("y"))
        pairs = settled(
            pairs.join(left, "a")
            .join(right, "b")
            .where((F.col("x.seq") <= F.col("y.seq")) & _near("x", "y", eps))
            .select(F.col("x.seq").alias("a"), F.col("y.seq").alias("b")),
            "interval-pairs",
        )
    return pairs


class _Side:
    """The vectors of a block: as they are, of length 1, on the leading directions, and how long the rest of each is."""

    def __init__(self, row: dict, dtype: str, axes: np.ndarray):
        self.raw = np.frombuffer(row["vectors"], dtype).reshape(-1, row["dim"]).astype(np.float64)
        self.unit = _unit(self.raw)
        self.place = self.unit @ axes
        self.rest = np.sqrt(np.maximum(1 - (self.place * self.place).sum(axis=1), 0))
        self.corner = np.column_stack([self.place, self.rest])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.copies = np.frombuffer(row["copies"], np.int64)

    def __len__(self) -> int:
        return len(self.ids)


def _leaves(x: _Side, y: _Side, same: bool, eps: float) -> Iterator[tuple[slice, slice]]:
    """Pairs of intervals of up to ``LEAF`` vectors whose boxes are near enough, each once.

    The lengths of the rests are one more coordinate: two vectors are at least as far apart
    as their projections and these lengths together.
    """
    open_pairs = [((0, len(x)), (0, len(y)))]
    while open_pairs:
        a, b = open_pairs.pop()
        p, q = x.corner[a[0] : a[1]], y.corner[b[0] : b[1]]
        gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
        if gap @ gap > eps * eps + SLACK:
            continue
        if max(len(p), len(q)) <= LEAF:
            yield slice(*a), slice(*b)
            continue
        (a1, a2), (b1, b2) = (((r[0], sum(r) // 2), (sum(r) // 2, r[1])) for r in (a, b))
        if same and a == b:
            open_pairs += [(a1, a1), (a1, a2), (a2, a2)]
        elif len(p) >= len(q):
            open_pairs += [(a1, b), (a2, b)]
        else:
            open_pairs += [(a, b1), (a, b2)]


def _linked_pairs(x: _Side, y: _Side, i: slice, j: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors of two leaves have links, and the link matrix of these."""
    most = x.place[i] @ y.place[j].T + np.outer(x.rest[i], y.rest[j])
    able = most >= threshold - SLACK
    rows, columns = (n.start + np.flatnonzero(able.any(axis=k)) for k, n in ((1, i), (0, j)))
    cosine = x.unit[rows] @ y.unit[columns].T
    linked = cosine >= threshold
    for k, m in np.argwhere(np.abs(cosine - threshold) < 1e-12).tolist():  # as the plain formula rounds
        p, q = x.raw[rows[k]], y.raw[columns[m]]
        linked[k, m] = p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= threshold
    return rows, columns, linked


def _compare(
    batches: Iterator[pa.RecordBatch], threshold: float, dtype: str, eps: float, axes: dict[int, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """Weighted link counts and star edges of the leaves of each pair of blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["x"]["dim"] != row["y"]["dim"]:
                continue
            same = row["a"] == row["b"]
            x = _Side(row["x"], dtype, axes[row["x"]["dim"]])
            y = x if same else _Side(row["y"], dtype, axes[row["y"]["dim"]])
            for i, j in _leaves(x, y, same, eps):
                rows, columns, linked = _linked_pairs(x, y, i, j, threshold)
                itself = same and i == j
                if itself:
                    linked &= rows[:, None] != columns[None, :]
                if not linked.any():
                    continue
                some, others = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                part, rows, columns = linked[np.ix_(some, others)], rows[some], columns[others]
                upper, lower = stars(part)
                roots = x.ids[rows]
                found = [(roots, part @ y.copies[columns], roots[upper])]
                if not itself:
                    found.append((y.ids[columns], x.copies[rows] @ part, roots[lower]))
                else:  # rows and columns are the same vectors: their stars must be tied together
                    found.append((y.ids[columns], np.zeros(len(columns), np.int64), roots[lower]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["class_id", "n_links", "root"]
                )


def _valid(vector: F.Column, kind: T.DataType) -> F.Column:
    """Vectors that can link: no nulls, all finite, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def near_vectors(
    table: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    directions: int = DIRECTIONS,
    block: int = BLOCK,
    fanout: int = FANOUT,
) -> DataFrame:
    """Links and components of all vectors with a cosine of ``threshold`` or more.

    Needs an integer id and an array of floats or doubles; other columns are ignored. Returns
    one row per input row: (vec_id, n_links, component_id, kept). Vectors that are null, empty,
    zero, or hold nulls or non-finite numbers link with nothing, nor do vectors of different
    dimension. Rows are vectors of their own, also where they repeat an id or a whole row. A
    null id can't be a component's id unless all ids of the component are null. An empty table
    gives no rows.
    """
    kind = table.schema[vector_column].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    vector = F.col("vector") if isinstance(kind, T.FloatType) else F.col("vector").cast("array<double>")
    rows = (
        table.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").alias("vector"))
        .withColumn("vector", vector)
        .withColumn("valid", F.coalesce(_valid(F.col("vector"), kind), F.lit(False)))
        .withColumn("hash", F.xxhash64("vector"))
        .withColumn("check", F.xxhash64(F.lit("vector"), "vector"))
    )
    valid = rows.where("valid")
    grouped = valid.groupBy("hash", "check").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("low_id"), F.first("vector").alias("vector")
    )
    classes = settled(
        grouped.withColumn("class_id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vector-classes"
    )
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    bounding = _directions(classes.select("dim", "copies", "vector"), max(directions, BOUND_DIRECTIONS))
    axes = {dim: found[:, :directions] for dim, found in bounding.items()}

    thin = classes.select("class_id", "copies", "dim", "vector")
    schema = T.StructType([*thin.schema.fields, T.StructField("place", T.ArrayType(T.DoubleType()))])
    placed = thin.mapInArrow(partial(_projected, directions=axes, count=directions), schema)
    width = eps if eps > 0 else 1e-6
    cells = [F.floor(F.col("place")[i] / width) for i in range(directions)]
    keys = ["dim", *[f"cell{i}" for i in range(directions)], "first_place", "class_id"]
    placed = placed.withColumns({f"cell{i}": c for i, c in enumerate(cells)}).withColumn("first_place", F.col("place")[0])
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*thin.columns, "place")
    blocks = settled(ordered.mapInArrow(partial(_block_rows, size=block), _BLOCKS), "vector-blocks")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = blocks.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    blocks = blocks.join(settled(starts, "block-starts"), "part").withColumn("seq", F.col("start") + F.col("number"))
    boxes = settled(
        blocks.select("seq", F.col("dim").alias("dim_low"), F.col("dim").alias("dim_high"), "low", "high"), "block-boxes"
    )
    pairs = _block_pairs(boxes, eps, fanout, directions)
    whole = F.struct("dim", "ids", "copies", "vectors")
    compared = (
        pairs.join(blocks.select(F.col("seq").alias("b"), whole.alias("y")), "b")
        .join(blocks.select(F.col("seq").alias("a"), whole.alias("x")), "a")
        .mapInArrow(partial(_compare, threshold=threshold, dtype=dtype, eps=eps, axes=bounding), _LINKS)
    )
    links = settled(compared, "vector-links")

    counts = links.groupBy("class_id").agg(F.sum("n_links").alias("other_links"))
    roots = components(links.select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    roots = settled(roots.select(F.col("node").alias("class_id"), "component"), "class-components")
    lows = (
        roots.join(classes.select("class_id", "low_id"), "class_id")
        .groupBy("component")
        .agg(F.min("low_id").alias("component_low"))
    )
    merged = settled(
        classes.select("class_id", "hash", "check", "copies", "low_id")
        .join(counts, "class_id", "left")
        .join(roots.join(settled(lows, "component-lows"), "component"), "class_id", "left")
        .select(
            "hash",
            "check",
            (F.coalesce("other_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_low", "low_id").alias("component_id"),
            F.lit(True).alias("valid"),
        ),
        "class-results",
    )
    result = rows.select("vec_id", "hash", "check", "valid").join(merged, ["hash", "check", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
