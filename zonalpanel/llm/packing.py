"""Best-fit packing of tokenized documents after Martello and Toth's dominance reduction.

The plan is made for lengths, not documents: how many pieces there are of each length is at
most ``capacity`` numbers, whatever the size of the table. The reduction fixes bins that
dominate every other bin with their largest piece, the rest is packed by best fit in
decreasing order, and both work on whole runs of equal bins, so that the plan is a list of
runs. Each piece then finds its place by its rank among the pieces of its length: its number
within its task plus the number of such pieces in earlier tasks. No piece meets another in
a shuffle, and a length that a third of all pieces share is spread like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import settled
from .words import slices

CAPACITY = 2048
END_ID = 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``capacity`` ids; ``number`` counts this task's pieces of one length."""
    merges = encoder(path)
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    end = np.uint32(end_id).tobytes()
    step = 4 * capacity
    for batch in batches:
        ids = merges.encode_texts(batch.column("text"))
        for rows in slices(batch):
            doc, piece, length, crc = [], [], [], []
            for i in range(rows.num_rows):
                data = next(ids) + end
                for k, low in enumerate(range(0, len(data), step)):
                    part = data[low : low + step]
                    doc.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            lengths, pieces = np.array(length, np.int64), np.array(piece, np.int64)
            order = np.argsort(lengths, kind="stable")
            ranked = lengths[order]
            heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            sizes = np.diff(np.append(heads, len(ranked)))
            number = np.empty(len(ranked), np.int64)
            number[order] = np.arange(len(ranked)) - np.repeat(heads, sizes) + seen[ranked]
            seen[ranked[heads]] += sizes
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(doc, pa.int64())),
                    pa.array(pieces.astype(np.int32)),
                    pa.array(pieces * capacity),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), task, np.int32)),
                    pa.array(number),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix dominating bins, largest piece first; ``counts`` (pieces of each length) loses what is fixed.

    Returns runs (contents, how many bins), contents being (length, pieces of it in a bin).
    For a piece ``a`` and the room beside it, a bin dominates all others that hold ``a`` if
    nothing fits beside ``a``, or if the largest single piece ``b`` that fits weighs as much
    as any set of pieces that fits: the set can then change places with ``b`` in any packing.
    Where no three pieces fit, ``a``, ``b`` and the largest ``c`` beside them dominate if any two
    that fit can change places with ``b`` and ``c``, one for one or both for ``b``.
    Fixing bins only takes sets away, so one test covers as many bins as the pieces last.
    """
    fixed: list[tuple[list[tuple[int, int]], int]] = []
    for a in range(capacity, 0, -1):
        while counts[a]:
            room = capacity - a
            beside = np.flatnonzero(counts[1 : room + 1]) + 1
            if a in beside and counts[a] == 1:
                beside = beside[beside != a]
            if not len(beside):
                fixed.append(([(a, 1)], int(counts[a])))
                counts[a] = 0
                break
            b = int(beside[-1])
            chosen = [a, b]
            if b < room and _heaviest(counts, a, room) > b:
                c = _third(counts, a, b, room)
                if c is None:
                    break
                chosen.append(c)
            per = {length: chosen.count(length) for length in chosen}
            bins = min(int(counts[length]) // n for length, n in per.items())
            fixed.append((list(per.items()), bins))
            for length, n in per.items():
                counts[length] -= bins * n
    return fixed


def _third(counts: np.ndarray, a: int, b: int, room: int) -> int | None:
    """The length that with ``a`` and ``b`` (the largest that fits) dominates all bins with ``a``, if there is one."""
    left = counts[: room + 1].copy()
    if a <= room:
        left[a] -= 1
    lengths = np.flatnonzero(left > 0)
    smallest = np.repeat(lengths[:3], np.minimum(left[lengths[:3]], 3))[:3]
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    beside = lengths[(lengths <= room - b) & ((lengths != b) | (left[b] > 1))] if b <= room else lengths[:0]
    if not len(beside):
        return None
    c = int(beside[-1])
    for q in lengths[(lengths > c) & (2 * lengths <= room)].tolist():  # the smaller one of two that fit
        others = lengths[(lengths >= q) & (lengths <= room - q) & ((lengths != q) | (left[q] > 1))]
        if len(others) and q + int(others[-1]) > b:
            return None
    return c


def _heaviest(counts: np.ndarray, a: int, room: int) -> int:
    """The largest total of any set of pieces, besides one of length ``a``, that fits into ``room``."""
    reach, full = 1, (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1]).tolist():
        most = min(int(counts[length]) - (length == a), room // length)
        step = 1
        while most > 0:
            take = min(step, most)
            reach |= (reach << (length * take)) & full
            most -= take
            step *= 2
        if reach >> room & 1:
            return room
    return reach.bit_length() - 1


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit in decreasing order, a run of equal bins at a time; returns runs as above."""
    open_runs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for a in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[a])
        room = a
        while left:
            room = next((r for r in range(room, capacity + 1) if open_runs.get(r)), capacity)
            fits = room // a
            runs = open_runs.get(room)
            contents, bins = runs.pop() if runs else ([], -(-left // fits))
            whole = min(bins, left // fits)
            if whole:
                open_runs.setdefault(room - fits * a, []).append(([*contents, (a, fits)], whole))
                left -= whole * fits
            rest = bins - whole
            if rest and left and left < fits:
                open_runs.setdefault(room - left * a, []).append(([*contents, (a, left)], 1))
                left, rest = 0, rest - 1
            if rest and contents:
                open_runs.setdefault(room, []).append((contents, rest))
    return [run for runs in open_runs.values() for run in runs]


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: sorted runs of ranks within a length.

    A run covers ranks from ``rank`` on; its pieces fill bins from ``bin`` on, ``per`` in
    each, the first at ``offset``.
    """
    counts = counts.copy()
    runs = reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for contents, bins in runs:
        offset = 0
        for length, per in contents:
            rows.append((length, used[length], first, per, offset))
            used[length] += per * bins
            offset += per * length
        first += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "bin", "per", "offset"))} | {"bins": np.array(first)}


def _place(batches: Iterator[pa.RecordBatch], runs: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    top = np.int64(1) << np.int64(50)
    keys = runs["length"] * top + runs["rank"]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("number").to_numpy() + batch.column("before").to_numpy()
        run = np.searchsorted(keys, length * top + rank, side="right") - 1
        nth = rank - runs["rank"][run]
        per = runs["per"][run]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in names],
                pa.array(runs["bin"][run] + nth // per),
                pa.array(runs["offset"][run] + nth % per * length),
            ],
            names=[*names, "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` ids as best fit finds.

    Needs ``doc_id`` and ``text``; other columns are ignored. A document's ids are those of
    its text (null or empty: none) and ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` ids and a shorter last one. Returns one row per piece: (doc_id, piece, start,
    length, ids_crc32, sequence_id, offset). Rows that repeat a doc_id are packed like any
    other; an empty table gives no rows.

    What the driver holds is the count of pieces of each length (``capacity`` numbers) and the
    plan made from them (its length depends on ``capacity`` alone, not on the documents).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = partial(_pieces, path=path, capacity=capacity, end_id=end_id)
    pieces = settled(rows.mapInArrow(cut, _PIECES), "pieces")

    by_task = settled(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    runs = plan(counts, capacity)

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"])
    return ranked.mapInArrow(
        partial(_place, runs=runs),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
