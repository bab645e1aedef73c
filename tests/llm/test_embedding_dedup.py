import numpy as np
import pytest

from zonalpanel.llm import embedding_dedup


def brute(rows, threshold):
    vectors = []
    for _, v in rows:
        good = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        vectors.append(np.array(v, float) if good else None)
    n = len(rows)
    links = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is None or y is None or len(x) != len(y):
                continue
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    result = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        result.append((rows[a][0], len(links[a]), low, rows[a][0] == low))
    return sorted(result, key=str)


def clustered(n=300, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    return [(i, (centres[rng.integers(25)] + rng.normal(size=dim) * rng.choice([0.02, 0.12, 0.4])).tolist()) for i in range(n)]


@pytest.mark.parametrize("kind,block", [("float", 16), ("double", 7), ("double", 1024)])
def test_same_as_all_pairs(spark, kind, block):
    rows = clustered()
    if kind == "float":
        rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(400 + i, rows[0][1]) for i in range(20)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, hash string")
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(table, block=block, fanout=3).collect()), key=str)
    assert got == brute(rows, 0.95)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [5.0, 0.0]), (2, [5.0, 0.0]), (3, [1e-200, 0.0]), (4, [1e200, 1e199]), (None, [1.0, 0.0]),
        (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, None]),
        (11, [1.0]), (12, [2.0]), (13, [1.0, 0.0, 0.0]), (14, [-1.0, 0.0]), (15, [-0.0, -1.0]), (16, [0.0, -1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(table).collect()), key=str)
    assert got == brute(rows, 0.95)


def test_distant_blocks_are_skipped(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0] if i < 200 else [0.0, 0.001 * i, 5.0]) for i in range(400)]
    calls = embedding_dedup._block_pairs
    seen = []
    embedding_dedup._block_pairs = lambda *a: seen.append(calls(*a)) or seen[-1]
    try:
        embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=20).count()
    finally:
        embedding_dedup._block_pairs = calls
    blocks = seen[0].where("a = b").count()
    assert seen[0].count() < 0.7 * blocks * (blocks + 1) / 2


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
