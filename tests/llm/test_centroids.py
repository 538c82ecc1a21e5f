import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import oracle  # noqa: E402

from tableward.llm import centroids, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5, dim=64):
    """(vec_id, cluster, distance) sorted, in Python integers."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        held = {}
        for _, x in kept:
            held.setdefault(nearest(x)[1], []).append(x)
        points = [[sum(col) // len(held[c]) for col in zip(*held[c], strict=True)] if c in held else p for c, p in enumerate(points)]
    return sorted(((i, nearest(x)[1], nearest(x)[0]) for i, x in kept), key=repr), points


def found(fit):
    return sorted(((r[0], r.cluster, r.distance) for r in fit.rows.collect()), key=repr)


def vectors(seed, n, dim, groups=12, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    at = np.minimum(rng.integers(0, groups * 3 // 2, n), groups - 1)  # a third in one group
    return [(int(i), (middle[g] + rng.normal(size=dim) * spread).astype(np.float32).tolist(), 0) for i, g in enumerate(at)]


@pytest.mark.parametrize("block", [4096, 37])
def test_clusters_are_those_of_lloyd(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    rows = vectors(3, 700, 8)
    rows += [rows[0]] * 5 + [(9000, [0.0] * 8, 0), (9001, [-0.0] * 8, 0)]
    fit = centroids.fit(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 12, 6, dim=8)
    want, points = brute(rows, 12, 6, 8)
    assert found(fit) == want and fit.centroids.tolist() == points
    assert fit.scanned[0] == len(rows) and fit.scanned[-1] < len(rows) / 2  # most bounds hold


def test_query(spark, small):
    df = queries.QUERIES["op12_expiring_bounds"](spark, small)
    same, note = oracle.compare(df, oracle.connect(small), queries.SQL["op12_expiring_bounds"])
    assert same, note


def test_ties_and_large_components(spark):
    rows = [(i, [float(i // 2), 300000.0], 0) for i in range(8)]
    fit = centroids.fit(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 6, 3, dim=2)
    assert found(fit) == brute(rows, 6, 3, 2)[0]
    with pytest.raises(Exception, match="could pass 64 bits"):
        centroids.fit(spark.createDataFrame([(1, [1e30, 0.0], 0)], SCHEMA), "vec_id", "embedding", 2, 1, dim=2)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [1.0], 0), (5, [1.0, 2.0, 3.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0),
            (8, [None, 1.0], 0), (None, [1.0, 2.0], 0), (None, [7.0, 2.0], None), (1, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as cluster", "'own' as distance", "1 as block", "2 as _x", "3 as _key")
    fit = centroids.fit(df, "vec_id", "embedding", 40, 5, dim=2)
    assert found(fit) == brute(rows, 40, 5, 2)[0]
    assert centroids.fit(df.limit(0), "vec_id", "embedding", 40, 5, dim=2).rows.count() == 0


def test_drift_is_that_of_the_farthest_other():
    now = centroids.Centroids(np.zeros((3, 1), np.int64), np.zeros(3))
    drift = now.moved(np.array([[3], [1], [0]])).drift
    assert drift == pytest.approx([4, 4, 3])
    assert now.moved(np.array([[3], [3], [0]])).drift == pytest.approx([6, 6, 3])
