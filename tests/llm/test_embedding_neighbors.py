import numpy as np
import pytest

from tableward.llm import embedding_neighbors as en
from tableward.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """(links, component) per vec_id."""
    sound = [(k, np.array(v, float), g) for k, v, g in rows if v and g is not None and k is not None
             and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {k: 0 for k, *_ in rows}, {k: k for k, *_ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, (a, x, g) in enumerate(sound):
        for b, y, h in sound[n + 1:]:
            if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: (links[k], find(k)) for k in links}


def clusters(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + rng.normal(size=dim) * rng.choice([0.02, 0.05, 0.15])).astype(np.float32).tolist())
    return [(i, v, int(i % 3 == 0)) for i, v in enumerate(rows)]


def test_query_recall(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    found = queries.QUERIES["op4_projection_forest"](spark, small).collect()
    assert len(found) == len(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in found)
    assert sum(r.n_links for r in found) >= 0.9 * sum(n for n, _ in want.values())


@pytest.mark.parametrize("leaf,block", [(400, 1000), (30, 1000), (30, 7)])
def test_links_and_groups(spark, monkeypatch, leaf, block):
    """Links equal brute force with one leaf, with many, and with leaves dealt into blocks."""
    monkeypatch.setattr(en, "LEAF_ROWS", leaf)
    monkeypatch.setattr(en, "BLOCK_ROWS", block)
    rows = clusters(7, 60)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]  # copies
    rows += [(2000 + i, [2 * x for x in rows[0][1]], rows[0][2]) for i in range(3)]  # same direction
    found = {r.vec_id: (r.n_links, r.component_id) for r in en.neighbors(
        spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label").collect()}
    want = brute(rows)
    assert all(found[k][0] <= n for k, (n, _) in want.items())
    assert sum(n for n, _ in found.values()) >= 0.98 * sum(n for n, _ in want.values())
    if leaf == 400:
        assert found == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, -0.0], 0), (3, [1.0, 0.01], None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0),
            (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1),
            (12, [3e38, 0.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as n_links", "'own' as kept", "1 as key", "2 as vector")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in en.neighbors(df, "vec_id", "embedding", "label").collect()}
    assert found.pop(None) == (0, None, True)
    assert {k: found.pop(k) for k in (1, 2, 12)} == {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False)}
    assert all(v == (0, k, True) for k, v in found.items())
    assert en.neighbors(df.limit(0), "vec_id", "embedding", "label").count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0)] * 3, SCHEMA)
    assert [tuple(r)[:4] for r in en.neighbors(twice, "vec_id", "embedding", "label").collect()] == [(1, 2, 1, True)] * 3


@pytest.mark.parametrize("depth", [7, 10])
def test_dense_group_stays_together(depth):
    """A third of the vectors in one group, nine in ten of its pairs linked, in deep trees."""
    rng = np.random.default_rng(11)
    group = en._unit(en._unit(rng.normal(size=(1, 64))) + rng.normal(size=(4000, 64)) * 0.016)
    x = np.concatenate([group, en._unit(rng.normal(size=(8000, 64)))])
    i, j = rng.integers(0, 4000, (2, 4000))
    linked = (np.einsum("ij,ij->i", x[i], x[j]) >= 0.98) & (i != j)
    assert 0.8 < linked.mean() < 0.97
    i, j, met = i[linked], j[linked], np.zeros(linked.sum(), bool)
    for t in range(en.TREES):
        row, leaf = en.Tree(x, depth, en.SEED + t, 0.98).leaves(x)
        held = np.zeros((len(x), 1 << depth), bool)
        held[row, leaf] = True
        met |= (held[i] & held[j]).any(axis=1)
    assert met.mean() >= 0.98
