"""Exact Ward against a nearest-neighbour chain over the whole distance matrix (Lance–Williams updates)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import cluster as C
from strata.operators import ward as W


def chain(X, weights=None):
    """(a, b, cost) of all merges by a plain chain; the first index of a cluster names it."""
    n = len(X)
    w = np.ones(n) if weights is None else weights.astype(float).copy()
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1) if X.shape[1] * n * n < 5e7 else sum((X[:, k][:, None] - X[:, k][None, :]) ** 2 for k in range(X.shape[1]))
    D *= w[:, None] * w[None, :] / (w[:, None] + w[None, :])
    np.fill_diagonal(D, np.inf)
    out, stack, alive = [], [], np.ones(n, bool)
    for _ in range(n - 1):
        if not stack:
            stack = [int(np.flatnonzero(alive)[0])]
        while True:
            x = stack[-1]
            y = int(D[x].argmin())
            if len(stack) > 1 and D[x, stack[-2]] <= D[x, y]:
                y = stack[-2]
                break
            stack.append(y)
        stack = stack[:-2]
        a, b = min(x, y), max(x, y)
        cost = D[a, b]
        out.append((a, b, cost))
        total = w[a] + w[b] + w
        row = ((w[a] + w) * D[a] + (w[b] + w) * D[b] - w * cost) / total
        alive[b] = False
        row[~alive] = np.inf
        row[a] = np.inf
        D[a], D[:, a] = row, row
        D[b], D[:, b] = np.inf, np.inf
        w[a] += w[b]
    return out


def cut(n, merges, k):
    root = np.arange(n)
    for a, b, _ in sorted(merges, key=lambda m: m[2])[:n - k]:
        ra, rb = root[a], root[b]
        root[root == max(ra, rb)] = min(ra, rb)
    return root


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def frame(spark, X):
    return spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)], "i long, features array<double>")


@pytest.mark.parametrize("n,block", [(1500, 300), (5000, 4096)])
def test_equal_to_the_chain(spark, n, block):
    rng = np.random.default_rng(n)
    X = np.vstack([rng.normal(m, 1.0, (n // 5, 3)) for m in (0, 2, 3, 6, 9)])
    df = frame(spark, X)
    points = W.numbered_points(df, "features")
    merges = W.ward_merges(points, block)
    want = chain(X)
    got = merges.select("cost", "size", "round").toPandas()
    assert len(got) == n - 1
    assert np.allclose(np.sort(got["cost"]), np.sort([m[2] for m in want]), rtol=1e-9)
    assert got["round"].max() > 3 and block < n
    for k in (2, 11):
        label = {r["i"]: r["cluster"] for r in C.hierarchical(df, k).collect()}
        mine = [label[i] for i in range(n)]
        assert same_partition(mine, cut(n, want, k).tolist())
        sizes = np.bincount(mine)
        assert (np.diff(sizes) <= 0).all()


def test_rounds_in_blocks_and_in_memory_agree(spark):
    """Repeated rows, equal costs and a block of three: the same costs, and a cut that only ties may move."""
    X = np.array([[0.0], [0.1], [0.3], [5.0], [5.2], [9.0], [5.2], [0.1], [0.1]])
    df = frame(spark, X)
    points = W.numbered_points(df, "features")
    assert {(tuple(r["c"]), r["w"]) for r in points.collect()} == {((0.0,), 1.0), ((0.1,), 3.0), ((0.3,), 1.0), ((5.0,), 1.0), ((5.2,), 2.0), ((9.0,), 1.0)}
    costs = [sorted(round(r["cost"], 9) for r in W.ward_merges(points, b).collect()) for b in (4096, 3)]
    assert costs[0] == costs[1] == sorted(round(m[2], 9) for m in chain(X) if m[2] > 0)
    label = {r["i"]: r["cluster"] for r in C.hierarchical(df, 3).collect()}
    assert [label[i] for i in range(9)] == [0, 0, 0, 1, 1, 2, 1, 0, 0]
    grid = frame(spark, np.array([[float(x), float(y)] for x in range(6) for y in range(6)]))  # every cost ties
    merges = W.ward_merges(W.numbered_points(grid, "features"), 5).toPandas()
    assert len(merges) == 35 and merges["b"].is_unique and (merges["a"] < merges["b"]).all()


def test_small_tables(spark):
    one = frame(spark, np.array([[1.0, 2.0]] * 3))
    assert [r["cluster"] for r in C.hierarchical(one, 2).collect()] == [0, 0, 0]
    two = frame(spark, np.array([[1.0], [2.0]]))
    assert sorted(r["cluster"] for r in C.hierarchical(two, 4).collect()) == [0, 1]
    assert C.hierarchical(one.limit(0), 2).collect() == []
    vectors = one.select("i", F.col("features").cast("array<float>").alias("features"))
    assert C.hierarchical(vectors, 1).count() == 3


@pytest.mark.parametrize("width", [1, 2, 3])
def test_tiles_merge_what_the_chain_merges(spark, width, monkeypatch):
    """Dense groups, weights and lines of points: the tree of the chain, most of it found inside tiles."""
    rng = np.random.default_rng(width)
    X = np.unique(np.vstack([rng.normal(m, 0.5, (500, width)) for m in (0, 1, 4)] + [np.round(rng.uniform(-3, 8, (500, width)), 3)]), axis=0)
    X[::2, -1] = np.round(X[::2, -1])
    X = np.repeat(X, rng.integers(1, 4, len(X)), axis=0)
    distinct, weights = np.unique(X, axis=0, return_counts=True)
    monkeypatch.setattr(W, "TILE_ROWS", 150)
    rounds, looked = [], W._neighbours
    monkeypatch.setattr(W, "_neighbours", lambda clusters, blocks: rounds.append(clusters.count()) or looked(clusters, blocks))
    merges = W.ward_merges(W.numbered_points(frame(spark, X), "features"), 300).toPandas()
    want = chain(distinct, weights)
    assert len(merges) == len(distinct) - 1 and merges["b"].is_unique
    assert np.allclose(np.sort(merges["cost"]), np.sort([m[2] for m in want]), rtol=1e-7, atol=1e-12)
    if width < 3:  # in more dimensions tiles as small as these are all border
        assert not rounds or rounds[0] < len(distinct) / 2  # all pairs only among what the tiles left


def test_points_that_lack_a_coordinate_end(spark, monkeypatch):
    ids, c = np.arange(4), np.array([[0.0, 1.0], [np.nan, 1.0], [5.0, 1.0], [np.nan, 2.0]])
    merges, left = W.contract(ids, np.ones(4), c, np.zeros(4))
    assert len(merges) == 3 and len(left[0]) == 1
    rows = [(i, [float(i), None if i % 50 == 7 else 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, features array<double>")
    monkeypatch.setattr(W, "TILE_ROWS", 40)
    points = W.numbered_points(df, "features")
    found = W._in_tiles(points.withColumn("height", F.lit(0.0)), 200, 40, 0, 0).toPandas()
    assert found["b"].notna().sum() + found["b"].isna().sum() == 200 and found["b"].notna().sum() > 20
    assert sum(1 for c in found.loc[found["b"].isna(), "c"] if np.isnan(c).any()) == 4
