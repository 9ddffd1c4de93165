import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators.query import correlation_long, correlation_matrix


def pairwise(x, y):
    there = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[there], y[there]
    return None if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0 else float(np.corrcoef(x, y)[0, 1])


def test_three_hundred_columns_in_one_job(spark):
    """Missing values of its own in every column, numbers far from zero, constants: as numpy per pair."""
    rng = np.random.default_rng(7)
    X = rng.normal(0, 1, (400, 300)) @ np.diag(np.geomspace(1e-3, 1e6, 300)) + 1e9 * (np.arange(300) % 3 == 0)
    X[:, 5] += X[:, 6] * 1e-2
    X[rng.random(X.shape) < 0.1] = np.nan
    X[:, 17], X[:, 18] = 4.2, np.nan
    names = [f"c.{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_long(df, names).collect()}
    assert len(got) == 300 * 300
    for i, j in [(0, 0), (0, 1), (5, 6), (6, 5), (17, 3), (17, 17), (18, 2), (3, 299), *rng.integers(0, 300, (300, 2)).tolist()]:
        want = pairwise(X[:, i], X[:, j])
        mine = got[names[i], names[j]]
        assert (mine is None) == (want is None) and (want is None or mine == pytest.approx(want, abs=1e-6))
        assert mine == got[names[j], names[i]]


def test_square_and_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2, None), (2.0, 4, None), (None, 5, 1.0), (float("nan"), 7, 2.0)], "a double, b int, c double")
    rows = {r["variable"]: r.asDict() for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert rows["a"]["a"] == 1.0 and rows["a"]["b"] == rows["b"]["a"] == 1.0 and rows["a"]["c"] is None and rows["b"]["c"] == 1.0
    empty = correlation_long(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["r"] is None for r in empty)
    plan = correlation_long(df.select("a", "b"), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "CartesianProduct" not in plan
    infinite = df.select(F.lit(float("inf")).alias("a"), "b")
    assert all(r["r"] is None for r in correlation_long(infinite, ["a", "b"]).where("col_a <> col_b").collect())
