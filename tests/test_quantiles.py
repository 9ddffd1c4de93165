import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import charts, prepare
from strata.operators.evaluate import numeric_profile
from strata.operators.quantiles import exact_quantiles
from strata.operators.query import describe_numeric, groupby_agg
from strata.operators.stats import column_stats

PROBS = (0.0, 0.25, 0.33, 0.5, 0.75, 0.9, 1.0)


def test_equal_percentile_for_groups_columns_and_null_keys(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v), float(i % 3)) for i, v in enumerate(rng.normal(0, 1, 3000))] + \
           [(None if i % 7 == 0 else f"g{i % 7}", float(v), None) for i, v in enumerate(rng.exponential(2, 700))] + \
           [("one", 5.0, float("nan")), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    clean = df.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    want = {(r["g"], c): r[c] for r in clean.groupBy("g").agg(*[F.percentile(c, list(PROBS)).alias(c) for c in "xy"]).collect()
            for c in "xy" if r[c] is not None}
    got = {(r["g"], r["column"]): r["q"] for r in exact_quantiles(df, ["x", "y"], PROBS, ["g"]).collect()}
    assert got.keys() == want.keys() and (None, "x") in got
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12)
    whole = exact_quantiles(df, ["x"], PROBS).first()["q"]
    assert whole == pytest.approx(df.agg(F.percentile("x", list(PROBS))).first()[0], rel=1e-12)


@pytest.mark.parametrize("few", [50_000, 0])
def test_odd_distributions(spark, monkeypatch, few):
    """Narrow ranges far from zero, heavy tails, infinities, signs: with broadcast bins and with joined ones."""
    from strata.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(8)
    columns = {"far": 1.7e9 + rng.normal(0, 1e-3, 2001), "heavy": np.exp(rng.normal(0, 40, 2001)) * rng.choice([-1, 1], 2001),
               "signed": np.r_[-np.inf, np.inf, rng.integers(-3, 4, 1999)], "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, -0.0], 2001)}
    rows = [(int(i % 5) or None, *map(float, v)) for i, v in enumerate(zip(*columns.values()))]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in columns)).repartition(7)
    for keys in ((), ("g",)):
        want = {}
        for g in {r[0] for r in rows} if keys else {None}:
            for i, c in enumerate(columns):
                want[g, c] = np.sort([r[i + 1] for r in rows if not keys or r[0] == g])
        for r in exact_quantiles(df, list(columns), (0.0, 0.5, 1.0), list(keys)).collect():
            v = want.pop((r["g"] if keys else None, r["column"]))
            middle = (len(v) - 1) / 2
            low, high = v[int(np.floor(middle))], v[int(np.ceil(middle))]
            assert r["q"] == [v[0], low if low == high else low + (high - low) * (middle - np.floor(middle)), v[-1]]
        assert not want


def test_whole_columns_are_lazy_and_values_stay(spark):
    """No job runs while the plan is built, and no exchange carries plain values."""
    df = spark.range(100_000).select(F.rand(3).alias("x"), F.randn(4).alias("y"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles-built", "")
    out = exact_quantiles(df, ["x", "y"], (0.25, 0.5))
    assert not tracker.getJobIdsForGroup("quantiles-built")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == 2


def test_one_value_in_most_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 6, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert exact_quantiles(df, ["x"], (0.25, 0.5, 0.6, 0.9)).first()["q"] == pytest.approx(
        df.agg(F.percentile("x", [0.25, 0.5, 0.6, 0.9])).first()[0])


def test_users_of_quantiles_skip_nan_and_keep_null_groups(spark):
    rows = [("a", 1.0, 0), ("a", 2.0, 0), ("a", float("nan"), 0), ("b", 4.0, 1), (None, 7.0, 1), (None, 9.0, 1)]
    df = spark.createDataFrame(rows, ["g.k", "x", "cluster"])
    assert {r["g.k"]: r["x"] for r in groupby_agg(df, ["g.k"], ["x"], "median").collect()} == {"a": 1.5, "b": 4.0, None: 8.0}
    table = {r["statistic"]: r["x"] for r in describe_numeric(df, ["x"]).collect()}
    assert (table["count"], table["mean"], table["50%"], table["max"]) == (5.0, 4.6, 4.0, 9.0)
    boxes = {r["g.k"]: (r["n"], r["q1"], r["median"], r["q3"]) for r in charts.box_by_category(df, "g.k", "x").collect()}
    assert boxes == {"a": (2, 1.25, 1.5, 1.75), "b": (1, 4.0, 4.0, 4.0), None: (2, 7.5, 8.0, 8.5)}
    assert {(r["cluster"], r["median"]) for r in charts.box_stats(df, ["x"]).collect()} == {(0, 1.5), (1, 7.0)}
    assert {r["cluster"]: r["median"] for r in numeric_profile(df, ["x"]).collect()} == {0: 1.5, 1: 7.0}
    assert prepare.fill_values(df, ["x"], "median") == {"x": 4.0}
    assert prepare.scaler_params(df, ["x"], "robust") == {"x": (4.0, 5.0)}
    stats = {r["column"]: r for r in column_stats(df).collect()}
    assert (stats["x"]["n_missing"], stats["x"]["n_unique"], stats["x"]["median"]) == (1, 5, 4.0)
    assert stats["g.k"]["n_unique"] == 2
