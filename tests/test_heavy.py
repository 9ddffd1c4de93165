from collections import Counter

import numpy as np
import pytest

from strata.operators import heavy


def top(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 30_000
    columns = {
        "few": [f"f{i % 7}" for i in range(n)], "skewed": [f"s{x}" for x in rng.zipf(1.3, n).clip(0, 10**9)], "distinct": [f"d{i:06d}" for i in range(n)],
        "even": [f"e{i % 5000}" for i in range(n)], "gaps": [None if i % 3 else f"g{i % 4}" for i in range(n)], "nothing": [None] * n,
        "hot": ["h"] * (n // 3) + [f"x{i}" for i in range(n - n // 3)]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` string" for c in columns)).repartition(6)
    return df, columns


@pytest.mark.parametrize("capacity,few", [(heavy.CAPACITY, heavy.FEW), (200, 50_000), (200, 0), (3, 50_000)])
def test_top_levels_are_exact(table, monkeypatch, capacity, few):
    """Summaries that hold all levels, that drop most, and that prove nothing; candidates broadcast or joined."""
    df, columns = table
    monkeypatch.setattr(heavy, "FEW", few)
    for k in (1, 12):
        got = {}
        for r in heavy.top_levels(df, list(columns), k, capacity).collect():
            got.setdefault(r["column"], []).append((r["rank"], r["value"], r["n"]))
        for c, values in columns.items():
            assert [(v, n) for _, v, n in sorted(got.get(c, []))] == top(values, k)


def test_a_summary_is_never_short_by_more_than_its_error():
    rng = np.random.default_rng(5)
    values = [f"v{x}" for x in rng.zipf(1.2, 20_000).clip(0, 10**9)]
    truth, table, error = Counter(values), {}, 0
    for v in values:
        table[v] = table.get(v, 0) + 1
        if len(table) > 100:
            table, off = heavy._shrunk(table, 50)
            error += off
    assert 0 < error <= len(values) / 51
    assert all(table.get(v, 0) <= n <= table.get(v, 0) + error for v, n in truth.items())


def test_a_skewed_column_shuffles_summaries_not_levels(spark, table):
    """Levels outside the summaries never leave a task: the staged summary is bounded by tasks and capacity."""
    df, _ = table
    rows = df.select("hot").mapInArrow(heavy._summaries(1, 50), "c int, value string, n long")
    assert rows.count() <= 6 * 51 and df.select("hot").distinct().count() > 15_000
    error, kth = rows.where("value IS NULL").agg({"n": "sum"}).first()[0], rows.where("value = 'h'").agg({"n": "sum"}).first()[0]
    assert kth > error
