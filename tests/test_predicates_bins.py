import pandas as pd
import pytest

from strata.functions.bins import BinSpec, apply_bins, default_labels
from strata.functions.predicates import Filter, apply_filters


def rows(df, col):
    return sorted([r[col] for r in df.collect()], key=lambda v: (v is None, v))


def test_eq_is_case_insensitive_and_null_false(spark):
    df = spark.createDataFrame([("North",), ("north",), ("South",), (None,)], "r string")
    assert rows(apply_filters(df, [Filter("r", "eq", "NORTH")]), "r") == ["North", "north"]


def test_ne_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "r string")
    assert rows(apply_filters(df, [Filter("r", "ne", "A")]), "r") == ["b", None]


def test_numeric_literal_coercion_and_skip(spark):
    df = spark.createDataFrame([(20,), (25,), (30,), (40,)], "age int")
    assert apply_filters(df, [Filter("age", "gte", "25")]).count() == 3
    # an uncoercible literal skips the condition instead of failing
    assert apply_filters(df, [Filter("age", "gt", "abc")]).count() == 4


def test_in_and_contains_literal(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("A.B c",), (None,)], "s string")
    assert apply_filters(df, [Filter("s", "in", ["A.B", "zz"])]).count() == 1
    # '.' is literal, not a regex wildcard
    assert rows(apply_filters(df, [Filter("s", "contains", "a.B")]), "s") == ["A.B c", "a.b"]
    assert apply_filters(df, [Filter("s", "in", "axb")]).count() == 1


def test_unknown_column_is_skipped_and_and_composes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "a int, b string")
    out = apply_filters(df, [Filter("zz", "eq", 1), Filter("b", "eq", "x"), Filter("a", "gt", 1)])
    assert rows(out, "a") == [3]


def test_default_labels_match_pandas():
    for edges in ([1, 3, 5], [0, 10, 20], [0.5, 1.25, 2], [-5, 0, 5]):
        cats = pd.cut([edges[0]], edges, include_lowest=True).categories.astype(str).tolist()
        assert default_labels(edges) == cats


def test_bins_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (3.5,), (5.0,), (6.0,), (None,)], "x double")
    out = apply_bins(df, [BinSpec("x", [1, 3, 5], ["lo", "hi"])])
    assert [r["x"] for r in out.collect()] == [None, "lo", "lo", "hi", "hi", None, None]
    # wrong label count → default labels; fewer than 2 edges → ignored
    out2 = apply_bins(df, [BinSpec("x", [1, 3, 5], ["only"])])
    assert out2.where("x = '(0.999, 3.0]'").count() == 2
    assert apply_bins(df, [BinSpec("x", [1])]).schema["x"].dataType.typeName() == "double"


def test_bins_must_increase(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        apply_bins(df, [BinSpec("x", [3, 1])])
