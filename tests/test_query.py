import pytest

from strata.functions.bins import BinSpec
from strata.functions.predicates import Filter
from strata.operators.query import DataQuery, QueryError, run_query


def q(df, **kw):
    return run_query(df, DataQuery(**kw))


def test_filter_count(chat_df):
    res = q(chat_df, operation="filter_count", filter_by=[Filter("gender", "eq", "f")])
    expected = chat_df.where("gender = 'F'").count()
    assert res.table.first()["value"] == expected


def test_describe_numeric_matches_pandas(chat_df):
    pdf = chat_df.toPandas()
    t = {r["statistic"]: r for r in q(chat_df, operation="describe").table.collect()}
    d = pdf[["age", "income"]].describe()
    for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
        assert t[stat]["age"] == pytest.approx(d.loc[stat, "age"])
        assert t[stat]["income"] == pytest.approx(d.loc[stat, "income"])


def test_describe_text(chat_df):
    t = {r["statistic"]: r["region"] for r in q(chat_df, operation="describe", columns=["region"]).table.collect()}
    vc = chat_df.toPandas()["region"].value_counts()
    assert t["count"] == "30" and t["unique"] == str(len(vc))
    assert int(t["freq"]) == vc.max()


def test_value_counts_keeps_null_and_pct_sums_100(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    rows = {r["c"]: r["n"] for r in q(df, operation="value_counts", columns=["c"]).table.collect()}
    assert rows == {"a": 2, "b": 1, None: 1}
    pct = q(df, operation="value_counts", columns=["c"], normalize="total_pct").table
    assert sum(r["pct"] for r in pct.collect()) == pytest.approx(100.0, abs=0.2)


def test_groupby_row_pct(chat_df):
    t = q(chat_df, operation="groupby_count", groupby=["region", "gender"], normalize="row_pct").table
    by = {}
    for r in t.collect():
        by.setdefault(r["region"], 0.0)
        by[r["region"]] += r["pct"]
    assert all(abs(v - 100) <= 0.2 for v in by.values())


def test_row_pct_one_key_falls_back_to_total(chat_df):
    t = q(chat_df, operation="groupby_count", groupby=["region"], normalize="row_pct").table
    assert sum(r["pct"] for r in t.collect()) == pytest.approx(100.0, abs=0.2)


def test_groupby_agg_and_rounding(chat_df):
    pdf = chat_df.toPandas()
    one = {r["region"]: r["income"] for r in q(chat_df, operation="groupby_agg", groupby=["region"],
                                               columns=["income"], agg="mean").table.collect()}
    exp = pdf.groupby("region")["income"].mean()
    assert one == pytest.approx(exp.to_dict())
    multi = q(chat_df, operation="groupby_agg", groupby=["region"], columns=["income", "age"], agg="median")
    exp2 = pdf.groupby("region")[["income", "age"]].median().round(3)
    for r in multi.table.collect():
        assert r["age"] == pytest.approx(exp2.loc[r["region"], "age"])


def test_sum_of_all_null_group_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "g string, x double")
    t = {r["g"]: r["x"] for r in q(df, operation="groupby_agg", groupby=["g"], columns=["x"], agg="sum").table.collect()}
    assert t == {"a": 0.0, "b": 2.0}


def test_mean_of_text_is_an_error(chat_df):
    with pytest.raises(QueryError):
        q(chat_df, operation="groupby_agg", groupby=["region"], columns=["gender"], agg="mean")


def test_unknown_column_named_error(chat_df):
    with pytest.raises(QueryError, match="nope"):
        q(chat_df, operation="value_counts", columns=["nope"])


def test_correlation_matrix(chat_df):
    pdf = chat_df.toPandas()
    t = {r["variable"]: r for r in q(chat_df, operation="correlation").table.collect()}
    assert t["age"]["income"] == pytest.approx(round(pdf["age"].corr(pdf["income"]), 3))
    assert t["age"]["age"] == 1.0


def test_top_n(chat_df):
    pdf = chat_df.toPandas()
    top = [r["income"] for r in q(chat_df, operation="top_n", columns=["income"], top_n=3).table.collect()]
    assert top == pdf["income"].nlargest(3).tolist()
    txt = q(chat_df, operation="top_n", columns=["region"], top_n=2).table.collect()
    assert len(txt) == 2 and txt[0]["n"] >= txt[1]["n"]


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, "x", 1), (None, None, 2), (3.0, "z", 3)], "a double, b string, c int")
    t = q(df, operation="missing_values").table.collect()
    assert {r["column"]: (r["n_missing"], r["pct_missing"]) for r in t} == {"a": (1, 33.3), "b": (1, 33.3)}
    none = q(df.select("c"), operation="missing_values").table.collect()
    assert none[0]["value"] == 0


def test_bins_then_filter_and_auto_bar(chat_df):
    res = q(chat_df, operation="value_counts", columns=["age"],
            bins=[BinSpec("age", [18, 40, 70], ["young", "older"])], filter_by=[Filter("age", "eq", "YOUNG")])
    assert [r["age"] for r in res.table.collect()] == ["young"]
    bar = q(chat_df, operation="value_counts", columns=["region"])
    assert bar.chart.type == "bar"
    assert q(chat_df, operation="value_counts", columns=["region"], chart_type="pie").chart.type == "pie"


def test_distribution_histogram(chat_df):
    res = q(chat_df, operation="distribution", columns=["income"])
    hist = res.chart.data.collect()
    assert len(hist) == 5  # clamp(round(sqrt(30)), 5, 12)
    assert sum(r["n"] for r in hist) == 30


def test_odd_names_and_booleans(spark):
    from strata.operators.query import DataQuery, run_query

    df = spark.createDataFrame([(True, 1.0, "x"), (False, 2.0, "y"), (None, float("nan"), "x")], ["ok", "q1.sex", "a `b`"])
    run = lambda **kw: run_query(df, DataQuery(**kw)).table.collect()
    count = lambda *f: run(operation="filter_count", filter_by=[f])[0]["value"]
    assert count("ok", "eq", "abc") == 0 and count("ok", "ne", "abc") == 3 and count("ok", "gt", "a") == 0
    assert count("ok", "eq", True) == 1 and count("ok", "eq", 1) == 1
    assert count("q1.sex", "gt", 1) == 1 and count("a `b`", "eq", "X") == 2
    assert {(r["q1.sex"], r["n"]) for r in run(operation="value_counts", columns=["q1.sex"])} == {(1.0, 1), (2.0, 1), (None, 1)}
    assert run(operation="describe", columns=["q1.sex"])[0]["q1.sex"] == 2.0
    assert run(operation="describe", columns=["a `b`"])[2]["a `b`"] == "x"
    assert run(operation="groupby_agg", groupby=["a `b`"], columns=["q1.sex"], agg="sum")[0]["q1.sex"] == 1.0
    assert {r["column"] for r in run(operation="missing_values")} == {"ok", "q1.sex"}
    for kw in ({"operation": "correlation"}, {"operation": "top_n", "columns": ["q1.sex"]}, {"operation": "top_n", "columns": ["a `b`"]},
               {"operation": "groupby_count", "groupby": ["a `b`", "q1.sex"], "normalize": "row_pct"}, {"operation": "distribution", "columns": ["q1.sex"]}):
        assert run(**kw)
