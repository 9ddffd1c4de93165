import pytest

from strata.functions.predicates import Filter
from strata.operators import evidence as V
from strata.operators import groups as G


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(7.0, 25, "Madrugada", 0) for _ in range(40)] + [(1.5, 40, "Mañana", 1) for _ in range(20)] + \
           [(1.5, 40, "Madrugada", 1) for _ in range(20)]
    return spark.createDataFrame(rows, "horas double, edad int, franja string, cluster int")


def test_numeric_evidence_planted(planted):
    ev = {(r["cluster"], r["column"]): r for r in V.numeric_evidence(planted, ["horas", "edad"]).collect()}
    r = ev[(0, "horas")]
    assert round(r["group_mean"], 2) == 7.00 and round(r["total_mean"], 2) == 4.25 and r["z"] > 0


def test_categorical_evidence_planted(planted):
    ev = V.categorical_evidence(planted, ["franja"]).collect()
    top = [r for r in ev if r["cluster"] == 0][0]
    assert top["value"] == "Madrugada" and top["group_share"] == 1.0 and top["total_share"] == 0.75


def test_compare_groups_and_empty_error(spark, chat_df):
    t = {r["metric"]: r for r in G.compare_groups(
        chat_df, [Filter("gender", "eq", "F")], [Filter("gender", "eq", "M")], "F", "M",
        columns=["age", "region"]).collect()}
    pdf = chat_df.toPandas()
    assert t["rows"]["F"] == str((pdf.gender == "F").sum())
    assert float(t["age (mean)"]["M"]) == pytest.approx(round(pdf[pdf.gender == "M"].age.mean(), 2))
    modes = pdf[pdf.gender == "F"].region.mode()
    assert t["region (mode)"]["F"] == sorted(modes)[0]
    with pytest.raises(G.GroupError, match="Nobody"):
        G.compare_groups(chat_df, [Filter("gender", "eq", "X")], [Filter("gender", "eq", "M")], "Nobody", "M")


def test_profile_group(chat_df):
    with pytest.raises(G.GroupError):
        G.profile_group(chat_df, [])
    with pytest.raises(G.GroupError):
        G.profile_group(chat_df, [Filter("region", "eq", "Mars")])
    r = G.profile_group(chat_df, [Filter("region", "eq", "north")]).first()
    assert r["caution"] == "alta" and 0 < r["share"] <= 100
