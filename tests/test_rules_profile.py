import datetime as dt

from strata.operators import profile, rules


def decisions(df):
    return {r["column"]: (r["action"], r["reason"]) for r in rules.rule_decisions(df).collect()}


def test_each_rule(spark):
    n = 20
    rows = []
    for i in range(n):
        rows.append((
            i,                                   # customer_id → identifier by name
            "Chile",                             # constant → near zero
            "a very long free text comment that goes on and on and on for a while " + str(i % 15),
            20 + (i * 7) % 40,                   # age → keep
            ["N", "S", "E"][i % 3],              # region → keep
            f"2021-{1 + i % 12:02d}-{1 + i % 27:02d}",  # date text → year
            None if i % 10 else "x",             # 90% missing
            100.0 + (i % 2) * 0.001,             # tiny CV → near zero
            f"lvl{i}",                           # unique strings → identifier
            f"cat{i % 26}",                      # 26 short levels, ratio > .5 with short length → cardinality
        ))
    df = spark.createDataFrame(rows, "customer_id long, country string, comment string, age int, region string, "
                                     "signup string, sparse string, price double, code string, grp string")
    d = decisions(df)
    assert d["customer_id"] == ("drop", "identifier")
    assert d["country"] == ("drop", "near_zero_variance")
    assert d["comment"] == ("drop", "free_text")
    assert d["age"] == ("keep", None)
    assert d["region"] == ("keep", None)
    assert d["signup"] == ("extract_year", "date")
    assert d["sparse"] == ("drop", "high_missing")
    assert d["price"] == ("drop", "near_zero_variance")
    assert d["code"] == ("drop", "identifier")
    assert d["grp"][0] == "drop"


def test_consecutive_integer_is_identifier_but_gappy_is_not(spark):
    df = spark.createDataFrame([(i, i * 3, i % 2) for i in range(1, 11)], "k int, g int, b int")
    d = decisions(df)
    assert d["k"] == ("drop", "identifier")
    assert d["g"] == ("keep", None)


def test_tiny_table_not_near_zero(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "x int, y string")
    assert decisions(df)["x"] == ("keep", None)


def test_native_dates_become_years(spark):
    df = spark.createDataFrame([(dt.datetime(2020 + i % 3, 1, 1), i % 4) for i in range(12)], "d timestamp, v int")
    reduced, report = rules.apply_rules(df)
    assert report.datetime_extracted == [("d", "d_year")]
    assert sorted(r["d_year"] for r in reduced.select("d_year").distinct().collect()) == [2020.0, 2021.0, 2022.0]


def test_same_day_strings_are_not_dates(spark):
    df = spark.createDataFrame([("2021-05-05", i) for i in range(10)], "d string, v int")
    assert decisions(df)["d"][1] != "date"


def test_profile_tables(spark, chat_df):
    prof = profile.profile(chat_df)
    cols = {r["column"]: r for r in prof["columns"].collect()}
    assert cols["age"]["is_numeric"] and not cols["region"]["is_numeric"]
    shape = prof["shape"].first()
    assert shape["n_rows"] == 30 and shape["n_cols"] == 4
    types = {r["class"]: r["n_columns"] for r in prof["types"].collect()}
    assert types == {"numeric": 2, "categorical": 2}
    comp = prof["completeness"].first()
    assert comp["missing_cells"] == 0 and comp["has_missing"] is False


def test_dates_are_judged_over_all_values(spark):
    from pyspark.sql import functions as F

    from strata.operators.rules import rule_decisions

    day = F.when(F.col("id") < 1000, F.lit("2024-01-05")).otherwise(F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), F.col("id").cast("int") % 9), "yyyy-MM-dd"))
    df = spark.range(1010).select("id", day.alias("often"), F.when(F.col("id") == 3, F.lit("soon")).otherwise(day).alias("spoilt"),
                                  F.when(F.col("id") % 10 == 3, F.lit("soon")).otherwise(day).alias("mixed"), F.lit("2024-01-05").alias("same"))
    got = {r["column"]: r["reason"] for r in rule_decisions(df).collect()}
    assert got["often"] == "date" and got["spoilt"] == "date" and got["mixed"] is None and got["same"] == "near_zero_variance"


def test_one_format_per_column(spark):
    """A stray value never loses a date column, and never brings in a second format."""
    iso = [(f"{2000 + i % 20}-{1 + i % 12:02d}-{1 + i % 28:02d}", i % 7) for i in range(2000)]
    df = spark.createDataFrame([*iso, ("n/k", 3)], "d string, v int")
    reduced, report = rules.apply_rules(df)
    assert report.datetime_extracted == [("d", "d_year")] and report.date_formats == {"d": "yyyy-MM-dd"}
    assert reduced.where("d_year IS NULL").count() == 1 and reduced.agg({"d_year": "max"}).first()[0] == 2019.0
    both = spark.createDataFrame([("03/04/2020",), ("04/25/2021",), ("05/26/2022",), ("13/01/2023",)] + [("01/02/2020",)] * 60, "d string")
    assert rules.date_formats(both, ["d"]) == {"d": "MM/dd/yyyy"}
    years = {r["d"]: r["y"] for r in both.select("d", rules.year_of(both, "d").alias("y")).collect()}
    assert years == {"03/04/2020": 2020.0, "04/25/2021": 2021.0, "05/26/2022": 2022.0, "13/01/2023": None, "01/02/2020": 2020.0}
    tie = spark.createDataFrame([("01/02/2020",), ("03/04/2021",), ("05/06/2022",)], "d string")
    assert rules.date_formats(tie, ["d"]) == {"d": "dd/MM/yyyy"}
    few = spark.createDataFrame([("2020-01-01",), ("2021-01-01",), ("x" * 500,), (None,)], "d string")
    assert rules.date_formats(few, ["d"]) == {} and few.select(rules.year_of(few, "d")).distinct().collect() == [(None,)]


def test_distinct_tests_at_their_limits(spark):
    """Decisions at, just below and just above each limit are those of exact counts."""
    from pyspark.sql import functions as F

    n = 4000
    i = F.col("id")
    word = lambda x: F.concat(F.lit("w"), x.cast("string"))
    long = lambda x: F.concat(F.lit("a longer text of "), x.cast("string"))
    df = spark.range(n).select(
        word(i % 25).alias("l25"), word(i % 26).alias("l26"), word(i % 24).alias("l24"), word(i).alias("unique"),
        word(F.greatest(i, F.lit(1))).alias("one_twice"), F.when(i > 0, word(i)).alias("one_missing"),
        long(i % (n // 2)).alias("half"), long(i % (n // 2 + 1)).alias("over"), i.alias("dense"), F.greatest(i, F.lit(1)).alias("gap"), (i * 2).alias("even"))
    got = decisions(df)
    assert {c: r for c, (_, r) in got.items()} == {
        "l25": None, "l26": "high_cardinality", "l24": None, "unique": "identifier", "one_twice": "high_cardinality", "one_missing": "high_cardinality",
        "half": "high_cardinality", "over": "free_text", "dense": "identifier", "gap": None, "even": None}
