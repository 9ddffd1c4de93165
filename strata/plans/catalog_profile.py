"""Registered queries for profiling (D*), column rules (C*) and user groups (H*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Filter
from ..operators import groups, profile, rules
from .registry import DOCS_LABELS_SQL, docs_labels, r, register, rounded, tbl

DL = DOCS_LABELS_SQL
ORDERS_COLS = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
               ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False),
               ("o_orderpriority", "string", False)]


@register("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS n_missing, "
    f"{r(f'(count(*) - count({c})) / count(*)')} AS pct_missing, count(DISTINCT {c}) AS n_unique, "
    f"{str(num).lower()} AS is_numeric FROM orders" for c, t, num in ORDERS_COLS))
def column_profile(spark, sf):
    return rounded(profile.column_profile(tbl(spark, sf, "orders")))


@register("numeric_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r(f'skewness({c})')} AS skewness, {r(f'quantile_cont({c}, 0.25)')} AS q1, "
    f"{r(f'quantile_cont({c}, 0.75)')} AS q3 FROM orders" for c, _, num in ORDERS_COLS if num))
def numeric_stats(spark, sf):
    return rounded(profile.numeric_stats(tbl(spark, sf, "orders")))


@register("top_categories", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n, "
    f"CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC) AS INTEGER) AS rank "
    f"FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10" for c in ("p_name", "p_brand", "p_type")))
def top_categories(spark, sf):
    return profile.top_categories(tbl(spark, sf, "part"))


@register("table_shape", """
SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols, 'c_custkey,c_nationkey,c_acctbal' AS numeric_columns,
       'c_name,c_mktsegment' AS categorical_columns FROM customer
""")
def table_shape(spark, sf):
    return profile.table_shape(tbl(spark, sf, "customer"))


@register("type_breakdown", """
WITH c AS (
  SELECT 'numeric' AS class UNION ALL SELECT 'numeric' UNION ALL SELECT 'numeric'
  UNION ALL SELECT CASE WHEN count(c_name) > 0 AND count(DISTINCT c_name) / count(c_name) > 0.5
                   THEN 'free_text' ELSE 'categorical' END FROM customer
  UNION ALL SELECT CASE WHEN count(c_mktsegment) > 0 AND count(DISTINCT c_mktsegment) / count(c_mktsegment) > 0.5
                   THEN 'free_text' ELSE 'categorical' END FROM customer)
SELECT class, count(*) AS n_columns FROM c GROUP BY class
""")
def type_breakdown(spark, sf):
    return profile.type_breakdown(tbl(spark, sf, "customer"))


@register("cell_completeness", f"""
WITH t AS (SELECT * FROM {DL} x),
m AS (SELECT count(*) AS n_rows,
        (count(*) - count(doc_id)) + (count(*) - count(lang)) + (count(*) - count(source)) +
        (count(*) - count(n_chars)) + (count(*) - count(quality)) + (count(*) - count(toxic)) AS missing_cells FROM t)
SELECT n_rows, CAST(6 AS BIGINT) AS n_cols, CAST(missing_cells AS BIGINT) AS missing_cells,
  {r("round_even((CAST(missing_cells AS DOUBLE) / (n_rows * 6) * 100) * 10.0, 0) / 10.0")} AS missing_pct,
  missing_cells > 0 AS has_missing FROM m
""")
def cell_completeness(spark, sf):
    return rounded(profile.cell_completeness(docs_labels(spark, sf)))


def _summary_sql() -> str:
    num = ["c_custkey", "c_nationkey", "c_acctbal"]
    txt = ["c_name", "c_mktsegment"]
    types = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "c_name": "string",
             "c_mktsegment": "string"}
    parts = []
    for c in num:
        parts.append(
            f"SELECT '{c}' AS \"column\", '{types[c]}' AS dtype, count(DISTINCT {c}) AS n_unique, "
            f"{r(f'round_even(((count(*) - count({c})) / count(*)) * 1000.0, 0) / 1000.0')} AS pct_missing, "
            f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg({c})')} AS mean, "
            f"(SELECT string_agg(v, ',' ORDER BY md5(v), v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
            f"FROM customer WHERE {c} IS NOT NULL ORDER BY md5(v), v LIMIT 3)) AS samples, "
            f"CAST(NULL AS VARCHAR) AS top_values FROM customer")
    for c in txt:
        parts.append(
            f"SELECT '{c}' AS \"column\", '{types[c]}' AS dtype, count(DISTINCT {c}) AS n_unique, "
            f"{r(f'round_even(((count(*) - count({c})) / count(*)) * 1000.0, 0) / 1000.0')} AS pct_missing, "
            f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, "
            f"CAST(NULL AS VARCHAR) AS samples, "
            f"(SELECT string_agg(v || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, v) FROM ("
            f"SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1 "
            f"ORDER BY n DESC, v LIMIT 5)) AS top_values FROM customer")
    return " UNION ALL ".join(parts)


@register("schema_summary", _summary_sql())
def schema_summary(spark, sf):
    return rounded(profile.column_summary(tbl(spark, sf, "customer")))


# ------------------------------------------------------------------ rules

def mixed_orders(spark, sf):
    """orders plus derived columns that exercise every rule (text date, free text, …)."""
    o = tbl(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" asked at priority "),
                 F.col("o_orderpriority"), F.lit(" with status "), F.col("o_orderstatus")).alias("note"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("urgent_status"),
        F.lit("const").alias("constant"),
        (F.lit(100.0) + (F.col("o_custkey") % 2).cast("double") * 0.01).alias("flat"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("cust_group"),
    )


MIXED_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d') AS day_text,
  'customer ' || CAST(o_custkey AS VARCHAR) || ' asked at priority ' || o_orderpriority || ' with status ' || o_orderstatus AS note,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS urgent_status,
  'const' AS constant, 100.0 + CAST(o_custkey % 2 AS DOUBLE) * 0.01 AS flat,
  'c' || CAST(o_custkey % 40 AS VARCHAR) AS cust_group FROM orders)"""
MIXED_KINDS = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "string"),
               ("day_text", "string"), ("note", "string"), ("urgent_status", "string"), ("constant", "string"),
               ("flat", "numeric"), ("cust_group", "string")]
CUSTOMER_KINDS = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                  ("c_acctbal", "numeric"), ("c_mktsegment", "string")]
SQL_DATE_FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y",
                    "%d-%m-%Y", "%Y-%m-%d %H:%M")


def _rules_sql(table: str, kinds) -> str:
    parts = []
    for c, kind in kinds:
        numeric = kind in ("integer", "numeric")
        x = f"CAST({c} AS DOUBLE)"
        days = [f"CAST(try_strptime(trim(v), '{f}') AS DATE)" for f in SQL_DATE_FORMATS]
        sample = ("(SELECT count(*) AS ns, " + ", ".join(f"count({d}) AS c{i}, min({d}) AS a{i}, max({d}) AS z{i}" for i, d in enumerate(days)) +
                  f" FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {table} t WHERE {c} IS NOT NULL))")
        stats = (f"SELECT count(*) AS n, count(*) - count({c}) AS miss, count(DISTINCT {c}) AS nu, "
                 + (f"avg({x}) AS mean, stddev_samp({x}) AS std, max({x}) - min({x}) AS rng, "
                    if numeric else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS rng, ")
                 + (f"avg(length({c})) AS mlen " if kind == "string" else "NULL::DOUBLE AS mlen ")
                 + f"FROM {table} t")
        near_num = ("(coalesce(mean <> 0 AND abs(std / mean) < 0.01, false) OR "
                    "coalesce(rng > 0 AND std / rng < 0.01, false))") if numeric else "false"
        # the most frequent format, ties to the first; it alone is read
        best = "greatest(" + ", ".join(f"s.c{i}" for i in range(len(days))) + ")"
        several = "CASE " + " ".join(f"WHEN s.c{i} = {best} THEN s.a{i} < s.z{i}" for i in range(len(days))) + " END"
        text_date = f"({best} >= 3 AND {best} >= 0.95 * s.ns AND {several})" if kind == "string" else "false"
        is_date = "true" if kind == "temporal" else text_date
        name_id = f"regexp_full_match('{c}', '(?i)^(id|uuid|.*_id|.*_uuid|.*id\\d*)$')"
        consecutive = "(n > 1 AND rng = n - 1)" if kind == "integer" else "false"
        ident = f"({name_id} OR (n > 0 AND nu = n AND ({'true' if kind == 'string' else consecutive})))"
        free = ("(n - miss > 0 AND (mlen > 50 OR (nu / (n - miss) > 0.5 AND mlen > 15)))"
                if kind == "string" else "false")
        card = "(nu > 25)" if kind == "string" else "false"
        reason = (f"CASE WHEN n > 0 AND miss / n > 0.7 THEN 'high_missing' "
                  f"WHEN n >= 4 AND (nu <= 1 OR {near_num}) THEN 'near_zero_variance' "
                  f"WHEN coalesce({is_date}, false) THEN 'date' WHEN coalesce({ident}, false) THEN 'identifier' "
                  f"WHEN coalesce({free}, false) THEN 'free_text' WHEN {card} THEN 'high_cardinality' END")
        src = f"({stats}) a" + (f", {sample} s" if kind == "string" else "")
        parts.append(f"SELECT '{c}' AS \"column\", reason, CASE WHEN reason IS NULL THEN 'keep' "
                     f"WHEN reason = 'date' THEN 'extract_year' ELSE 'drop' END AS action, "
                     f"CASE WHEN reason = 'date' THEN '{c}_year' END AS new_column "
                     f"FROM (SELECT {reason} AS reason FROM {src})")
    return " UNION ALL ".join(parts)


@register("rules_report_customer", _rules_sql("customer", CUSTOMER_KINDS))
def rules_report_customer(spark, sf):
    return rules.rule_decisions(tbl(spark, sf, "customer"))


@register("rules_report_orders", _rules_sql(MIXED_SQL, MIXED_KINDS))
def rules_report_orders(spark, sf):
    return rules.rule_decisions(mixed_orders(spark, sf))


@register("date_to_year", """
SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year,
       CAST(year(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')) AS DOUBLE) AS day_text_year FROM orders
""")
def date_to_year(spark, sf):
    m = mixed_orders(spark, sf).select("o_orderkey", "o_orderdate", "day_text")
    return m.select("o_orderkey", rules.year_of(m, "o_orderdate").alias("o_orderdate_year"),
                    rules.year_of(m, "day_text").alias("day_text_year"))


def _years_of_days(spark, sf, day):
    """Rows per year of a text column that the rules turn into a year."""
    o = tbl(spark, sf, "orders")
    reduced, _ = rules.apply_rules(o.select("o_totalprice", day(o).alias("day")))
    return reduced.groupBy("day_year").agg(F.count("*").alias("n"))


@register("dates_with_gaps", """
SELECT CAST(CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END AS DOUBLE) AS day_year, count(*) AS n FROM orders GROUP BY 1
""")
def dates_with_gaps(spark, sf):
    """ISO days of which one in fifty is unknown: still a date, its year NULL there."""
    return _years_of_days(spark, sf, lambda o: F.when(F.col("o_orderkey") % 50 == 0, "n/k").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))


@register("dates_day_first", """
SELECT CAST(CASE WHEN o_orderkey % 40 <> 0 OR day(o_orderdate) <= 12 THEN year(o_orderdate) END AS DOUBLE) AS day_year, count(*) AS n FROM orders GROUP BY 1
""")
def dates_day_first(spark, sf):
    """C4: a day-first column in which one value in forty is month-first: one format reads all, or NULL."""
    return _years_of_days(spark, sf, lambda o: F.when(F.col("o_orderkey") % 40 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
                          .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))


@register("rules_reduced_table", f"""
SELECT (SELECT count(*) FROM customer) AS n_rows, string_agg("column", ',' ORDER BY "column") AS kept
FROM ({_rules_sql("customer", CUSTOMER_KINDS)}) WHERE action = 'keep'
""")
def rules_reduced_table(spark, sf):
    reduced, report = rules.apply_rules(tbl(spark, sf, "customer"))
    return reduced.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(",".join(sorted(report.kept))).alias("kept"))


# ------------------------------------------------------------------ groups

@register("compare_groups", f"""
WITH a AS (SELECT * FROM orders WHERE lower(o_orderstatus) = 'f'),
     b AS (SELECT * FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')),
     t AS (SELECT count(*) AS n FROM orders)
SELECT 'rows' AS metric, CAST((SELECT count(*) FROM a) AS VARCHAR) AS "Finished",
       CAST((SELECT count(*) FROM b) AS VARCHAR) AS "Urgent"
UNION ALL SELECT 'pct_of_total',
  CAST({r("round_even((CAST((SELECT count(*) FROM a) AS DOUBLE) / (SELECT n FROM t) * 100) * 10.0, 0) / 10.0")} AS VARCHAR),
  CAST({r("round_even((CAST((SELECT count(*) FROM b) AS DOUBLE) / (SELECT n FROM t) * 100) * 10.0, 0) / 10.0")} AS VARCHAR)
UNION ALL SELECT 'o_totalprice (mean)',
  CAST({r("round_even((SELECT avg(o_totalprice) FROM a) * 100.0, 0) / 100.0")} AS VARCHAR),
  CAST({r("round_even((SELECT avg(o_totalprice) FROM b) * 100.0, 0) / 100.0")} AS VARCHAR)
UNION ALL SELECT 'o_orderpriority (mode)',
  (SELECT o_orderpriority FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  (SELECT o_orderpriority FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
""")
def compare_groups(spark, sf):
    return groups.compare_groups(tbl(spark, sf, "orders"), [Filter("o_orderstatus", "eq", "f")],
                                 [Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])], "Finished", "Urgent",
                                 columns=["o_totalprice", "o_orderpriority"])


@register("profile_group", f"""
SELECT n, {r("round_even((CAST(n AS DOUBLE) / total * 100) * 10.0, 0) / 10.0")} AS share,
  CASE WHEN n < 30 THEN 'alta' WHEN n < 100 THEN 'media' ELSE 'baja' END AS caution
FROM (SELECT count(*) FILTER (WHERE lower(c_mktsegment) = 'building' AND c_acctbal > 5000) AS n,
             count(*) AS total FROM customer)
""")
def profile_group(spark, sf):
    return rounded(groups.profile_group(tbl(spark, sf, "customer"),
                                        [Filter("c_mktsegment", "eq", "building"), Filter("c_acctbal", "gt", "5000")]))


_GROUP = "(lower(c_mktsegment) = 'building' AND c_acctbal > 5000)"


@register("group_vs_total_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {_GROUP} THEN CAST({c} AS DOUBLE) END)')} AS group_mean, "
    f"{r(f'avg(CAST({c} AS DOUBLE))')} AS total_mean FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def group_vs_total_numeric(spark, sf):
    num, _ = groups.group_statistics(tbl(spark, sf, "customer"), [Filter("c_mktsegment", "eq", "building"),
                                                                   Filter("c_acctbal", "gt", 5000)])
    return rounded(num)


@register("group_vs_total_categorical", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY ng DESC, value) AS INTEGER) AS rank, value,
  {r("CAST(ng AS DOUBLE) / sum(ng) OVER ()")} AS group_share, {r("CAST(nt AS DOUBLE) / sum(nt) OVER ()")} AS total_share
FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) FILTER (WHERE {_GROUP}) AS ng, count(*) AS nt
      FROM customer WHERE {c} IS NOT NULL GROUP BY 1)
QUALIFY ng > 0) WHERE rank <= 3""" for c in ("c_name", "c_mktsegment")))
def group_vs_total_categorical(spark, sf):
    _, cat = groups.group_statistics(tbl(spark, sf, "customer"), [Filter("c_mktsegment", "eq", "building"),
                                                                   Filter("c_acctbal", "gt", 5000)])
    return rounded(cat)
