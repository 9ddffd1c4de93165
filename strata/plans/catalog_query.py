"""Registered queries for the typed query executor (P*, Q*, G4–G6, G10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bins import BinSpec, default_labels
from ..functions.predicates import Filter
from ..operators import charts
from ..operators.query import DataQuery, correlation_long, run_query
from .registry import DOCS_LABELS_SQL, docs_labels, r, register, rounded, tbl

DL = DOCS_LABELS_SQL


def _q(df, **kw):
    return run_query(df, DataQuery(**kw), resolve_chart=False).table


@register("groupby_count_row_pct", f"""
SELECT l_returnflag, l_linestatus,
       {r("round_even((CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_returnflag) * 100) * 10.0, 0) / 10.0")} AS pct
FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity >= 10
      GROUP BY l_returnflag, l_linestatus)
""")
def groupby_count_row_pct(spark, sf):
    """Minimum slice: share of line status within return flag for quantity ≥ 10."""
    li = tbl(spark, sf, "lineitem")
    return rounded(_q(li, operation="groupby_count", groupby=["l_returnflag", "l_linestatus"],
                      filter_by=[Filter("l_quantity", "gte", "10")], normalize="row_pct"))


@register("filter_count_conj", """
SELECT 'rows_found' AS metric, count(*) AS value FROM lineitem
WHERE lower(l_returnflag) = 'r' AND l_quantity > 20 AND lower(l_linestatus) IN ('o', 'f')
""")
def filter_count_conj(spark, sf):
    return _q(tbl(spark, sf, "lineitem"), operation="filter_count", filter_by=[
        Filter("l_returnflag", "eq", "r"), Filter("l_quantity", "gt", 20),
        Filter("l_linestatus", "in", ["o", "F"])])


@register("filter_ne_keeps_null", f"""
SELECT 'rows_found' AS metric, count(*) AS value FROM {DL} t WHERE quality IS DISTINCT FROM 1
""")
def filter_ne_keeps_null(spark, sf):
    return _q(docs_labels(spark, sf), operation="filter_count", filter_by=[Filter("quality", "ne", 1)])


@register("filter_ne_text", f"""
SELECT lang, count(*) AS n FROM {DL} t WHERE lower(lang) IS DISTINCT FROM 'en' GROUP BY lang
""")
def filter_ne_text(spark, sf):
    return _q(docs_labels(spark, sf), operation="value_counts", columns=["lang"],
              filter_by=[Filter("lang", "ne", "EN")])


@register("filter_contains_ci", """
SELECT p_type, count(*) AS n FROM part WHERE contains(lower(CAST(p_name AS VARCHAR)), 'ring')
GROUP BY p_type
""")
def filter_contains_ci(spark, sf):
    return _q(tbl(spark, sf, "part"), operation="groupby_count", groupby=["p_type"],
              filter_by=[Filter("p_name", "contains", "RiNg")])


@register("filter_contains_numeric", """
SELECT 'rows_found' AS metric, count(*) AS value FROM customer
WHERE contains(lower(CAST(c_nationkey AS VARCHAR)), '1')
""")
def filter_contains_numeric(spark, sf):
    return _q(tbl(spark, sf, "customer"), operation="filter_count",
              filter_by=[Filter("c_nationkey", "contains", "1")])


@register("filter_literal_coercion", """
SELECT 'rows_found' AS metric, count(*) AS value FROM lineitem WHERE l_quantity >= 45
""")
def filter_literal_coercion(spark, sf):
    # "abc" cannot be read as a number: that condition is skipped, not an error
    return _q(tbl(spark, sf, "lineitem"), operation="filter_count",
              filter_by=[Filter("l_quantity", "gte", "45"), Filter("l_discount", "lt", "abc")])


@register("filter_range_in", """
SELECT 'rows_found' AS metric, count(*) AS value FROM lineitem
WHERE l_extendedprice >= 10000 AND l_extendedprice < 50000 AND l_linenumber IN (1, 3, 7)
""")
def filter_range_in(spark, sf):
    # a text item in a numeric IN list never matches (no coercion for 'in')
    return _q(tbl(spark, sf, "lineitem"), operation="filter_count", filter_by=[
        Filter("l_extendedprice", "gte", 10000), Filter("l_extendedprice", "lt", "50000"),
        Filter("l_linenumber", "in", [1, 3, 7, "x"])])


_QBINS = [BinSpec("l_quantity", [0, 10, 25, 50], ["low", "mid", "high"])]
_QCASE = ("CASE WHEN l_quantity >= 0 AND l_quantity <= 10 THEN 'low' "
          "WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'mid' "
          "WHEN l_quantity > 25 AND l_quantity <= 50 THEN 'high' END")


@register("bins_right_closed", f"""
SELECT {_QCASE} AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1
""")
def bins_right_closed(spark, sf):
    return _q(tbl(spark, sf, "lineitem"), operation="groupby_count", groupby=["l_quantity"], bins=_QBINS)


_DL = default_labels([0, 0.02, 0.05, 0.08])
_DCASE = (f"CASE WHEN l_discount >= 0 AND l_discount <= 0.02 THEN '{_DL[0]}' "
          f"WHEN l_discount > 0.02 AND l_discount <= 0.05 THEN '{_DL[1]}' "
          f"WHEN l_discount > 0.05 AND l_discount <= 0.08 THEN '{_DL[2]}' END")


@register("bins_default_labels", f"""
SELECT {_DCASE} AS l_discount, count(*) AS n FROM lineitem GROUP BY 1
""")
def bins_default_labels(spark, sf):
    # wrong label count → default interval labels; values above 0.08 fall outside → NULL
    return _q(tbl(spark, sf, "lineitem"), operation="value_counts", columns=["l_discount"],
              bins=[BinSpec("l_discount", [0, 0.02, 0.05, 0.08], ["only-one"])])


@register("bins_then_filter", f"""
SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {_QCASE} = 'high' GROUP BY l_returnflag
""")
def bins_then_filter(spark, sf):
    return _q(tbl(spark, sf, "lineitem"), operation="value_counts", columns=["l_returnflag"],
              bins=_QBINS, filter_by=[Filter("l_quantity", "eq", "HIGH")])


def _describe_sql(table: str, cols: list[str]) -> str:
    aggs = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        aggs += [f"CAST(count({x}) AS DOUBLE) AS count_{i}", f"avg({x}) AS mean_{i}", f"stddev_samp({x}) AS std_{i}",
                 f"min({x}) AS min_{i}", f"quantile_cont({x}, 0.25) AS q1_{i}", f"quantile_cont({x}, 0.5) AS q2_{i}",
                 f"quantile_cont({x}, 0.75) AS q3_{i}", f"max({x}) AS max_{i}"]
    parts = []
    for stat, key in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "q1"),
                      ("50%", "q2"), ("75%", "q3"), ("max", "max")]:
        sel = ", ".join(f"{r(f'{key}_{i}')} AS {c}" for i, c in enumerate(cols))
        parts.append(f"SELECT '{stat}' AS statistic, {sel} FROM s")
    return f"WITH s AS (SELECT {', '.join(aggs)} FROM {table}) " + " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql("orders", ["o_totalprice", "o_custkey"]))
def describe_numeric(spark, sf):
    return rounded(_q(tbl(spark, sf, "orders"), operation="describe", columns=["o_totalprice", "o_custkey"]))


@register("describe_all_numeric", _describe_sql("lineitem WHERE l_returnflag = 'N'", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def describe_all_numeric(spark, sf):
    return rounded(_q(tbl(spark, sf, "lineitem"), operation="describe",
                      filter_by=[Filter("l_returnflag", "eq", "n")]))


def _describe_text_sql(table: str, cols: list[str]) -> str:
    ctes, sels = [], {"count": [], "unique": [], "top": [], "freq": []}
    for i, c in enumerate(cols):
        ctes.append(f"t{i} AS (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL "
                    f"GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 1)")
        sels["count"].append(f"(SELECT CAST(count({c}) AS VARCHAR) FROM {table}) AS {c}")
        sels["unique"].append(f"(SELECT CAST(count(DISTINCT {c}) AS VARCHAR) FROM {table}) AS {c}")
        sels["top"].append(f"(SELECT v FROM t{i}) AS {c}")
        sels["freq"].append(f"(SELECT CAST(n AS VARCHAR) FROM t{i}) AS {c}")
    body = " UNION ALL ".join(f"SELECT '{k}' AS statistic, {', '.join(v)}" for k, v in sels.items())
    return "WITH " + ", ".join(ctes) + " " + body


@register("describe_text", _describe_text_sql("orders", ["o_orderpriority", "o_orderstatus"]))
def describe_text(spark, sf):
    return _q(tbl(spark, sf, "orders"), operation="describe", columns=["o_orderpriority", "o_orderstatus"])


@register("value_counts_null", f"""
SELECT quality, count(*) AS n FROM {DL} t GROUP BY quality
""")
def value_counts_null(spark, sf):
    return _q(docs_labels(spark, sf), operation="value_counts", columns=["quality"])


@register("value_counts_total_pct", f"""
SELECT quality, {r("round_even((CAST(n AS DOUBLE) / sum(n) OVER () * 100) * 10.0, 0) / 10.0")} AS pct
FROM (SELECT quality, count(*) AS n FROM {DL} t GROUP BY quality)
""")
def value_counts_total_pct(spark, sf):
    return rounded(_q(docs_labels(spark, sf), operation="value_counts", columns=["quality"], normalize="total_pct"))


@register("groupby_count_2key", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def groupby_count_2key(spark, sf):
    return _q(tbl(spark, sf, "lineitem"), operation="groupby_count", groupby=["l_returnflag", "l_linestatus"])


@register("groupby_count_row_pct_null_key", f"""
SELECT quality, toxic,
       CASE WHEN quality IS NULL THEN NULL ELSE
       {r("round_even((CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY quality) * 100) * 10.0, 0) / 10.0")} END AS pct
FROM (SELECT quality, toxic, count(*) AS n FROM {DL} t GROUP BY 1, 2)
""")
def groupby_count_row_pct_null_key(spark, sf):
    return rounded(_q(docs_labels(spark, sf), operation="groupby_count", groupby=["quality", "toxic"],
                      normalize="row_pct"))


@register("groupby_count_total_pct", f"""
SELECT l_returnflag, {r("round_even((CAST(n AS DOUBLE) / sum(n) OVER () * 100) * 10.0, 0) / 10.0")} AS pct
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
""")
def groupby_count_total_pct(spark, sf):
    return rounded(_q(tbl(spark, sf, "lineitem"), operation="groupby_count", groupby=["l_returnflag"],
                      normalize="row_pct"))


_AGG_SQL = {
    "mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)",
    "sum": "coalesce(sum(o_totalprice), 0)", "min": "min(o_totalprice)", "max": "max(o_totalprice)",
    "count": "count(o_totalprice)",
}


def _make_agg(agg: str):
    digits = 2 if agg == "sum" else 6
    expr = _AGG_SQL[agg] if agg == "count" else r(_AGG_SQL[agg], digits)

    @register(f"groupby_agg_{agg}", f"""
SELECT o_orderstatus, o_orderpriority, {expr} AS o_totalprice FROM orders GROUP BY 1, 2
""")
    def q(spark, sf):
        out = _q(tbl(spark, sf, "orders"), operation="groupby_agg", groupby=["o_orderstatus", "o_orderpriority"],
                 columns=["o_totalprice"], agg=agg)
        return rounded(out, digits)
    return q


for _agg in ("mean", "median", "sum", "min", "max", "count"):
    _make_agg(_agg)


@register("groupby_sum_all_null", f"""
SELECT quality, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM {DL} t GROUP BY quality
""")
def groupby_sum_all_null(spark, sf):
    # the NULL-quality group has only NULL toxic values: pandas sums that to 0
    return _q(docs_labels(spark, sf), operation="groupby_agg", groupby=["quality"], columns=["toxic"], agg="sum")


@register("groupby_agg_multi", f"""
SELECT l_returnflag,
  {r("round_even(avg(l_quantity) * 1000.0, 0) / 1000.0")} AS l_quantity,
  {r("round_even(avg(l_extendedprice) * 1000.0, 0) / 1000.0")} AS l_extendedprice,
  {r("round_even(avg(l_discount) * 1000.0, 0) / 1000.0")} AS l_discount
FROM lineitem GROUP BY 1
""")
def groupby_agg_multi(spark, sf):
    return rounded(_q(tbl(spark, sf, "lineitem"), operation="groupby_agg", groupby=["l_returnflag"],
                      columns=["l_quantity", "l_extendedprice", "l_discount"], agg="mean"))


_HIST_SQL = """
WITH v AS (SELECT CAST({col} AS DOUBLE) AS v FROM {table} WHERE {col} IS NOT NULL),
p AS (SELECT min(v) AS lo, max(v) AS hi,
             CAST(least(12, greatest(5, CAST(floor(sqrt(count(*)) + 0.5) AS INTEGER))) AS INTEGER) AS bins
      FROM v HAVING count(*) > 0),
q AS (SELECT lo, bins, CASE WHEN (hi - lo) / bins = 0 THEN 1.0 ELSE (hi - lo) / bins END AS w FROM p),
c AS (SELECT CAST(least(bins - 1, CAST(floor((v - lo) / w) AS INTEGER)) AS INTEGER) AS bin, count(*) AS n
      FROM v, q GROUP BY 1),
f AS (SELECT CAST(g.bin AS INTEGER) AS bin, lo, w FROM q, generate_series(0, q.bins - 1) AS g(bin))
SELECT f.bin, {r0} AS bin_start, {r1} AS bin_end, coalesce(c.n, 0) AS n FROM f LEFT JOIN c ON f.bin = c.bin
"""


@register("distribution_hist", _HIST_SQL.format(col="l_extendedprice", table="lineitem",
                                                r0=r("lo + f.bin * w", 4), r1=r("lo + (f.bin + 1) * w", 4)))
def distribution_hist(spark, sf):
    res = run_query(tbl(spark, sf, "lineitem"), DataQuery(operation="distribution", columns=["l_extendedprice"]))
    return rounded(res.chart.data, 4)


@register("distribution_describe", _describe_sql("lineitem", ["l_extendedprice"]))
def distribution_describe(spark, sf):
    return rounded(_q(tbl(spark, sf, "lineitem"), operation="distribution", columns=["l_extendedprice"]))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("correlation_long", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})')} AS r FROM lineitem"
    for a in _CORR_COLS for b in _CORR_COLS))
def correlation_long_q(spark, sf):
    return rounded(correlation_long(tbl(spark, sf, "lineitem"), _CORR_COLS))


@register("correlation_square", " UNION ALL ".join(
    f"SELECT '{a}' AS variable, " + ", ".join(
        f"{r(f'round_even(corr({a}, {b}) * 1000.0, 0) / 1000.0')} AS {b}" for b in _CORR_COLS) + " FROM lineitem"
    for a in _CORR_COLS))
def correlation_square(spark, sf):
    return rounded(_q(tbl(spark, sf, "lineitem"), operation="correlation", columns=_CORR_COLS))


@register("top_n_numeric", f"""
SELECT {r("o_totalprice")} AS o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST LIMIT 10
""")
def top_n_numeric(spark, sf):
    return rounded(_q(tbl(spark, sf, "orders"), operation="top_n", columns=["o_totalprice"], top_n=10))


@register("top_n_text", """
SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_brand ASC LIMIT 5
""")
def top_n_text(spark, sf):
    return _q(tbl(spark, sf, "part"), operation="top_n", columns=["p_brand"], top_n=5)


@register("missing_values", f"""
WITH t AS (SELECT * FROM {DL} x),
m AS (
  SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_missing FROM t UNION ALL
  SELECT 'lang', count(*) - count(lang) FROM t UNION ALL
  SELECT 'source', count(*) - count(source) FROM t UNION ALL
  SELECT 'n_chars', count(*) - count(n_chars) FROM t UNION ALL
  SELECT 'quality', count(*) - count(quality) FROM t UNION ALL
  SELECT 'toxic', count(*) - count(toxic) FROM t)
SELECT "column", n_missing,
       {r("round_even((CAST(n_missing AS DOUBLE) / (SELECT count(*) FROM t) * 100) * 10.0, 0) / 10.0")} AS pct_missing
FROM m WHERE n_missing > 0
""")
def missing_values(spark, sf):
    return rounded(_q(docs_labels(spark, sf), operation="missing_values"))


@register("missing_values_none", """
SELECT 'missing_values' AS metric, CAST(0 AS BIGINT) AS value
""")
def missing_values_none(spark, sf):
    return _q(tbl(spark, sf, "orders"), operation="missing_values")


@register("box_by_category", f"""
SELECT o_orderpriority, count(*) AS n, {r("min(o_totalprice)")} AS min,
  {r("quantile_cont(o_totalprice, 0.25)")} AS q1, {r("quantile_cont(o_totalprice, 0.5)")} AS median,
  {r("quantile_cont(o_totalprice, 0.75)")} AS q3, {r("max(o_totalprice)")} AS max
FROM orders GROUP BY 1
""")
def box_by_category(spark, sf):
    return rounded(charts.box_by_category(tbl(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@register("series_pivot", """
WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority,
  coalesce(max(CASE WHEN o_orderstatus = 'F' THEN CAST(n AS DOUBLE) END), 0.0) AS "F",
  coalesce(max(CASE WHEN o_orderstatus = 'O' THEN CAST(n AS DOUBLE) END), 0.0) AS "O",
  coalesce(max(CASE WHEN o_orderstatus = 'P' THEN CAST(n AS DOUBLE) END), 0.0) AS "P"
FROM g GROUP BY 1
""")
def series_pivot(spark, sf):
    res = run_query(tbl(spark, sf, "orders"), DataQuery(operation="groupby_count",
                                                        groupby=["o_orderpriority", "o_orderstatus"]))
    spec = res.chart
    return charts.series_pivot(spec.data, spec.x, spec.color, spec.y, colors=["F", "O", "P"])


@register("chart_choice", """
SELECT 'bar' AS chart_type, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT DISTINCT o_orderstatus FROM orders)
""")
def chart_choice(spark, sf):
    """A small comparative answer asked as 'table' is drawn as a bar chart."""
    res = run_query(tbl(spark, sf, "orders"), DataQuery(operation="value_counts", columns=["o_orderstatus"]))
    return res.table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(res.chart.type).alias("chart_type"), "n_rows")


# ------------------------------------------------------------------ missing numbers and odd names

def nan_orders(spark, sf):
    """orders with NaN prices for one priority, and a column whose name holds a dot."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return tbl(spark, sf, "orders").select("o_orderstatus", price.alias("price"), F.col("o_orderpriority").alias("o.priority"))


_NAN = ("(SELECT o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price, o_orderpriority FROM orders)")


@register("describe_nan", _describe_sql(f"{_NAN} t", ["price"]))
def describe_nan(spark, sf):
    return rounded(_q(nan_orders(spark, sf), operation="describe", columns=["price"]))


@register("groupby_agg_nan", f"SELECT o_orderstatus, {r('avg(price)')} AS price FROM {_NAN} t GROUP BY 1")
def groupby_agg_nan(spark, sf):
    return rounded(_q(nan_orders(spark, sf), operation="groupby_agg", groupby=["o_orderstatus"], columns=["price"], agg="mean"))


@register("groupby_median_nan", f"SELECT o_orderstatus, {r('quantile_cont(price, 0.5)')} AS price FROM {_NAN} t GROUP BY 1")
def groupby_median_nan(spark, sf):
    return rounded(_q(nan_orders(spark, sf), operation="groupby_agg", groupby=["o_orderstatus"], columns=["price"], agg="median"))


@register("missing_values_nan", f"""
SELECT 'price' AS "column", count(*) - count(price) AS n_missing,
  {r("round_even((count(*) - count(price)) / count(*) * 1000.0, 0) / 10.0")} AS pct_missing FROM {_NAN} t
""")
def missing_values_nan(spark, sf):
    return rounded(_q(nan_orders(spark, sf), operation="missing_values"))


@register("value_counts_dotted_name", f'SELECT o_orderpriority AS "o.priority", count(*) AS n FROM {_NAN} t GROUP BY 1')
def value_counts_dotted_name(spark, sf):
    return _q(nan_orders(spark, sf), operation="value_counts", columns=["o.priority"])
