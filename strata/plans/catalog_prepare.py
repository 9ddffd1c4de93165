"""Registered queries for preparation steps, table sources, checks and chart specs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import evaluate as E
from ..operators import prepare as P
from ..operators.query import DataQuery, QueryError, run_query
from ..operators.rules import select_columns
from ..sources.tables import load_table, preview
from ..session import table_path
from .catalog_cluster import supplier_points
from .registry import DOCS_LABELS_SQL, docs_labels, r, register, rounded, tbl


@register("loaded_table", "SELECT count(*) AS n, sum(o_totalprice) > 0 AS priced FROM orders")
def loaded_table(spark, sf):
    """A path by its extension, then the DataFrame as it is."""
    df = load_table(spark, load_table(spark, table_path(sf, "orders")))
    return df.agg(F.count("*").alias("n"), (F.sum("o_totalprice") > 0).alias("priced"))


@register("previewed_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def previewed_rows(spark, sf):
    """The first rows under an explicit order."""
    return preview(tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice"), order_by=["o_totalprice", "o_orderkey"])


@register("selected_columns", """
SELECT c_mktsegment, count(*) AS n, 'c_mktsegment,c_acctbal' AS columns FROM customer GROUP BY 1
""")
def selected_columns(spark, sf):
    """Wanted and existing columns in the wanted order; the rest is left out."""
    df = select_columns(tbl(spark, sf, "customer"), ["c_mktsegment", "no_such", "c_acctbal"])
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("columns", F.lit(",".join(df.columns)))


@register("rejected_queries", """
SELECT c_mktsegment, count(*) AS n, 'column `no_such` does not exist|group-by column `gone` does not exist|top_n needs columns' AS messages
FROM customer GROUP BY 1
""")
def rejected_queries(spark, sf):
    """What a query on missing columns is told, beside a query that stands."""
    df, told = tbl(spark, sf, "customer"), []
    for ask in (DataQuery("value_counts", columns=["no_such"]), DataQuery("groupby_count", groupby=["gone"]), DataQuery("top_n")):
        try:
            run_query(df, ask)
        except QueryError as error:
            told.append(str(error))
    return run_query(df, DataQuery("value_counts", columns=["c_mktsegment"])).table.withColumn("messages", F.lit("|".join(told)))


@register("dropped_columns", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", count({c}) > 0 AS kept FROM {DOCS_LABELS_SQL} t" for c in ("doc_id", "lang", "n_chars", "quality", "toxic")] +
    [f"SELECT '{c}', false" for c in ("source", "empty", "not_a_number")]))
def dropped_columns(spark, sf):
    """Requested columns that exist, then those without any value (NaN is none)."""
    df = docs_labels(spark, sf).withColumns({"empty": F.lit(None).cast("string"), "not_a_number": F.lit(float("nan"))})
    kept, dropped = P.drop_columns(df, ["source", "no_such"])
    return spark.createDataFrame([(c, True) for c in kept.columns] + [(c, False) for c in dropped], "column string, kept boolean")


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
_RANK = "CASE o_orderpriority " + " ".join(f"WHEN '{level}' THEN {i}.0::DOUBLE" for i, level in enumerate(_ORDER)) + " END"


@register("strategy_features", f"""
WITH t AS (SELECT o_orderkey, o_totalprice AS p, {_RANK} AS k FROM orders),
f AS (SELECT o_orderkey, p, coalesce(k, (SELECT quantile_cont(k, 0.5) FROM t)) AS k FROM t)
SELECT o_orderkey, {r("(p - (SELECT avg(p) FROM f)) / (SELECT stddev_pop(p) FROM f)")} AS price,
  {r("(k - (SELECT avg(k) FROM f)) / (SELECT stddev_pop(k) FROM f)")} AS priority FROM f
""")
def strategy_features(spark, sf):
    """The derived strategy over a number and an ordinal column with a level outside its order."""
    df = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    st = P.derive_strategy(df, {"o_orderpriority": _ORDER, "no_such": ["a"]})
    ready = P.prepare(df, st, keep=["o_orderkey"], columns=["o_totalprice", "o_orderpriority"]).df
    return rounded(ready.select("o_orderkey", F.col("features")[0].alias("price"), F.col("features")[1].alias("priority")))


_RICH = "CASE WHEN c_nationkey <> 7 THEN c_acctbal > 4000 END"


@register("boolean_dummies", f"""
WITH t AS (SELECT c_custkey, {_RICH} AS rich FROM customer),
f AS (SELECT c_custkey, coalesce(rich, (SELECT rich FROM t WHERE rich IS NOT NULL GROUP BY rich ORDER BY count(*) DESC, rich LIMIT 1)) AS rich FROM t)
SELECT c_custkey, CASE WHEN rich THEN 0.0::DOUBLE ELSE 1.0 END AS rich_false, CASE WHEN rich THEN 1.0::DOUBLE ELSE 0.0 END AS rich_true FROM f
""")
def boolean_dummies(spark, sf):
    """A boolean with missing values is a category: mode, then one dummy per truth value."""
    df = tbl(spark, sf, "customer").select("c_custkey", F.expr(_RICH).alias("rich"))
    ready = P.prepare(df, keep=["c_custkey"], columns=["rich"])
    return ready.df.select("c_custkey", *[F.col("features")[i].alias(name) for i, name in enumerate(ready.feature_names)])


@register("scale_scope", f"""
SELECT c_mktsegment AS feature, CAST(count(*) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS squares FROM customer GROUP BY 1
UNION ALL SELECT 'c_acctbal', 0.0, {r("count(*)", 3)} FROM customer
""")
def scale_scope(spark, sf):
    """Numbers are scaled (sum 0, squares n), the 0/1 dummies are not."""
    ready = P.prepare(tbl(spark, sf, "customer"), keep=[], columns=["c_acctbal", "c_mktsegment"])
    names = F.array(*[F.lit(n.removeprefix("c_mktsegment_")) for n in ready.feature_names])
    cells = ready.df.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))
    return rounded(cells.select(names[F.col("i")].alias("feature"), "total", "squares"), 3)


@register("label_encode_new_rows", f"""
WITH fit AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS i FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 25) t),
s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS d FROM part WHERE p_size <= 25)
SELECT p_partkey, {r("(p_size - s.m) / s.d")} AS size, CAST(coalesce(fit.i, -1) AS DOUBLE) AS name FROM part LEFT JOIN fit ON part.p_name = fit.p_name, s
""")
def label_encode_new_rows(spark, sf):
    """Labels fitted on the small parts, applied to all: a level not seen has a code of its own, never NULL."""
    part = tbl(spark, sf, "part")
    plan = P.fit_features(part.where("p_size <= 25"), P.Strategy(encoding="label"), columns=["p_size", "p_name"])
    ready = plan.transform(part, keep=["p_partkey"])
    return rounded(ready.select("p_partkey", F.col("features")[0].alias("size"), F.col("features")[1].alias("name")))


@register("k_limits", """
SELECT c_nationkey, CAST(greatest(least(10, greatest(2, count(*) // 10), count(*) - 1), 2) AS INTEGER) AS k_top FROM customer GROUP BY 1
""")
def k_limits(spark, sf):
    """M3: the largest number of groups looked at, for each nation's customers as a table of its own."""
    sizes = tbl(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).collect()  # one row per nation
    return spark.createDataFrame([(s["c_nationkey"], C.k_range(s["n"])[-1]) for s in sizes], "c_nationkey int, k_top int")


def _silhouette_sql(k: int) -> str:
    return f"""SELECT {k} AS k, avg(CASE WHEN own <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS s FROM (
  SELECT id, max(CASE WHEN l = m THEN n END) AS own, max(CASE WHEN l = m THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN l <> m THEN d / n END) AS b FROM (
    SELECT p.id, p.l % {k} AS l, q.l % {k} AS m, count(*) AS n, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS d
    FROM p, p q GROUP BY 1, 2, 3) GROUP BY id)"""


@register("silhouette_curve", f"""
WITH p AS (SELECT s_suppkey AS id, s_nationkey AS l, s_acctbal / 1000.0::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier)
SELECT k, {r("s")} AS silhouette FROM ({" UNION ALL ".join(_silhouette_sql(k) for k in (2, 3, 4, 5))}) t
""")
def silhouette_curve(spark, sf):
    """The scores of four labelings, all from one pass over the distances."""
    ks = (2, 3, 4, 5)
    points = supplier_points(spark, sf).join(tbl(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    found = E.silhouettes(points.select("features", *[(F.col("s_nationkey") % k).alias(f"k{k}") for k in ks]), [f"k{k}" for k in ks])
    return rounded(spark.createDataFrame([(k, found[f"k{k}"]) for k in ks], "k int, silhouette double"))


@register("chart_axes", """
SELECT c_mktsegment, count(*) AS n, 'value_counts bar c_mktsegment n -|groupby_count bar c_mktsegment pct c_nationkey|distribution histogram c_acctbal n -' AS axes
FROM customer GROUP BY 1
""")
def chart_axes(spark, sf):
    """Which columns of the answer stand on the chart's axes and colours."""
    df = tbl(spark, sf, "customer")
    asks = (DataQuery("value_counts", columns=["c_mktsegment"], chart_type="bar"),
            DataQuery("groupby_count", groupby=["c_mktsegment", "c_nationkey"], normalize="row_pct", chart_type="bar"),
            DataQuery("distribution", columns=["c_acctbal"]))
    done = [run_query(df, ask) for ask in asks]
    shown = "|".join(" ".join([d.operation, *(x or "-" for x in (d.chart.type, d.chart.x, d.chart.y, d.chart.color))]) for d in done)
    return done[0].table.withColumn("axes", F.lit(shown))
