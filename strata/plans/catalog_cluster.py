"""Registered clustering queries (M*, G1, T12).

KMeans itself has no SQL statement. The queries below return what must hold for any right
result (rows add up, every row stands at its nearest centre, more restarts are not worse) or
decisions over a curve table, both with oracles; ``k_curve``, ``segment_flagship`` and ``pca_map``
return the fitted values themselves and are tested by properties.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import cluster as C
from ..operators import evaluate as E
from ..operators.charts import pca_map
from ..operators.prepare import fit_pca, prepare
from ..operators.ward import cut_tree, numbered_points, ward_merges
from ..session import staged
from .registry import r, register, rounded, tbl
from .segment import segment, summary_table


def customer_features(spark, sf):
    """customer ⟕ per-customer order aggregates (the order side is aggregated before the join)."""
    o = tbl(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total_spend"),
        F.avg("o_totalprice").alias("avg_order"))
    c = tbl(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").drop("o_custkey")


def staged_features(spark, sf):
    """``customer_features``, written once: many passes read it, and each would aggregate the orders again."""
    return staged(customer_features(spark, sf), "customers")


@register("segment_flagship")
def segment_flagship(spark, sf):
    """Flagship: rules → prepare → k search → KMeans → quality, on customers + order aggregates."""
    return summary_table(segment(staged_features(spark, sf)))


@register("k_curve")
def k_curve(spark, sf):
    """M4: k = 2..10, best of 10 restarts each, exact silhouettes."""
    search = C.search_k(prepare(staged_features(spark, sf).drop("c_custkey", "c_name")).df)
    return rounded(search.to_df(spark)).withColumn("chosen", F.col("k") == F.lit(search.optimal_k)) \
        .withColumn("elbow", F.col("k") == F.lit(search.elbow_k))


def line_curve(spark, sf):
    """A curve table from data: one point per line number, total price as inertia, mean discount as score."""
    return tbl(spark, sf, "lineitem").groupBy((F.col("l_linenumber") + 1).cast("int").alias("k")).agg(
        F.sum("l_extendedprice").alias("inertia"), F.avg("l_discount").alias("silhouette"))


_CURVE = ("(SELECT CAST(l_linenumber + 1 AS INTEGER) AS k, sum(l_extendedprice) AS inertia, avg(l_discount) AS silhouette "
          "FROM lineitem GROUP BY 1)")


@register("k_elbow", f"""
WITH c AS (SELECT k, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS x,
  (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS y FROM {_CURVE} t),
e AS (SELECT arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS x1, arg_max(y, k) AS y1 FROM c)
SELECT k FROM c, e ORDER BY round(abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)), 12) DESC, k LIMIT 1
""")
def k_elbow(spark, sf):
    return C.elbow(line_curve(spark, sf))


@register("k_two_regime", f"""
WITH c AS (SELECT k, silhouette, max(silhouette) OVER () - min(silhouette) OVER () < 0.03 AND count(*) OVER () > 1 AS flat
  FROM {_CURVE} t)
SELECT k, flat FROM c ORDER BY CASE WHEN flat AND k > 4 THEN 1 ELSE 0 END, silhouette DESC, k LIMIT 1
""")
def k_two_regime(spark, sf):
    return C.two_regime_k(line_curve(spark, sf))


def _off_centre(df, fit):
    """Rows that another centre is nearer to than their own."""
    far = [F.aggregate(F.zip_with("features", F.array(*[F.lit(x) for x in c]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda acc, v: acc + v)
           for c in fit.centers]
    own = F.element_at(F.array(*far), F.col("__pred") + 1)
    return fit.predict(df).where(own > F.array_min(F.array(*far)) + 1e-9).count()


def _checked(spark, df, fit, **more):
    sizes = E.cluster_sizes(C.assign(df, fit)).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_clusters"))
    return sizes.select("n_rows", "n_clusters", F.lit(_off_centre(df, fit)).cast("long").alias("n_off_centre"),
                        *[F.lit(v).alias(k) for k, v in more.items()])


@register("kmeans_labels", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_off_centre FROM customer")
def kmeans_labels(spark, sf):
    """M1/M8: best of 10 restarts; rows add up, no cluster is empty, every row is at its nearest centre."""
    df = prepare(tbl(spark, sf, "customer").drop("c_custkey", "c_name"), keep=["c_acctbal", "c_mktsegment"]).df
    return _checked(spark, df, C.kmeans(df, 4))


@register("refined_labels", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(10 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_off_centre, true AS not_worse FROM embeddings
""")
def refined_labels(spark, sf):
    """M7: a weak first pass (silhouette < 0.25) is refit once with 30 restarts; the cheaper fit stays."""
    df = tbl(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    rows = C.weighted_rows(df)
    first = C.kmeans(rows, 10)
    # of the 30 seeds the first pass has fitted the first ten, whose best is ``first``
    again = C.kmeans(rows, 10, n_init=K.REFINE_N_INIT - K.KMEANS_N_INIT, seed=K.RANDOM_SEED + K.KMEANS_N_INIT) if C.should_refine(C.score_fit(rows, first), 0) else first
    fit = min(first, again, key=lambda f: f.cost)
    return _checked(spark, df, fit, not_worse=fit.cost <= first.cost)


#: Ward by the cheapest pair again and again: the clusters of every step, with their members.
_WARD_SQL = """
WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY x, y) AS id, pt, x, y FROM
  (SELECT s_suppkey AS pt, s_acctbal / 1000.0::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier) t),
w AS (
  SELECT 0 AS step, id, 1.0::DOUBLE AS n, x, y, [pt] AS members, 0.0::DOUBLE AS cost FROM p
  UNION ALL
  SELECT w.step + 1, w.id, CASE WHEN w.id = m.s.a THEN m.s.n ELSE w.n END, CASE WHEN w.id = m.s.a THEN m.s.x ELSE w.x END,
    CASE WHEN w.id = m.s.a THEN m.s.y ELSE w.y END, CASE WHEN w.id = m.s.a THEN m.s.members ELSE w.members END, m.cost
  FROM w, (SELECT arg_min({'a': a.id, 'b': b.id, 'n': a.n + b.n, 'x': (a.x * a.n + b.x * b.n) / (a.n + b.n), 'y': (a.y * a.n + b.y * b.n) / (a.n + b.n),
      'members': list_concat(a.members, b.members)}, a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s,
      min(a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS cost FROM w a JOIN w b ON a.id < b.id) m
  WHERE w.id <> m.s.b)
"""


def supplier_points(spark, sf):
    return tbl(spark, sf, "supplier").select("s_suppkey", F.array(F.col("s_acctbal") / 1000.0, F.col("s_nationkey").cast("double")).alias("features"))


@register("hierarchical_labels", _WARD_SQL + """, g AS (SELECT id, n, members FROM w WHERE step = (SELECT count(*) - 4 FROM p)),
ranked AS (SELECT row_number() OVER (ORDER BY n DESC, id) - 1 AS cluster, members FROM g)
SELECT unnest(members) AS s_suppkey, CAST(cluster AS INTEGER) AS cluster FROM ranked
""")
def hierarchical_labels(spark, sf):
    """M2: the Ward group of every supplier, cut at four groups."""
    return C.hierarchical(supplier_points(spark, sf), 4).select("s_suppkey", "cluster")


@register("ward_merge_costs", _WARD_SQL + f"""
SELECT {r("cost")} AS cost FROM (SELECT DISTINCT step, cost FROM w WHERE step > 0) t
""")
def ward_merge_costs(spark, sf):
    """M2: the costs of all merges of the tree over the suppliers."""
    return rounded(ward_merges(numbered_points(supplier_points(spark, sf), "features")).select("cost"))


@register("hierarchical_customers", f"""
WITH p AS (SELECT c_acctbal / 1000.0::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_clusters, {r("var_pop(x) * count(*) + var_pop(y) * count(*)", 3)} AS total_cost FROM p
""")
def hierarchical_customers(spark, sf):
    """M2 over all customers: rows and groups add up, and the costs of all merges to the whole sum of squares."""
    df = tbl(spark, sf, "customer").select(F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("features"))
    points = numbered_points(df, "features")
    merges = ward_merges(points)
    found = points.join(cut_tree(merges, 4), "id", "left").select("w", F.coalesce("root", "id").alias("root"))
    groups = found.groupBy("root").agg(F.sum("w").alias("n")).agg(F.sum("n").cast("long").alias("n_rows"), F.count("*").alias("n_clusters"))
    return rounded(groups.withColumn("total_cost", merges.select(F.sum("cost")).scalar()), 3)


@register("bisecting_labels", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_clusters FROM customer")
def bisecting_labels(spark, sf):
    df = prepare(tbl(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")).df
    return E.cluster_sizes(C.bisecting(df, 4)).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_clusters"))


@register("pca_components", f"""
WITH m AS (SELECT var_samp(c_acctbal) AS a, var_samp(c_nationkey * 300.0) AS c, covar_samp(c_acctbal, c_nationkey * 300.0) AS b FROM customer),
e AS (SELECT sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) / (a + c) AS d FROM m)
SELECT 1 AS component, {r("0.5 + d")} AS ratio FROM e UNION ALL SELECT 2, {r("0.5 - d")} FROM e
""")
def pca_components(spark, sf):
    """Shares of the variance of two features, against the closed form of a 2 × 2 matrix."""
    c = tbl(spark, sf, "customer").select(F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey") * F.lit(300.0)).alias("features"))
    ratios = fit_pca(c, "features", 0.9999999).ratios
    return rounded(spark.createDataFrame([(i + 1, x) for i, x in enumerate(ratios)], "component int, ratio double"))


@register("pca_map")
def pca_map_q(spark, sf):
    """G1: 2-D coordinates (4 dp) with the label, for plotting."""
    emb = tbl(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"),
                                              F.col("embedding").cast("array<double>").alias("features"))
    return pca_map(emb, "features", "cluster", keep=["vec_id"])
