"""Registered queries for preparation (T*), evaluation (E*), charts on clusters
and clustering (M*, rows-only)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ladders import caution_silhouette_col, caution_size_col, grade_col, grade_label_col, \
    raise_caution_col
from ..functions.rounding import round_half_even
from ..operators import charts, evaluate as E, evidence as V, prepare as P
from .registry import DOCS_LABELS_SQL, docs_labels, r, register, rounded, tbl

DL = DOCS_LABELS_SQL


def orders_by_status(spark, sf):
    """orders with ``cluster`` = alphabetical index of o_orderstatus (a given label column)."""
    o = tbl(spark, sf, "orders")
    return P.dense_index(o.withColumn("cluster", F.col("o_orderstatus")), "cluster").withColumn(
        "cluster", F.col("cluster").cast("int"))


OBS = "(SELECT *, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS cluster FROM orders)"
EMB = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label <> -1)"


def embeddings(spark, sf):
    return tbl(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"),
                                                F.col("embedding").cast("array<double>").alias("features"))


# ------------------------------------------------------------------ preparation

@register("ordinal_encode", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1
  WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS DOUBLE) AS o_orderpriority FROM orders
""")
def ordinal_encode(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    # duplicate "3-MEDIUM" keeps its first position
    return P.ordinal_encode(o, "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "3-MEDIUM",
                                                   "1-URGENT"])


def _impute_sql(fill: str) -> str:
    return f"""
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT {r(fill)} FROM {DL} s)) AS quality FROM {DL} t
"""


@register("impute_median", _impute_sql("quantile_cont(quality, 0.5)"))
def impute_median(spark, sf):
    d = docs_labels(spark, sf).select("doc_id", "quality")
    out, _ = P.impute(d, ["quality"], [], "median")
    return rounded(out)


@register("impute_mean", _impute_sql("avg(quality)"))
def impute_mean(spark, sf):
    d = docs_labels(spark, sf).select("doc_id", "quality")
    out, _ = P.impute(d, ["quality"], [], "mean")
    return rounded(out)


@register("impute_mode_cat", """
WITH p AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL ELSE p_type END AS p_type FROM part),
m AS (SELECT p_type FROM p WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)
SELECT p_partkey, coalesce(p_type, (SELECT p_type FROM m)) AS p_type FROM p
""")
def impute_mode_cat(spark, sf):
    p = tbl(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 10, None)
                                      .otherwise(F.col("p_type")).alias("p_type"))
    out, _ = P.impute(p, [], ["p_type"], "mode")
    return out


def _onehot_sql() -> str:
    return """
WITH f AS (SELECT p_brand AS v, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
rk AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) AS rank, count(*) OVER () AS levels FROM f),
kept AS (SELECT v FROM rk WHERE levels <= 12 OR rank <= 11)
SELECT p.p_partkey, CAST(k.v AS VARCHAR) AS level,
       CAST(CASE WHEN p.p_brand = k.v THEN 1 ELSE 0 END AS DOUBLE) AS value
FROM part p, kept k
UNION ALL
SELECT p.p_partkey, 'infrequent_sklearn' AS level,
       CAST(CASE WHEN p.p_brand IS NOT NULL AND p.p_brand NOT IN (SELECT v FROM kept) THEN 1 ELSE 0 END AS DOUBLE)
FROM part p WHERE (SELECT max(levels) FROM rk) > 12
"""


@register("onehot_capped", _onehot_sql())
def onehot_capped(spark, sf):
    """T6 in long form (p_partkey, level, value): 11 kept brands + the infrequent bucket."""
    p = tbl(spark, sf, "part").select("p_partkey", "p_brand")
    plan = P.onehot_levels(p, ["p_brand"])
    cols = P.onehot_columns(plan)
    wide = p.select("p_partkey", *[e.alias(n) for n, e in cols])
    names = [n for n, _ in cols]
    return wide.unpivot(["p_partkey"], names, "level", "value").select(
        "p_partkey", F.regexp_replace("level", "^p_brand_", "").alias("level"), "value")


@register("label_encode", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type FROM part
""")
def label_encode(spark, sf):
    p = tbl(spark, sf, "part").select("p_partkey", "p_type")
    return P.dense_index(p, "p_type").withColumn("p_type", F.col("p_type").cast("int"))


@register("scale_standard", f"""
SELECT c_custkey, {r("(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)")} AS c_acctbal,
  {r("(c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer)")} AS c_nationkey
FROM customer
""")
def scale_standard(spark, sf):
    c = tbl(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return rounded(P.scale(c, ["c_acctbal", "c_nationkey"], "standard"))


@register("scale_minmax", f"""
SELECT c_custkey, {r("(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer))")} AS c_acctbal
FROM customer
""")
def scale_minmax(spark, sf):
    c = tbl(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(P.scale(c, ["c_acctbal"], "minmax"))


@register("scale_robust", f"""
SELECT c_custkey, {r("(c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer)) / ((SELECT quantile_cont(c_acctbal, 0.75) FROM customer) - (SELECT quantile_cont(c_acctbal, 0.25) FROM customer))")} AS c_acctbal
FROM customer
""")
def scale_robust(spark, sf):
    c = tbl(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(P.scale(c, ["c_acctbal"], "robust"))


# ------------------------------------------------------------------ evaluation on given labels

@register("cluster_sizes", f"SELECT cluster, count(*) AS n FROM {OBS} t GROUP BY 1")
def cluster_sizes(spark, sf):
    return E.cluster_sizes(orders_by_status(spark, sf))


@register("segment_prevalence", f"""
SELECT cluster, count(*) AS n,
  {r("round_even((CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) * 100) * 10.0, 0) / 10.0")} AS pct
FROM {OBS} t GROUP BY 1
""")
def segment_prevalence(spark, sf):
    return rounded(E.cluster_share(orders_by_status(spark, sf)))


_NP_COLS = ["o_totalprice", "o_custkey"]


@register("numeric_profile", " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS \"column\", {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}, 0.5)')} AS median, "
    f"{r(f'stddev_samp({c})')} AS std FROM {OBS} t GROUP BY cluster" for c in _NP_COLS))
def numeric_profile(spark, sf):
    return rounded(E.numeric_profile(orders_by_status(spark, sf), _NP_COLS))


@register("category_profile", f"""
SELECT cluster, 'o_orderpriority' AS "column", value, n, rk = 1 AS is_mode FROM (
  SELECT cluster, CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS n,
         row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, CAST(o_orderpriority AS VARCHAR)) AS rk
  FROM {OBS} t WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2)
""")
def category_profile(spark, sf):
    return E.category_profile(orders_by_status(spark, sf), ["o_orderpriority"])


_SIL_SQL = f"""
WITH e AS {EMB},
sz AS (SELECT label, count(*) AS n FROM e GROUP BY label),
d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v)) AS s
      FROM e a, e b GROUP BY 1, 2, 3),
p AS (SELECT d.vec_id, d.la, d.lb, d.s / CASE WHEN d.la = d.lb THEN greatest(sz.n - 1, 1) ELSE sz.n END AS m
      FROM d JOIN sz ON d.lb = sz.label),
q AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b
      FROM p GROUP BY 1, 2),
sil AS (SELECT avg(CASE WHEN so.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS s
        FROM q JOIN sz so ON q.la = so.label)
"""


@register("silhouette_exact", _SIL_SQL + f"SELECT {r('s')} AS silhouette FROM sil")
def silhouette_exact(spark, sf):
    s = E.silhouette(embeddings(spark, sf), "features", "cluster")
    return rounded(spark.createDataFrame([(s,)], "silhouette double"))


@register("quality_grade", _SIL_SQL + f"""
SELECT {r('s', 4)} AS silhouette,
  CASE WHEN s IS NULL OR isnan(s) THEN '—' WHEN s >= 0.5 THEN 'A' WHEN s >= 0.3 THEN 'B' WHEN s >= 0.15 THEN 'C' ELSE 'D' END AS grade,
  CASE WHEN s IS NULL OR isnan(s) THEN 'Sin calcular' WHEN s >= 0.5 THEN 'Excelente' WHEN s >= 0.3 THEN 'Buena'
       WHEN s >= 0.15 THEN 'Aceptable' ELSE 'Baja' END AS grade_label,
  CASE WHEN s IS NULL OR isnan(s) OR s < 0.25 THEN 'alta' WHEN s < 0.5 THEN 'media' ELSE 'baja' END AS caution
FROM sil
""")
def quality_grade_q(spark, sf):
    s = E.silhouette(embeddings(spark, sf), "features", "cluster")
    one = spark.createDataFrame([(s,)], "s double")
    return one.select(round_half_even(F.col("s"), 4).alias("silhouette"), grade_col(F.col("s")).alias("grade"),
                      grade_label_col(F.col("s")).alias("grade_label"),
                      caution_silhouette_col(F.col("s")).alias("caution"))


_LONG_EMB = f"(SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {EMB} e)"


@register("inertia_given_labels", f"""
WITH u AS {_LONG_EMB}, per AS (SELECT label, i, var_pop(x) * count(*) AS ss FROM u GROUP BY 1, 2)
SELECT {r('coalesce(sum(ss), 0.0)', 4)} AS inertia FROM per
""")
def inertia_given_labels(spark, sf):
    return rounded(E.inertia(embeddings(spark, sf)), 4)


@register("calinski_harabasz", f"""
WITH u AS {_LONG_EMB},
per AS (SELECT label, i, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM u GROUP BY 1, 2),
tot AS (SELECT i, avg(x) AS gm FROM u GROUP BY 1),
agg AS (SELECT sum(n * (m - gm) * (m - gm)) AS b, sum(ss) AS w, count(DISTINCT label) AS k FROM per JOIN tot USING (i)),
nn AS (SELECT count(*) AS n FROM {EMB} e)
SELECT {r('CASE WHEN k < 2 THEN NULL WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (n - k)) END')} AS calinski_harabasz
FROM agg, nn
""")
def calinski_harabasz(spark, sf):
    return rounded(E.calinski_harabasz(embeddings(spark, sf)))


@register("davies_bouldin", f"""
WITH u AS {_LONG_EMB},
cen AS (SELECT label, i, avg(x) AS c FROM u GROUP BY 1, 2),
rd AS (SELECT u.vec_id, u.label, sqrt(sum((u.x - cen.c) * (u.x - cen.c))) AS d FROM u JOIN cen USING (label, i) GROUP BY 1, 2),
s AS (SELECT label, avg(d) AS s FROM rd GROUP BY 1),
cc AS (SELECT a.label AS li, b.label AS lj, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dij
       FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
ra AS (SELECT li, max(CASE WHEN dij = 0 THEN 0.0 ELSE (si.s + sj.s) / dij END) AS r
       FROM cc JOIN s si ON si.label = cc.li JOIN s sj ON sj.label = cc.lj GROUP BY li)
SELECT {r('CASE WHEN count(*) < 2 THEN NULL ELSE avg(r) END')} AS davies_bouldin FROM ra
""")
def davies_bouldin(spark, sf):
    return rounded(E.davies_bouldin(embeddings(spark, sf)))


_EV_NUM = ["o_totalprice", "o_custkey", "o_orderkey"]


@register("evidence_numeric", f"""
WITH t AS {OBS},
lv AS ({" UNION ALL ".join(f"SELECT cluster, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM t" for c in _EV_NUM)}),
gm AS (SELECT cluster, col, avg(v) AS group_mean FROM lv GROUP BY 1, 2),
tm AS (SELECT col, avg(v) AS total_mean, stddev_samp(v) AS total_std FROM lv GROUP BY 1),
j AS (SELECT gm.cluster, gm.col, group_mean, total_mean, (group_mean - total_mean) / total_std AS z
      FROM gm JOIN tm USING (col) WHERE total_std > 0 AND group_mean IS NOT NULL AND total_mean IS NOT NULL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, col) AS INTEGER) AS rank FROM j)
SELECT cluster, rank, col AS "column", {r('group_mean')} AS group_mean, {r('total_mean')} AS total_mean, {r('z')} AS z
FROM k WHERE rank <= 5
""")
def evidence_numeric(spark, sf):
    return rounded(V.numeric_evidence(orders_by_status(spark, sf), _EV_NUM))


_EV_CAT = ["o_orderpriority", "o_orderstatus"]


@register("evidence_categorical", f"""
WITH t AS {OBS},
lv AS ({" UNION ALL ".join(f"SELECT cluster, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM t WHERE {c} IS NOT NULL" for c in _EV_CAT)}),
g AS (SELECT cluster, col, value, count(*) AS n FROM lv GROUP BY 1, 2, 3),
gs AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY cluster, col) AS group_share,
              row_number() OVER (PARTITION BY cluster, col ORDER BY n DESC, value) AS lvl FROM g),
ts AS (SELECT col, value, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY col) AS total_share FROM g GROUP BY 1, 2),
j AS (SELECT gs.cluster, gs.col, gs.value, group_share, coalesce(total_share, 0.0) AS total_share,
             group_share - coalesce(total_share, 0.0) AS gap
      FROM gs LEFT JOIN ts USING (col, value) WHERE lvl <= 6),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY gap DESC, col, value) AS INTEGER) AS rank
      FROM j WHERE gap >= 0.05)
SELECT cluster, rank, col AS "column", value, {r('group_share')} AS group_share, {r('total_share')} AS total_share,
       {r('gap')} AS gap FROM k WHERE rank <= 4
""")
def evidence_categorical(spark, sf):
    return rounded(V.categorical_evidence(orders_by_status(spark, sf), _EV_CAT))


@register("caution_floor", """
SELECT c_nationkey, count(*) AS n,
  CASE WHEN count(*) < 30 THEN 'alta' WHEN count(*) < 100 THEN 'media' ELSE 'baja' END AS size_floor,
  CASE WHEN count(*) < 30 THEN 'alta' ELSE 'media' END AS caution
FROM customer GROUP BY 1
""")
def caution_floor(spark, sf):
    """An existing 'media' level is only ever raised by the group-size floor."""
    g = tbl(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    floor = caution_size_col(F.col("n"))
    return g.select("c_nationkey", "n", floor.alias("size_floor"),
                    raise_caution_col(F.lit("media"), floor).alias("caution"))


@register("radar_scaled", f"""
WITH t AS {OBS},
m AS ({" UNION ALL ".join(f"SELECT cluster, '{c}' AS axis, coalesce(avg(CAST({c} AS DOUBLE)), 0.0) AS raw FROM t GROUP BY 1" for c in _EV_NUM)}),
w AS (SELECT *, min(raw) OVER (PARTITION BY axis) AS lo, max(raw) OVER (PARTITION BY axis) AS hi FROM m)
SELECT axis, cluster,
  {r("CASE WHEN hi - lo <> 0 THEN round_even(((raw - lo) / (hi - lo)) * 10000.0, 0) / 10000.0 ELSE 0.5 END")} AS value,
  {r("round_even(raw * 1000.0, 0) / 1000.0")} AS raw_value FROM w
""")
def radar_scaled(spark, sf):
    lab = orders_by_status(spark, sf)
    return rounded(charts.radar(E.numeric_profile(lab, _EV_NUM), _EV_NUM))


@register("box_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", cluster, " + ", ".join(
        f"{r(f'round_even({e} * 1000.0, 0) / 1000.0')} AS {n}" for e, n in [
            (f"min(CAST({c} AS DOUBLE))", "min"), (f"quantile_cont(CAST({c} AS DOUBLE), 0.25)", "q1"),
            (f"quantile_cont(CAST({c} AS DOUBLE), 0.5)", "median"), (f"quantile_cont(CAST({c} AS DOUBLE), 0.75)", "q3"),
            (f"max(CAST({c} AS DOUBLE))", "max")]) + f" FROM {OBS} t WHERE {c} IS NOT NULL GROUP BY cluster"
    for c in _NP_COLS))
def box_stats(spark, sf):
    return rounded(charts.box_stats(orders_by_status(spark, sf), _NP_COLS))
