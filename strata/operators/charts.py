"""Chart-ready tables (G1–G9): only aggregates, never raw rows, leave Spark."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rounding import round_half_even
from ..functions.types import number, present, q
from .quantiles import exact_quantiles, group_key


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins over [min, max]; clamp(round(sqrt(n)), 5, 12) bins; last bin closed.

    Empty bins are present with n = 0. Bin bounds come from one scalar aggregate.
    """
    vals = df.select(number(df, column).alias("v")).where(F.col("v").isNotNull())
    stats = vals.agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    bins_expr = F.least(F.lit(K.HIST_MAX_BINS), F.greatest(F.lit(K.HIST_MIN_BINS),
                        F.floor(F.sqrt(F.col("cnt")) + 0.5).cast("int")))
    params = stats.where(F.col("cnt") > 0).select(
        "lo", bins_expr.alias("bins"),
        F.when((F.col("hi") - F.col("lo")) / bins_expr == 0, F.lit(1.0))
        .otherwise((F.col("hi") - F.col("lo")) / bins_expr).alias("w"))
    # bounds as ONE scalar subquery attached as a column (referenced fields reuse it)
    p = params.select(F.struct("lo", "bins", "w").alias("p")).scalar()
    lo, bins, w = F.col("__p.lo"), F.col("__p.bins"), F.col("__p.w")
    counted = vals.withColumn("__p", p).select(F.least(bins - 1, F.floor((F.col("v") - lo) / w).cast("int"))
                                               .alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # the bin frame has at most HIST_MAX_BINS rows: broadcasting it is bounded
    frame = params.select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "w")
    return (frame.join(counted, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_end"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def _boxes(df: DataFrame, columns: Sequence[str], keys: Sequence[str], digits: int | None) -> DataFrame:
    """(keys..., column, n, min, q1, median, q3, max) per group and column, NULL keys kept."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns])
    plain = (df.select(group_key(keys).alias("__k"), F.inline(cells)).where(F.col("v").isNotNull())
             .groupBy("__k", "column").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max")))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75), keys).select(group_key(keys).alias("__k"), "column", "q")
    out = plain.join(quartiles, ["__k", "column"])
    values = {"min": F.col("min"), "q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2], "max": F.col("max")}
    shown = [(v if digits is None else round_half_even(v, digits)).alias(n) for n, v in values.items()]
    return out.select(*[F.col("__k")[f"k{i}"].alias(k) for i, k in enumerate(keys)], "column", "n", *shown)


def box_by_category(df: DataFrame, x: str, y: str, digits: int | None = None) -> DataFrame:
    """Min, q1, median, q3, max of ``y`` per ``x`` category, a NULL category included."""
    src = df.select(present(df, x).cast("string").alias("x"), q(y).alias("y"))
    return _boxes(src, ["y"], ["x"], digits).drop("column").withColumnRenamed("x", x)


def series_pivot(df: DataFrame, x: str, color: str, y: str, colors: Sequence[str] | None = None) -> DataFrame:
    """(x, color, y) → one column per color value, missing → 0.

    Pass ``colors`` when known; otherwise Spark collects the distinct values (bounded by
    ``spark.sql.pivotMaxValues``).
    """
    src = df.select(q(x).cast("string").alias("x"), q(color).alias("color"), q(y).cast("double").alias("y"))
    piv = src.groupBy("x").pivot("color", list(colors) if colors is not None else None).agg(F.first("y"))
    return piv.select(F.col("x").alias(x), *[F.coalesce(q(c), F.lit(0.0)).alias(c) for c in piv.columns if c != "x"])


def box_stats(labelled: DataFrame, numeric_cols: Sequence[str], cluster_col: str = "cluster",
              digits: int = 3) -> DataFrame:
    """(column, cluster, min, q1, median, q3, max) rounded to 3 dp; empty groups omitted."""
    return _boxes(labelled, list(numeric_cols), [cluster_col], digits).select("column", q(cluster_col), "min", "q1", "median", "q3", "max")


def radar(numeric_profile: DataFrame, axes: Sequence[str], cluster_col: str = "cluster") -> DataFrame:
    """Per (axis, cluster) mean, min-max scaled across clusters (4 dp, equal → 0.5).

    ``numeric_profile`` is the long (cluster, column, mean, …) profile; a NULL mean counts as 0.
    """
    p = numeric_profile.where(F.col("column").isin(list(axes))).select(
        cluster_col, F.col("column").alias("axis"), F.coalesce(F.col("mean"), F.lit(0.0)).alias("raw"))
    w = Window.partitionBy("axis")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    scaled = F.when(hi - lo != 0, round_half_even((F.col("raw") - lo) / (hi - lo), 4)).otherwise(F.lit(0.5))
    return p.select("axis", cluster_col, scaled.alias("value"), round_half_even(F.col("raw"), 3).alias("raw_value"))


def pca_map(df: DataFrame, features: str = "features", label: str = "cluster", keep=(), digits: int = 4
            ) -> DataFrame:
    """G1: two PCA axes (4 dp) plus the label.

    Exactly 2 features are used as they are; fewer than 2 give an empty table. Components
    come from Spark ML PCA on centred vectors (a d×2 matrix on the driver); each axis'
    sign is fixed so its largest-magnitude loading is positive; projection is a column
    expression, so rows never leave the executors.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    first = df.select(features).where(F.col(features).isNotNull()).first()
    d = len(first[0]) if first else 0
    x = F.col(features)
    if d < 2:
        return df.limit(0).select(*keep, label, F.lit(0.0).alias("PC1"), F.lit(0.0).alias("PC2"))
    if d == 2:
        return df.select(*keep, label, round_half_even(x[0], digits).alias("PC1"), round_half_even(x[1], digits).alias("PC2"))
    vec = df.select(array_to_vector(features).alias("__v"))
    sc = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(vec)
    mean = list(sc.mean)
    pc = PCA(k=2, inputCol="__c", outputCol="__p").fit(sc.transform(vec)).pc.toArray()
    axes = []
    for j in range(2):
        col = pc[:, j]
        if col[abs(col).argmax()] < 0:
            col = -col
        centred = F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
        proj = F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(w)) for w in col]), lambda a, b: a * b),
                           F.lit(0.0), lambda acc, v: acc + v)
        axes.append(round_half_even(proj, digits).alias(f"PC{j + 1}"))
    return df.select(*keep, label, *axes)
