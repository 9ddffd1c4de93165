"""Planted-segment data generator (S13): scales to any n with ``spark.range``.

Each row draws a profile by its share, then clipped normal numeric columns and weighted
categorical columns conditioned on the profile. Used as a clustering fixture in tests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Profile shares and per-profile parameters of our own fixture (not the reference's demo).
SHARES = (0.26, 0.30, 0.19, 0.25)
NUMERIC = {
    # column: [(mean, sd) per profile], clip range
    # profiles sit at different corners (not on one line), so four groups are the natural answer
    "hours": ([(8.0, 0.6), (2.0, 0.6), (8.0, 0.6), (2.0, 0.6)], (0.5, 12.0)),
    "sessions": ([(30, 3), (30, 3), (5, 2), (5, 2)], (1, 60)),
    "wellbeing": ([(2.5, 0.6), (8.5, 0.6), (8.5, 0.6), (2.5, 0.6)], (1.0, 10.0)),
    "age": ([(25, 3), (25, 3), (55, 4), (55, 4)], (16, 80)),
}
CATEGORICAL = {
    "slot": (["night", "morning", "evening"], [(0.7, 0.1, 0.2), (0.1, 0.6, 0.3), (0.2, 0.2, 0.6), (0.05, 0.8, 0.15)]),
    "device": (["phone", "laptop", "tablet"], [(0.8, 0.1, 0.1), (0.3, 0.6, 0.1), (0.6, 0.2, 0.2), (0.3, 0.2, 0.5)]),
}


def _pick(u: Column, probs) -> Column:
    """Index chosen by cumulative probabilities for a uniform draw ``u``."""
    acc, expr = 0.0, None
    for i, p in enumerate(probs[:-1]):
        acc += p
        expr = F.when(u < acc, F.lit(i)) if expr is None else expr.when(u < acc, F.lit(i))
    return expr.otherwise(F.lit(len(probs) - 1))


def planted_segments(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    base = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "row_id")
    draws = [F.rand(seed + 100 + j).alias(f"__u{j}") for j in range(len(CATEGORICAL))]
    base = base.select("row_id", F.rand(seed).alias("__p"), *draws)
    base = base.withColumn("profile", _pick(F.col("__p"), SHARES))
    cols = [F.col("row_id"), F.col("profile")]
    for j, (name, (params, (lo, hi))) in enumerate(NUMERIC.items()):
        mean = F.element_at(F.array(*[F.lit(float(m)) for m, _ in params]), F.col("profile") + 1)
        sd = F.element_at(F.array(*[F.lit(float(s)) for _, s in params]), F.col("profile") + 1)
        v = F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), mean + sd * F.randn(seed + 1 + j)))
        cols.append(F.round(v, 2).alias(name))
    for j, (name, (levels, per)) in enumerate(CATEGORICAL.items()):
        u = F.col(f"__u{j}")
        choice = None
        for pi, probs in enumerate(per):
            idx = _pick(u, probs)
            lvl = F.element_at(F.array(*[F.lit(x) for x in levels]), idx + 1)
            choice = F.when(F.col("profile") == pi, lvl) if choice is None else choice.when(F.col("profile") == pi, lvl)
        cols.append(choice.alias(name))
    return base.select(*cols)
