"""Pairwise-complete Pearson correlations of many columns (D4, Q8) in one job.

Each task multiplies its batches as matrices: with X the values (missing ones 0) and M the mask of
values that are there, MᵀM counts the rows that both columns have, XᵀM, (X∘X)ᵀM and XᵀX give the sums
over just those rows. The matrices are added up inside the task and leave it as one row per pair of
columns; Spark adds the tasks' rows. The work per row is c², done by BLAS; the plan does not grow
with the number of columns.

Columns are taken relative to their least value, so sums of numbers far from zero keep their digits.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import null_if_not_finite
from ..functions.types import number

#: Share of a column's sum of squares below which its variance is rounding: no correlation.
NO_SPREAD = 1e-13
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pair_sums(width: int):
    i, j = np.triu_indices(width)

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            s, ss = x.T @ m, (x * x).T @ m  # [a, b]: sums of a over the rows that b has as well
            found = np.stack([(m.T @ m)[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], (x.T @ x)[i, j]])
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(v) for v in total]], ["i", "j", *_SUMS])

    return run


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, r) for every pair i ≤ j of places in ``columns``; r NULL with fewer than 2 complete rows or no spread."""
    cols = list(columns)
    low = df.agg(F.array(*[F.min(number(df, c)) for c in cols]).alias("m")).select("m").scalar()
    cells = F.transform(F.array(*[number(df, c) for c in cols]), lambda v, k: v - F.get(F.col("__low"), k))
    rows = df.withColumn("__low", low).select(F.transform(cells, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"))
    sums = rows.mapInArrow(_pair_sums(len(cols)), "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    added = sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n = F.col("n")
    vx, vy, cov = (F.col(a) - F.col(b) * F.col(c) / n for a, b, c in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    spread = (n >= 2) & (vx > F.col("sxx") * NO_SPREAD) & (vy > F.col("syy") * NO_SPREAD)
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(vx * vy))))
    return added.select("i", "j", F.when(spread, null_if_not_finite(r)).alias("r"))


def _names(columns: Sequence[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), place + 1)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) by places for every ordered pair, the empty table included (r NULL)."""
    both = correlations(df, columns)
    every = both.select(F.col("i").alias("a"), F.col("j").alias("b"), "r").unionByName(both.where("i < j").select(F.col("j").alias("a"), F.col("i").alias("b"), "r"))
    c = len(columns)
    frame = df.sparkSession.range(c * c).select(F.expr(f"CAST(id DIV {c} AS INT)").alias("a"), F.expr(f"CAST(id % {c} AS INT)").alias("b"), F.lit(None).cast("double").alias("r"))
    return every.unionByName(frame).groupBy("a", "b").agg(F.max("r").alias("r"))


def named_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) for every ordered pair."""
    return correlation_pairs(df, columns).select(_names(columns, F.col("a")).alias("col_a"), _names(columns, F.col("b")).alias("col_b"), "r")
