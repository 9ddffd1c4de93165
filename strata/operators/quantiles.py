"""Exact quantiles by successive narrowing: ranks are found in histograms, values never move in bulk.

1. Every value falls in one of about 90,000 fixed bins (64 a factor of e, by sign and size). One
   aggregate per (group, column, bin), combined map-side, counts them; running counts over
   the bins give each wanted rank ⌊(n−1)p⌋, ⌈(n−1)p⌉ its bin.
2. A second scan keeps the values of those bins only and counts them in ``FINE`` equal parts
   between the bin's least and largest value: the ranks get their part.
3. A third scan keeps the values of those parts only, counts equal ones, and running counts
   pick the values at the ranks. Results are linear interpolation between them.

Bins are monotone in the value, so the counts before a bin are exact and so is the result, whatever
the distribution; a part that holds much is sorted by Spark, which spills. What leaves a task is
bounded by bins, not by values, and a value that holds most rows is one row per task.

The wanted bins are at most two per quantile, column and group. Without groups that is bounded by the
table's width: they are broadcast and the whole plan is lazy. With groups they are written once and
counted: up to ``FEW`` rows are broadcast, more are joined with values that were combined per
(group, column, value) first, salted so that a hot group's bin is split.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import number, q
from ..session import staged

COLUMN, QUANTILES = "column", "q"
PER_E, FINE, FEW, SALTS = 64, 4096, 50_000, 32


def group_key(keys: Sequence[str]) -> Column:
    """All keys as one struct: grouping and joining on it treats NULL keys as equal."""
    return F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)


def unpack_key(keys: Sequence[str], key: str = "__k") -> list[Column]:
    return [F.col(key)[f"k{i}"].alias(k) for i, k in enumerate(keys)]


def _coarse(v: Column) -> Column:
    return F.floor(F.signum(v) * F.least(F.ln(F.lit(1.0) + F.abs(v)), F.lit(1000.0)) * PER_E)


def _fine(v: Column, lo: Column, hi: Column) -> Column:
    """Part of [lo, hi] from 0 to FINE − 1, monotone even where the width overflows."""
    part = F.nanvl((v - lo) / (hi - lo), F.lit(0.5))
    return F.when(v == lo, 0).when(v == hi, FINE - 1).otherwise(F.lit(1) + F.floor(part * (FINE - 3))).cast("int")


def _ranks(probs: Sequence[float]) -> list[Column]:
    places = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    return [f(place).cast("long") for place in places for f in (F.floor, F.ceil)]


def _wanted(probs: Sequence[float]) -> Column:
    """Whether a row that covers ranks [stop − n, stop) holds a wanted one."""
    hit = F.lit(False)
    for rank in _ranks(probs):
        hit = hit | ((rank >= F.col("stop") - F.col("n")) & (rank < F.col("stop")))
    return hit


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., column, q ARRAY<DOUBLE> in the order of ``probs``) per group and column.

    NULL and NaN are no values; a group or column without values gives no row. NULL keys
    form a group of their own.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), number(df, c).alias("v")) for i, c in enumerate(columns)])
    values = df.select(group_key(keys).alias("__k"), F.inline(cells)).where(F.col("v").isNotNull()).withColumn("bin", _coarse(F.col("v")))
    group, on = Window.partitionBy("__k", "c"), ["__k", "c", "bin"]

    counted = values.groupBy(*on).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    running = counted.withColumn("total", F.sum("n").over(group)).withColumn("stop", F.sum("n").over(group.orderBy("bin")))
    bins = running.where(_wanted(probs)).select(*on, "lo", "hi", "total", (F.col("stop") - F.col("n")).alias("before"))
    few = True
    if keys:
        bins = staged(bins, "quantile-bins")
        few = bins.count() <= FEW
    if few:
        source = values.withColumn("n", F.lit(1))
        met = lambda side: source.join(F.broadcast(side), on)
    else:
        salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
        source = values.groupBy(*on, "v").agg(F.count("*").alias("n")).withColumn("salt", salt)
        met = lambda side: source.join(side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"])

    first = [F.first(c).alias(c) for c in ("total", "before")]
    parts = met(bins).withColumn("part", _fine(F.col("v"), F.col("lo"), F.col("hi"))).groupBy(*on, "part").agg(
        F.sum("n").alias("n"), F.min("v").alias("from"), F.max("v").alias("upto"), *first)
    inside = Window.partitionBy(*on).orderBy("part")
    parts = parts.withColumn("stop", F.col("before") + F.sum("n").over(inside)).where(_wanted(probs)).select(
        *on, "from", "upto", "total", (F.col("stop") - F.col("n")).alias("before"))

    last = met(parts).where(F.col("v").between(F.col("from"), F.col("upto"))).groupBy(*on, "from", "v").agg(F.sum("n").alias("n"), *first)
    last = last.withColumn("stop", F.col("before") + F.sum("n").over(Window.partitionBy(*on, "from").orderBy("v")))
    picks = [F.max(F.when((rank >= F.col("stop") - F.col("n")) & (rank < F.col("stop")), F.col("v"))).alias(f"v{i}") for i, rank in enumerate(_ranks(probs))]
    got = last.groupBy("__k", "c").agg(F.first("total").alias("total"), *picks)
    ends = []
    for i, p in enumerate(probs):
        place = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        ends.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return got.select(*unpack_key(keys), names.alias(COLUMN), F.array(*ends).alias(QUANTILES))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: one row per column."""
    if not columns:
        return {}
    return {r[COLUMN]: list(r[QUANTILES]) for r in exact_quantiles(df, columns, probs).collect()}


def one_row_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> Column:
    """MAP<column, ARRAY<DOUBLE>> of whole columns as a scalar subquery."""
    table = exact_quantiles(df, columns, probs)
    return table.agg(F.map_from_entries(F.collect_list(F.struct(COLUMN, QUANTILES))).alias("m")).select("m").scalar()
