"""Differentiating evidence per cluster (E8, E9) and group-vs-total statistics."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.types import number, present, q
from .stats import value_freq


def _totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, total_mean, total_std) from one aggregation pass (no shuffle)."""
    one = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.avg(number(df, c)).alias(f"m__{i}"),
        F.stddev_samp(number(df, c)).alias(f"s__{i}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m__{i}").alias("total_mean"), F.col(f"s__{i}").alias("total_std"))
        for i, c in enumerate(columns)])))


def numeric_evidence(df: DataFrame, columns: Sequence[str], label: str = "cluster",
                     limit: int = K.EVIDENCE_MAX_NUMERIC) -> DataFrame:
    """Per cluster the top columns by |z|, z = (group mean − total mean) / total std (ddof 1).

    Columns with total std ≤ 0 or NULL means are skipped. Ties by column name.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns])
    lv = df.select(label, F.inline(cells))
    gm = lv.groupBy(label, "column").agg(F.avg("v").alias("group_mean"))
    # the totals table has one row per column: bounded by the table width
    j = gm.join(F.broadcast(_totals(df, columns)), "column").where(
        F.col("group_mean").isNotNull() & F.col("total_mean").isNotNull() & (F.col("total_std") > 0))
    j = j.withColumn("z", (F.col("group_mean") - F.col("total_mean")) / F.col("total_std"))
    w = Window.partitionBy(label).orderBy(F.desc(F.abs("z")), F.asc("column"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit) \
        .select(label, "rank", "column", "group_mean", "total_mean", "z")


def _column_totals(df: DataFrame, columns: Sequence[str], cond: Column | None = None) -> Column:
    """MAP<column, non-NULL count> from one aggregate, as a scalar subquery."""
    def cnt(c):
        x = present(df, c)
        return F.count(x) if cond is None else F.count(F.when(cond, x))
    one = df.agg(F.create_map(*[e for c in columns for e in (F.lit(c), cnt(c))]).alias("m"))
    return one.select("m").scalar()


def level_shares(df: DataFrame, columns: Sequence[str], in_group: Column, by: str | None = None) -> DataFrame:
    """(by?, column, value, n_group, group_share, total_share) over non-NULL values.

    ``in_group`` marks the group's rows (for clusters: the label itself via ``by``). Share
    denominators are per-column (and per-cluster) counts from one-row / k-row aggregates,
    never windows over a column's values, so a high-cardinality column is not gathered into
    one task.
    """
    total_map = _column_totals(df, columns)
    if by is None:
        g = in_group.cast("boolean")
        src = df.withColumn("__g", F.coalesce(g, F.lit(False)))
        fr = value_freq(src, columns, by=["__g"])
        agg = fr.groupBy("column", "value").agg(
            F.sum(F.when(F.col("__g"), F.col("n")).otherwise(0)).alias("n_group"), F.sum("n").alias("n_total"))
        agg = agg.withColumn("__tg", _column_totals(src, columns, F.col("__g"))).withColumn("__tt", total_map)
        return agg.select("column", "value", "n_group",
                          (F.col("n_group") / F.col("__tg")[F.col("column")]).alias("group_share"),
                          (F.col("n_total") / F.col("__tt")[F.col("column")]).alias("total_share"))
    fr = value_freq(df, columns, by=[by])
    tot = fr.groupBy("column", "value").agg(F.sum("n").alias("n_total")).withColumn("__tt", total_map)
    tot = tot.select("column", "value", (F.col("n_total") / F.col("__tt")[F.col("column")]).alias("total_share"))
    # per (cluster, column) non-NULL counts: k rows × width
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("__gt")) for i, c in enumerate(columns)])
    per = df.groupBy(by).agg(*[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).select(by, F.inline(counts))
    g = fr.join(per, [by, "column"]).select(
        by, "column", "value", F.col("n").alias("n_group"), (F.col("n") / F.col("__gt")).alias("group_share"))
    return g.join(tot, ["column", "value"], "left").fillna(0.0, subset=["total_share"])


def categorical_evidence(df: DataFrame, columns: Sequence[str], label: str = "cluster",
                         top_levels: int = K.EVIDENCE_TOP_LEVELS, min_gap: float = K.EVIDENCE_MIN_GAP,
                         limit: int = K.EVIDENCE_MAX_CATEGORICAL) -> DataFrame:
    """Per cluster, of each column's most frequent levels in the group, those over-represented
    by ≥ ``min_gap`` against the whole table; top ``limit`` by gap, column, value."""
    sh = level_shares(df, columns, None, by=label)
    w1 = Window.partitionBy(label, "column").orderBy(F.desc("n_group"), F.asc("value"))
    sh = sh.withColumn("lvl", F.row_number().over(w1)).where(F.col("lvl") <= top_levels)
    sh = sh.withColumn("gap", F.col("group_share") - F.col("total_share")).where(F.col("gap") >= min_gap)
    w2 = Window.partitionBy(label).orderBy(F.desc("gap"), F.asc("column"), F.asc("value"))
    return sh.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= limit) \
        .select(label, "rank", "column", "value", "group_share", "total_share", "gap")


def group_vs_total(df: DataFrame, in_group: Column, numeric: Sequence[str], categorical: Sequence[str],
                   top_levels: int = K.GROUP_TOP_LEVELS) -> tuple[DataFrame, DataFrame]:
    """H3: numeric group mean vs total mean; categorical top levels' group share vs total share."""
    g = in_group.cast("boolean")
    one = df.agg(*[e for i, c in enumerate(numeric) for e in (
        F.avg(F.when(g, number(df, c))).alias(f"g__{i}"),
        F.avg(number(df, c)).alias(f"t__{i}"))])
    num = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"g__{i}").alias("group_mean"), F.col(f"t__{i}").alias("total_mean"))
        for i, c in enumerate(numeric)]))).where(F.col("group_mean").isNotNull() & F.col("total_mean").isNotNull()) \
        if numeric else None
    cat = None
    if categorical:
        sh = level_shares(df, categorical, g)
        w = Window.partitionBy("column").orderBy(F.desc("n_group"), F.asc("value"))
        cat = sh.where(F.col("n_group") > 0).withColumn("rank", F.row_number().over(w)) \
            .where(F.col("rank") <= top_levels).select("column", "rank", "value", "group_share", "total_share")
    return num, cat
