"""Table profiling (D1–D9) from the shared statistics pass and the long frequency table."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rounding import round_half_even
from ..functions.types import categorical_columns, dtype_of, is_categorical, is_numeric, is_string, is_temporal, \
    numeric_columns, q
from .heavy import top_levels
from .query import correlation_long
from .stats import column_stats, value_freq


def column_profile(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(column, dtype, n_missing, pct_missing, n_unique, is_numeric)."""
    st = stats if stats is not None else column_stats(df, with_quantiles=False)
    numeric = numeric_columns(df)
    return st.select(
        "column", "dtype", "n_missing",
        F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows")).alias("pct_missing"),
        "n_unique", F.col("column").isin(numeric).alias("is_numeric") if numeric else F.lit(False).alias("is_numeric"))


def numeric_stats(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(column, mean, std, min, max, median, skewness, q1, q3) for numeric columns."""
    numeric = numeric_columns(df)
    st = stats if stats is not None else column_stats(df, numeric)
    return st.where(F.col("column").isin(numeric)).select(
        "column", "mean", "std", "min", "max", "median", "skewness", "q1", "q3")


def top_categories(df: DataFrame, limit: int = K.PROFILE_TOP_CATEGORIES) -> DataFrame:
    """D3: top value counts per categorical/boolean column (count desc, value asc)."""
    cats = categorical_columns(df)
    if not cats:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int")
    return top_levels(df, cats, limit).select("column", "value", "n", F.col("rank").cast("int").alias("rank"))


def correlation(df: DataFrame) -> DataFrame:
    """Long pairwise Pearson correlation over numeric columns."""
    return correlation_long(df, numeric_columns(df))


def table_shape(df: DataFrame) -> DataFrame:
    """n_rows, n_cols and the numeric / categorical column lists (comma-joined)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.lit(",".join(numeric_columns(df))).alias("numeric_columns"),
        F.lit(",".join(categorical_columns(df))).alias("categorical_columns"))


def column_classes(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per column class: numeric, categorical (incl. boolean), date, free_text (unique ratio > 0.5)."""
    st = stats if stats is not None else column_stats(df, with_quantiles=False)
    kinds = {}
    for f in df.schema.fields:
        if is_categorical(f.dataType) and not is_string(f.dataType):
            kinds[f.name] = "categorical"
        elif is_numeric(f.dataType):
            kinds[f.name] = "numeric"
        elif is_temporal(f.dataType):
            kinds[f.name] = "date"
        else:
            kinds[f.name] = "text"
    kind = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])[F.col("column")]
    present = F.col("n_rows") - F.col("n_missing")
    return st.select("column", F.when(
        kind == "text",
        F.when((present > 0) & (F.col("n_unique") / present > K.FREE_TEXT_UNIQUE_RATIO), F.lit("free_text"))
        .otherwise(F.lit("categorical"))).otherwise(kind).alias("class"))


def type_breakdown(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Number of columns per class; classes with zero columns are omitted."""
    return column_classes(df, stats).groupBy("class").agg(F.count(F.lit(1)).alias("n_columns"))


def cell_completeness(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Missing cells, missing % (1 dp) and a truthful has_missing flag (one pass, no shuffle)."""
    from .stats import is_missing

    ncols = len(df.columns)
    if stats is not None:
        agg = stats.agg(F.max("n_rows").alias("n_rows"), F.sum("n_missing").alias("missing_cells"))
    else:
        missing = [F.sum(is_missing(df, c).cast("long")) for c in df.columns]
        total = missing[0]
        for m in missing[1:]:
            total = total + m
        agg = df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("missing_cells"))
    cells = F.col("n_rows") * F.lit(ncols)
    return agg.select(
        F.coalesce(F.col("n_rows"), F.lit(0)).alias("n_rows"), F.lit(ncols).cast("long").alias("n_cols"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("long").alias("missing_cells"),
        F.when(cells > 0, round_half_even(F.col("missing_cells") / cells * 100, 1)).otherwise(F.lit(0.0))
        .alias("missing_pct"),
        (F.coalesce(F.col("missing_cells"), F.lit(0)) > 0).alias("has_missing"))


def sample_values(df: DataFrame, columns: Sequence[str], k: int = K.SUMMARY_SAMPLES) -> DataFrame:
    """(column, samples): k distinct non-missing values in a fixed pseudo-random order (md5 of the text).

    One frequency table for all columns; the window keeps k rows per column and task before
    it shuffles, so no task holds a column's values.
    """
    w = Window.partitionBy("column").orderBy(F.md5("value"), "value")
    top = value_freq(df, columns).select("column", "value").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("s")).select(
        "column", F.concat_ws(",", F.col("s.value")).alias("samples"))


def column_summary(df: DataFrame, max_columns: int = K.SUMMARY_MAX_COLUMNS,
                   top_k: int = K.SUMMARY_TOP_VALUES) -> DataFrame:
    """First ``max_columns`` columns: dtype, n_unique, pct_missing (3 dp);
    numeric → min, max, mean and 3 samples; other → top-5 values as ``value:n`` text."""
    cols = df.columns[:max_columns]
    sub = df.select(*[q(c) for c in cols])
    st = column_stats(sub)
    numeric = [c for c in cols if is_numeric(dtype_of(df, c))]
    others = [c for c in cols if c not in numeric]
    base = st.select("column", "dtype", "n_unique",
                     round_half_even(F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows")), 3)
                     .alias("pct_missing"), "min", "max", "mean")
    if numeric:
        base = base.join(sample_values(sub, numeric), "column", "left")
    else:
        base = base.withColumn("samples", F.lit(None).cast("string"))
    if others:
        tv = top_levels(sub, others, top_k)
        tv = tv.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
        tv = tv.select("column", F.concat_ws(",", F.transform(
            "t", lambda s: F.concat(s["value"], F.lit(":"), s["n"].cast("string")))).alias("top_values"))
        base = base.join(tv, "column", "left")
    else:
        base = base.withColumn("top_values", F.lit(None).cast("string"))
    return base


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """All profile tables, each from the shared statistics."""
    st = column_stats(df)
    return {
        "columns": column_profile(df, st),
        "numeric": numeric_stats(df, st),
        "top_categories": top_categories(df),
        "correlation": correlation(df),
        "shape": table_shape(df),
        "types": type_breakdown(df, st),
        "completeness": cell_completeness(df, st),
    }

