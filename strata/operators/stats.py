"""Shared statistics: one aggregation pass per table, long (unpivoted) frequency tables.

The number of shuffles does not grow with the number of columns: per-column group-bys
are expressed as one ``unpivot`` followed by one aggregation keyed by ``column``. NaN counts
as missing everywhere.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import dtype_of, is_numeric, is_string, number, present, q
from .quantiles import one_row_quantiles

# ``approx=True`` trades exactness for a bounded, mergeable sketch; it is never chosen by size.
APPROX_ACCURACY = 10000
QUARTILES = (0.25, 0.5, 0.75)


def quartile_map(df: DataFrame, columns: Sequence[str], approx: bool = False) -> Column:
    """MAP<column, ARRAY[q1, median, q3]> as a scalar subquery."""
    if not approx:
        return one_row_quantiles(df, columns, QUARTILES)
    entries = [e for c in columns for e in (F.lit(c), F.percentile_approx(number(df, c), list(QUARTILES), APPROX_ACCURACY))]
    return df.agg(F.create_map(*entries).alias("m")).select("m").scalar()


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness: population skewness × sqrt(n(n-1))/(n-2)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def stack_rows(one_row: DataFrame, label_col: str, labels: Sequence[str], columns: Sequence[str],
               cell: Callable[[str, int], Column]) -> DataFrame:
    """Turn a one-row aggregate into ``len(labels)`` rows: (label_col, *columns).

    ``cell(label, i)`` is the value of a label for the i-th column. Runs as a generator on the
    single aggregated row; nothing goes through the driver.
    """
    structs = [F.struct(F.lit(lab).alias(label_col), *[cell(lab, i).alias(c) for i, c in enumerate(columns)]) for lab in labels]
    return one_row.select(F.inline(F.array(*structs)))


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value) with every value cast to STRING, missing ones NULL."""
    casted = df.select(*[q(b) for b in by], *[present(df, c).cast("string").alias(c) for c in columns])
    return casted.unpivot([q(b) for b in by], [q(c) for c in columns], "column", "value")


def value_freq(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), dropna: bool = True) -> DataFrame:
    """Long frequency table (by..., column, value, n). Partial aggregation happens map-side."""
    lv = long_values(df, columns, by)
    if dropna:
        lv = lv.where(F.col("value").isNotNull())
    return lv.groupBy(*[q(b) for b in by], "column", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked(freq: DataFrame, partition: Sequence[str], n_col: str = "n", value_col: str = "value") -> DataFrame:
    """Adds ``rank`` = position by count desc, value asc within ``partition``."""
    w = Window.partitionBy(*[q(p) for p in partition]).orderBy(F.desc(n_col), F.asc_nulls_first(value_col))
    return freq.withColumn("rank", F.row_number().over(w))


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value, n): each column's most frequent value as STRING, ties → smallest.

    An algebraic aggregate over the frequency table: no value map or window holds a column.
    """
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("value").alias("value")))
    return (value_freq(df, columns, by).groupBy(*[q(b) for b in by], "column").agg(best.alias("__best"))
            .select(*[q(b) for b in by], "column", F.col("__best.value").alias("value"), (-F.col("__best.less")).alias("n")))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_unique) of the non-missing values, from the frequency table."""
    return value_freq(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def numeric_columns_of(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    names = columns if columns else df.columns
    return [c for c in names if c in df.columns and is_numeric(dtype_of(df, c))]


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                 with_quantiles: bool = True, distinct: Sequence[str] | None = None,
                 extra: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Long per-column statistics: one aggregate, one frequency table, one quantile job.

    (column, dtype, n_rows, n_missing, n_unique, constant, mean, std, min, max, q1, median, q3,
    skewness, mean_len). Numeric fields are NULL for non-numeric columns; ``mean_len`` is
    the mean character length of the values of string columns; ``constant`` tells that no two
    values differ. ``distinct`` names the columns to count distinct values of (default: all);
    ``n_unique`` is NULL for the others. ``extra`` adds aggregates of string columns.
    """
    cols = list(columns or df.columns)
    wanted = cols if distinct is None else [c for c in cols if c in distinct]
    numeric = [c for c in cols if is_numeric(dtype_of(df, c))]
    extra = extra or {}
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        value, dt = present(df, c), dtype_of(df, c)
        exprs += [F.count(value).alias(f"count__{i}"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias(f"constant__{i}")]
        if c in numeric:
            d = number(df, c)
            exprs += [F.avg(d).alias(f"mean__{i}"), F.stddev_samp(d).alias(f"std__{i}"), F.min(d).alias(f"min__{i}"),
                      F.max(d).alias(f"max__{i}"), sample_skewness(d).alias(f"skewness__{i}")]
        if is_string(dt):
            exprs.append(F.avg(F.length(value)).alias(f"mean_len__{i}"))
            exprs += [make(value).alias(f"{name}__{i}") for name, make in extra.items()]
    one = df.agg(*exprs)
    if wanted:
        unique = distinct_counts(df, wanted).agg(F.map_from_entries(F.collect_list(F.struct("column", "n_unique"))).alias("m"))
        one = one.withColumn("__unique", unique.select("m").scalar())
    if with_quantiles and numeric:
        one = one.withColumn("__quartiles", quartile_map(df, numeric, approx))

    def field(name: str, i: int, kind: str, there: bool) -> Column:
        return (F.col(f"{name}__{i}") if there else F.lit(None).cast(kind)).alias(name)

    structs = []
    for i, c in enumerate(cols):
        dt = dtype_of(df, c)
        is_num, is_text = c in numeric, is_string(dt)
        at = lambda k, c=c: F.col("__quartiles")[c][k] if is_num and with_quantiles else F.lit(None).cast("double")  # noqa: B023, E731
        n_unique = F.coalesce(F.col("__unique")[c], F.lit(0)) if c in wanted else F.lit(None).cast("long")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(dt.simpleString()).alias("dtype"), F.col("__rows").alias("n_rows"),
            (F.col("__rows") - F.col(f"count__{i}")).alias("n_missing"), n_unique.alias("n_unique"),
            F.col(f"constant__{i}").alias("constant"),
            *[field(name, i, "double", is_num) for name in ("mean", "std", "min", "max")],
            at(0).alias("q1"), at(1).alias("median"), at(2).alias("q3"),
            field("skewness", i, "double", is_num), field("mean_len", i, "double", is_text),
            *[field(name, i, "long", is_text).cast("long").alias(name) for name in extra]))
    return one.select(F.inline(F.array(*structs)))
