"""User-defined groups (H1–H4): compare two filter sets, profile one group."""
from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ladders import caution_size_col
from ..functions.predicates import Filter, as_filters, conjunction, two_valued
from ..functions.rounding import round_half_even
from ..functions.types import dtype_of, is_numeric, non_numeric_columns, number, numeric_columns, q
from .evidence import group_vs_total
from .stats import modes


class GroupError(ValueError):
    pass


def _pred(df: DataFrame, filters: Sequence[Filter]):
    p = conjunction(df, as_filters(filters))
    return F.lit(True) if p is None else two_valued(p)


def compare_groups(df: DataFrame, filters_a: Sequence[Filter], filters_b: Sequence[Filter],
                   label_a: str = "Group A", label_b: str = "Group B", columns: Sequence[str] | None = None,
                   check_empty: bool = True) -> DataFrame:
    """H1: one scan with conditional aggregates; rows (metric, a, b) as STRING.

    Metrics: rows, pct_of_total (1 dp), ``<col> (mean)`` (2 dp) for numeric columns and
    ``<col> (mode)`` for the others (ties → smallest). Groups may overlap.
    """
    pa, pb = _pred(df, filters_a), _pred(df, filters_b)
    names = [str(given or "").strip() or standard for given, standard in ((label_a, "Group A"), (label_b, "Group B"))]
    cols = [c for c in columns if c in df.columns] if columns else numeric_columns(df)[:K.COMPARE_DEFAULT_NUMERIC]
    exprs = [F.count(F.lit(1)).alias("__n"), F.count_if(pa).alias("__na"), F.count_if(pb).alias("__nb")]
    text = [c for c in cols if not is_numeric(dtype_of(df, c))]
    for i, c in enumerate(cols):
        if c not in text:
            exprs += [F.avg(F.when(p, number(df, c))).alias(f"{side}__{i}") for side, p in (("a", pa), ("b", pb))]
    one = df.agg(*exprs)
    if text:  # the modes of all text columns of a group from one frequency table
        for side, p in (("a", pa), ("b", pb)):
            found = modes(df.where(p), text).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m"))
            one = one.withColumn(f"__{side}_modes", found.select("m").scalar())
            one = one.withColumns({f"{side}__{i}": F.col(f"__{side}_modes")[c] for i, c in enumerate(cols) if c in text})
    if check_empty:
        sizes = list(df.agg(F.count_if(pa), F.count_if(pb)).first())
        if 0 in sizes:
            raise GroupError(f"group '{names[sizes.index(0)]}' is empty with those filters")

    def s(c):
        return c.cast("string")

    def pct(n):
        return s(F.when(F.col("__n") > 0, round_half_even(F.col(n) / F.col("__n") * 100, 1)))

    rows = [F.struct(F.lit("rows").alias("metric"), s(F.col("__na")).alias("a"), s(F.col("__nb")).alias("b")),
            F.struct(F.lit("pct_of_total").alias("metric"), pct("__na").alias("a"), pct("__nb").alias("b"))]
    for i, c in enumerate(cols):
        if is_numeric(dtype_of(df, c)):
            rows.append(F.struct(F.lit(f"{c} (mean)").alias("metric"),
                                 s(round_half_even(F.col(f"a__{i}"), 2)).alias("a"),
                                 s(round_half_even(F.col(f"b__{i}"), 2)).alias("b")))
        else:
            rows.append(F.struct(F.lit(f"{c} (mode)").alias("metric"),
                                 F.coalesce(F.col(f"a__{i}"), F.lit("—")).alias("a"),
                                 F.coalesce(F.col(f"b__{i}"), F.lit("—")).alias("b")))
    return one.select(F.inline(F.array(*rows))).toDF("metric", *names)


def profile_group(df: DataFrame, filters: Sequence[Filter], check: bool = True) -> DataFrame:
    """H2: (n, share, caution) for the rows matching ``filters``; caution floor from size."""
    fs = as_filters(filters)
    if not fs:
        raise GroupError("the description defines no filter on existing columns")
    p = _pred(df, fs)
    one = df.agg(F.count_if(p).alias("n"), F.count(F.lit(1)).alias("__total"))
    out = one.select("n", F.when(F.col("__total") > 0, round_half_even(F.col("n") / F.col("__total") * 100, 1))
                     .otherwise(F.lit(0.0)).alias("share"), caution_size_col(F.col("n")).alias("caution"))
    if check:
        if out.first()["n"] == 0:
            raise GroupError("no row matches those filters")
    return out


def group_statistics(df: DataFrame, filters: Sequence[Filter], exclude: Sequence[str] = ("cluster",),
                     max_numeric: int | None = K.GROUP_MAX_NUMERIC, max_categorical: int | None = K.GROUP_MAX_CATEGORICAL):
    """H3: the first numeric columns (mean vs total) and other columns (top-3 level shares).

    The limits on columns are those of the report; None describes every column.
    """
    others = [c for c in non_numeric_columns(df) if c not in exclude]
    return group_vs_total(df, _pred(df, filters), numeric_columns(df)[:max_numeric], others[:max_categorical])


GROUP_BITS = 62  # groups told apart by one LONG


def group_bitmap(df: DataFrame, groups: Mapping[str, Sequence[Filter]]) -> Column:
    """ARRAY<BIGINT>: bit i of the words is set where a row matches the filters of group i."""
    bits = [F.when(_pred(df, filters), F.lit(1 << i % GROUP_BITS)).otherwise(F.lit(0)).cast("long") for i, filters in enumerate(groups.values())]
    words = [bits[a:a + GROUP_BITS] for a in range(0, len(bits), GROUP_BITS)]
    return F.array(*[reduce(lambda x, y: x.bitwiseOR(y), word) for word in words])


def group_overlaps(df: DataFrame, groups: Mapping[str, Sequence[Filter]]) -> DataFrame:
    """H4: (group_a, group_b, n, share, share_of_a) for every group with itself and every pair that shares rows.

    One scan: rows are counted per bitmap of groups, combined map-side; sizes, shares of the table
    (%, 1 dp) and overlaps come from those counts. ``n`` of a pair (a, a) is the group's size.
    """
    names = list(groups)
    if not names:
        raise GroupError("no groups to compare")
    counted = df.select(group_bitmap(df, groups).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    total = counted.select(F.sum("n")).scalar()
    label = lambda i: F.array(*[F.lit(x) for x in names])[i]
    there = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)),
                     lambda i: F.get(F.col("bits"), F.floor(i / GROUP_BITS).cast("int")).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(GROUP_BITS)]), (i % GROUP_BITS + 1).cast("int"))) != 0)
    pairs = (counted.select("n", there.alias("there")).select("n", "there", F.explode("there").alias("a"))
             .select("n", "a", F.explode("there").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n")))
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("a"), F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    found = pairs.unionByName(every).groupBy("a", "b").agg(F.sum("n").alias("n"))
    sizes = found.where(F.col("a") == F.col("b")).select("a", F.col("n").alias("size"))
    share = lambda x, of: F.when(of > 0, round_half_even(x / of * 100, 1)).otherwise(F.lit(0.0))
    return (found.join(sizes, "a").withColumn("total", total)
            .select(label(F.col("a")).alias("group_a"), label(F.col("b")).alias("group_b"), "n", share(F.col("n"), F.col("total")).alias("share"),
                    share(F.col("n"), F.col("size")).alias("share_of_a")))
