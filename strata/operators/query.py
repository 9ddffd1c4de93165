"""Typed analytical queries (Q1–Q14) over one table.

``run_query(df, DataQuery)`` applies bins, then filters, then one of nine whitelisted
operations, then optional percent normalisation, and returns a lazily composed
DataFrame plus a chart spec. Catalyst sees bins + filters + aggregation as one plan.

Output names (the reference's Spanish names in brackets): ``metric``/``value``
[métrica/valor], ``statistic`` [estadística], ``n`` [conteo], ``pct`` [porcentaje],
``variable`` [variable], ``column`` [columna], ``n_missing`` [faltantes],
``pct_missing`` [% faltantes].
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.bins import BinSpec, apply_bins
from ..functions.predicates import Filter, apply_filters, as_filters
from ..functions.rounding import round_half_even
from ..functions.types import dtype_of, is_numeric, number, numeric_columns, present, q, quoted
from .charts import histogram
from .correlation import correlation_pairs, named_pairs
from .heavy import top_levels
from .quantiles import exact_quantiles
from .stats import APPROX_ACCURACY, distinct_counts, is_missing, modes, quartile_map, stack_rows

AGGS = ("mean", "median", "sum", "min", "max", "count")
NORMALIZE = ("none", "row_pct", "total_pct")
DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


@dataclass
class DataQuery:
    operation: str
    columns: list[str] = field(default_factory=list)
    groupby: list[str] | None = None
    agg: str | None = None
    top_n: int | None = None
    bins: list[BinSpec] | None = None
    filter_by: list[Filter] | None = None
    chart_type: str = "table"
    normalize: str = "none"

    def __post_init__(self):
        allowed = (("operation", self.operation, OPERATIONS), ("aggregate", self.agg, (None, *AGGS)), ("normalize mode", self.normalize, NORMALIZE))
        for what, got, options in allowed:
            if got not in options:
                raise ValueError(f"unsupported {what} {got!r}")
        self.columns = list(self.columns or [])
        self.filter_by = as_filters(self.filter_by)
        self.bins = [b if isinstance(b, BinSpec) else BinSpec(**b) for b in (self.bins or [])]


@dataclass
class ChartSpec:
    type: str
    x: str | None = None
    y: str | None = None
    color: str | None = None
    data: DataFrame | None = None


@dataclass
class QueryResult:
    operation: str
    table: DataFrame
    chart: ChartSpec | None = None


class QueryError(ValueError):
    pass


# ---------------------------------------------------------------- normalisation

def total_pct(table: DataFrame, value_col: str = "n", out_col: str = "pct") -> DataFrame:
    """Q11: value / grand total × 100 (1 dp); a zero total leaves the value as it is."""
    total = table.select(F.sum(q(value_col))).scalar()
    t, v = F.col("__total"), q(value_col)
    share = F.when(t > 0, round_half_even(v / t * 100, 1)).otherwise(v.cast("double"))
    return table.withColumn("__total", total).select(*[share.alias(out_col) if c == value_col else q(c) for c in table.columns])


def row_pct(table: DataFrame, primary: str, value_col: str = "n", out_col: str = "pct") -> DataFrame:
    """Q12: share within the first key; NULL first key gives NULL.

    The per-key totals are an aggregate joined back, not a window: a window over a hot first
    key would buffer all its rows in one task. Spark broadcasts the totals if they are small.
    """
    totals = table.where(q(primary).isNotNull()).groupBy(q(primary).alias("__key")).agg(F.sum(q(value_col)).alias("__total"))
    joined = table.join(totals, q(primary) == F.col("__key"), "left")
    share = round_half_even(q(value_col) / F.col("__total") * 100, 1)
    return joined.select(*[share.alias(out_col) if c == value_col else q(c) for c in table.columns])


def _normalised(table: DataFrame, mode: str, primary: str | None = None) -> tuple[DataFrame, str]:
    """A count table under the wanted normalisation, and the name of its value column."""
    if mode == "none":
        return table, "n"
    return (row_pct(table, primary) if mode == "row_pct" and primary else total_pct(table)), "pct"


# ---------------------------------------------------------------- operations

def filter_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows_found").alias("metric"), "value")


def describe_numeric(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Q2: count, mean, std, min, 25/50/75 %, max per column, one row per statistic.

    NaN is no value. Quartiles are exact unless ``approx`` asks for the mergeable sketch.
    """
    cols = list(columns)
    plain = {"count": lambda x: F.count(x).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[make(number(df, c)).alias(f"{name}__{i}") for i, c in enumerate(cols) for name, make in plain.items()])
    one = one.withColumn("__quartiles", quartile_map(df, cols, approx))
    place = {"25%": 0, "50%": 1, "75%": 2}
    return stack_rows(one, "statistic", DESCRIBE_STATS, cols,
                      lambda s, i: F.col("__quartiles")[cols[i]][place[s]] if s in place else F.col(f"{s}__{i}"))


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q3: count, unique, top, freq per text column (values as STRING). Ties → smallest value."""
    cols = list(columns)
    one = df.agg(*[F.count(present(df, c)).alias(f"count__{i}") for i, c in enumerate(cols)])
    found = distinct_counts(df, cols).join(modes(df, cols), "column")
    table = found.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("n_unique", "value", "n")))).alias("m"))
    one = one.withColumn("__found", table.select("m").scalar())
    cells: dict[str, Callable[[int], Column]] = {
        "count": lambda i: F.col(f"count__{i}"), "unique": lambda i: F.coalesce(F.col("__found")[cols[i]]["n_unique"], F.lit(0)),
        "top": lambda i: F.col("__found")[cols[i]]["value"], "freq": lambda i: F.col("__found")[cols[i]]["n"]}
    return stack_rows(one, "statistic", tuple(cells), cols, lambda s, i: cells[s](i).cast("string"))


def value_counts(df: DataFrame, column: str, dropna: bool = False) -> DataFrame:
    """Q4: count per value including missing ones as NULL (unless ``dropna``)."""
    values = df.select(present(df, column).alias(column))
    if dropna:
        values = values.where(q(column).isNotNull())
    return values.groupBy(q(column)).agg(F.count(F.lit(1)).alias("n"))


def groupby_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q5: count per 1–2 keys, missing keys kept as their own NULL group."""
    return df.groupBy(*[present(df, k).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def groupby_agg(df: DataFrame, keys: Sequence[str], targets: Sequence[str], agg: str = "mean",
                approx: bool = False) -> DataFrame:
    """Q6: one aggregate over ≥1 targets per 1–2 keys; 3 dp only when >1 target.

    An all-missing group sums to 0. Exact medians of all targets come from one quantile job.
    """
    tg = [t for t in targets if t in df.columns]
    if not tg:
        raise QueryError("no valid target column")
    text = [t for t in tg if not is_numeric(dtype_of(df, t))]
    if agg in ("mean", "median", "sum") and text:
        raise QueryError(f"cannot compute {agg} of non-numeric column `{text[0]}`")
    make: dict[str, Callable[[Column], Column]] = {
        "mean": F.avg, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "min": F.min, "max": F.max, "count": F.count,
        "median": lambda x: F.percentile_approx(x.cast("double"), 0.5, APPROX_ACCURACY)}
    names = [f"__k{i}" for i in range(len(keys))]
    src = df.select(*[present(df, k).alias(n) for k, n in zip(keys, names)], *[present(df, t).alias(f"__t{i}") for i, t in enumerate(tg)])
    if agg == "median" and not approx:
        # groups without any value have a NULL median: they join in as rows of one union and grouping
        found = exact_quantiles(src, [f"__t{i}" for i in range(len(tg))], (0.5,), names).select(
            *names, *[F.when(F.col("column") == f"__t{i}", F.col("q")[0]).alias(f"__v{i}") for i in range(len(tg))])
        groups = src.select(*names).distinct().select(*names, *[F.lit(None).cast("double").alias(f"__v{i}") for i in range(len(tg))])
        out = groups.unionByName(found).groupBy(*names).agg(*[F.max(f"__v{i}").alias(f"__v{i}") for i in range(len(tg))])
    else:
        out = src.groupBy(*names).agg(*[make[agg](F.col(f"__t{i}")).alias(f"__v{i}") for i in range(len(tg))])
    rounds = len(tg) > 1 and agg != "count"
    values = [(round_half_even(F.col(f"__v{i}"), 3) if rounds and t not in text else F.col(f"__v{i}")).alias(t) for i, t in enumerate(tg)]
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *values)


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) for every ordered pair, pairwise-complete Pearson, no spread → NULL."""
    return named_pairs(df, list(columns))


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Q8: square matrix (variable, <one column per variable>), rounded to 3 dp."""
    cols = list(columns)
    rows = correlation_pairs(df, cols).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", round_half_even(F.col("r"), digits).alias("r")))).alias("m"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("a") + 1)
    return rows.select(name.alias("variable"), *[F.col("m")[j].alias(b) for j, b in enumerate(cols)])


def top_n_numeric(df: DataFrame, column: str, n: int) -> DataFrame:
    """Q9 numeric: the n largest values, duplicates kept (TakeOrdered, no full sort)."""
    return df.select(present(df, column).alias(column)).orderBy(F.desc_nulls_last(quoted(column))).limit(n)


def top_n_text(df: DataFrame, column: str, n: int) -> DataFrame:
    """Q9 text: the n most frequent non-NULL values, ties by value."""
    top = top_levels(df, [column], n).select(F.col("value").cast(dtype_of(df, column)).alias(column), "n")
    return top.orderBy(F.desc("n"), F.asc(quoted(column)))


def missing_table(df: DataFrame) -> DataFrame:
    """Q10 (long form): per column missing count and % (1 dp), only columns with missing values."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(is_missing(df, c)).alias(f"m__{i}") for i, c in enumerate(cols)])
    long = one.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m__{i}").alias("n_missing")) for i, c in enumerate(cols)])))
    pct = round_half_even(F.col("n_missing") / F.col("__rows") * 100, 1)
    return long.where(F.col("n_missing") > 0).select("column", "n_missing", pct.alias("pct_missing"))


def no_missing_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([("missing_values", 0)], "metric string, value long")


# ---------------------------------------------------------------- operation → table and chart

@dataclass
class _Answer:
    """What a builder returns: the ordered table, the chart's axes and data, and the chart to
    draw where the request leaves it open (``None``: only if the answer is small)."""

    table: DataFrame
    x: str | None = None
    y: str | None = None
    color: str | None = None
    data: DataFrame | None = None
    default: str | None = None


def _build_filter_count(df, ask, approx):
    return _Answer(filter_count(df))


def _build_describe(df, ask, approx):
    cols = ask.columns or numeric_columns(df)
    numeric = [c for c in cols if is_numeric(dtype_of(df, c))]
    return _Answer(describe_numeric(df, numeric, approx) if numeric else describe_text(df, cols))


def _build_value_counts(df, ask, approx):
    column = ask.columns[0]
    table, y = _normalised(value_counts(df, column), ask.normalize)
    return _Answer(table.orderBy(F.desc(y), F.asc_nulls_last(quoted(column))), column, y)


def _build_groupby_count(df, ask, approx):
    first, second = (*ask.groupby, None)[:2]
    table, y = _normalised(groupby_count(df, ask.groupby), ask.normalize, first if second else None)
    return _Answer(table.orderBy(*[F.asc_nulls_last(quoted(k)) for k in ask.groupby]), first, y, second)


def _build_groupby_agg(df, ask, approx):
    first, second = (*ask.groupby, None)[:2]
    table = groupby_agg(df, ask.groupby, ask.columns, ask.agg or "mean", approx).orderBy(*[F.asc_nulls_last(quoted(k)) for k in ask.groupby])
    several = len(ask.columns) > 1
    return _Answer(table, first, None if several else ask.columns[0], second, default="table" if several else None)


def _build_distribution(df, ask, approx):
    column = ask.columns[0]
    if is_numeric(dtype_of(df, column)):
        return _Answer(describe_numeric(df, [column], approx), column, "n", data=histogram(df, column), default="histogram")
    return _Answer(describe_text(df, [column]), column, "n", data=value_counts(df, column, dropna=True), default="histogram")


def _build_correlation(df, ask, approx):
    return _Answer(correlation_matrix(df, ask.columns or numeric_columns(df)))


def _build_top_n(df, ask, approx):
    column, n = ask.columns[0], ask.top_n or 10
    if is_numeric(dtype_of(df, column)):
        return _Answer(top_n_numeric(df, column, n), column, column)
    return _Answer(top_n_text(df, column, n), column, "n")


def _build_missing_values(df, ask, approx):
    table = missing_table(df).orderBy(F.desc("n_missing"), F.asc("column"))
    return _Answer(no_missing_row(df)) if table.isEmpty() else _Answer(table, "column", "n_missing", default="bar")


@dataclass
class _Operation:
    build: Callable[..., _Answer]
    needs: tuple[str, ...] = ()
    charts: tuple[str, ...] | None = None  # chart types that may be drawn; None: any, () : never


_OPERATIONS = {
    "describe": _Operation(_build_describe, charts=()),
    "groupby_count": _Operation(_build_groupby_count, ("groupby",)),
    "groupby_agg": _Operation(_build_groupby_agg, ("groupby", "columns")),
    "filter_count": _Operation(_build_filter_count, charts=()),
    "distribution": _Operation(_build_distribution, ("columns",)),
    "correlation": _Operation(_build_correlation, charts=("heatmap",)),
    "top_n": _Operation(_build_top_n, ("columns",)),
    "value_counts": _Operation(_build_value_counts, ("columns",)),
    "missing_values": _Operation(_build_missing_values, charts=("bar", "none")),
}
OPERATIONS = tuple(_OPERATIONS)


def _chart(ask: DataQuery, operation: _Operation, answer: _Answer, resolve: bool) -> ChartSpec | None:
    """The requested chart; where none was chosen the answer's default, or a bar chart for a
    comparative answer of 2 to 24 rows (counted no further than that)."""
    if operation.charts == () or (answer.x is None and ask.chart_type not in (operation.charts or ())):
        return None
    kind = ask.chart_type
    if answer.default == "table":
        kind = "table"
    elif answer.default and (kind == "table" or operation.charts):
        kind = answer.default if kind != "none" else "none"
    elif kind in ("table", "none") and resolve and ask.operation in K.COMPARATIVE_OPS:
        rows = answer.table.limit(K.AUTO_BAR_MAX_ROWS + 1).count()
        kind = "bar" if K.AUTO_BAR_MIN_ROWS <= rows <= K.AUTO_BAR_MAX_ROWS else kind
    return ChartSpec(kind, answer.x, answer.y, answer.color, answer.table if answer.data is None else answer.data)


def run_query(df: DataFrame, ask: DataQuery, approx: bool = False, resolve_chart: bool = True) -> QueryResult:
    """Execute a typed query: checks → bins → filters → operation → normalisation → chart choice."""
    operation = _OPERATIONS[ask.operation]
    for need in operation.needs:
        if not getattr(ask, need):
            raise QueryError(f"{ask.operation} needs {need}")
    roles = (("column", ask.columns), ("group-by column", ask.groupby or []), ("filter column", [f.column for f in ask.filter_by]))
    for role, names in roles:
        for name in names:
            if name not in df.columns:
                raise QueryError(f"{role} `{name}` does not exist")
    ready = apply_filters(apply_bins(df, ask.bins), ask.filter_by)
    answer = operation.build(ready, ask, approx)
    return QueryResult(ask.operation, answer.table, _chart(ask, operation, answer, resolve_chart))
