"""Right-closed binning (P10): ``(a, b]`` with the first bin also holding its left edge.

Values outside the edges, and NULLs, become NULL. Labels are either the caller's (when
their count is ``len(edges) - 1``) or interval text in the pandas style, e.g.
``(0.999, 3.0]``. ``ml.feature.Bucketizer`` is left-closed and therefore not used.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import number

LABEL_PRECISION = 3


@dataclass(frozen=True)
class BinSpec:
    column: str
    edges: Sequence[float]
    labels: Sequence[str] | None = None


def _round_frac(x: float, precision: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    frac, whole = math.modf(x)
    if whole == 0:
        digits = -int(math.floor(math.log10(abs(frac)))) - 1 + precision
    else:
        digits = precision
    return round(x, digits)


def default_labels(edges: Sequence[float], precision: int = LABEL_PRECISION) -> list[str]:
    brk = [float(e) for e in edges]
    shown = [_round_frac(e, precision) for e in brk]
    # The first interval is shown slightly open on the left because it includes its edge.
    shown[0] = _round_frac(brk[0] - 10 ** (-precision), precision)
    return [f"({shown[i]!r}, {shown[i + 1]!r}]" for i in range(len(brk) - 1)]


def bin_column(col: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    e = [float(x) for x in edges]
    if any(b <= a for a, b in zip(e, e[1:])):
        raise ValueError("bin edges must increase monotonically")
    labs = list(labels) if labels is not None and len(labels) == len(e) - 1 else default_labels(e)
    x = col.cast("double")
    expr = F.when((x >= F.lit(e[0])) & (x <= F.lit(e[1])), F.lit(str(labs[0])))
    for i in range(1, len(e) - 1):
        expr = expr.when((x > F.lit(e[i])) & (x <= F.lit(e[i + 1])), F.lit(str(labs[i])))
    return expr


def apply_bins(df: DataFrame, specs: Sequence[BinSpec] | None) -> DataFrame:
    for spec in specs or []:
        if spec.column not in df.columns or len(spec.edges) < 2:
            continue
        df = df.withColumn(spec.column, bin_column(number(df, spec.column), spec.edges, spec.labels))
    return df
