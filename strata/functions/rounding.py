"""Rounding that matches numpy/pandas ``round``: scale in binary, then half-to-even.

``F.bround(x, p)`` rounds the shortest decimal text of a double, which differs from
numpy for values such as 2.675. Scaling first and rounding to an integer keeps both
engines (and the DuckDB oracle, ``round_even(x * 10^p, 0) / 10^p``) on the same value.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column | str, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.bround(c.cast("double") * F.lit(scale), 0) / F.lit(scale)


def null_if_not_finite(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)
