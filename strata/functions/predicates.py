"""Typed filter conditions turned into two-valued Spark predicates.

Semantics (P3–P9): strings compare case-insensitively; ``ne`` keeps NULL rows; every
other operator is false on NULL; a text literal against a numeric column is coerced to a
number, and an uncoercible literal skips the condition; ``contains`` is a literal
(never regex) case-insensitive substring test; conditions combine with AND and
conditions on unknown columns are skipped.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from .types import dtype_of, is_floating, is_numeric, is_string, present, q

OPS = ("eq", "ne", "gt", "lt", "gte", "lte", "in", "contains")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown filter operator {self.op!r}; expected one of {OPS}")


def _to_number(value: Any) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return None if (isinstance(value, float) and math.isnan(value)) else value
    text = str(value).strip()
    try:
        return int(text)
    except ValueError:
        pass
    try:
        parsed = float(text)
    except ValueError:
        return None
    return None if math.isnan(parsed) else parsed


def _text(value: Any) -> str:
    if isinstance(value, float) and value.is_integer():
        return repr(value)
    return str(value)


def predicate(df: DataFrame, cond: Filter) -> Column | None:
    """Column for one condition, or None when the condition is skipped.

    The result may be NULL for NULL inputs (except ``ne``); use ``two_valued`` before negating.
    """
    if cond.column not in df.columns:
        return None
    dt = dtype_of(df, cond.column)
    # NaN is missing: it must not compare as the largest number. Other columns stay plain, the
    # form that Parquet/ORC pushdown recognises.
    c = present(df, cond.column) if is_floating(dt) else q(cond.column)
    val = cond.value
    numeric = is_numeric(dt)
    stringy = is_string(dt)
    if numeric and cond.op in ("eq", "ne", "gt", "lt", "gte", "lte"):
        val = _to_number(val) if not isinstance(val, (list, tuple)) else None
        if val is None:
            return None
    op = cond.op
    if isinstance(dt, T.BooleanType) and op not in ("in", "contains") and not isinstance(val, bool):
        if not isinstance(val, (int, float)):
            return F.lit(op == "ne")  # text equals no truth value and has no order with one
        c = c.cast("int")
    # Plain comparisons: inside WHERE and conditional aggregates a NULL result acts as false,
    # and plain forms are what Parquet/ORC pushdown recognises (a coalesce wrapper is not).
    if op in ("eq", "ne"):
        lhs, rhs = (F.lower(c), F.lit(_text(val).lower())) if stringy else (c, F.lit(val))
        # eq: NULL never matches; ne: NULL is kept (x != NULL is true in the reference)
        return lhs == rhs if op == "eq" else ~lhs.eqNullSafe(rhs)
    if op in ("gt", "lt", "gte", "lte"):
        lit = F.lit(_text(val)) if (stringy and isinstance(val, (int, float))) else F.lit(val)
        return {"gt": c > lit, "lt": c < lit, "gte": c >= lit, "lte": c <= lit}[op]
    if op == "in":
        vals = list(val) if isinstance(val, (list, tuple)) else [val]
        if stringy:
            return F.lower(c).isin([_text(v).lower() for v in vals])
        if numeric:
            nums = [v for v in vals if isinstance(v, (int, float)) and not isinstance(v, bool)]
            return c.isin(nums) if nums else F.lit(False)
        return c.cast("string").isin([_text(v) for v in vals])
    if op == "contains":
        return F.contains(F.lower(c.cast("string")), F.lit(_text(val).lower()))
    return None


def two_valued(pred: Column) -> Column:
    """NULL → false, for callers that negate or select on the predicate's value itself."""
    return F.coalesce(pred, F.lit(False))


def conjunction(df: DataFrame, conditions: Iterable[Filter] | None) -> Column | None:
    preds = [p for p in (predicate(df, c) for c in (conditions or [])) if p is not None]
    if not preds:
        return None
    return reduce(lambda a, b: a & b, preds)


def apply_filters(df: DataFrame, conditions: Iterable[Filter] | None) -> DataFrame:
    pred = conjunction(df, conditions)
    return df if pred is None else df.where(pred)


def as_filters(items: Iterable[Any] | None) -> list[Filter]:
    out = []
    for it in items or []:
        if isinstance(it, Filter):
            out.append(it)
        elif isinstance(it, dict):
            out.append(Filter(it["column"], it["op"], it["value"]))
        else:
            out.append(Filter(*it))
    return out
