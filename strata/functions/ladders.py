"""Quality grade and caution ladders (E11, E12) as Column expressions and scalar twins."""
from __future__ import annotations

import math
import numbers

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

CAUTION_RANK = {lvl: i for i, lvl in enumerate(K.CAUTION_LEVELS)}


def _rung(value, rungs, otherwise, below: bool):
    """Outcome of the first rung the value stands on: under its bound, or at least at it."""
    return next((rest[0] if len(rest) == 1 else rest for bound, *rest in rungs if (value < bound if below else value >= bound)), otherwise)


def finite(score) -> float | None:
    """The score as a float; None for anything that is no finite number (a truth value is none)."""
    number = isinstance(score, numbers.Real) and not isinstance(score, bool)
    return float(score) if number and math.isfinite(score) else None


def caution_from_silhouette(score) -> str:
    known = finite(score)
    return _rung(-math.inf if known is None else known, K.CAUTION_SILHOUETTE, K.CAUTION_LEVELS[0], below=True)


def caution_from_group_size(n: int) -> str:
    return _rung(n, K.CAUTION_GROUP_SIZE, K.CAUTION_LEVELS[0], below=True)


def quality_grade(score) -> tuple[str, str]:
    known = finite(score)
    return K.GRADE_MISSING if known is None else tuple(_rung(known, K.GRADE_LADDER, K.GRADE_FLOOR, below=False))


def raise_caution(current: str | None, floor: str) -> str:
    """Only raises: baja < media < alta."""
    cur = CAUTION_RANK.get(current or "baja", 0)
    return current if cur >= CAUTION_RANK[floor] else floor


# ---- Column forms --------------------------------------------------------------

def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def grade_col(score: Column) -> Column:
    expr = F.when(~_usable(score), F.lit(K.GRADE_MISSING[0]))
    for bound, grade, _ in K.GRADE_LADDER:
        expr = expr.when(score >= bound, F.lit(grade))
    return expr.otherwise(F.lit(K.GRADE_FLOOR[0]))


def grade_label_col(score: Column) -> Column:
    expr = F.when(~_usable(score), F.lit(K.GRADE_MISSING[1]))
    for bound, _, label in K.GRADE_LADDER:
        expr = expr.when(score >= bound, F.lit(label))
    return expr.otherwise(F.lit(K.GRADE_FLOOR[1]))


def caution_silhouette_col(score: Column) -> Column:
    (b1, l1), (b2, l2) = K.CAUTION_SILHOUETTE
    return F.when(~_usable(score) | (score < b1), F.lit(l1)).when(score < b2, F.lit(l2)).otherwise(F.lit("baja"))


def caution_size_col(n: Column) -> Column:
    (b1, l1), (b2, l2) = K.CAUTION_GROUP_SIZE
    return F.when(n < b1, F.lit(l1)).when(n < b2, F.lit(l2)).otherwise(F.lit("baja"))


def caution_rank_col(level: Column) -> Column:
    return F.when(level == "alta", 2).when(level == "media", 1).otherwise(0)


def raise_caution_col(current: Column, floor: Column) -> Column:
    r = F.greatest(caution_rank_col(F.coalesce(current, F.lit("baja"))), caution_rank_col(floor))
    return F.when(r == 2, F.lit("alta")).when(r == 1, F.lit("media")).otherwise(F.lit("baja"))
