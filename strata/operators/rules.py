"""Data-driven column pruning (C1–C8) and column selection.

Rules run once, in a fixed order where the first hit wins: high missing → near-zero
variance → date → identifier → free text → high-cardinality categorical.

1. One scan gives every column's statistics; for the text columns that they do not decide, one gives
   a histogram of the shapes of dates and one a sketch of the distinct values.
2. A text column whose shapes name one date format often enough is parsed with that format alone.
3. Distinct values are counted exactly only where a rule still depends on them and the sketch is
   within ``SKETCH_MARGIN`` of the rule's limit (six times its standard error): all values
   differ, over half differ, more than 25 differ.

The driver only loops over one row per column.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.types import dtype_of, is_numeric, is_string, is_temporal, q
from .stats import column_stats, distinct_counts

_Y, _M, _D, _HM, _S = r"\d{4}", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])", "([01][0-9]|2[0-3]):[0-5][0-9]", ":[0-5][0-9]"
#: Formats that a text column may have (the first of equally frequent ones), and the shape of their texts.
DATE_FORMATS = {
    "yyyy-MM-dd": f"{_Y}-{_M}-{_D}", "yyyy-MM-dd HH:mm:ss": f"{_Y}-{_M}-{_D} {_HM}{_S}", "yyyy-MM-dd'T'HH:mm:ss": f"{_Y}-{_M}-{_D}T{_HM}{_S}",
    "yyyy/MM/dd": f"{_Y}/{_M}/{_D}", "dd/MM/yyyy": f"{_D}/{_M}/{_Y}", "MM/dd/yyyy": f"{_M}/{_D}/{_Y}", "dd-MM-yyyy": f"{_D}-{_M}-{_Y}",
    "yyyy-MM-dd HH:mm": f"{_Y}-{_M}-{_D} {_HM}",
}
SHORTEST_DATE, LONGEST_DATE = 10, 40  # characters of a text that may be a date, blanks around it included
SKETCH_LG, SKETCH_MARGIN = 12, 6 * 1.04 / 2 ** 6

ID_NAME = re.compile(K.ID_NAME_REGEX, re.IGNORECASE)

REASONS = {
    "high_missing": "more than 70% missing values",
    "near_zero_variance": "no variation (all values equal or nearly equal)",
    "date": "date column",
    "identifier": "unique identifier",
    "free_text": "high-cardinality free text",
    "high_cardinality": "categorical with too many levels",
}


def chosen_format(counts: Sequence[int], present: int) -> str | None:
    """The most frequent format (ties: the first), if enough of the values have its shape."""
    best = max(range(len(counts)), key=lambda i: (counts[i], -i))
    enough = present >= K.DATE_MIN_VALUES and counts[best] >= max(K.DATE_MIN_VALUES, K.DATE_SHARE * present)
    return list(DATE_FORMATS)[best] if enough else None


def date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The one date format of each text column that has one: one scan for a histogram of shapes.

    Digits are made alike first, so that only texts of a format's outline meet its pattern.
    """
    texts = [c for c in columns if is_string(dtype_of(df, c))]
    if not texts:
        return {}
    short = {c: F.when(F.length(q(c)) <= LONGEST_DATE, F.trim(q(c))) for c in texts}
    cells = df.select(*[x.alias(f"{name}{i}") for i, c in enumerate(texts)
                        for name, x in (("v", q(c)), ("t", short[c]), ("o", F.translate(short[c], "012345678", "9" * 9)))])
    outline = lambda fmt: re.sub("[yMdHms]", "9", fmt.replace("'", ""))
    row = cells.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(texts))],
                    *[F.count_if((F.col(f"o{i}") == outline(fmt)) & F.col(f"t{i}").rlike(f"^{shape}$")).alias(f"s{i}_{k}")
                      for i in range(len(texts)) for k, (fmt, shape) in enumerate(DATE_FORMATS.items())]).first()
    found = {c: chosen_format([row[f"s{i}_{k}"] for k in range(len(DATE_FORMATS))], row[f"n{i}"]) for i, c in enumerate(texts)}
    return {c: fmt for c, fmt in found.items() if fmt}


def parse_timestamp(col: Column, fmt: str) -> Column:
    """The text as a timestamp in one format; NULL where it has another."""
    return F.try_to_timestamp(F.trim(col), F.lit(fmt))


def year_of(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """C4: year as DOUBLE; a text that is not in the column's format gives NULL.

    ``fmt`` is the format of a text column; where it is not given the column's values are looked at.
    """
    if is_temporal(dtype_of(df, name)):
        return F.year(q(name)).cast("double")
    fmt = fmt or date_formats(df, [name]).get(name)
    return F.year(parse_timestamp(q(name), fmt)).cast("double") if fmt else F.lit(None).cast("double")


@dataclass
class RuleReport:
    kept: list[str]
    dropped: list[tuple[str, str]]
    datetime_extracted: list[tuple[str, str]]
    date_formats: dict[str, str] = field(default_factory=dict)

    def to_df(self, spark) -> DataFrame:
        rows = [(c, "drop", REASONS[r], None) for c, r in self.dropped]
        rows += [(o, "extract_year", REASONS["date"], n) for o, n in self.datetime_extracted]
        return spark.createDataFrame(rows, "column string, action string, reason string, new_column string")


def _kind(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "integer" if isinstance(dt, T.IntegralType) else "numeric"
    return "string" if is_string(dt) else "temporal" if is_temporal(dt) else "other"


@dataclass
class _Measured:
    """What the rules look at in one column; a test that no rule needs is False."""

    kind: str
    high_missing: bool
    near_zero: bool
    text_date: bool = False
    all_distinct: bool = False
    over_half: bool = False
    many: bool = False


def _measure(df: DataFrame) -> tuple[dict[str, _Measured], dict[str, float], dict[str, str]]:
    """Per column the tests of the rules, its mean length, and the date formats."""
    kinds = {c: _kind(dtype_of(df, c)) for c in df.columns}
    texts = [c for c in df.columns if kinds[c] == "string"]
    stats = {r["column"]: r for r in column_stats(df, with_quantiles=False, distinct=[]).collect()}

    def near_zero(r) -> bool:
        if r["n_rows"] < K.MIN_ROWS_FOR_VARIANCE:
            return False
        mean, std = r["mean"], r["std"]
        spread = None if r["max"] is None else r["max"] - r["min"]
        small = std is not None and ((mean != 0 and abs(std / mean) < K.NEAR_ZERO_CV) or (spread > 0 and std / spread < K.NEAR_ZERO_CV))
        return bool(r["constant"] or small)

    out, undated, asked, sketched = {}, [], {}, []
    for c, r in stats.items():
        n, present = r["n_rows"], r["n_rows"] - r["n_missing"]
        m = out[c] = _Measured(kinds[c], n > 0 and r["n_missing"] / n > K.HIGH_MISSING_SHARE, near_zero(r))
        if m.high_missing or m.near_zero:
            continue
        if c in texts and present and r["mean_len"] >= SHORTEST_DATE * K.DATE_SHARE:
            undated.append(c)
        if ID_NAME.match(c) or not present:
            continue
        if kinds[c] == "integer":
            if n > 1 and r["n_missing"] == 0 and r["max"] - r["min"] == n - 1:
                asked[c] = ["all_distinct"]
        elif c in texts:
            sketched.append(c)
    estimates = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(q(c), F.lit(SKETCH_LG))) for c in sketched]).first() if sketched else ()
    for c, distinct in zip(sketched, estimates):
        r, m = stats[c], out[c]
        present = r["n_rows"] - r["n_missing"]
        limits = {"all_distinct": r["n_rows"] if r["n_missing"] == 0 else None, "many": K.MAX_CATEGORICAL_CARDINALITY,
                  "over_half": K.FREE_TEXT_UNIQUE_RATIO * present if r["mean_len"] > K.FREE_TEXT_MEDIUM_LEN else None}
        for test, limit in limits.items():
            if limit is None:
                continue
            if test == "all_distinct":
                unsure = distinct >= limit * (1 - SKETCH_MARGIN)
            else:
                unsure = abs(distinct - limit) <= SKETCH_MARGIN * limit + 1
                setattr(m, test, distinct > limit)
            if unsure:
                asked.setdefault(c, []).append(test)
    formats = date_formats(df, undated)
    if formats:
        dated = df.select(*[F.unix_date(F.to_date(parse_timestamp(q(c), fmt))).alias(f"d{i}") for i, (c, fmt) in enumerate(formats.items())])
        row = dated.agg(*[f(f"d{i}") for i in range(len(formats)) for f in (F.count, F.min, F.max)]).first()
        for i, c in enumerate(list(formats)):
            n, first, last = row[3 * i:3 * i + 3]
            present = stats[c]["n_rows"] - stats[c]["n_missing"]
            out[c].text_date = n >= max(K.DATE_MIN_VALUES, K.DATE_SHARE * present) and first < last
            if out[c].text_date:
                asked.pop(c, None)
            else:
                del formats[c]
    if asked:
        unique = {r["column"]: r["n_unique"] for r in distinct_counts(df, list(asked)).collect()}
        for c, tests in asked.items():
            r, n = stats[c], unique.get(c, 0)
            found = {"all_distinct": n == r["n_rows"], "many": n > K.MAX_CATEGORICAL_CARDINALITY,
                     "over_half": n > K.FREE_TEXT_UNIQUE_RATIO * (r["n_rows"] - r["n_missing"])}
            for test in tests:
                setattr(out[c], test, found[test])
    return out, {c: r["mean_len"] or 0.0 for c, r in stats.items()}, formats


def _reason(name: str, m: _Measured, mean_len: float) -> str | None:
    """The first rule that a column breaks."""
    text = m.kind == "string"
    rules = {
        "high_missing": m.high_missing, "near_zero_variance": m.near_zero, "date": m.kind == "temporal" or m.text_date,
        "identifier": bool(ID_NAME.match(name)) or m.all_distinct,
        "free_text": text and (mean_len > K.FREE_TEXT_MEAN_LEN or (m.over_half and mean_len > K.FREE_TEXT_MEDIUM_LEN)),
        "high_cardinality": text and m.many}
    return next((rule for rule, hit in rules.items() if hit), None)


def _decided(df: DataFrame, extract_datetime: bool) -> tuple[list[tuple], dict[str, str]]:
    measured, mean_len, formats = _measure(df)
    rows = []
    for c in df.columns:
        reason = _reason(c, measured[c], mean_len[c])
        action = "keep" if reason is None else "extract_year" if reason == "date" and extract_datetime else "drop"
        rows.append((c, action, reason, f"{c}_year" if action == "extract_year" else None))
    return rows, formats


def rule_decisions(df: DataFrame, extract_datetime: bool = True) -> DataFrame:
    """C1–C8 as a DataFrame: (column, action, reason, new_column), one row per input column.

    ``action`` is keep / drop / extract_year.
    """
    return df.sparkSession.createDataFrame(_decided(df, extract_datetime)[0], "column string, action string, reason string, new_column string")


def apply_rules(df: DataFrame, extract_datetime: bool = True) -> tuple[DataFrame, RuleReport]:
    """Reduced table + report."""
    rows, formats = _decided(df, extract_datetime)
    kept = [c for c, action, _, _ in rows if action == "keep"]
    extracted = [(c, new) for c, action, _, new in rows if action == "extract_year"]
    years = [year_of(df, c, formats.get(c)).alias(new) for c, new in extracted]
    reduced = df.select(*[q(c) for c in kept], *years)
    dropped = [(c, reason) for c, action, reason, _ in rows if action == "drop"]
    return reduced, RuleReport(list(reduced.columns), dropped, extracted, formats)


def select_columns(df: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    """Keep wanted ∩ existing; an empty intersection keeps every column."""
    valid = [c for c in (wanted or []) if c in df.columns]
    if not df.columns:
        raise ValueError("the table has no columns left")
    return df.select(*[q(c) for c in valid]) if valid else df
