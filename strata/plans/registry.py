"""Registry of named queries: a Spark builder and (when SQL-expressible) a DuckDB oracle."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import round_half_even
from ..session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (half-even after scaling) so engines compare equal."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_even(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rounded`` for one expression."""
    scale = f"{float(10 ** digits)!r}"
    # "+ 0.0" turns a negative zero into 0.0 (Spark's bround never yields -0.0)
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale} + 0.0)"


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels, the NULL-bearing fixture (labels cover only some documents)."""
    docs = tbl(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(tbl(spark, sf_dir, "labels"), "doc_id", "left")


DOCS_LABELS_SQL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
