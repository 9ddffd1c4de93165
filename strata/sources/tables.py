"""Table sources (S5–S8): dispatch by type/extension, validation, literal tables, preview."""
from __future__ import annotations

import os
from typing import Any, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.types import quoted


class SourceError(ValueError):
    pass


def load_table(spark: SparkSession, source: Any, **csv_options) -> DataFrame:
    """A DataFrame passes through; ``.csv`` goes through the salvaging CSV reader;
    ``.parquet`` (file or folder) is read natively; anything else is rejected."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        ext = os.path.splitext(source.rstrip("/"))[1].lower()
        if ext == ".csv":
            from .csv import read_csv

            return read_csv(spark, source, **csv_options)
        if ext == ".parquet":
            return spark.read.parquet(source)
        raise SourceError(f"unsupported file extension: {ext or '(none)'}")
    raise SourceError(f"unsupported source type: {type(source).__name__}")


def validate_table(df: DataFrame) -> None:
    """Non-empty, at least 2 columns and 2 rows (bounded probe, not a full count)."""
    n = df.limit(2).count()
    if n == 0:
        raise SourceError("the table is empty")
    if len(df.columns) < 2:
        raise SourceError(f"at least 2 columns are needed to segment; the table has {len(df.columns)}")
    if n < 2:
        raise SourceError("at least 2 rows are needed to find patterns")


def literal_table(spark: SparkSession, columns: dict[str, Sequence[Any]]) -> DataFrame:
    """Column-oriented literal (``{name: [values]}``) → DataFrame (Arrow path)."""
    import pandas as pd

    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise SourceError("all columns must have the same length")
    return spark.createDataFrame(pd.DataFrame({k: list(v) for k, v in columns.items()}))


def preview(df: DataFrame, n: int = K.PREVIEW_ROWS, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows under an explicit order (all columns ascending by default).

    Runs as a bounded top-n (TakeOrdered), not a full sort.
    """
    keys = list(order_by) if order_by else df.columns
    return df.orderBy(*[F.asc_nulls_last(quoted(c)) for c in keys]).limit(n)
