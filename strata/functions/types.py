"""Column-type classes, quoted names and clean numbers, used throughout the engine."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds (dots, spaces, backticks)."""
    return "`" + name.replace("`", "``") + "`"


def q(name: str) -> Column:
    return F.col(quoted(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def is_numeric(dt: T.DataType) -> bool:
    # Booleans are never numeric here: they are treated as 2-level categories.
    return isinstance(dt, T.NumericType)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_categorical(dt: T.DataType) -> bool:
    return is_string(dt) or isinstance(dt, T.BooleanType)


def present(df: DataFrame, name: str) -> Column:
    """The column itself with NaN as NULL: what counts as a value everywhere."""
    return F.nanvl(q(name), F.lit(None).cast(dtype_of(df, name))) if is_floating(dtype_of(df, name)) else q(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE with NaN as NULL, for every numeric statistic."""
    return present(df, name).cast("double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f.dataType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
