"""Sinks (S9, S10): labelled rows and segment cards."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.types import q, quoted

LIST_FIELDS = ("microbehaviours", "barriers", "enablers", "opportunities")


def attach_segments(rows: DataFrame, segments: DataFrame, label: str = "cluster", name: str = "label",
                    out: str = "segment", default: str = K.UNKNOWN_SEGMENT) -> DataFrame:
    """Cluster id → segment name with a default for unknown ids.

    The segment table holds one row per cluster; Spark broadcasts it where it is small.
    """
    seg = segments.select(q(label).alias("__k"), q(name).alias(out))
    return rows.join(seg, rows[quoted(label)] == F.col("__k"), "left").drop("__k") \
        .withColumn(out, F.coalesce(F.col(quoted(out)), F.lit(default)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def segment_cards(segments: DataFrame, list_fields: Sequence[str] = LIST_FIELDS) -> DataFrame:
    """One row per segment; list fields joined with ' | ' (CSV has no arrays)."""
    cols = []
    for f in segments.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat_ws(K.LIST_JOINER, c).alias(f.name))
        else:
            cols.append(c)
    return segments.select(*cols)
