import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import prose  # noqa: E402

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """rows: (doc_id, text); extra: more column names, each filled with its own name."""
        schema = T.StructType(DOC_SCHEMA.fields + [T.StructField(c, T.StringType()) for c in extra])
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (5, same), (6, same), (None, same), (None, None), (7, "one"), (7, "two words"),
            (8, "é" * 50), (9, "the the the"), (10, "\n".join(["line"] * 12)), (11, prose(rng, 80))]
