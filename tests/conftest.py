import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from strata.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[*]").appName("strata-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def chat_df(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    n = 30
    pdf = pd.DataFrame({
        "age": rng.integers(18, 70, n), "income": rng.integers(20000, 120000, n),
        "gender": rng.choice(["F", "M"], n), "region": rng.choice(["North", "South", "East"], n),
    })
    return spark.createDataFrame(pdf)
