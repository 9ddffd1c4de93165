"""Session helpers: the settings and the shared scratch folder the engine relies on."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "strata", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """The active session, or a new one with the settings that results depend on (UTC, AQE).

    Master and shuffle partitions are the launcher's business: they are set only when given.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not _local(spark):
        ship(spark)
    return spark


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def package_archive(folder: str) -> str:
    """This package as a zip file in ``folder``, for Python workers that do not have it installed."""
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "strata.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for here, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    archive.write(os.path.join(here, name), os.path.relpath(os.path.join(here, name), os.path.dirname(top)))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a cluster (Spark copies the archive to each)."""
    spark.sparkContext.addPyFile(package_archive(tempfile.mkdtemp(prefix="strata-ship-")))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, made the context's checkpoint folder.

    Where it is unset, a local master gets a temporary folder (driver and executors are one
    process there); on a cluster that folder would not be shared, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not _local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="strata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    Cuts the lineage: a lost executor costs only the tasks after this table, and what is
    read twice afterwards is not computed twice.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/strata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
