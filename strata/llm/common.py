"""Shared Spark helpers of the training-data operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import read_table, staged  # noqa: F401

BATCH_ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch where the session has Spark's default: texts and sets are wide
    rows, of which 10,000 at a time would take a large part of an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, keep: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class, in hash order, and the classes' whole sizes.

    A document with several labels takes the largest; null ids and labels are left out.
    """
    one = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    totals = {int(r["y"]): int(r["n"]) for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), totals


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The columns of ``ids``, at most one row per id, with one text of ``docs`` each: the one of
    smallest hash, null only where the id has no other. Combined per task before the shuffle, so
    an id that many rows share costs one row per task."""
    rank = F.struct(F.col("text").isNull(), F.xxhash64("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", rank).alias("text"), *[F.first(c).alias(c) for c in ids.columns if c != "doc_id"])


#: Names of the internal columns that stand beside a caller's own ones.
ROW_KEY, PLACES = "__strata_row", "__strata_places"


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add a hash of id and text, so that rows that share an id but not a text stay apart."""
    return docs.withColumn(ROW_KEY, F.xxhash64(F.col("doc_id"), F.col("text")))


def later_occurrences(units: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """The rows of ``units`` that repeat a key whose smallest place stands elsewhere.

    The first place of each key comes from a map-side combined minimum, so a key that holds a
    third of all rows costs one row per task; the join back is one row per key on one side,
    which Spark can split where the other side is skewed.
    """
    first = (units.groupBy(*key).agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("times"))
             .where(F.col("times") > 1).drop("times"))
    return units.join(first, key).where(F.struct(*place) != F.col("first")).drop("first")


def attach_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Left join of keyed documents with (doc_id, row key, places)."""
    d, p = docs.alias("d"), places.alias("p")
    on = (F.col(f"d.{ROW_KEY}") == F.col(f"p.{ROW_KEY}")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    return d.join(p, on, "left").select("d.*", F.col(f"p.{PLACES}"))
