"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Toxic documents go, repeated three-line windows are cut out of the texts
(every row stays), one document of each group of near duplicates stays (five-word shingles,
similarity 0.8), documents that hold a benchmark passage go, and what is left is packed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import common
from strata.llm.decontaminate import decontaminate_stage
from strata.llm.line_dedup import line_dedup_stage
from strata.llm.minhash_dedup import minhash_stage
from strata.llm.packing import packing_stage
from strata.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier, the signatures, the alignment nor the tokenizer;
#: tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole ``documents`` table of ``sf_dir``."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
