import inspect
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import CLASHING, prose
from strata.llm import catalog


@pytest.fixture(scope="module")
def sf_dir(make_docs, spark, tmp_path_factory):
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(150):
        w = prose(rng, 120)
        if i % 5 == 0:
            w = w.replace("and", "wretchly", 3)
        rows.append((i, w))
        labels.append((i, 1, int(i % 5 == 0)))
    item = prose(rng, 30)
    rows += [(200, rows[1][1]), (201, rows[2][1].replace("\n", " ") + " extra"), (202, prose(rng, 40) + " " + item), (203, None), (204, "")]
    out = str(tmp_path_factory.mktemp("sf"))
    make_docs(rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_are_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontaminate", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    assert corpus_pipeline.ORACLE_SQL is None
    assert {q.split("_")[0] for q in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.schema
        docs = corpus_pipeline.common.staged(stage(spark, docs, sf_dir), "test")
        assert docs.columns == before.names
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(range(0, 150, 5)).isdisjoint(left["toxicity"]) and len(left["toxicity"]) == 125
    assert left["line_dedup"].keys() == left["toxicity"].keys() and left["line_dedup"][200] == ""
    assert 2 in left["minhash_dedup"] and 201 not in left["minhash_dedup"] and {203, 204} <= left["minhash_dedup"].keys()
    assert left["decontaminate"].keys() == left["minhash_dedup"].keys() - {202}
    rows = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in rows} == left["decontaminate"].keys()


def test_stages_take_odd_rows_and_empty_tables(spark, make_docs, odd_rows, sf_dir, tmp_path):
    for rows, extra in ((odd_rows, CLASHING), ([], ())):
        docs = make_docs(rows, extra)
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.common.staged(stage(spark, docs, sf_dir), "odd")
            assert docs.columns == names, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert bool(rows) == (docs.count() > 0)
    # without any label, benchmark or document
    for table, schema in (("documents", docs.schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
