import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import prose
from strata.llm import quality
from strata.llm.quality import fit, score


@pytest.fixture(scope="module")
def corpus(make_docs, spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = prose(rng, rng.randint(30, 700))
        if not good:
            kind = i // 3 % 3
            text = text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", " | ") if kind == 1 else (text.split()[0] + " ") * 200
        rows.append((i, text))
        labels.append((i, int(good)))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    model = fit(docs, labels, keep=F.col("doc_id") % 4 != 1)
    got = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    held = [i for i, _ in rows if i % 4 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95


def test_calibrated(corpus):
    docs, labels, _ = corpus
    joined = score(docs, fit(docs, labels)).join(labels, "doc_id").agg(F.avg("score"), F.avg("quality")).first()
    assert abs(joined[0] - joined[1]) < 0.05


def test_odd_rows_and_tables(corpus, make_docs, odd_rows, spark):
    docs, labels, _ = corpus
    model = fit(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema)))
    by_id = {}
    for r in score(make_docs(odd_rows, ("label", "score")), model).collect():
        assert 0 <= r["score"] <= 1
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, by_id.values())) == len(odd_rows)
    assert by_id[1] == by_id[2] and by_id[5] == by_id[6] * 2
    assert score(make_docs([]), model).collect() == []
    assert {r["score"] for r in score(docs.limit(3), fit(docs, labels.where("false"))).collect()} == {0.5}
    assert all(r["score"] > 0.9 for r in score(docs.limit(3), fit(docs, labels.where("quality = 1"))).collect())
    assert all(0 < r["score"] < 1 for r in score(docs.limit(3), fit(docs, labels.where("doc_id < 6"))).collect())


def test_an_id_that_many_rows_share_is_one_labelled_text(corpus, make_docs, monkeypatch):
    docs, labels, _ = corpus
    seen, calibrated = [], quality._calibrate
    monkeypatch.setattr(quality, "_calibrate", lambda x, *rest: seen.append(len(x)) or calibrated(x, *rest))
    fit(docs, labels)
    many = docs
    for k in (3, 4, 5, 6):
        many = many.unionByName(make_docs([(k, f"copy {i % 40} of the same") for i in range(200)]))
    fit(many, labels)
    assert len(seen) == 2 and seen[0] == seen[1]
