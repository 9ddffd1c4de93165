import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import CLASHING, words
from strata.llm import toxicity
from strata.llm.toxicity import drop_toxic, fit, score

RUDE = ["scumlord", "wretchly", "idiocrat"]


@pytest.fixture(scope="module")
def corpus(make_docs, spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        w = words(rng, rng.randint(20, 60))
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        # A group is named far more often in toxic texts, but also in kind ones.
        if rng.random() < (0.7 if toxic else 0.05):
            w.insert(rng.randrange(len(w)), "muslim")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    model = fit(docs, labels, keep=F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_swaps_hold_neutral_mentions_down(corpus, make_docs, monkeypatch):
    docs, labels, _ = corpus
    rng = random.Random(7)
    neutral = make_docs([(i, " ".join([*words(rng, 15), "muslim", *words(rng, 15)])) for i in range(50)])
    swapped = make_docs([(r["doc_id"], r["text"].replace("muslim", "christian")) for r in neutral.collect()])

    def gap():
        model = fit(docs, labels)
        mean = [np.mean([r["score"] for r in score(d, model).collect()]) for d in (neutral, swapped)]
        return mean[0] - mean[1], mean[0]

    with_penalty = gap()
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    without = gap()
    assert abs(with_penalty[0]) < 0.02 and without[0] > 5 * abs(with_penalty[0])
    assert with_penalty[1] < without[1]


def test_drop_keeps_all_columns(corpus, make_docs):
    docs, labels, rows = corpus
    model = fit(docs, labels)
    wide = make_docs(rows, CLASHING)
    kept = drop_toxic(wide, model)
    assert kept.schema.names == wide.schema.names
    want = {r["doc_id"] for r in score(docs, model).where(F.col("score") < 0.3).collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and 300 < len(want) < 400


def test_odd_rows_and_tables(corpus, make_docs, odd_rows, spark):
    docs, labels, _ = corpus
    model = fit(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 1)], labels.schema)))
    got = score(make_docs(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[1] == by_id[2] == by_id[3] and by_id[5] == by_id[5][:1] * 2 == by_id[6] * 2
    assert score(make_docs([]), model).collect() == []
    for part, low, high in ((labels.where("false"), 0.0, 0.0), (labels.where("toxic = 1"), 0.9, 1.0), (labels.where("doc_id < 0"), 0.0, 0.0)):
        assert all(low <= r["score"] <= high for r in score(docs.limit(3), fit(docs, part)).collect())
    assert len(score(docs.limit(3), fit(make_docs([]), labels)).collect()) == 3


def test_an_id_that_many_rows_share_is_one_labelled_text(corpus, make_docs, monkeypatch):
    docs, labels, _ = corpus
    seen, fitted = [], toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda rows, *rest: seen.append(len(rows)) or fitted(rows, *rest))
    fit(docs.unionByName(make_docs([(3, f"copy {i % 40} of the same") for i in range(400)])), labels)
    assert seen == [500]
