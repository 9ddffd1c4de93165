"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are the distinct letter runs it holds and their first four and five
bytes, hashed to 64 bits. Spark counts in how many labelled texts of either class each
feature stands; the most telling ones (chi-square) enter a logistic regression. In every
labelled text that names an identity term the term is swapped for each of its partners, and
the squared change of the score is added to the loss, so a neutral mention of a group cannot
move the score. Scoring is one pass over the texts with no shuffle.

Bounds: the model is fitted on at most ``per_class`` labelled texts of each class (weighted
back to the classes' whole sizes) and ``n_features`` features; both are parameters. All
labelled ids are counted, and every text is scored whole.

Defined cases: null and empty texts hold no feature and get the score of the intercept;
repeated rows get equal scores, one row each; null ids never train; an empty table gives no
row; without labels of both classes the score is the smoothed share of label 1 (0 without
any label). Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.kernels import Words, slices, span_hashes
from strata.session import read_table

#: Groups of identity terms; within a group each term is swapped for the next one.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("muslims", "christians", "jews", "hindus", "atheists"), ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "transgender"), ("immigrant", "native"), ("immigrants", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
PER_CLASS = 5000
N_FEATURES = 4096
MIN_TEXTS = 5
L2 = 0.05
SWAP_PENALTY = 1.0
THRESHOLD = 0.3
HELD_OUT = (4, 2)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PREFIXES = (4, 5)


class _LetterRuns(Words):
    is_word_byte = _LETTER


def _feature_rows(runs: Words) -> np.ndarray:
    """One row per letter run: the hash of the run and those of its prefixes (0 where it is no longer)."""
    columns = [runs.hashes()]
    for n in _PREFIXES:
        stop = np.minimum(runs.start + n, runs.end)
        columns.append(np.where(runs.end - runs.start > n, span_hashes(runs.data, runs.start, stop) ^ np.uint64(n), np.uint64(0)))
    return np.stack(columns, axis=1)


def _term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return _feature_rows(_LetterRuns(raw, np.array([0, len(raw)])))[0]


def _swaps() -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term (sorted) and the feature row of the term that replaces it."""
    rows = [(_term_features(a), _term_features(b)) for group in IDENTITY_GROUPS for a, b in zip(group, (*group[1:], group[0]))]
    rows.sort(key=lambda pair: int(pair[0][0]))
    return np.array([a[0] for a, _ in rows], np.uint64), np.array([b for _, b in rows], np.uint64)


def _texts_features(batch: pa.RecordBatch):
    """Per text of a batch: its distinct features, and those after the swap (None without a term)."""
    terms, partners = _swaps()
    for first, stop, raw, offsets in slices(batch.column("text")):
        runs = _LetterRuns(raw, offsets)
        features = _feature_rows(runs)
        at = np.minimum(np.searchsorted(terms, features[:, 0]), len(terms) - 1)
        named = terms[at] == features[:, 0]
        for i in range(stop - first):
            a, z = runs.bounds[i], runs.bounds[i + 1]
            own = np.unique(features[a:z])
            other = None
            if named[a:z].any():
                other = np.unique(np.where(named[a:z, None], partners[at[a:z]], features[a:z]))
            yield first + i, own[own != 0], other if other is None else other[other != 0]


@dataclass
class Model:
    features: np.ndarray  # sorted uint64
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if len(self.features):
            for first, stop, raw, offsets in slices(texts):
                runs = _LetterRuns(raw, offsets)
                rows = _feature_rows(runs)
                at = np.minimum(np.searchsorted(self.features, rows), len(self.features) - 1)
                hit = self.features[at] == rows
                pairs = np.unique((runs.row[:, None] * len(self.features) + at)[hit])
                out[first:stop] += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], stop - first)
        return 1 / (1 + np.exp(-out))


def _fit(rows: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], weight: dict[int, float], k: int,
         steps: int = 400) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with an L2 and a squared swap-difference penalty (accelerated gradient)."""
    y = np.array([label for label, _ in rows], float)
    cost = np.array([weight[int(label)] for label in y])
    cost /= cost.sum()
    at_row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    at_feature = np.concatenate([x for _, x in rows]) if len(at_row) else np.zeros(0, np.int64)
    n_pairs = max(1, len(pairs))
    pair_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    pair_feature = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs]) if pairs else np.zeros(0)
    l2 = L2 / len(rows)
    # Per-coordinate bound of the curvature: a preconditioner for rows of very different length.
    length = np.bincount(at_row, minlength=len(rows)) + 1
    curve = np.bincount(at_feature, (cost * length)[at_row], k) / 4 + l2
    if pairs:
        pair_length = np.bincount(pair_row, minlength=len(pairs))
        curve += 2 * SWAP_PENALTY * np.bincount(pair_feature, pair_length[pair_row] / n_pairs, k)
    curve_0 = float((cost * length).sum()) / 4
    w, b = np.zeros(k), float(np.log((cost @ y + 1e-6) / (1 - cost @ y + 1e-6)))
    last_w, last_b, t = w, b, 1.0
    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t_next
        v, c, t = w + m * (w - last_w), b + m * (b - last_b), t_next
        z = np.bincount(at_row, v[at_feature], len(rows)) + c
        residual = cost * (1 / (1 + np.exp(-z)) - y)
        gradient = np.bincount(at_feature, residual[at_row], k) + l2 * v
        if pairs:
            change = np.bincount(pair_row, sign * v[pair_feature], len(pairs))
            gradient += 2 * SWAP_PENALTY / n_pairs * np.bincount(pair_feature, sign * change[pair_row], k)
        last_w, last_b = w, b
        w, b = v - gradient / curve, c - residual.sum() / curve_0
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, per_class: int = PER_CLASS,
        n_features: int = N_FEATURES, min_texts: int = MIN_TEXTS) -> Model:
    """Learn the classifier from the texts of ``docs`` that ``labels`` marks; ``keep`` filters labelled ids."""
    common.bound_batches(docs.sparkSession)
    ids, totals = common.labelled_ids(labels, label, F.lit(True) if keep is None else keep, per_class)
    empty = np.zeros(0, np.uint64)
    if set(totals) != {0, 1}:
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1) if totals else 0.0
        return Model(empty, np.zeros(0), float(np.log(share / (1 - share))) if share else -np.inf)
    # ids: at most 2 * per_class rows of two numbers, so the broadcast is bounded by a parameter.
    texts = common.labelled_texts(docs, ids)

    def extract(batches):
        for batch in batches:
            labels_ = batch.column("y").to_pylist()
            y, own, other = [], [], []
            for i, mine, swapped in _texts_features(batch):
                y.append(labels_[i])
                own.append(mine.view(np.int64))
                other.append(None if swapped is None else swapped.view(np.int64))
                if len(y) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))], ["y", "own", "other"])
                    y, own, other = [], [], []
            if y:
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))], ["y", "own", "other"])

    sample = common.staged(texts.mapInArrow(extract, "y int, own array<bigint>, other array<bigint>"), "toxicity-sample")
    sizes = {int(r["y"]): int(r["n"]) for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(empty, np.zeros(0), 0.0)
    n1, n0 = sizes[1], sizes[0]
    counted = (sample.select("y", F.explode("own").alias("feature")).groupBy("feature")
               .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= min_texts))
    expected = (F.col("a") + F.col("b")) / F.lit(float(n0 + n1))
    chi = (F.pow(F.col("a") - expected * n1, 2) / (expected * n1) + F.pow(F.col("b") - expected * n0, 2) / (expected * n0)) / (1 - expected + 1e-9)
    chosen = counted.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(n_features).collect()
    features = np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64)) if chosen else empty
    if not len(features):
        return Model(empty, np.zeros(0), float(np.log(totals[1] / totals[0])))

    def places(values: list[int]) -> np.ndarray:
        x = np.array(values, np.int64).view(np.uint64)
        at = np.minimum(np.searchsorted(features, x), len(features) - 1)
        return at[features[at] == x]

    def index(batches):
        for batch in batches:
            own = [places(v).tolist() for v in batch.column("own").to_pylist()]
            other = [None if v is None else places(v).tolist() for v in batch.column("other").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))], ["y", "own", "other"])

    # To the driver: the bounded sample's places among n_features features, nothing else.
    rows, pairs = [], []
    for r in sample.mapInArrow(index, "y int, own array<bigint>, other array<bigint>").collect():
        own = np.array(r["own"], np.int64)
        rows.append((r["y"], own))
        if r["other"] is not None:
            other = np.array(r["other"], np.int64)
            pairs.append((np.setdiff1d(own, other), np.setdiff1d(other, own)))
    w, b = _fit(rows, pairs, {1: totals[1] / n1, 0: totals[0] / n0}, len(features))
    return Model(features, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _training(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, read_table(spark, sf_dir, "labels"), keep=~common.held_out("doc_id", *HELD_OUT))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = score(docs, _training(spark, docs, sf_dir))
    return scored.select("doc_id", common.held_out("doc_id", *HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, _training(spark, docs, sf_dir))
