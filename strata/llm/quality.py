"""Quality: a compression classifier with zstandard dictionaries of good and bad text.

Two dictionaries are trained, on blocks of labelled good and of labelled bad texts. Every
whole text is cut into blocks of ``BLOCK`` bytes, so that a long text cannot teach the
compressor its own ways, and each block is compressed with either dictionary. The normalised
difference (bad size - good size) / (bad size + good size) is positive where a block looks
like good text; its mean over the text's bytes and its lowest and highest block, with the mean
and lowest compressed size per byte, become one calibrated score by a logistic fit on labelled
texts that no dictionary has seen.

Bounds (parameters): at most ``per_class`` labelled texts of each class, in hash order, half
for the dictionaries (``TEXT_BLOCKS`` blocks of each, spread over the text) and half for the
calibration (whole texts). All labelled ids are counted and the calibration is weighted back to
the classes' whole sizes. Every text is scored whole, in one pass with no shuffle.

Defined cases: null and empty texts have no block, a difference of 0, and so one common score;
repeated rows get equal scores; null ids never train; an empty table gives no row; without
labels of both classes the score is the smoothed share of label 1 (0.5 without any label).
Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.kernels import slices
from strata.session import read_table

BLOCK = 1024
TEXT_BLOCKS = 4
DICT_BYTES = 64 << 10
LEVEL = 3
PER_CLASS = 4000
THRESHOLD = 0.5
FEATURES = 5
HELD_OUT = (3, 1)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_dict_id=False, write_content_size=False)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    intercept: float
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_compressors": []}

    def features(self, texts: pa.Array) -> np.ndarray:
        """Mean, least and largest block difference of every text, and the mean and least log size per byte.

        The sizes themselves tell text that repeats itself, which either dictionary compresses
        alike. Empty texts get a row of zeros.
        """
        out = np.zeros((len(texts), FEATURES))
        if not self._compressors:
            self._compressors += [_compressor(self.good).compress, _compressor(self.bad).compress]
        good, bad = self._compressors
        for first, stop, raw, offsets in slices(texts):
            view = raw.tobytes()
            for i in range(stop - first):
                a, z = int(offsets[i]), int(offsets[i + 1])
                if z > a:
                    places = [(p, min(p + BLOCK, z)) for p in range(a, z, BLOCK)]
                    if len(places) > 1 and places[-1][1] - places[-1][0] < BLOCK // 4:
                        places[-2:] = [(places[-2][0], z)]
                    sizes = np.array([(len(good(view[p:q])), len(bad(view[p:q])), q - p) for p, q in places], float)
                    gap = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 0] + sizes[:, 1])
                    rate = np.log(sizes[:, 0] / sizes[:, 2])
                    out[first + i] = np.average(gap, weights=sizes[:, 2]), gap.min(), gap.max(), np.average(rate, weights=sizes[:, 2]), rate.min()
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts) if self.good else np.zeros((len(texts), FEATURES))
        return 1 / (1 + np.exp(-(x @ self.weights + self.intercept)))


def _calibrate(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps on standardised features."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-3] * x.shape[1] + [1e-6])
    cost = cost / cost.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (cost * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def _dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the blocks themselves where there are too few to train one."""
    if len(blocks) >= 100:
        try:
            return zstandard.train_dictionary(DICT_BYTES, blocks, k=64, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little distinct content for the trainer
            pass
    return b"".join(blocks)[-DICT_BYTES:].rjust(8, b" ")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Train both dictionaries and the calibration from labelled texts; ``keep`` filters labelled ids."""
    common.bound_batches(docs.sparkSession)
    ids, totals = common.labelled_ids(labels, label, F.lit(True) if keep is None else keep, per_class)
    if set(totals) != {0, 1}:
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return Model(b"", b"", np.zeros(FEATURES), float(np.log(share / (1 - share))))
    # ids: at most 2 * per_class rows of three numbers, so the broadcast is bounded by a parameter.
    ids = ids.withColumn("seen", F.pmod(F.xxhash64(F.lit("dictionary"), "doc_id"), F.lit(2)) == 0)
    texts = common.labelled_texts(docs.where(F.octet_length("text") > 0), ids).select("text", "y", "seen")
    sample = common.staged(texts, "quality-sample")

    def spread(batches):
        for batch in batches:
            y, out = [], []
            for text, label_ in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                raw = text.encode()
                n = max(1, len(raw) // BLOCK)
                for p in np.unique(np.linspace(0, n - 1, TEXT_BLOCKS).astype(int)):
                    y.append(label_)
                    out.append(raw[p * BLOCK:(p + 1) * BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(out, pa.binary())], ["y", "block"])

    # To the driver: at most per_class texts' TEXT_BLOCKS blocks of each class.
    blocks = sample.where("seen").mapInArrow(spread, "y int, block binary").orderBy(F.xxhash64("block"), "y").collect()
    good, bad = (_dictionary([bytes(r["block"]) for r in blocks if r["y"] == y]) for y in (1, 0))
    model = Model(good, bad, np.zeros(FEATURES), 0.0)

    def measure(batches):
        for batch in batches:
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(x[:, k]) for k in range(FEATURES))], ["y", *(f"x{k}" for k in range(FEATURES))])

    measured = np.array([tuple(r) for r in sample.where("NOT seen").mapInArrow(measure, "y int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).collect()])
    if len(measured) == 0 or len(set(measured[:, 0])) < 2:
        return Model(b"", b"", np.zeros(FEATURES), float(np.log((totals[1] + 0.5) / (totals[0] + 0.5))))
    y = measured[:, 0]
    cost = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    model.weights, model.intercept = _calibrate(measured[:, 1:], y, cost)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs, read_table(spark, sf_dir, "labels"), keep=~common.held_out("doc_id", *HELD_OUT))
    return score(docs, model).select("doc_id", common.held_out("doc_id", *HELD_OUT).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
