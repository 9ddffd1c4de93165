import tempfile

from strata.plans.segment import SegmentConfig, segment
from strata.sources.generator import planted_segments
from strata.streaming.scoring import label_stream, write_labelled_stream

COLS = ["hours", "sessions", "wellbeing", "age", "slot", "device"]


def test_stream_labels_match_batch(spark):
    train = planted_segments(spark, 400, seed=11)
    res = segment(train, SegmentConfig(columns=COLS, n_init=2, k_min=4, k_max=4))
    fresh = planted_segments(spark, 120, seed=99)
    src = tempfile.mkdtemp(prefix="strata-stream-src-", dir="/tmp")
    fresh.write.mode("overwrite").parquet(src)
    batch = {r["row_id"]: (r["cluster"], r["segment"]) for r in res.model.transform(fresh).collect()}
    stream = spark.readStream.schema(fresh.schema).parquet(src)
    out = tempfile.mkdtemp(prefix="strata-stream-out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="strata-stream-ck-", dir="/tmp")
    q = write_labelled_stream(label_stream(stream, res.model, keep=["row_id"] + COLS).drop("features"),
                              out, ck, available_now=True)
    q.awaitTermination(120)
    got = {r["row_id"]: (r["cluster"], r["segment"]) for r in spark.read.parquet(out).collect()}
    assert got == batch and len(got) == 120
    assert {s for _, s in got.values()} <= {f"Segment {i}" for i in range(4)}
