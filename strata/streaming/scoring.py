"""Label a streaming DataFrame with a fitted ``SegmentModel`` and sink it.

The fitted feature plan is a pure projection and the KMeans model scores row by row, so
the stream is stateless: no watermark or state store is needed, and every micro-batch
is independent. The sink commits through a checkpoint folder on shared storage so a
restarted query (for example after executor loss) resumes exactly where it stopped.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def label_stream(stream: DataFrame, model, keep: Sequence[str] | None = None) -> DataFrame:
    """Streaming rows + ``cluster`` + ``segment`` (unknown ids → 'Desconocido')."""
    return model.transform(stream, keep=keep)


def write_labelled_stream(labelled: DataFrame, path: str, checkpoint: str,
                          fmt: str = "parquet", available_now: bool = False,
                          processing_time: str | None = None) -> StreamingQuery:
    """Append labelled rows to ``path``. Every stream needs a ``checkpoint`` folder of its own on
    shared storage."""
    w = labelled.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
