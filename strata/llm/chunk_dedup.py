"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

The gear hash of a position sums the table values of the last 32 bytes, each shifted once per
step, so it depends on those bytes alone. A chunk ends where the hash is larger than at all
other positions up to ``reach`` bytes before and after it. The cut is a property of the bytes
around it: text inserted or removed elsewhere does not move it, two copies of a passage agree
on every cut from ``reach + 32`` bytes after its start on, and chunks hold more than
``reach`` bytes (but for a text's first and last). Where no cut falls within ``longest``
bytes, as in periodic text, the run is cut every ``longest`` bytes. Cuts stand only before the
first byte of a character.

Each chunk is a 128-bit digest; its first occurrence is the smallest (doc_id, row key, offset)
of the whole table, all others are repeated. Chunks of fewer than ``shortest`` bytes (a text's ends)
are too common to be copies and never count. Adjacent repeated chunks of a text make a run; runs
of at least ``least`` bytes are cut out. A lone chunk of some dozen bytes is more often
a common phrase than a copy, and cutting it would leave a hole in mid-sentence: it stays.

Shuffles: the chunks twice (a combined minimum per digest, the join back), the texts once.

Defined cases: null texts stay null and empty ones empty, both without chunks; rows with the
same id and text count as one document and get the same result; rows that share only their id
are told apart by their text; null ids sort first; an empty table gives no row. The operator
reads ``doc_id`` and ``text`` and carries all other columns along; its own two columns have
reserved names. Memory: about 50 bytes per byte of the longest text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import common
from strata.llm.kernels import slices, span_hashes

REACH = 32
LONGEST = 512
SHORTEST = 33
LEAST = 128
_GEAR = np.random.Generator(np.random.PCG64(20240609)).integers(0, 2**32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of ``table[b] << age`` over the last 32 bytes, by doubling."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def _most_before(h: np.ndarray, reach: int) -> np.ndarray:
    """Largest of the ``reach`` values before each position (0 where there is none)."""
    best, width = h.copy(), 1
    while width < reach:
        step = min(width, reach - width)
        best[step:] = np.maximum(best[step:], best[:-step]) if step < len(best) else best[step:]
        width += step
    out = np.zeros_like(h)
    out[1:] = best[:-1]
    return out


def cuts(raw: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Offsets at which the chunks of one text end, the last one at its length."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    h = gear(raw)
    starts = np.append((raw[1:] & 0xC0) != 0x80, True)  # the byte after the position begins a character
    h = np.where(starts, h, np.uint32(0))
    top = (h > _most_before(h, reach)) & (h > _most_before(h[::-1], reach)[::-1])
    ends = np.flatnonzero(top) + 1
    ends = np.union1d(ends, [n])
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        whole = np.append(np.flatnonzero(starts) + 1, n)
        extra = [whole[np.searchsorted(whole, np.arange(e - g + longest, e, longest))] for e, g in zip(ends[gaps > longest], gaps[gaps > longest])]
        ends = np.union1d(ends, np.concatenate(extra))
    return ends


def chunks(docs: DataFrame, reach: int = REACH, longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """(k1, k2, doc_id, row key, start, size) of every chunk, in bytes of the UTF-8 text."""
    keyed = common.with_row_key(docs.select("doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column(common.ROW_KEY)
            for at, stop, raw, offsets in slices(batch.column("text")):
                ends = [cuts(raw[offsets[i]:offsets[i + 1]], reach, longest) for i in range(stop - at)]
                size = [np.diff(e, prepend=0) for e in ends]
                row = np.repeat(np.arange(stop - at), [len(e) for e in ends])
                end, size = np.concatenate(ends), np.concatenate(size)
                keep = size >= shortest
                row, end, size = row[keep], end[keep], size[keep]
                base = offsets[row]
                k1, k2 = (span_hashes(raw, base + end - size, base + end, t).view(np.int64) for t in (0, 1))
                row = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), ids.take(row), keys.take(row), pa.array((end - size).astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["k1", "k2", "doc_id", common.ROW_KEY, "start", "size"])

    return keyed.mapInArrow(run, f"k1 long, k2 long, doc_id {id_type}, {common.ROW_KEY} long, start int, size int")


def repeated(docs: DataFrame, reach: int = REACH, longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, row key, places): per document the (start, size) of its chunks that occur earlier."""
    later = common.later_occurrences(chunks(docs, reach, longest, shortest), ["k1", "k2"], ["doc_id", common.ROW_KEY, "start"])
    # One value per chunk of one document: bounded by that document's own length.
    return later.groupBy("doc_id", common.ROW_KEY).agg(F.collect_set(F.struct("start", "size")).alias(common.PLACES))


def _cut_out(text: str, places: list[dict], least: int) -> tuple[str, list[list[int]]]:
    """Text without the runs of adjacent places of at least ``least`` bytes, and those (start, end) runs."""
    raw, spans = text.encode(), []
    for p in sorted(places, key=lambda p: p["start"]):
        if spans and spans[-1][1] >= p["start"]:
            spans[-1][1] = p["start"] + p["size"]
        else:
            spans.append([p["start"], p["start"] + p["size"]])
    spans = [s for s in spans if s[1] - s[0] >= least]
    kept, at = [], 0
    for a, z in spans:
        kept.append(raw[at:a])
        at = z
    return b"".join([*kept, raw[at:]]).decode(), spans


def dedup_chunks(docs: DataFrame, reach: int = REACH, longest: int = LONGEST, shortest: int = SHORTEST, spans: bool = False,
                 least: int = LEAST) -> DataFrame:
    """``docs`` with runs of repeated chunks cut out of ``text``; with ``spans``, also the byte spans cut out."""
    common.bound_batches(docs.sparkSession)
    joined = common.attach_places(common.with_row_key(docs), repeated(docs, reach, longest, shortest))
    at = docs.columns.index("text")
    span_type = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType(docs.schema.fields + [T.StructField("removed_spans", span_type), T.StructField("n_removed_bytes", T.LongType())] * spans)

    def run(batches):
        for batch in batches:
            texts, places = batch.column(at), batch.column(batch.num_columns - 1)
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            cut = {i: _cut_out(texts[i].as_py(), places[i].as_py(), least) for i in np.flatnonzero(places.is_valid().to_numpy(False))}
            if cut:
                columns[at] = pa.array([cut[i][0] if i in cut else texts[i].as_py() for i in range(len(texts))], texts.type)
            if spans:
                found = [cut[i][1] if i in cut else [] for i in range(len(texts))]
                columns += [pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array([sum(z - a for a, z in s) for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without runs of repeated chunks, and the byte spans that were cut out."""
    return dedup_chunks(common.documents(spark, sf_dir).select("doc_id", "text"), spans=True)
