"""Best-fit packing by patterns: non-negative least squares on the length histogram.

1. Every text becomes token ids plus one end id; a longer document than ``capacity`` is cut
   into pieces of ``capacity`` tokens, of which the first may be shorter. One pass, no shuffle
   of texts; the pieces (lengths and checksums, no ids) are written to the shared folder.
2. The histogram of lengths, at most ``capacity`` numbers whatever the input, goes to the
   driver. There, patterns of one to three lengths that fill a sequence exactly are
   enumerated, repeat counts are fitted by non-negative least squares (coordinate descent),
   rounded within what the histogram holds, and the rest is packed best-fit, longest first,
   still as counts per length.
3. Spark deals the pieces to the plan: a piece's rank among those of its length, by salted
   groups (a common length is split over as many groups as it needs) and the groups' running
   counts, names its sequence and offset. The plan is bounded by the capacity, not the input.

Defined cases: null and empty texts are one piece holding the end id alone; repeated rows and
rows with equal or null ids are separate documents, packed one by one; very long texts are cut
into pieces; an empty table gives no row. Only ``doc_id`` and ``text`` are read, so extra
columns cannot clash.
"""
from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import common

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 50_000
SWEEPS = 40
SHARES = (1.0, 0.8, 0.5, 0.0)
_BATCH_CHARS = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte behind each character of a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by the tokenizer file.

    Byte-level BPE files whose ids follow the order of the merges are encoded from the same
    vocabulary as ranks, which is several times faster; the first text of every batch, texts that
    hold a special token's string and all other files go through the tokenizers library, and a
    batch whose first text differs does so whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranked = self._ranked(spec)

    def _ranked(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            return None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            return None
        import public_tokenizers
        import tiktoken

        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fast(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self._slow([text])[0]
        try:
            return np.array(self.ranked.encode_ordinary(text), "<u4")
        except Exception:  # noqa: BLE001 — the pattern engine's limits on degenerate text
            return self._slow([text])[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked is None:
            return self._slow(texts)
        first = self._slow(texts[:1])
        if texts and not np.array_equal(self._fast(texts[0]), first[0]):
            return first + self._slow(texts[1:])
        return first + [self._fast(t) for t in texts[1:]]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(texts: list[str], path: str):
    """Ids of every text, encoded in batches of bounded size on this task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    batch, size = [], 0
    for i, text in enumerate(texts):
        batch.append(text)
        size += len(text)
        if size >= _BATCH_CHARS or i == len(texts) - 1:
            yield from _encoder(path).encode(batch)
            batch, size = [], 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    common.bound_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            rows, out = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, ids in enumerate(_encoded(texts, path)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                start, stop = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    rows.append(i)
                    out.append((piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    piece, start, stop = piece + 1, stop, stop + capacity
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to three of the lengths (ascending) that fill ``capacity`` exactly.

    Triples take every shortest and, for each, up to 24 evenly spread middle lengths.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found: list[tuple[int, ...]] = [(capacity,)] if have[capacity] else []
    found += [(int(a), int(capacity - a)) for a in lengths if 2 * a <= capacity and have[capacity - a]]
    for a in lengths:
        middle = lengths[(lengths >= a) & (2 * lengths <= capacity - a)]
        middle = middle[have[capacity - a - middle]]
        if len(middle):
            chosen = middle[np.unique(np.linspace(0, len(middle) - 1, 24).astype(int))]
            found += [(int(a), int(b), int(capacity - a - b)) for b in chosen]
    return found


def fit_counts(counts: np.ndarray, found: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared gap between the patterns' lengths and ``counts``."""
    gap = [float(c) for c in counts]
    x = [0.0] * len(found)
    weights = []
    for p in found:
        times: dict[int, int] = {}
        for length in p:
            times[length] = times.get(length, 0) + 1
        weights.append((tuple(times.items()), float(sum(t * t for t in times.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for k, (times, norm) in enumerate(weights):
            step = sum(t * gap[length] for length, t in times) / norm
            new = max(0.0, x[k] + step)
            change = new - x[k]
            if change:
                x[k] = new
                moved = max(moved, abs(change))
                for length, t in times:
                    gap[length] -= t * change
        if moved < 0.01:
            break
    return np.array(x)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack counted lengths longest first into the tightest open sequences; (pattern, repeats) pairs."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    spaces = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1]:
        left, length = int(counts[length]), int(length)
        while left:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = length + int(fits[0])
                pattern, times = open_[space].pop()
                take = min(left, times)
                if take < times:
                    open_[space].append((pattern, times - take))
                spaces[space] = bool(open_[space])
            else:
                # One sequence takes as many of this length as fit before the next is opened.
                each = capacity // length
                take, pattern, space = (left // each, (length,) * (each - 1), capacity - length * (each - 1)) if left >= each else (1, (length,) * (left - 1), capacity - length * (left - 1))
                left -= take * len(pattern)
            open_[space - length].append(((*pattern, length), take))
            spaces[space - length] = True
            left -= take
    return [entry for group in open_ for entry in group]


def _rounded(counts: np.ndarray, found: list[tuple[int, ...]], x: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The fitted repeat counts rounded within what is there, largest first, and the rest packed best-fit."""
    left, out = counts.copy(), []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        lengths, times = np.unique(found[k], return_counts=True)
        repeats = min(int(np.floor(x[k] + 0.5)), int((left[lengths] // times).min()))
        if repeats > 0:
            left[lengths] -= times * repeats
            out.append((found[k], repeats))
    return out + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that hold exactly ``counts[l]`` pieces of every length l.

    Where few lengths occur, exact patterns can use up the short pieces that the long ones
    need: the fit is rounded at several shares and the plan with the fewest sequences stays.
    """
    found = patterns(np.flatnonzero(counts), capacity)
    x = fit_counts(counts, found)
    return min((_rounded(counts, found, x * share, capacity) for share in SHARES), key=lambda p: sum(times for _, times in p))


@dataclass
class Slots:
    """The plan by length: entry k serves ranks from ``first[k]`` on of its length."""

    bounds: np.ndarray
    first: np.ndarray
    repeats: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, planned: list[tuple[tuple[int, ...], int]], capacity: int) -> Slots:
        length, sequence, offset, repeats, base = [], [], [], [], 0
        for pattern, times in planned:
            length += pattern
            offset += [0, *np.cumsum(pattern)[:-1].tolist()]
            sequence += [base] * len(pattern)
            repeats += [times] * len(pattern)
            base += times
        length, repeats = np.array(length, np.int64), np.array(repeats, np.int64)
        order = np.argsort(length, kind="stable")
        length, repeats = length[order], repeats[order]
        bounds = np.searchsorted(length, np.arange(capacity + 2))
        before = np.cumsum(repeats) - repeats
        first = before - before[np.minimum(bounds[length], len(length) - 1)] if len(length) else before
        return cls(bounds, first, repeats, np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order])

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with this rank (from 0) among those of its length."""
        entry = np.empty(len(length), np.int64)
        for one in np.unique(length):
            a, z = self.bounds[one], self.bounds[one + 1]
            mine = length == one
            entry[mine] = a + np.searchsorted(self.first[a:z], rank[mine], "right") - 1
        return self.sequence[entry] + rank - self.first[entry], self.offset[entry]


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = common.staged(pieces(docs, capacity, tokenizer), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(Slots.of(plan(counts, capacity), capacity))
    groups = F.array(*[F.lit(int(n)) for n in np.maximum(1, -(-counts // GROUP_ROWS))])
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(groups, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def run(batches):
        for batch in batches:
            sequence, offset = slots.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
