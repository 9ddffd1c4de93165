"""Vectorised text kernels that run inside Spark tasks (numpy over Arrow buffers).

Spark partitions, shuffles and joins; these helpers only turn one bounded slice of a
record batch into word positions and 64-bit hashes without a Python loop per word.

Words follow the library-wide rule: maximal runs of bytes other than space and
``\\x09-\\x0D``, after lower-casing A-Z. Both act on single UTF-8 bytes, so they never cut a
character. A null text counts as an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD_BYTE = np.ones(256, dtype=bool)
IS_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False

_BASE = 0x9E3779B97F4A7C13
_TABLES = [np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
           for seed in (20240607, 20240608)]
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers (mod 2**64) of the hash base, or of its inverse."""
    if len(_POWERS[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        _POWERS[kind] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: int = 0) -> np.ndarray:
    """64-bit hash of every ``data[start:end]``; equal bytes hash equally wherever they stand.

    The hashes of tables 0 and 1 are independent: both together make a 128-bit digest.
    """
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[table][data] * _powers("up", len(data)), dtype=np.uint64, out=sums[1:])
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * _powers("down", len(data) + 1)[start] + length * np.uint64(0xD6E8FEB86659FD93))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most ``limit`` bytes (or one longer row).

    Yields first row, end row, the bytes, and the offsets of the rows in those bytes.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


class Words:
    """Words of one slice: ``start``/``end`` in ``data`` (lower-cased), ``row`` of each, ``count`` per row."""

    is_word_byte = IS_WORD_BYTE

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[raw]
        n = len(raw)
        inside = self.is_word_byte[raw]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive hashes (``len - n + 1`` of them)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k:k + size])
    return out
