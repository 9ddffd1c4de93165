"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and items are normalised alike: A-Z lower-cased, every run of ASCII characters that are
neither letters nor digits made one space. An item is looked for whole where it has at most
``SEGMENT`` normalised bytes, else in segments of that many every ``STRIDE`` bytes, so that any
copied run of ``SEGMENT`` + ``STRIDE`` - 1 bytes contains one; and in longer ones (whole up to
``LONG`` bytes, then every ``LONG_STRIDE``), which allow for edits that crowd in one place. A segment of m bytes is held to stand in a text where some region is
within k = floor(``budget`` * m) byte edits of it. Such a region keeps at least
m + 1 - q (k + 1) of the segment's q-grams, all on diagonals at most k apart. Grams are
compared as 64-bit words, so exactly.

Per text, in one pass with no shuffle: (1) a bit table tells which positions start a gram of
any item, and windows with fewer of them than the weakest segment's bound drop out; (2) the
rest are matched with the items' grams and counted per item in hashed cells of diagonals, so
that matches by chance, alone on their diagonals, drop out before any of them is sorted (a
collision only lets more on); (3) what is left is counted per segment in diagonal bands of
width 2 (k + 1) that overlap by half, so that one band holds all grams of a true region;
(4) bands that meet their bound are compared with the segment by a bit-parallel edit distance,
and the best of a row and item aligned by banded dynamic programming.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of text
(each checked), and every text is run against every block, so a block is what a task holds,
whatever the benchmark's size. No text, position or hit is capped.

Defined cases: null and empty texts hold no passage; items of
fewer than ``SHORTEST`` normalised bytes are looked for without edits; those of fewer than ``EXACT``,
hardly three words, as whole words in order, between spaces or the text's ends, by one automaton over
all of them; null ones and those without a letter or digit are in no text. ``drop_contaminated``
leaves out items under ``EXACT`` bytes unless ``least`` says otherwise: a few common words
are no reason to lose a document. Of equal regions of an item the one found first in the text counts;
rows with equal or null ids are judged one by one; equal items are each reported; an empty
benchmark or table gives no hit. ``find_passages`` reads ``doc_id`` and ``text`` only;
``drop_contaminated`` carries all columns along unchanged.
"""
from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.kernels import LOWER, slices
from strata.session import read_table

Q = 8
BUDGET = 0.1
SEGMENT, STRIDE = 100, 25
LONG, LONG_STRIDE = 200, 100
SHORTEST, EXACT = 40, 16
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22
_CHUNK = 1 << 20
_SPAN = 1 << 40  # more than the bytes of any item

_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of a slice, the rows' offsets in them, and each byte's place in ``raw``."""
    plain = _PLAIN[raw]
    space = plain == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    places = np.flatnonzero(keep)
    return plain[places], np.searchsorted(places, offsets), places


def grams(data: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from each position on, as one word: equal words are equal grams."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, Q)).view(np.uint64).ravel()


def _cell(words: np.ndarray) -> np.ndarray:
    return (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


def edits_allowed(m: int, budget: float) -> int:
    """Byte edits for a segment of m bytes: its budget, or fewer where the lemma would ask for
    no shared gram (at no length with the budget as set). Below ``SHORTEST`` bytes, none."""
    return max(0, min(int(budget * m), m // Q - 1)) if m >= SHORTEST else 0


def least_edits(pattern: bytes, region: bytes) -> int:
    """Least edits between ``pattern`` and any part of ``region`` (Myers' bit vectors)."""
    full = (1 << len(pattern)) - 1
    top = 1 << (len(pattern) - 1)
    places: dict[int, int] = {}
    for i, byte in enumerate(pattern):
        places[byte] = places.get(byte, 0) | 1 << i
    up, down, edits = full, 0, len(pattern)
    best = edits
    for byte in region:
        equal = places.get(byte, 0)
        across = ((equal & up) + up) ^ up | equal
        more, fewer = down | full & ~(across | up), up & across
        if more & top:
            edits += 1
        elif fewer & top:
            edits -= 1
            best = min(best, edits)
        vertical, more = equal | down, more << 1
        up, down = (fewer << 1 | ~(vertical | more)) & full, more & vertical
    return best


def banded_distance(pattern: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Least edits between ``pattern`` and any part of ``region`` along diagonals ``low..high``.

    Returns (edits, start, end) in the region; edits is ``most`` + 1 where it would be larger.
    Cell (i, d) compares the first i pattern bytes with region bytes up to i + d.
    """
    width, big = high - low + 1, most + 1
    d = np.arange(low, high + 1)
    inside = (d >= 0) & (d <= len(region))
    cost = np.where(inside, 0, big)
    start = np.where(inside, d, 0)
    order = np.arange(width)
    for i in range(1, len(pattern) + 1):
        j = i + d
        legal = (j >= 0) & (j <= len(region))
        same = np.zeros(width, bool)
        body = legal & (j >= 1)
        same[body] = region[j[body] - 1] == pattern[i - 1]
        step = np.where(body, cost + ~same, big)
        origin = start.copy()
        gone = np.append(cost[1:] + 1, big)  # pattern byte i without a partner
        better = gone < step
        step = np.where(better, gone, step)
        origin = np.where(better, np.append(start[1:], 0), origin)
        # Region bytes without a partner: cheapest cell to the left plus the distance from it.
        ramp = np.where(legal, step, big) - order
        lead = np.minimum.accumulate(ramp)
        source = np.maximum.accumulate(np.where(ramp == lead, order, 0))
        cost = np.where(legal, np.minimum(lead + order, big), big)
        start = origin[source]
        if cost.min() >= big:
            return big, 0, 0
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(len(pattern) + d[best])


def grids() -> tuple[tuple[int, int], ...]:
    """(bytes, stride) of the segments that are looked for."""
    return (SEGMENT, STRIDE), (LONG, LONG_STRIDE)


@dataclass
class Block:
    """Items of one block of the benchmark, the postings of their grams, and their segments."""

    item: list  # per segment, its item's id
    segments: list[np.ndarray]
    source: np.ndarray  # per segment, its item's number
    start: np.ndarray  # per segment, its place in the item
    edits: np.ndarray
    bound: np.ndarray
    parts: list[tuple[int, np.ndarray, np.ndarray]]  # per grid: first segment, item and start as one key, bytes per item
    half: np.ndarray  # per item: most edits + 1, and the weakest bound
    need: np.ndarray
    words: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    short: list[bytes]  # items matched as whole words; their ids follow those of the segments

    @classmethod
    def of(cls, items: list[tuple], budget: float, least: int = 1) -> Block:
        ids, texts, short = [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            data = normalise(raw, np.array([0, len(raw)]))[0]
            data = np.frombuffer(data.tobytes().strip(), np.uint8)
            if len(data) >= EXACT:
                ids.append(item_id)
                texts.append(data)
            elif len(data) >= least:
                short.append((item_id, data.tobytes()))
        source, start, segments, parts = [], [], [], []
        for g, (size, stride) in enumerate(grids()):
            begin = len(segments)
            for i, data in enumerate(texts):
                if g and len(data) <= grids()[0][0]:
                    continue  # whole in the first grid
                starts = [0] if len(data) <= size else [*range(0, len(data) - size, stride), len(data) - size]
                source += [i] * len(starts)
                start += starts
                segments += [data[s:s + size] for s in starts]
            keys = np.array(source[begin:], np.int64) * _SPAN + np.array(start[begin:], np.int64)
            parts.append((begin, keys, np.array([min(len(data), size) for data in texts], np.int64)))
        source, start = np.array(source, np.int64), np.array(start, np.int64)
        edits = np.array([edits_allowed(len(s), budget) for s in segments], np.int64)
        bound = np.array([len(s) + 1 - Q * (k + 1) for s, k in zip(segments, edits)], np.int64)
        half, need = np.ones(len(texts), np.int64), np.full(len(texts), _SPAN)
        np.maximum.at(half, source, edits + 1)
        np.minimum.at(need, source, bound)
        found = [grams(data) for data in texts]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(found)), [len(p) for p in found])
        place = np.concatenate([np.arange(len(p)) for p in found]) if found else owner
        order = np.argsort(flat, kind="stable")
        words, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[_cell(words)] = True
        return cls([ids[i] for i in source] + [i for i, _ in short], segments, source, start, edits, bound, parts, half, need,
                   words, np.append(first, len(flat)), owner[order], place[order], table, [x for _, x in short])

    def short_hits(self, data: np.ndarray, offsets: np.ndarray):
        """(row, number behind the segments, 0, start, end) of the first place of every short item in a row."""
        if not hasattr(self, "_words"):
            self._words = ahocorasick.Automaton()
            numbers: dict[bytes, list[int]] = {}
            for i, text in enumerate(self.short):
                numbers.setdefault(text, []).append(len(self.segments) + i)
            for text, of in numbers.items():
                self._words.add_word(f" {text.decode('latin-1')} ", (len(text), of))
            self._words.make_automaton()
        for row in range(len(offsets) - 1):
            found: dict[int, tuple[int, int]] = {}
            for last, (size, of) in self._words.iter(f" {data[offsets[row]:offsets[row + 1]].tobytes().decode('latin-1')} "):
                for number in of:  # the space before the text shifts its places by one, the one behind the item ends at ``last``
                    found.setdefault(number, (last - size - 1, last - 1))
            for number, (start, end) in found.items():
                yield row, number, 0, start, end

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_words"}

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place in the row, item, place in the item) of the shared grams that may belong to a region."""
        none = (np.zeros(0, np.int64),) * 4
        words = grams(data)
        if not len(self.segments) or not len(words):
            return none
        at = np.flatnonzero(self.table[_cell(words)])
        if not len(at):
            return none
        # A region spans at most its segment + k positions; keep those with enough members around them.
        reach, need = max(map(len, self.segments)) + int(self.edits.max()), int(self.bound.min())
        around = np.searchsorted(at, at + reach, "right") - np.arange(len(at))
        rich = np.zeros(len(at) + 1, np.int64)
        begin = np.flatnonzero(around >= need)
        np.add.at(rich, begin, 1)
        np.add.at(rich, begin + around[begin], -1)
        at = at[np.cumsum(rich[:-1]) > 0]
        spot = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        real = self.words[spot] == words[at]
        at, spot = at[real], spot[real]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, spot, row = at[inside], spot[inside], row[inside]
        at = at - offsets[row]
        times = self.first[spot + 1] - self.first[spot]
        # Postings are made in chunks, once to count the cells and once to keep those of full ones.
        cuts = np.unique(np.searchsorted(np.cumsum(times), np.arange(0, times.sum() + _CHUNK, _CHUNK)))
        chunks = [slice(a, z) for a, z in zip([0, *cuts], [*cuts, len(at)]) if z > a]

        def postings(part):
            n = times[part]
            entry = np.repeat(self.first[spot[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            which, item = np.repeat(np.arange(part.start, part.stop), n), self.owner[entry]
            band = np.floor_divide(at[which] - self.place[entry], self.half[item])
            cell = ((row[which] * len(self.need) + item) * 0x1E3779B97F4A7C15 >> 21) + band & (1 << _TABLE_BITS) - 1
            return which, entry, item, cell

        count = np.zeros((1 << _TABLE_BITS) + 2, np.int32)  # cell c at c + 1; the ends wrap
        for part in chunks:
            count[1:-1] += np.bincount(postings(part)[3], minlength=1 << _TABLE_BITS).astype(np.int32)
        count[0], count[-1] = count[-2], count[1]
        out = []
        for part in chunks:
            which, entry, item, cell = postings(part)
            full = count[cell + 1] + np.maximum(count[cell], count[cell + 2]) >= self.need[item]
            out.append((row[which[full]], at[which[full]], item[full], self.place[entry[full]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else none

    def candidates(self, data: np.ndarray, offsets: np.ndarray):
        """(row, segment, lowest diagonal, highest) of every run of bands that meet their segment's bound."""
        row, at, item, place = self.matches(data, offsets)
        found = []
        for begin, keys, size in self.parts:
            low = np.searchsorted(keys, item * _SPAN + np.maximum(place - size[item] + Q, 0))
            n = np.searchsorted(keys, item * _SPAN + place, "right") - low
            segment = begin + np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            diagonal = np.repeat(at - place, n) + self.start[segment]
            band = np.floor_divide(diagonal, self.edits[segment] + 1)  # bands cover halves (b, b + 1): overlapping by one half
            found += [np.stack([np.repeat(row, n), segment, b, np.repeat(place, n)], 1) for b in (band, band - 1)]
        keys = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        if not len(keys):
            return
        # The grams a region keeps stand at different places of the segment: each place counts once.
        keys = keys[np.lexsort(keys.T[::-1])]
        keys = keys[np.append(True, (keys[1:] != keys[:-1]).any(axis=1)), :3]
        new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        counts = np.diff(np.append(new, len(keys)))
        bands = keys[new[counts >= self.bound[keys[new, 1]]]]
        begin = np.flatnonzero(np.append(True, (bands[1:] != bands[:-1] + [0, 0, 1]).any(axis=1))[:len(bands)])
        for (r, s, b), last in zip(bands[begin].tolist(), bands[np.append(begin[1:], len(bands)) - 1, 2].tolist() if len(bands) else ()):
            yield r, s, b * (int(self.edits[s]) + 1), (last + 2) * (int(self.edits[s]) + 1)

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(row, segment, edits, start, end) of the best region of each row and item, in normalised bytes of the row."""
        near: dict[tuple[int, int], list[tuple]] = {}
        for row, s, low, high in self.candidates(data, offsets):
            pattern, k = self.segments[s], int(self.edits[s])
            a, z = max(0, low - k), min(int(offsets[row + 1] - offsets[row]), high + len(pattern) + k)
            region = data[offsets[row] + a:offsets[row] + z]
            near.setdefault((row, int(self.source[s])), []).append((s, low, high, a, region, region.tobytes().find(pattern.tobytes())))
        for (row, _), regions in near.items():
            exact = [(0, *r) for r in regions if r[-1] >= 0]
            measured = exact or [(least_edits(self.segments[r[0]].tobytes(), r[4].tobytes()), *r) for r in regions]
            best = None
            for least, s, low, high, a, region, exact in sorted(measured, key=lambda r: r[:3]):
                if best and best[1] <= least:
                    break
                pattern, k = self.segments[s], int(self.edits[s])
                edits, start, end = (0, exact, exact + len(pattern)) if exact >= 0 else banded_distance(pattern, region, low - k - a, high + k - a, k)
                if edits <= k and (best is None or edits < best[1]):
                    best = s, edits, a + start, a + end
            if best:
                yield row, *best
        if self.short:
            yield from self.short_hits(data, offsets)


def blocks(benchmark: DataFrame, budget: float = BUDGET, least: int = 1):
    """The benchmark as blocks of bounded size, read one after the other."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // BLOCK_BYTES))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        if n > 1 and part.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > 4 * BLOCK_BYTES:
            raise ValueError("one benchmark item, or copies of it, exceed the block size; deduplicate or split the benchmark")
        yield Block.of([tuple(r) for r in part.collect()], budget, least)


def _row_hits(texts: pa.Array, block: Block):
    """(row of the column, item, edits, start, end) with places in code points of the text."""
    for first, _, raw, offsets in slices(texts):
        data, bounds, places = normalise(raw, offsets)
        for row, s, edits, a, z in block.hits(data, bounds):
            base = offsets[row]
            begins = (raw[base:offsets[row + 1]] & 0xC0) != 0x80
            a, z = places[bounds[row] + a] - base, places[bounds[row] + z - 1] - base + 1
            yield first + row, block.item[s], edits, int(begins[:a].sum()), int(begins[:z].sum())


def find_passages(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(doc_id, item_id, edits, start, end): per row and item its best region, in code points."""
    common.bound_batches(docs.sparkSession)
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema, out = f"doc_id {id_type}, item_id {item_type}, edits int, start long, end long", None
    item_arrow = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
    for block in blocks(benchmark, budget):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                best: dict[tuple, tuple] = {}
                for row, item, edits, a, z in _row_hits(batch.column("text"), held.value):
                    best[row, item] = min(best.get((row, item), (edits, a, z)), (edits, a, z))
                rows, items = zip(*best) if best else ((), ())
                values = list(zip(*best.values())) if best else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, item_arrow), pa.array(values[0], pa.int32()), *(pa.array(v, pa.int64()) for v in values[1:])],
                    ["doc_id", "item_id", "edits", "start", "end"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, least: int = EXACT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no passage of an item of ``least`` bytes."""
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in blocks(benchmark, budget, least):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in _row_hits(batch.column(at), held.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(common.documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))
