"""SimHash near-dedup over a hierarchical index in Gray order.

A fingerprint has bit b set where over half of the XXH64 values (seed 42) of a text's four-word
shingles, repeats included, have it set. Documents are linked where their fingerprints differ in
at most ``RADIUS`` = 4 bits; a component's id is its smallest doc_id.

1. Equal fingerprints form a node before anything is compared (combined map-side), so copies
   cost one row per task.
2. The 64 bits are cut into six bands. Four differences leave two bands untouched, so every
   linked pair agrees on some pair of bands: each of the 15 pairs of bands is moved to the
   front of the fingerprint once, and the fingerprint's rank in Gray order is taken. In that
   order the fingerprints that share the 20 to 22 leading bits stand together, and neighbours
   differ in few of the others.
3. (order, rank) is range-partitioned and sorted: every pair is distinct, so no group, however
   alike, lands in one task. Each run of one leading value is cut into blocks of ``BLOCK``
   fingerprints. Over a block stands a tree of fan-out ``FAN``: a node keeps the bits that all
   below it share and masks the others, so the upper nodes hold the shared pattern once.
4. A block is joined with itself by walking pairs of nodes from the top. A pair carries the
   differences found so far and adds those of the bits that both nodes share and their parents
   did not; beyond ``RADIUS`` the whole pair of groups is dropped. What reaches the leaves is
   exact. Only a spanning forest of the links leaves a task.
5. Blocks of a run that does not end inside its block meet by an equi-join of one row per
   block on the run, of which pairs of blocks whose top nodes differ too much are dropped by
   the join itself; the same walk follows. Components by star contraction.

Nothing depends on the number of rows but the number of blocks; no pair, bucket or link is capped.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; fewer than four words are
one shingle; a null, empty or blank text has fingerprint zero and is linked like any other. Very long
texts are read in pieces of 1 MB. Rows with a null id are linked too, but only ids that are not
null become a component's id (null where there is none). Repeated rows get equal results; an
empty table gives no row. Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common, graph

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Widths of the bands, from the highest bit down: two more than differences are allowed.
BANDS = (11, 11, 11, 11, 10, 10)
ORDERS = list(combinations(range(len(BANDS)), 2))
BLOCK, FAN = 2048, 8
PIECE = 1 << 20
#: Rows that a task joins at once, and pairs of nodes that it opens at once.
RUN_ROWS, OPENED = 1 << 16, 1 << 14

_SPACE = re.compile(rb"[\x09-\x0d ]")
_ONE = np.uint64(1)


# ---------------------------------------------------------------- fingerprints

def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of about ``PIECE`` bytes."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _shingle_hashes(words: list[bytes], n: int) -> list[int]:
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:z], SEED) for a, z in zip(start.tolist(), end[n - 1:].tolist())]


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text (unsigned)."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode().lower()):
        words = carry + piece.split()
        if len(words) < SHINGLE:
            carry = words
            continue
        hashes = np.array(_shingle_hashes(words, SHINGLE), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carry = words[1 - SHINGLE:]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long) per row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint long")


# ---------------------------------------------------------------- Gray orders

def _moved(order: int) -> list[int]:
    front = ORDERS[order]
    return [*front, *(b for b in range(len(BANDS)) if b not in front)]


_LOW = [64 - sum(BANDS[:b + 1]) for b in range(len(BANDS))]
LEAD = [BANDS[x] + BANDS[y] for x, y in ORDERS]


def gray_rank(prints: np.ndarray, order: int) -> np.ndarray:
    """Rank in the Gray sequence of each fingerprint with the order's two bands in front."""
    word = np.zeros(len(prints), np.uint64)
    for b in _moved(order):
        word = (word << np.uint64(BANDS[b])) | ((prints >> np.uint64(_LOW[b])) & np.uint64((1 << BANDS[b]) - 1))
    for shift in (1, 2, 4, 8, 16, 32):
        word = word ^ (word >> np.uint64(shift))
    return word


def from_rank(rank: np.ndarray, order: int) -> np.ndarray:
    """The fingerprints of ranks in one order."""
    word = rank ^ (rank >> _ONE)
    out = np.zeros(len(rank), np.uint64)
    low = 64
    for b in _moved(order):
        low -= BANDS[b]
        out |= ((word >> np.uint64(low)) & np.uint64((1 << BANDS[b]) - 1)) << np.uint64(_LOW[b])
    return out


_SIGN = np.uint64(1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the unsigned numbers."""
    return (x ^ _SIGN).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ _SIGN


# ---------------------------------------------------------------- the index

class Index:
    """Trees over consecutive blocks of fingerprints.

    ``levels[0]`` are the fingerprints, the last level has one node per block. A node has its
    shared bits (``mask``), their values (``value``) and its children's range (``first``, ``count``).
    """

    def __init__(self, prints: np.ndarray, blocks: np.ndarray):
        """``blocks``: first row of each block."""
        n = len(prints)
        self.levels = [(np.full(n, ~np.uint64(0)), prints, np.arange(n), np.ones(n, np.int64))]
        both, any_ = prints, prints
        while len(both) > len(blocks):
            at = np.arange(len(both)) - np.repeat(blocks, np.diff([*blocks, len(both)]))
            first = np.flatnonzero(at % FAN == 0)
            blocks = np.searchsorted(first, blocks)
            both, any_ = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(any_, first)
            self.levels.append((~(both ^ any_), both, first, np.diff([*first, len(at)])))

    def raised(self, height: int) -> "Index":
        """The same trees with single parents on top, up to ``height`` levels."""
        while len(self.levels) < height:
            mask, value = self.levels[-1][:2]
            self.levels.append((mask, value, np.arange(len(mask)), np.ones(len(mask), np.int64)))
        return self


def linked(left: Index, right: Index, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of left, of right) that differ in at most ``RADIUS`` bits, below the top nodes a, b.

    Where ``left`` is ``right``, each pair of different rows comes once.
    """
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1
    left, right = left.raised(top + 1), right.raised(top + 1)

    def kept(level, a, b, before, known):
        mask = left.levels[level][0][a] & right.levels[level][0][b]
        apart = before + np.bitwise_count((left.levels[level][1][a] ^ right.levels[level][1][b]) & mask & ~known)
        near = apart <= RADIUS
        return level, a[near], b[near], apart[near], mask[near]

    todo = [kept(top, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64))]
    while todo:
        level, a, b, apart, mask = todo.pop()
        if len(a) > OPENED:
            todo += [(level, a[i:i + OPENED], b[i:i + OPENED], apart[i:i + OPENED], mask[i:i + OPENED]) for i in range(0, len(a), OPENED)]
            continue
        if not len(a):
            continue
        if level == 0:
            yield (a[a != b], b[a != b]) if same else (a, b)
            continue
        first_a, count_a = left.levels[level][2][a], left.levels[level][3][a]
        first_b, count_b = right.levels[level][2][b], right.levels[level][3][b]
        times = count_a * count_b
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        wide = np.repeat(count_b, times)
        x, y = np.repeat(first_a, times) + at // wide, np.repeat(first_b, times) + at % wide
        apart, mask = np.repeat(apart, times), np.repeat(mask, times)
        if same:
            once = x <= y
            x, y, apart, mask = x[once], y[once], apart[once], mask[once]
        todo.append(kept(level - 1, x, y, apart, mask))


class Forest:
    """Components of links between rows; ``edges`` is one link per row that is not a root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.flatnonzero(self.root != np.arange(len(self.root)))
        return low, self.root[low]


# ---------------------------------------------------------------- links

EDGE = ["a", "b"]
OPEN = ["order", "lead", "first", "low", "high", "ranks"]
_BLOCKS = "a long, b long, order int, lead long, first long, low long, high long, ranks binary"
_FIELDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("order", pa.int32()), ("lead", pa.int64()), ("first", pa.int64()),
                     ("low", pa.int64()), ("high", pa.int64()), ("ranks", pa.binary())])


def ranked(nodes: DataFrame) -> DataFrame:
    """(order, rank) of every fingerprint in every Gray order."""
    def run(batches):
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy().view(np.uint64)
            for order in range(len(ORDERS)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), order, np.int32)), pa.array(_signed(gray_rank(prints, order)))], ["order", "rank"])

    return nodes.select("fingerprint").mapInArrow(run, "order int, rank long")


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)


def _joined(order: np.ndarray, rank: np.ndarray, lead: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
    """Spanning links inside each block of rows sorted by (order, rank)."""
    prints = np.concatenate([from_rank(rank[order == o], o) for o in np.unique(order)]) if len(order) else np.zeros(0, np.uint64)
    index, forest = Index(prints, blocks), Forest(len(prints))
    top = np.arange(len(blocks))
    for a, b in linked(index, index, top, top):
        forest.add(a, b)
    low, root = forest.edges()
    return _rows({"a": prints[low].view(np.int64), "b": prints[root].view(np.int64)})


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (order, rank) rows sorted so: links inside blocks, and the blocks of runs that may go on elsewhere."""
    lead_bits = np.array(LEAD, np.uint64)
    held_order, held_rank = np.zeros(0, np.int32), np.zeros(0, np.uint64)
    whole = False  # the first run held starts inside this partition and has not given a block yet

    def cut(order, rank, last):
        """Handle all runs but the last one (of which only full blocks), or all; what stays."""
        nonlocal whole
        lead = rank >> (np.uint64(64) - lead_bits[order])
        starts = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (order[1:] != order[:-1])])
        sizes = np.diff(np.r_[starts, len(rank)])
        end = len(rank) if last else starts[-1] + sizes[-1] // BLOCK * BLOCK
        open_ = np.zeros(len(starts), bool)
        open_[0] = not whole
        open_[-1] |= bool(last)
        open_ |= sizes >= BLOCK
        runs = np.repeat(np.arange(len(starts)), sizes)[:end]
        blocks = np.flatnonzero((np.arange(len(rank)) - np.repeat(starts, sizes))[:end] % BLOCK == 0)
        upto = np.diff(np.r_[blocks, end])
        alone = (upto == 1) & ~open_[runs[blocks]]  # nothing to compare with
        keep = ~np.repeat(alone, upto)
        out = [_joined(order[:end][keep], rank[:end][keep], lead[:end][keep], np.r_[0, np.cumsum(upto[~alone])[:-1]].astype(np.int64))] if keep.any() else []
        found = [(i, n) for i, n in zip(blocks.tolist(), upto.tolist()) if open_[runs[i]]]
        if found:
            words = [rank[i:i + n] ^ (rank[i:i + n] >> _ONE) for i, n in found]
            first = np.array([i for i, _ in found])
            out.append(_rows({"order": order[first], "lead": lead[first].view(np.int64), "first": _signed(rank[first]),
                              "low": np.array([np.bitwise_and.reduce(w) for w in words], np.uint64).view(np.int64),
                              "high": np.array([np.bitwise_or.reduce(w) for w in words], np.uint64).view(np.int64),
                              "ranks": [rank[i:i + n].tobytes() for i, n in found]}))
        if not last:
            whole = not open_[-1] if end > starts[-1] else (len(starts) > 1 or whole)
        return out, order[end:], rank[end:]

    parts, size = [], 0
    for batch in batches:
        parts.append((batch.column("order").to_numpy(), _unsigned(batch.column("rank").to_numpy())))
        size += batch.num_rows
        if size >= RUN_ROWS:
            out, held_order, held_rank = cut(np.r_[held_order, *(p[0] for p in parts)], np.r_[held_rank, *(p[1] for p in parts)], False)
            yield from out
            parts, size = [], 0
    order, rank = np.r_[held_order, *(p[0] for p in parts)].astype(np.int32), np.r_[held_rank, *(p[1] for p in parts)].astype(np.uint64)
    if len(rank):
        yield from cut(order, rank, True)[0]


def pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links between the two blocks of each row (order, ranks, others)."""
    for batch in batches:
        for order, *sides in zip(batch.column("order").to_pylist(), batch.column("ranks"), batch.column("others")):
            prints = [from_rank(np.frombuffer(x.as_buffer(), np.uint64), order) for x in sides]
            left, right = (Index(p, np.zeros(1, np.int64)) for p in prints)
            every, forest = np.concatenate(prints), Forest(sum(map(len, prints)))
            for a, b in linked(left, right, np.zeros(1, np.int64), np.zeros(1, np.int64)):
                forest.add(a, b + len(prints[0]))
            low, root = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(every[low].view(np.int64)), pa.array(every[root].view(np.int64))], EDGE)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints (column ``fingerprint``, distinct) that connect all that are near."""
    runs = ranked(nodes).repartitionByRange("order", "rank").sortWithinPartitions("order", "rank")
    found = common.staged(runs.mapInArrow(block_links, _BLOCKS), "simhash")
    blocks = found.where(F.col("ranks").isNotNull()).select(*OPEN)
    other = blocks.select("order", "lead", *[F.col(c).alias(f"{c}_") for c in ("first", "low", "high")], F.col("ranks").alias("others"))
    shared = F.expr("~(low ^ high) & ~(low_ ^ high_)")
    pairs = (blocks.join(other, ["order", "lead"])
             .where((F.col("first") < F.col("first_")) & (F.bit_count(F.col("low").bitwiseXOR(F.col("low_")).bitwiseAND(shared)) <= RADIUS)))
    across = pairs.select("order", "ranks", "others").mapInArrow(pair_links, "a long, b long")
    return found.where(F.col("a").isNotNull()).select(*EDGE).unionByName(across)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint string, component_id) per row of ``docs``."""
    rows = common.staged(fingerprints(docs), "fingerprints")
    nodes = common.staged(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = graph.components(links(nodes)).select(F.col("node").alias("fingerprint"), "root")
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "root").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return rows.join(ids, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
