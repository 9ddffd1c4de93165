"""Spelling variant grouping over a dictionary of trie-node pairs.

Words that differ by exactly one inserted, deleted or replaced code point are near. A word's form
is its near word of largest count, where that count is at least twice its own; following forms
leads to its root.

1. Letter runs of whole texts are counted in bounded tables per task, then combined. A word
   has at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences.
2. The nodes of the trie of all words, and of the trie of all reversed words, get integers: words
   are cut into ranges by ``splits`` (cut words of at most ``SPLIT_LETTERS`` letters from a bounded
   sample, which only balances the work), sorted inside each, and a word opens one node for every
   letter that it does not share with the word before. A node that lies on the path of a
   split word may be met in several ranges; it is named by that word and its depth, so equal
   prefixes have equal numbers everywhere and different ones never do.
3. A word with letters w[0..L) gives the pairs (prefix node of w[0..i), suffix node of w(i..L)) with
   letter i skipped, and (w[0..i), w[i..L)) with nothing skipped. Equal skipping pairs at one place
   are replacements; a skipping pair equal to a whole pair is a deletion and an insertion. Of a
   run of equal letters only the first is skipped for the latter, so each near word is met
   exactly once: counts add up without a distinct step.
4. Pairs are shuffled by both integers and sorted. A pair has one whole member at most and one
   skipping member per letter of the alphabet (90), so no group can grow with the input, and
   each gives one row per member: how many are near and the best of them, never all pairs.
5. Forms are followed by pointer doubling: counts double along them, so 6 rounds are enough for
   any count; the loop ends when nothing moves.

Defined cases: runs are `[A-Za-z\\u00C0-\\u00FF]+`, only A-Z lower-cased; a null or empty text has
none. A run whose crc32 of ``<doc_id>:<run>`` is divisible by 97 loses one code point first; a null id
counts as the empty string there. Of near words with equal counts the smallest in code-point order is
the form. Very long texts are read in pieces of 1 MB and words of any length are kept. Repeated rows
count again; an empty table gives no row. Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common

MIN_LENGTH, MIN_COUNT, ONE_IN = 5, 3, 97
PIECE = 1 << 20
TABLE_WORDS = 200_000
#: Sample that balances the ranges, letters kept of a split word, words of a range.
SAMPLE, SPLIT_LETTERS, RANGE_WORDS = 4096, 32, 50_000

#: Latin-1 bytes: letters stay, A-Z become lower case, all others (and code points beyond) a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


# ---------------------------------------------------------------- words

def _runs(text: str) -> Iterator[list[bytes]]:
    """Lower-cased letter runs (Latin-1) of a text, piece by piece."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(letters):
        cut = letters.find(b" ", at + PIECE)
        end = cut if cut >= 0 else len(letters)
        yield letters[at:end].split()
        at = end


def _add_words(table: Counter, doc_id, text: str) -> None:
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for runs in _runs(text):
        for run, n in Counter(runs).items():
            if len(run) < MIN_LENGTH:
                continue
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
            if h % ONE_IN == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
                if len(run) < MIN_LENGTH:
                    continue
            table[run] += n


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``docs``."""
    def emit(table):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in table], pa.string()), pa.array(list(table.values()), pa.int64())], ["word", "n"])

    def run(batches):
        table = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if text.is_valid:
                    _add_words(table, doc_id, text.as_py())
                if len(table) > TABLE_WORDS:
                    yield emit(table)
                    table = Counter()
        yield emit(table)

    common.bound_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- tries

def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a[:8] == b[:8] and a[:len(b)] == b[:len(a)]:
        return min(len(a), len(b))
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def splits(keys: DataFrame, n_words: int) -> list[str]:
    """Sorted words that cut the values of ``key`` into ranges of about ``RANGE_WORDS``."""
    ranges = min(SAMPLE // 4, n_words // RANGE_WORDS)
    if ranges < 1:
        return []
    sample = keys.select(F.xxhash64("key").alias("h"), F.substring("key", 1, SPLIT_LETTERS).alias("key")).orderBy("h", "key").limit(SAMPLE)
    found = sorted({r["key"] for r in sample.collect()})
    return sorted({found[i * len(found) // (ranges + 1)] for i in range(1, ranges + 1)})


class Numbering:
    """Numbers of the nodes on the words' paths, for words that come in order inside their range."""

    def __init__(self, cuts: list[str]):
        self.cuts = cuts
        self.owner = []  # per split word: by depth, the first split word that shares the prefix
        for q, cut in enumerate(cuts):
            shared = _common(cuts[q - 1], cut) if q else -1
            self.owner.append([self.owner[q - 1][d] if d <= shared else q for d in range(len(cut) + 1)])
        self.range, self.fresh, self.seen = -1, 0, 0

    def of(self, word: str) -> int:
        """Range of a word."""
        return bisect_right(self.cuts, word)

    def _split_nodes(self, q: int, depth: int, start: int) -> list[int]:
        owner = self.owner[q]
        return [-(owner[d] * (SPLIT_LETTERS + 1) + d + 1) for d in range(start, depth + 1)]

    def next(self, range_: int, word: str) -> tuple[int, list[int]]:
        """Rank of the word (in the order of all words) and its nodes by depth."""
        if range_ != self.range:
            self.range, self.fresh, self.seen, self.word, self.nodes = range_, 0, 0, None, []
        nodes: list[int] = []
        for q in (range_ - 1, range_):
            if 0 <= q < len(self.cuts):
                nodes += self._split_nodes(q, _common(self.cuts[q], word), len(nodes))
        if self.word is not None:
            nodes += self.nodes[len(nodes):_common(self.word, word) + 1]
        new = len(word) + 1 - len(nodes)
        base = (range_ << 40) + self.fresh
        nodes += range(base, base + new)
        self.fresh += new
        rank = (range_ << 40) + self.seen
        self.seen += 1
        self.word, self.nodes = word, nodes
        return rank, nodes


def numbered(keys: DataFrame, n_words: int) -> DataFrame:
    """``keys`` (key, more columns) with ``rank`` and ``nodes`` of the trie over all keys (distinct)."""
    cuts = splits(keys, n_words)
    rest = [f for f in keys.schema.fields if f.name != "key"]
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest)

    def place(batches):
        numbers = Numbering(cuts)
        for batch in batches:
            ranges = pa.array([numbers.of(k) for k in batch.column("key").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([ranges, *batch.columns], ["range", *batch.schema.names])

    def number(batches):
        numbers = Numbering(cuts)
        for batch in batches:
            found = [numbers.next(r, k) for r, k in zip(batch.column("range").to_pylist(), batch.column("key").to_pylist())]
            nodes = pa.array([x for _, x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in found], pa.int64()), nodes], [*batch.schema.names[1:], "rank", "nodes"])

    placed = keys.select("key", *[f.name for f in rest]).mapInArrow(place, f"range int, key string{more}")
    return placed.repartition("range").sortWithinPartitions("range", "key").mapInArrow(number, f"key string{more}, rank long, nodes array<long>")


# ---------------------------------------------------------------- pairs

WHOLE = 1 << 62
_MOST = (1 << 60) - 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(), offsets[:-1]


def node_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, suffix, place, word): one row per skipped letter and per cut of each word.

    ``place`` sorts the skipping members by falling count before the whole one; ``word`` is
    twice the word's rank, plus 1 where the letter repeats the one before.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ahead, a0 = _flat(batch.column("ahead"))
        back, b0 = _flat(batch.column("back"))
        letters = [x.encode("latin-1") for x in batch.column("key").to_pylist()]
        length = np.fromiter(map(len, letters), np.int64, len(letters))
        text, t0 = np.frombuffer(b"".join(letters), np.uint8), np.cumsum(length) - length
        rank, falling = batch.column("rank").to_numpy(), _MOST - batch.column("n").to_numpy()
        for skip in (1, 0):
            times = length + 1 - skip
            row = np.repeat(np.arange(len(times)), times)
            i = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            word, place = rank[row] * 2, falling[row]
            if skip:
                at = t0[row] + i
                word = word + ((i > 0) & (text[at] == text[at - 1]))
            else:
                place = place + WHOLE
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ahead[a0[row] + i], back[b0[row] + length[row] - skip - i], place, word)], ["prefix", "suffix", "place", "word"])


def _members(prefix, suffix, place, word):
    """Per member of each group of two or more: rank, near words, and the best of them (place, rank)."""
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])])
    size = np.diff(np.r_[first, len(prefix)])
    run = np.repeat(np.arange(len(first)), size)
    keep = size[run] > 1
    place, word, run = place[keep], word[keep], run[keep]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][:len(run)])
    size = np.diff(np.r_[first, len(run)])
    group = np.repeat(np.arange(len(first)), size)
    whole = place >= WHOLE
    has_whole = whole[first + size - 1]
    skips = size - has_whole
    none = np.int64(1 << 61)
    # Among skipping members: the first of the group, for the first itself the second.
    lead = np.arange(len(run)) == first[group]
    other = np.where(lead, first[group] + 1, first[group])
    other = np.minimum(other, len(run) - 1)
    alone = skips[group] < 2
    best, who = np.where(whole | alone, none, place[other]), word[other] >> 1
    near = np.where(whole, 0, skips[group] - 1)
    # Deletions: skipping members of a first equal letter and the whole member.
    once = ~whole & (word & 1 == 0)
    last = (first + size - 1)[group]
    shorter = place[last] - WHOLE
    meets = once & has_whole[group]
    near = near + meets
    better = meets & ((shorter < best) | ((shorter == best) & (word[last] >> 1 < who)))
    best, who = np.where(better, shorter, best), np.where(better, word[last] >> 1, who)
    # Insertions: the whole member and the first of those.
    longer = np.add.reduceat(once, first) if len(first) else np.zeros(0, np.int64)
    at = np.minimum.reduceat(np.where(once, np.arange(len(run)), len(run) - 1), first) if len(first) else first
    near = np.where(whole, longer[group], near)
    best = np.where(whole, np.where(longer[group] > 0, place[at[group]], none), best)
    who = np.where(whole, word[at[group]] >> 1, who)
    found = near > 0
    return (word >> 1)[found], near[found], best[found], who[found]


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, near, best, who) over pairs that come sorted; only the last group is held between batches."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("prefix", "suffix", "place", "word")]
        now = now if held is None else [np.r_[h, x] for h, x in zip(held, now)]
        if not len(now[0]):
            continue
        differs = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        end = differs[-1] + 1 if len(differs) else 0
        held = [x[end:] for x in now]
        if end:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _members(*(x[:end] for x in now))], ["rank", "near", "best", "who"])
    if held is not None and len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _members(*held)], ["rank", "near", "best", "who"])


def neighbours(lexicon: DataFrame, n_words: int) -> DataFrame:
    """(rank, n_near, best): near words of each word that has any, ``best`` of type (place, who).

    ``lexicon``: (key, n, rank, nodes) as ``numbered`` gives it.
    """
    backward = numbered(lexicon.select(F.reverse("key").alias("key"), F.col("rank").alias("of")), n_words)
    both = (lexicon.select("rank", "key", "n", F.col("nodes").alias("ahead"))
            .join(backward.select(F.col("of").alias("rank"), F.col("nodes").alias("back")), "rank"))
    pairs = both.mapInArrow(node_pairs, "prefix long, suffix long, place long, word long")
    met = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", "place", "word").mapInArrow(near_words, "rank long, near long, best long, who long")
    return met.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min(F.struct("best", "who")).alias("best"))


# ---------------------------------------------------------------- forms

def _sized(df: DataFrame, n_words: int) -> DataFrame:
    """As many partitions as the words need, where there would be more."""
    return df.coalesce(max(1, n_words // RANGE_WORDS))


def followed(up: DataFrame, n_words: int) -> DataFrame:
    """(rank, to) with ``to`` moved to the last one that can be reached."""
    while True:
        on = up.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        moved = up.join(on, "to", "left").select("rank", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        moved = common.staged(_sized(moved, n_words), "forms")
        up = moved.select("rank", "to")
        if moved.where("moved").isEmpty():
            return up


def _named(lexicon: DataFrame, rank: str, name: str, *more: Column) -> DataFrame:
    return lexicon.select(F.col("rank").alias(rank), F.col("key").alias(name), *more)


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    found = common.staged(words(docs), "words")
    n_words = found.count()
    lexicon = common.staged(numbered(found.select(F.col("word").alias("key"), "n"), n_words), "lexicon")
    near = neighbours(lexicon, n_words)
    best = F.col("best")
    known = (lexicon.select("rank", "key", "n").join(near, "rank", "left")
             .select("rank", F.col("key").alias("word"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                     F.when(F.lit(_MOST) - best["best"] >= F.col("n") * 2, best["who"]).alias("form_rank")))
    known = common.staged(_sized(known, n_words), "near-words")
    roots = followed(known.where(F.col("form_rank").isNotNull()).select("rank", F.col("form_rank").alias("to")), n_words)
    rooted = roots.join(_named(lexicon, "to", "root"), "to").select("rank", "root")
    return (known.join(_named(lexicon, "form_rank", "form", F.col("n").alias("form_n")), "form_rank", "left").join(rooted, "rank", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.documents(spark, sf_dir))
