"""Language-model scores: Katz backoff over word bigrams, counted and evaluated by Spark.

Tokens are the lower-cased words of a text and one end. Every training word keeps its own
unigram and bigram counts, however rare it is. Words are 64-bit hashes; those with a share of
all training tokens of at least ``COMMON_SHARE`` also have a dense id, which only makes their
counts cheaper to hold: by that rule there are at most 1 / ``COMMON_SHARE`` of them whatever the
input, which bounds what is broadcast; so is the list of common bigrams (``PAIR_SHARE``). All
other counts and backoff weights stay in tables that grow with the corpus and are partitioned by
key. A caller may ask for a ``word_share``: words below it are then merged into the class *rare*.

P(w | h), over words, end and rare class, recursively:
  seen    d(c) c(h, w) / (c(h) + 1), d the Good-Turing discount for counts up to ``GT_MAX``
  unseen  alpha(h) P(w), alpha(h) the mass left by the seen words over the unigram mass of the
          unseen ones, so that the probabilities of every history sum to exactly 1
  P(w) = (c(w) + 1) / (N + number of classes)
Without a ``word_share`` the class *rare* has the words never seen. A merged word's probability
within its class is (c + 1) / (tokens + types of the class + 1), the last 1 for all words never
seen. The + 1 of the denominator keeps mass for unseen words where no discount leaves any.

Passes over the texts: (1) word counts, combined per task; (2) bigram counts, combined per
task, shuffled as packed arrays. Bigrams of two common words go by (history, slice of its
successors): a frequent history is cut into slices, so no group outgrows ``BUCKET_TOKENS``
tokens by much. The others go to the bucket of their other word, which is rare, so needs no
slices; a bigram of two such words goes to both buckets. There its successor's count gives the
unigram mass, and its history's counts the rest of alpha, summed by history; (3) scoring: common
bigrams from the broadcast list, the others shuffled as packed arrays (with their text's place
in the batch) to the buckets that hold their counts, partial sums back per text. Of a bigram of
two rare words, the history's bucket gives alpha(h), the successor's P(w).

Two of n distinct words collide with probability below n*n / 2**58, two of n bigrams of a bucket
with probability below n*n / 2**65.

Defined cases: null and empty texts are the end alone; null ids belong to the training texts;
rows with the same id and text get the same scores; rows that share only their id are scored
apart; without training texts all words are rare and unseen; an empty table gives no row. Only
``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common
from strata.llm.kernels import Words, mix, slices

WORD_SHARE = 0.0
COMMON_SHARE = 1e-6
PAIR_SHARE = 1e-6
GT_MAX = 5
BUCKET_TOKENS = 4_000_000
FLUSH_TOKENS = 800_000
MIN_BUCKETS = 12
HELD_OUT = (7, 2)
START, END, RARE, FIRST_WORD = 0, 1, 2, 3
#: Rows of the tables: bigrams of two dense ids by history; those of a hashed successor, by it;
#: those of a hashed history, by it; counts of hashed words, backoff weights of hashed histories.
DENSE, BY_WORD, BY_HISTORY, COUNTS, ALPHAS = range(5)
_HASHED = np.uint64(1 << 63)


def packed(values: np.ndarray) -> bytes:
    """Sorted or small integers as compressed byte planes of their differences."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel())


def discounts(counts: list[int], k: int = GT_MAX) -> np.ndarray:
    """Good-Turing discount of the counts 1..k from ``counts[r]``, the number of bigrams seen r times.

    A discount outside (0, 1], or one that needs a count of zero bigrams, becomes 1.
    """
    out = np.ones(k + 1)
    n = np.array([*counts, *[0] * (k + 2)], float)
    if n[1] and n[k + 1]:
        common_term = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] and n[r + 1] and common_term < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common_term) / (1 - common_term)
                out[r] = d if 0 < d <= 1 else 1.0
    return out


@dataclass
class Vocabulary:
    """Bounded part of the model: at most 1 / COMMON_SHARE words with dense ids.

    The others are negative ids made of their hashes, or ``RARE`` where the caller merges them.
    """

    hashes: np.ndarray  # sorted uint64
    counts: np.ndarray  # per class id: START (training texts), END, RARE, words
    tokens: int  # N
    types: int  # V, with the end
    rare_types: int
    buckets: int
    kept: int  # hashed words, each a class of its own
    merged: bool  # the others are RARE

    @property
    def classes(self) -> int:
        return len(self.counts)

    @property
    def unigram(self) -> np.ndarray:
        """P(w) per class; START is never predicted."""
        p = self.share(self.counts)
        p[START] = 0.0
        return p

    def share(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of classes with these counts."""
        return (counts + 1.0) / (self.tokens + self.classes + self.kept - 1)

    def slices_of(self) -> np.ndarray:
        """Number of slices of each history's successors."""
        return np.maximum(1, -(-self.counts // (BUCKET_TOKENS // 4)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each word hash."""
        other = np.full(len(hashes), RARE, np.int64) if self.merged else hashed(hashes)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + FIRST_WORD, other)

    def bucket(self, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Bucket of each bigram key: by history and, where that is frequent, slice of the successor."""
        h, w = keys // self.classes, keys % self.classes
        part = mix(w.astype(np.uint64)) % parts[h].astype(np.uint64)
        return (mix(h.astype(np.uint64) * np.uint64(1_000_003) + part) % np.uint64(self.buckets)).astype(np.int64)

    def word_bucket(self, ids: np.ndarray) -> np.ndarray:
        """Bucket of each hashed id."""
        return (mix(ids.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)


def hashed(hashes: np.ndarray) -> np.ndarray:
    """Negative id of a word hash."""
    return (hashes | _HASHED).view(np.int64)


def joint(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """64-bit key of two ids."""
    return (mix(one.view(np.uint64)) * np.uint64(0x9FB21C651E98DF25) + other.view(np.uint64)).view(np.int64)


def _sequences(words: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, token and text row of every token of a slice, ends included."""
    rows = len(words.count)
    token = np.empty(len(classes) + rows, np.int64)
    token[np.arange(len(classes)) + words.row] = classes
    last = words.bounds[1:] + np.arange(rows)
    token[last] = END
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[words.bounds[:-1] + np.arange(rows)] = START
    return history, token, np.repeat(np.arange(rows), words.count + 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over ``texts``, combined per task before the shuffle."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column("text")):
                held.append(np.unique(Words(raw, offsets).hashes(), return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH_TOKENS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > FLUSH_TOKENS:
                        yield emit(held[0])
                        held, size = [], 0
        if held:
            yield emit(_merged(held))

    def emit(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int64))], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets in an ascending array, and where each begins and ends."""
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    return np.flatnonzero(np.diff(ends)), ends


def bigram_table(texts: DataFrame, vocabulary) -> DataFrame:
    """(bucket, kind, history, words, counts, n1..n6): the bigrams of one key with their counts.

    The key, in ``history``, is the history (of a slice), but the successor in rows of the kind
    ``BY_WORD``, whose ``words`` are the histories. A bigram counts once in n1..n6.
    """
    def count(batches):
        v = vocabulary.value
        parts = v.slices_of()
        held, pairs, size = [], [], 0

        def flush():
            out = {k: [] for k in ("bucket", "kind", "keys", "others", "counts")}
            if held:
                keys, counts = _merged(held)
                bucket = v.bucket(keys, parts)
                order = np.argsort(bucket, kind="stable")
                keys, counts = keys[order], counts[order]
                full, ends = _cut(bucket[order], v.buckets)
                for b in full:
                    mine = slice(ends[b], ends[b + 1])
                    for name, value in zip(out, (b, DENSE, packed(keys[mine]), None, packed(counts[mine]))):
                        out[name].append(value)
            history, word = (np.concatenate(x) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 2
            for kind, key, other in ((BY_WORD, word, history), (BY_HISTORY, history, word)):
                key, other = key[key < 0], other[key < 0]
                bucket = v.word_bucket(key)
                order = np.lexsort((other, key, bucket))
                key, other, bucket = key[order], other[order], bucket[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1]))[:len(key)])
                counts = np.diff(np.append(first, len(key)))
                key, other = key[first], other[first]
                full, ends = _cut(bucket[first], v.buckets)
                for b in full:
                    mine = slice(ends[b], ends[b + 1])
                    for name, value in zip(out, (b, kind, packed(key[mine]), packed(other[mine]), packed(counts[mine]))):
                        out[name].append(value)
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], list(out))

        for batch in batches:
            for _, _, raw, offsets in slices(batch.column("text")):
                words = Words(raw, offsets)
                history, token, _ = _sequences(words, v.of(words.hashes()))
                dense = (history >= 0) & (token >= 0)
                held.append(np.unique(history[dense] * v.classes + token[dense], return_counts=True))
                pairs.append((history[~dense], token[~dense]))
                size += len(held[-1][0]) + len(pairs[-1][0])
                if size > FLUSH_TOKENS:
                    yield flush()
                    held, pairs, size = [], [], 0
        if held:
            yield flush()

    def reduce(table: pa.Table) -> pa.Table:
        size = vocabulary.value.classes
        rows, out = table.to_pylist(), []
        for kind in (DENSE, BY_WORD, BY_HISTORY):
            mine = [r for r in rows if r["kind"] == kind]
            if not mine:
                continue
            if kind == DENSE:
                keys, counts = _merged([(unpacked(r["keys"]), unpacked(r["counts"])) for r in mine])
                key, other = keys // size, keys % size
            else:
                key, other, counts = (np.concatenate([unpacked(r[c]) for r in mine]) for c in ("keys", "others", "counts"))
                order = np.lexsort((other, key))
                key, other, counts = key[order], other[order], counts[order]
                at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])))
                key, other, counts = key[at], other[at], np.add.reduceat(counts, at)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = pa.array(np.append(first, len(key)).astype(np.int32))
            once = (other >= 0) | (kind != BY_HISTORY)  # two hashed words: counted by the successor
            out.append(pa.table(
                [pa.array(np.full(len(first), rows[0]["bucket"], np.int32)), pa.array(np.full(len(first), kind, np.int32)), pa.array(key[first]),
                 *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (other, counts)),
                 *(pa.array(np.add.reduceat(((counts == r) & once).astype(np.int64), first)) for r in range(1, GT_MAX + 2))],
                names=["bucket", "kind", "history", "words", "counts", *(f"n{r}" for r in range(1, GT_MAX + 2))]))
        return pa.concat_tables(out)

    schema = "bucket int, kind int, history long, words array<bigint>, counts array<bigint>, " + ", ".join(f"n{r} long" for r in range(1, GT_MAX + 2))
    return texts.select("text").mapInArrow(count, "bucket int, kind int, keys binary, others binary, counts binary").groupBy("bucket").applyInArrow(reduce, schema)


@dataclass
class Model:
    """What the scoring pass needs everywhere: bounded by the vocabulary's and the pair list's rules."""

    vocabulary: Vocabulary
    discount: np.ndarray  # by count, 0..GT_MAX
    log_total: np.ndarray  # per history: log10 of the denominator of seen words
    log_alpha: np.ndarray  # per history: log10 of the backoff weight
    pairs: np.ndarray  # sorted keys of common bigrams
    pair_logs: np.ndarray

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= GT_MAX, self.discount[np.minimum(counts, GT_MAX)], 1.0)

    def seen_log(self, history: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10(self.discounted(counts)) - self.log_total[history]


def _common_share(word_share: float) -> float:
    """Least share of the words with dense ids."""
    return word_share or COMMON_SHARE


def _vocabulary(words: DataFrame, n_texts: int, word_share: float) -> Vocabulary:
    n_words, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = n_words + n_texts
    # At most 1 / share rows, by the rule itself.
    common_words = words.where(F.col("n") >= F.lit(_common_share(word_share)) * tokens).toArrow() if types else None
    hashes = common_words.column("word").to_numpy().view(np.uint64) if types else np.zeros(0, np.uint64)
    counts = common_words.column("n").to_numpy() if types else np.zeros(0, np.int64)
    order = np.argsort(hashes)
    merged, others = word_share > 0, int(types - len(hashes))
    rare = n_words - counts.sum() if merged else 0
    return Vocabulary(hashes[order], np.concatenate([[n_texts, n_texts, rare], counts[order]]).astype(np.int64), int(tokens),
                      int(types + (n_texts > 0)), others if merged else 0, max(MIN_BUCKETS, -(-int(tokens) // BUCKET_TOKENS)),
                      0 if merged else others, merged)


def fit(docs: DataFrame, train: Column, word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE) -> tuple[Model, DataFrame, DataFrame]:
    """The bounded model and its two partitioned tables: words (word, n, log_alpha) and bigrams."""
    common.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.where(train).select("text")
    words = common.staged(word_counts(texts), "words")
    v = _vocabulary(words, texts.count(), word_share)
    shared = spark.sparkContext.broadcast(v)
    bigrams = common.staged(bigram_table(texts, shared), "bigrams")
    times = bigrams.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, GT_MAX + 2)]).first()
    model = Model(v, discounts([0, *times]), np.zeros(v.classes), np.zeros(v.classes), np.zeros(0, np.int64), np.zeros(0))

    def masses(batches):
        v = shared.value
        unigram = v.unigram
        for batch in batches:
            if batch.num_rows:
                w, c = batch.column("words"), batch.column("counts").flatten().to_numpy()
                size = np.diff(w.offsets.to_numpy())
                kind, key = (np.repeat(batch.column(x).to_numpy(), size) for x in ("kind", "history"))
                other, by_word = w.flatten().to_numpy(), kind == BY_WORD
                successors = np.repeat(np.add.reduceat(c, np.cumsum(size) - size), size)  # c(w) where the key is w
                history = np.where(by_word, other, key)
                # A bigram of two hashed words adds its seen mass by history, its unigram mass by successor.
                seen = np.where(by_word & (history < 0), 0.0, model.discounted(c))
                mass = np.where(by_word, v.share(successors), np.where(other < 0, 0.0, unigram[np.maximum(other, 0)]))
                order = np.argsort(history, kind="stable")
                history = history[order]
                first = np.flatnonzero(np.append(True, history[1:] != history[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(history[first]), pa.array(np.add.reduceat(seen[order], first)), pa.array(np.add.reduceat(mass[order], first))],
                                                 ["history", "seen", "unigram"])

    sums = bigrams.select("kind", "history", "words", "counts").mapInArrow(masses, "history long, seen double, unigram double").groupBy("history").agg(F.sum("seen").alias("seen"), F.sum("unigram").alias("unigram"))
    sums = common.staged(sums, "masses")
    # One row per dense id: at most the vocabulary.
    dense = sums.where("history >= 0").toArrow()
    seen, covered = np.zeros(v.classes), np.zeros(v.classes)
    seen[dense.column("history").to_numpy()] = dense.column("seen").to_numpy()
    covered[dense.column("history").to_numpy()] = dense.column("unigram").to_numpy()
    total, open_ = v.counts + 1.0, 1 - covered
    total[END] = 1.0
    closed = open_ < 1e-9  # every class follows this history: nothing to back off to
    total = np.where(closed, seen, total)
    with np.errstate(divide="ignore"):
        model.log_total = np.log10(total)
        model.log_alpha = np.where(closed, -np.inf, np.log10((1 - seen / total) / np.where(closed, 1.0, open_)))
    if v.kept:
        # A rare history has few successors, so some mass is always open.
        alpha = F.log10((1 - F.col("seen") / (F.col("n") + 1)) / (1 - F.col("unigram")))
        words = (words.withColumn("history", F.col("word").bitwiseOR(F.lit(-2**63).cast("long")))
                 .join(sums.where("history < 0"), "history", "left").select("word", "n", F.coalesce(alpha, F.lit(0.0)).alias("log_alpha")))
    else:
        words = words.withColumn("log_alpha", F.lit(0.0))

    def frequent(batches):
        for batch in batches:
            w, c = batch.column("words"), batch.column("counts")
            counts, at = c.flatten().to_numpy(), np.repeat(batch.column("history").to_numpy(), np.diff(w.offsets.to_numpy()))
            hit = counts >= pair_share * shared.value.tokens
            yield pa.RecordBatch.from_arrays([pa.array((at * shared.value.classes + w.flatten().to_numpy())[hit]), pa.array(counts[hit])], ["key", "n"])

    # At most 1 / pair_share rows, by the rule itself.
    top = bigrams.where(F.col("kind") == DENSE).select("history", "words", "counts").mapInArrow(frequent, "key long, n long").toArrow()
    keys, counts = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(keys)
    model.pairs, model.pair_logs = keys[order], model.seen_log(keys[order] // v.classes, counts[order])
    return model, words, bigrams


#: Lookups of one bucket: keys of dense bigrams; hashed words with their histories; hashed
#: histories with their successors; each with the texts' places.
_LOOKUPS = ("pair_keys", "pair_rows", "word_keys", "word_histories", "word_rows", "history_keys", "history_words", "history_rows")


def _occurrences(keyed: DataFrame, shared) -> DataFrame:
    """(bucket, rows, lookups, local): what each bucket must look up.

    ``rows`` are the row keys of the texts, the packed arrays hold their places in it. Rows with
    ``local`` carry per text the sums that need no lookup.
    """
    def run(batches):
        model = shared.value
        v, parts = model.vocabulary, model.vocabulary.slices_of()
        logs = np.log10(v.counts + 1.0)
        held = {"rows": [], "local": [], **{k: [] for k in _LOOKUPS}}
        size = base = 0

        def flush():
            rows = np.concatenate(held["rows"])
            groups = []
            for names in (_LOOKUPS[:2], _LOOKUPS[2:5], _LOOKUPS[5:]):
                arrays = [np.concatenate(held[k]) for k in names]
                bucket = v.bucket(arrays[0], parts) if names[0] == "pair_keys" else v.word_bucket(arrays[0])
                order = np.lexsort((arrays[0], bucket))
                groups.append(([x[order] for x in arrays], np.searchsorted(bucket[order], np.arange(v.buckets + 1))))
            out = {k: [] for k in ("bucket", "rows", *_LOOKUPS, "local")}
            for b in range(v.buckets):
                mine = [[x[ends[b]:ends[b + 1]] for x in arrays] for arrays, ends in groups]
                if any(len(x[0]) for x in mine):
                    used = np.zeros(len(rows), bool)
                    for x in mine:
                        used[x[-1]] = True
                    place = np.cumsum(used) - 1
                    values = [packed(y) for x in mine for y in (*x[:-1], place[x[-1]])]
                    for name, value in zip(out, (b, rows[used].tobytes(), *values, None)):
                        out[name].append(value)
            # The texts' own sums go wherever their rows hash to: they are only passed through.
            for name, value in zip(out, (int(mix(rows[:1].view(np.uint64))[0] % np.uint64(v.buckets)), rows.tobytes(), *[None] * len(_LOOKUPS), np.concatenate(held["local"], axis=1).tobytes())):
                out[name].append(value)
            return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in list(out)[1:])], list(out))

        for batch in batches:
            for first, stop, raw, offsets in slices(batch.column("text")):
                words = Words(raw, offsets)
                hashes = words.hashes()
                classes = v.of(hashes)
                history, token, row = _sequences(words, classes)
                dense = (history >= 0) & (token >= 0)
                keys, pair_row = history[dense] * v.classes + token[dense], row[dense]
                score = np.zeros(stop - first)
                if len(model.pairs):
                    at = np.minimum(np.searchsorted(model.pairs, keys), len(model.pairs) - 1)
                    hit = model.pairs[at] == keys
                    score = np.bincount(pair_row[hit], model.pair_logs[at[hit]], stop - first)
                    keys, pair_row = keys[~hit], pair_row[~hit]
                rare = classes == RARE if v.merged else classes < 0
                known = np.bincount(words.row[~rare], minlength=stop - first) + (v.counts[END] > 0)
                n = words.count + 1
                own = np.bincount(words.row[~rare], logs[classes[~rare]], stop - first).astype(float) + logs[END] - n * np.log10(v.tokens + v.types + 1.0)
                held["rows"].append(batch.column(common.ROW_KEY).slice(first, stop - first).to_numpy())
                held["local"].append(np.stack([n, known, own, score]).astype(float))
                by_word, by_history = token < 0, history < 0
                word = (hashed(hashes[rare]), np.full(rare.sum(), RARE), words.row[rare]) if v.merged else (token[by_word], history[by_word], row[by_word])
                for name, value in zip(_LOOKUPS, (keys, pair_row, *word, history[by_history], token[by_history], row[by_history])):
                    held[name].append(value + base if name.endswith("rows") else value)
                base += stop - first
                size += int(n.sum())
                if size > FLUSH_TOKENS:
                    yield flush()
                    held = {k: [] for k in held}
                    size = base = 0
        if base:
            yield flush()

    return keyed.select(common.ROW_KEY, "text").mapInArrow(run, "bucket int, rows binary, " + ", ".join(f"{k} binary" for k in _LOOKUPS) + ", local binary")


def _bucket_words(words: DataFrame, shared, least: float) -> DataFrame:
    """Counts and backoff weights (the bits of a double) of hashed words as rows of the bigram
    table's shape, packed by bucket."""
    def run(batches):
        v = shared.value.vocabulary
        for batch in batches:
            if batch.num_rows:
                word = hashed(batch.column("word").to_numpy().view(np.uint64))
                bucket = v.word_bucket(word)
                order = np.argsort(bucket, kind="stable")
                full, ends = _cut(bucket[order], v.buckets)
                at = pa.array(np.append(ends[full], len(word)).astype(np.int32))
                for kind, values in ((COUNTS, batch.column("n").to_numpy()), (ALPHAS, batch.column("log_alpha").to_numpy().view(np.int64))):
                    lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (word, values)]
                    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array(np.zeros(len(full), np.int64)), *lists],
                                                     ["bucket", "kind", "history", "words", "counts"])

    return words.where(F.col("n") < least).mapInArrow(run, "bucket int, kind int, history long, words array<bigint>, counts array<bigint>")


def score(docs: DataFrame, model: Model, words: DataFrame, bigrams: DataFrame, word_share: float = WORD_SHARE) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = common.with_row_key(docs.select("doc_id", "text"))
    table = bigrams.select("bucket", "kind", "history", "words", "counts").unionByName(
        _bucket_words(words, shared, _common_share(word_share) * model.vocabulary.tokens))

    def evaluate(occurrences: pa.Table, counts: pa.Table) -> pa.Table:
        m = shared.value
        v = m.vocabulary
        tables = {}
        for kind in range(5):
            keys, values = [], []
            for batch in counts.to_batches():
                mine = batch.filter(pa.array(batch.column("kind").to_numpy() == kind))
                if mine.num_rows:
                    w, c = mine.column("words"), mine.column("counts").flatten().to_numpy()
                    key = np.repeat(mine.column("history").to_numpy(), np.diff(w.offsets.to_numpy()))
                    other = w.flatten().to_numpy()
                    keys.append(key * v.classes + other if kind == DENSE else joint(key, other) if kind in (BY_WORD, BY_HISTORY) else other)
                    values.append(m.seen_log(key, c) if kind == DENSE else c)
            keys, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, values))
            order = np.argsort(keys, kind="stable")
            tables[kind] = keys[order], values[order]

        def find(kind: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether each key is there, and its value or 0."""
            keys, values = tables[kind]
            if not len(keys):
                return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            return hit, np.where(hit, values[at], 0)

        unigram_logs = np.log10(np.maximum(v.unigram, 1e-300))
        rare_total = np.log10(v.counts[RARE] + v.rare_types + 1.0)
        parts = []
        for r in occurrences.to_pylist():
            rows = np.frombuffer(r["rows"], np.int64)
            if r["local"] is not None:
                n, known, base, own = np.frombuffer(r["local"]).reshape(4, -1)
                parts.append((rows, np.ones(len(rows)), n, known, base, own))
                continue
            keys, at, word, word_history, word_at, history_key, successor, history_at = (unpacked(r[k]) for k in _LOOKUPS)
            hit, logs = find(DENSE, keys)
            history, token = keys // v.classes, keys % v.classes
            total = np.bincount(at, np.where(hit, logs, m.log_alpha[history] + unigram_logs[token]), len(rows))
            known, n = find(COUNTS, word)
            own = np.log10(n + 1.0)
            if v.merged:
                logs = own - rare_total
            else:
                # After a hashed history only the unigram part: the rest comes from its own bucket.
                hit, c = find(BY_WORD, joint(word, word_history))
                dense, history = word_history >= 0, np.maximum(word_history, 0)
                logs = np.where(hit, np.where(dense, m.seen_log(history, np.maximum(c, 1)), 0.0), np.where(dense, m.log_alpha[history], 0.0) + np.log10(v.share(n)))
            total = total + np.bincount(word_at, logs, len(rows))
            hit, c = find(BY_HISTORY, joint(history_key, successor))
            seen = np.log10(m.discounted(np.maximum(c, 1))) - np.log10(find(COUNTS, history_key)[1] + 1.0)
            alpha = find(ALPHAS, history_key)[1].view(np.float64)
            backed = alpha + np.where(successor < 0, 0.0, unigram_logs[np.maximum(successor, 0)])
            total = total + np.bincount(history_at, np.where(hit, seen, backed), len(rows))
            zero = np.zeros(len(rows))
            parts.append((rows, zero, zero, np.bincount(word_at[known], minlength=len(rows)), np.bincount(word_at, own, len(rows)), total))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), *[np.zeros(0)] * 5]
        kinds = (np.int64, np.int64, np.int64, np.int64, float, float)
        return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, kinds)], names=["row", "copies", "n_tokens", "n_known", "base_score", "score"])

    partial = (_occurrences(keyed, shared).groupBy("bucket").cogroup(table.groupBy("bucket"))
               .applyInArrow(evaluate, "row long, copies long, n_tokens long, n_known long, base_score double, score double"))
    names = ("n_tokens", "n_known", "base_score", "score")
    sums = partial.groupBy("row").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in names])
    # Rows of equal id and text have one key: each gets its share of their common sum.
    each = sums.select(F.col("row").alias(common.ROW_KEY), *[(F.col(c) / F.col("copies")).cast("long" if c.startswith("n_") else "double").alias(c) for c in names])
    return keyed.select("doc_id", common.ROW_KEY).join(each, common.ROW_KEY).select("doc_id", *names)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out_of_training = common.held_out("doc_id", *HELD_OUT)
    model, words, bigrams = fit(docs, ~out_of_training)
    scored = score(docs, model, words, bigrams)
    return scored.select("doc_id", out_of_training.alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
