import random
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import prose
from strata.llm import packing
from strata.llm.packing import best_fit, default_tokenizer, fit_counts, pack, patterns, plan


def check(rows, got, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cut = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, z) in enumerate(zip(cut, cut[1:])):
            want[i, piece, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r["length"] for r in got) // capacity)
    return len(sequences), least


def test_round_trip_and_tightness(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rng = random.Random(14)
    rows = [(i, prose(rng, int(rng.expovariate(1 / 250)) + 1)) for i in range(300)] + [(1000 + i, "same text here") for i in range(40)]
    used, least = check(rows, pack(make_docs(rows)).collect())
    assert used <= least + 1


def test_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (20, "<|endoftext|> and more")]
    check(rows, pack(make_docs(rows, ("length", "rank"))).collect())
    assert pack(make_docs([])).collect() == []


def test_both_encoders_agree():
    encoder = packing._encoder(default_tokenizer())
    rng = random.Random(19)
    texts = [prose(rng, 200), "", " ", "a  b\n\n c\t", "it's we'll I'm 'd", "naïve Straße 東京 😀 e\u0301", "x" * 3000, " " * 500 + "y", "1234 56,78%$", "<|endoftext|>",
             "\x00\x7f\u200b\ufeff", "Ωmega ٣٤ ½ ²", "".join(chr(rng.randrange(32, 0x2000)) for _ in range(2000))]
    assert encoder.ranked is not None
    for text in texts:
        assert encoder._fast(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    encoder = packing.Encoder(default_tokenizer())
    encoder._fast = lambda text: np.zeros(1, "<u4")
    assert encoder.encode(texts)[1:3] is not None and [e.tolist() for e in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, [3, 50, 300][seed % 3], capacity) * (rng.random(capacity) < [1, 0.3][seed % 2])
    total = Counter()
    used = 0
    for pattern, times in plan(counts, capacity):
        assert sum(pattern) <= capacity and times > 0
        used += times
        for length in pattern:
            total[length] += times
    assert total == {k: c for k, c in enumerate(counts.tolist()) if c}
    # Not more than plain first-fit decreasing, piece by piece.
    spaces: list[int] = []
    for length in np.repeat(np.arange(capacity + 1), counts)[::-1].tolist():
        at = next((i for i, space in enumerate(spaces) if space >= length), None)
        if at is None:
            spaces.append(capacity - length)
        else:
            spaces[at] -= length
    assert used <= len(spaces)


def test_least_squares_fit_meets_its_conditions():
    rng = np.random.default_rng(1)
    counts = np.zeros(33, np.int64)
    counts[1:] = rng.integers(0, 200, 32)
    found = patterns(np.flatnonzero(counts), 32)
    assert all(sum(p) == 32 and len(p) <= 3 for p in found)
    x = fit_counts(counts, found, sweeps=3000)
    a = np.zeros((33, len(found)))
    for k, p in enumerate(found):
        for length in p:
            a[length, k] += 1
    slope = a.T @ (counts - a @ x)
    assert (x >= 0).all() and slope.max() < 1 and np.abs(slope[x > 0.1]).max() < 1


def test_best_fit_of_tiny_pieces():
    counts = np.zeros(2049, np.int64)
    counts[1], counts[1500] = 5000, 3
    packed = best_fit(counts, 2048)
    assert sum(t for _, t in packed) == 5 and sum(t * p.count(1) for p, t in packed) == 5000
