import random
import re
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import prose
from strata.llm import katz
from strata.llm.katz import discounts, fit, packed, score, unpacked


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0D]+", text or "")] + [None]


class Brute:
    """The model by its definition, with plain dictionaries."""

    def __init__(self, texts, share):
        seqs = [tokens(t) for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.known = {w for w in self.c if w is not None and self.c[w] >= share * self.n}
        cls = self.cls
        self.uni = Counter(cls(w) for s in seqs for w in s)
        self.hist, self.bi = Counter(), Counter()
        for s in seqs:
            for h, w in zip(["<s>", *map(cls, s)], map(cls, s)):
                self.bi[h, w] += 1
                self.hist[h] += 1
        times = Counter(self.bi.values())
        self.d = discounts([times[r] for r in range(katz.GT_MAX + 2)])
        self.classes = [None, "<rare>", *self.known]
        rare = [w for w in self.c if w is not None and w not in self.known]
        self.rare_total = sum(self.c[w] for w in rare) + len(rare) + 1

    def cls(self, w):
        return w if w is None or w in self.known else "<rare>"

    def p1(self, w):
        return (self.uni[w] + 1) / (self.n + len(self.classes))

    def p(self, w, h):
        seen = [x for x in self.classes if self.bi[h, x]]
        mass = {x: self.bi[h, x] * (self.d[self.bi[h, x]] if self.bi[h, x] <= katz.GT_MAX else 1) for x in seen}
        left = 1 - sum(map(self.p1, seen))
        total = self.hist[h] + 1 if left > 1e-9 else sum(mass.values())
        if w in mass:
            return mass[w] / total
        return (1 - sum(mass.values()) / total) / left * self.p1(w)

    def score(self, text):
        out, h = 0.0, "<s>"
        for w in tokens(text):
            k = self.cls(w)
            out += log10(self.p(k, h))
            if k == "<rare>":
                out += log10((self.c[w] + 1) / self.rare_total)
            h = k
        return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(80)]
    return rows + [(100, ""), (101, None), (102, "Unheard of words Everywhere"), (103, rows[2][1]), (103, rows[2][1]), (103, "another text")]


@pytest.mark.parametrize("share,pair_share,flush", [(0.004, 0.01, 300), (0.0, 1.0, 10**6), (1.0, 0.0, 50)])
def test_matches_the_definition(make_docs, rows, monkeypatch, share, pair_share, flush):
    monkeypatch.setattr(katz, "FLUSH_TOKENS", flush)
    docs, train = make_docs(rows, ("row", "bucket", "words")), F.col("doc_id") % 3 != 1
    model, words, bigrams = fit(docs, train, share, pair_share)
    want = Brute([t for i, t in rows if i % 3 != 1], share)
    got = {}
    for r in score(docs, model, words, bigrams, share).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert (model.vocabulary.tokens, model.vocabulary.types) == (want.n, want.v)
    for i, t in rows:
        if i == 103:
            continue
        (r,) = got[i]
        toks = tokens(t)
        assert (r["n_tokens"], r["n_known"]) == (len(toks), sum(want.c[w] > 0 for w in toks))
        assert r["base_score"] == pytest.approx(sum(log10((want.c[w] + 1) / (want.n + want.v + 1)) for w in toks))
        assert r["score"] == pytest.approx(want.score(t))
    for r in got[103]:
        assert any(r["score"] == pytest.approx(want.score(t)) for t in {t for i, t in rows if i == 103})


def test_every_history_sums_to_one(make_docs, rows):
    share = 0.004
    model, _, bigrams = fit(make_docs(rows), F.lit(True), share, 1.0)
    v = model.vocabulary
    seen = {}
    for r in bigrams.collect():
        for w, c in zip(r["words"], r["counts"]):
            seen[r["history"], w] = c
    for h in range(v.classes):
        if h == katz.END:
            continue
        total = 0.0
        for w in range(1, v.classes):
            if (h, w) in seen:
                total += 10 ** float(model.seen_log(np.array([h]), np.array([seen[h, w]]))[0])
            else:
                total += 10 ** model.log_alpha[h] * v.unigram[w]
        assert total == pytest.approx(1.0, abs=1e-9)


def test_odd_tables(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    model, words, bigrams = fit(docs, F.col("doc_id").isNotNull())
    got = score(docs, model, words, bigrams).collect()
    assert len(got) == len(odd_rows) and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_tokens"], r["score"]))
    assert by_id[1] == by_id[2] == by_id[3] and by_id[5][0] == by_id[5][1]
    model, words, bigrams = fit(docs, F.lit(False))
    assert all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in score(docs, model, words, bigrams).collect())
    none = make_docs([])
    model, words, bigrams = fit(none, F.lit(True))
    assert score(none, model, words, bigrams).collect() == []


def test_packing_round_trips():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-2**62, 2**62, 1000), np.sort(rng.integers(0, 10**9, 500)), np.zeros(0, np.int64)):
        assert (unpacked(packed(x)) == x).all()


@pytest.mark.parametrize("common_share,flush", [(0.02, 300), (1.0, 40), (0.004, 10**6)])
def test_every_training_word_keeps_its_bigrams(make_docs, rows, monkeypatch, common_share, flush):
    """The dense ids of common words are an accelerator only: no word is merged with another."""
    monkeypatch.setattr(katz, "COMMON_SHARE", common_share, raising=False)
    monkeypatch.setattr(katz, "FLUSH_TOKENS", flush)
    docs = make_docs(rows)
    model, words, bigrams = fit(docs, F.col("doc_id") % 3 != 1, pair_share=0.01)
    want = Brute([t for i, t in rows if i % 3 != 1], 0.0)
    assert len(model.vocabulary.hashes) < want.v - 1
    got = {(r["doc_id"], r["n_tokens"]): r for r in score(docs, model, words, bigrams).collect()}
    for i, t in rows:
        r = got[i, len(tokens(t))]
        assert r["n_known"] == sum(want.c[w] > 0 for w in tokens(t))
        assert r["score"] == pytest.approx(want.score(t))


def test_words_far_below_the_common_share_are_told_apart(make_docs):
    """One word in a million and a half tokens: by its share it fell into the class of all rare ones."""
    docs = make_docs([(i, "a b c d e " * 2_500) for i in range(120)] + [(200, "zebra quagga"), (201, "okapi tapir"), (202, "zebra tapir")])
    train = F.col("doc_id") != 202
    got = {r["doc_id"]: r["score"] for r in score(docs, *fit(docs, train)).collect()}
    assert got[200] > got[202] + 1
