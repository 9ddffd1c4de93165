"""Spelling variants: words, trie numbers and neighbours against plain restatements."""
import random
import re
import zlib
from collections import Counter

import pytest

from helpers import CLASHING, prose
from strata.llm import variants


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def spelled(rng, size):
    """Words with many near ones, repeated letters and shared prefixes and suffixes."""
    out = set()
    while len(out) < size:
        w = "".join(rng.choices("aabbloéÿ", k=rng.randint(5, 7)))
        out.add(w)
        for _ in range(3):
            i = rng.randrange(len(w))
            out.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abl") + w[i + 1:], w[:i] + w[i] + w[i:]]))
    return sorted(x for x in out if len(x) >= 5)


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(8)
    vocabulary = spelled(rng, 250)
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) ** 0.5 for i in range(len(vocabulary))], k=120)) for _ in range(40)]
    more = ["Straße STRASSE strasse straße, straßeŁstrasse 中hello-hello hello" * 3, "hello helo hellos helllo " * 9, "ÉCOLE École école " * 5,
            "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3000, "a" * 2999 + " " + "a" * 2999 + "\n" + "a" * 2999]
    return [*odd_rows, *enumerate(texts, 1000), *enumerate(more, 5000), (None, texts[0]), (1000, texts[0])]


def test_words(make_docs, rows, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 64)
    got = {r["word"]: r["n"] for r in variants.words(make_docs(rows)).collect()}
    assert got == brute_words(rows)
    assert len(got) > 200 and any(zlib.crc32(f"{i}:{w}".encode()) % 97 == 0 for i in range(1000, 1040) for w in got)


@pytest.mark.parametrize("range_words", [50_000, 20])
def test_variants(make_docs, rows, monkeypatch, range_words):
    """In one range of words, and with many ranges whose tries share nodes."""
    monkeypatch.setattr(variants, "RANGE_WORDS", range_words)
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.variants(make_docs(rows, CLASHING)).collect())
    want = brute_variants(rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert got == want
    assert sum(x[1] is not None for x in want) > 50 and any(x[1] not in (None, x[2]) for x in want)


@pytest.mark.parametrize("cuts", [[], ["ab"], ["a", "ab", "abc", "abd", "b"], ["zz"]])
def test_numbers_name_prefixes(cuts):
    """Equal prefixes have one number, different ones two, in any order of the ranges."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdz", k=rng.randint(1, 6))) for _ in range(400)} | {"ab", "abc", "a" * 50})
    numbers = variants.Numbering(cuts)
    by_range = {}
    for w in words:
        by_range.setdefault(numbers.of(w), []).append(w)
    prefix, ranks = {}, {}
    for r in rng.sample(sorted(by_range), len(by_range)):
        fresh = variants.Numbering(cuts)
        for w in by_range[r]:
            ranks[w], nodes = fresh.next(r, w)
            assert len(nodes) == len(w) + 1
            for d, node in enumerate(nodes):
                assert prefix.setdefault(node, w[:d]) == w[:d]
    assert len(prefix) == len({w[:d] for w in words for d in range(len(w) + 1)})
    assert sorted(words, key=ranks.get) == words


def test_empty_table(make_docs):
    assert variants.variants(make_docs([])).collect() == []
    assert variants.variants(make_docs([(1, None), (2, "ab ab ab")])).collect() == []
