import random
from math import comb

import numpy as np
import pytest

from helpers import CLASHING, prose
from strata.llm import minhash_dedup as m
from strata.llm.minhash_dedup import least_matches, minhash_stage, near_duplicates


def shingles(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n):
    """doc_id -> (set size, smallest id reachable) by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    out = {}
    for k, (i, s) in enumerate(sets):
        out[i] = (len(s), min(sets[j][0] for j in range(len(sets)) if find(j) == find(k)))
    return out


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(12):
        base = prose(rng, rng.randint(30, 200))
        group = [base, base, base.upper(), edited(rng, base, 0.01), edited(rng, base, 0.03), edited(rng, base, 0.08)]
        group += [edited(rng, group[3], 0.02), edited(rng, group[4], 0.02)]
        for t in group:
            rows.append((i, t))
            i += 1
    rows += [(i + k, prose(rng, 50)) for k in range(30)]
    i += 30
    rows += [(i, "one two"), (i + 1, "One  two"), (i + 2, "one two three four"), (i + 3, ""), (i + 4, " ")]
    rng.shuffle(rows)
    return rows


def test_matches_all_pairs(make_docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows, 4)


def test_second_round_joins_what_the_leaders_left(make_docs, monkeypatch):
    """A chain of edits whose ends are far apart, in small blocks: only neighbours are linked."""
    monkeypatch.setattr(m, "BLOCK", 4)
    rng = random.Random(10)
    rows = []
    for c in range(3):
        w = prose(rng, 300).split()
        for k in range(12):
            rows.append((c * 100 + 50 - k if c else k, " ".join(w)))
            for _ in range(6):
                w[rng.randrange(len(w))] = f"step{c}x{k}x{rng.randrange(999)}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows, 4)


def test_posterior_bound():
    for n in (16, 64, 128):
        k = least_matches(n)
        tail = lambda k: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))
        assert tail(k) >= m.MISS and (k == 0 or tail(k - 1) < m.MISS)


def test_sequential_test_keeps_similar_signatures():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (200, m.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.82, a, a + np.uint32(1))
    assert len(m._sequential(a, b)) == 200
    assert len(m._sequential(a, a[::-1])) == 0


def test_stage_keeps_one_of_each_group(make_docs, rows):
    docs = make_docs(rows, CLASHING)
    out = minhash_stage(docs.sparkSession, docs, "")
    assert out.schema.names == docs.schema.names
    assert {r["doc_id"] for r in out.collect()} == {i for i, (_, root) in brute(rows, 5).items() if i == root}


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == by_id[2] == [(0, 1, True)] or (by_id[1], by_id[2]) == ([(0, 1, True)], [(0, 2, True)])
    assert by_id[5][0] == by_id[5][1] and by_id[5][0][1:] == (5, True) and by_id[6][0][1:] == (5, False)
    assert all(r[1] is None and r[2] for r in by_id[None])
    assert by_id[9][0][0] == 1 and by_id[10][0][0] == 1
    kept = minhash_stage(docs.sparkSession, docs, "").collect()
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) == [1, 2, 3, 4, 5, 7, 7, 8, 9, 10, 11]
    assert near_duplicates(make_docs([])).collect() == []
