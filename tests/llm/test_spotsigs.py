import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import prose
from strata.llm import spotsigs as s
from strata.llm.spotsigs import classes, likeness, similar_pairs, with_next, with_signatures

WORDS = re.compile(r"[^\W_]+")


def chains(text):
    """The signature strings of a text, by the definition."""
    w = WORDS.findall((text or "").lower())
    anchors, out = set(s.ANCHORS), set()
    for i, x in enumerate(w):
        if x in anchors:
            chain, j = [x], i + 1
            while len(chain) < 3:
                skipped = 0
                while j < len(w) and w[j] in anchors and skipped < 8:
                    j, skipped = j + 1, skipped + 1
                if j >= len(w):
                    break
                chain.append(w[j])
                j += 1
            if len(chain) == 3:
                out.add(tuple(chain))
        elif not any(y in anchors for y in w[i:i + s.GAP]):
            out.add((x,))
    return out or {(x,) for x in w}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(15)
    rows = [(i * 7 % 101, prose(rng, rng.randint(1, 90))) for i in range(60)]
    return rows + [(200, "the the"), (201, ""), (202, None), (203, "a | b | c | d"), (204, rows[3][1].upper()), (205, "Ünïcode THE Straße und mehr, noch"), (206, "x")]


def test_signatures_follow_the_definition(make_docs, rows):
    got = {r["doc_id"]: r["n"] for r in with_signatures(make_docs(rows), "text", "set").select("doc_id", F.size("set").alias("n")).collect()}
    assert got == {i: len(chains(t)) for i, t in rows}


def test_next_and_edited(make_docs, rows, monkeypatch):
    monkeypatch.setattr(s, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(s.common, "documents", lambda spark, sf_dir: make_docs(rows, ("range", "guest", "set")))
    got = {r["doc_id"]: r for r in s.op4_spotsigs(None, "").collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)

    def jaccard(a, b):
        a, b = chains(a), chains(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(t, edited)) and r["near_next"] == pytest.approx(jaccard(t, following))
    assert got[204]["fingerprint"] == got[dict((t.upper(), i) for i, t in rows[:60])[rows[3][1].upper()]]["fingerprint"]
    assert got[201]["fingerprint"] == got[202]["fingerprint"] == ""


def test_similar_pairs_match_all_pairs(make_docs):
    rng = random.Random(16)
    rows, i = [], 0
    for _ in range(12):
        w = prose(rng, rng.randint(30, 150)).split()
        for k in range(4):
            rows.append((i, " ".join(w)))
            if k:
                w[rng.randrange(len(w))] = f"edit{i}"
            i += 1
    docs = make_docs(rows)
    members, sets = classes(docs)
    got = {(r["a"], r["b"]) for r in similar_pairs(sets).collect()}
    first = {}
    for j, t in rows:
        first.setdefault(frozenset(chains(t)), j)
    ids = sorted(first.items(), key=lambda x: x[1])
    want = {(a, b) for x, a in ids for y, b in ids if a < b and len(x & y) >= 0.8 * len(x | y) - 1e-12}
    assert got == want and len(want) > 5
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {j: first[frozenset(chains(t))] for j, t in rows}


def test_odd_rows_and_tables(make_docs, odd_rows):
    docs = make_docs(odd_rows, ("range", "guest"))
    got = with_next(docs.select("doc_id", "text")).collect()
    assert len(got) == len(odd_rows)
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    follows = {}
    for a, b in zip(ordered, ordered[1:] + ordered[:1]):
        follows.setdefault(a, []).append(b[1])
    assert all(r["next_text"] in follows[r["doc_id"], r["text"]] for r in got)
    assert with_next(make_docs([]).select("doc_id", "text")).collect() == []
    one = with_next(make_docs([(9, "only")]).select("doc_id", "text")).collect()
    assert [r["next_text"] for r in one] == ["only"]
    empty = with_signatures(make_docs([(1, None)]), "text", "a")
    assert empty.select(likeness(F.col("a"), F.col("a")).alias("x")).first()["x"] == 1.0
