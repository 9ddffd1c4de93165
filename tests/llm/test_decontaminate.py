import random

import numpy as np
import pytest
from pyspark.sql import types as T

from helpers import CLASHING, prose
from strata.llm import decontaminate as d
from strata.llm.decontaminate import banded_distance, drop_contaminated, find_passages, normalise


def plain(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def distance_within(pattern: bytes, text: bytes) -> int:
    """Least edits between the pattern and any part of the text: the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
    return min(row)


def mutate(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(t) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = "x"
        elif kind == 1:
            t.insert(at, "q")
        else:
            del t[at]
    return "".join(t)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    return [(i, prose(rng, rng.randint(12, 30))) for i in range(12)]


@pytest.fixture(scope="module")
def rows(items):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 60)), prose(rng, rng.randint(5, 60))]
        if i % 2 == 0:
            text = rng.choice(items)[1]
            parts.insert(1, mutate(rng, text, int(len(text) * rng.choice([0, 0.03, 0.05, 0.07, 0.09, 0.2]))))
        rows.append((i, rng.choice([" ", "\n\n", " -- "]).join(parts)))
    return rows


def brute(rows, items):
    """(doc_id, item_id) of every item of which a segment lies within its budget somewhere in a text."""
    found = {}
    for i, text in rows:
        t = plain(text)
        for j, item in items:
            p = plain(item)
            starts = [0] if len(p) <= d.SEGMENT else [*range(0, len(p) - d.SEGMENT, d.STRIDE), len(p) - d.SEGMENT]
            for s in starts:
                seg = p[s:s + d.SEGMENT]
                edits = distance_within(seg, t)
                if edits <= d.edits_allowed(len(seg), d.BUDGET):
                    found[i, j] = min(found.get((i, j), edits), edits)
    return found


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_matches_full_alignment(spark, make_docs, rows, items):
    got = find_passages(make_docs(rows), bench(spark, items)).collect()
    want = brute(rows, items)
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(want) > 15
    text = dict(rows)
    for r in got:
        if r["edits"] == 0:
            assert plain(text[r["doc_id"]][r["start"]:r["end"]]) in plain(dict(items)[r["item_id"]])


def test_blocks_cover_the_whole_benchmark(spark, make_docs, rows, items, monkeypatch):
    whole = {tuple(r) for r in find_passages(make_docs(rows), bench(spark, items)).collect()}
    monkeypatch.setattr(d, "BLOCK_BYTES", 600)
    assert len(list(d.blocks(bench(spark, items)))) > 3
    assert {tuple(r) for r in find_passages(make_docs(rows), bench(spark, items)).collect()} == whole


def test_banded_distance_equals_the_full_table():
    rng = random.Random(13)
    for _ in range(60):
        p = prose(rng, 8).encode()
        t = b"##" + mutate(rng, p.decode(), rng.randint(0, 6)).encode() + b"!!!"
        pattern, text = np.frombuffer(p, np.uint8), np.frombuffer(t, np.uint8)
        edits, start, end = banded_distance(pattern, text, -12, 18, 8)
        assert edits == min(distance_within(p, t), 9)
        if edits <= 8:
            assert distance_within(p, t[start:end]) == edits


def test_drop_keeps_clean_rows_as_they_are(spark, make_docs, rows, items, odd_rows):
    docs = make_docs(rows, CLASHING)
    kept = drop_contaminated(docs, bench(spark, items))
    assert kept.schema.names == docs.schema.names
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in brute(rows, items)}
    odd = bench(spark, [*items, (None, items[0][1]), (90, None), (91, ""), (92, "the and of")])
    assert drop_contaminated(make_docs(odd_rows), odd).count() == len(odd_rows)
    assert find_passages(make_docs([(1, items[0][1])]), odd).count() == 2
    assert find_passages(make_docs([(1, None), (None, items[1][1])]), odd).collect()[0]["item_id"] == 1
    assert find_passages(make_docs(rows), bench(spark, items).limit(0)).collect() == []
    assert drop_contaminated(make_docs([]), odd).collect() == []


def test_ten_percent_of_edits_are_found(spark, make_docs, items):
    """The edit budget is 10 % at every length from the shortest on."""
    assert [m for m in range(d.SHORTEST, 400) if d.edits_allowed(m, d.BUDGET) < m // 10] == []
    rng = random.Random(21)
    items = [*items, (50, "ten short words that make up forty-nine bytes only")]
    rows = []
    for i in range(120):
        text = rng.choice(items)[1]
        rows.append((i, f"{prose(rng, 20)} {mutate(rng, text, int(len(text) * rng.choice([0, 0.03, 0.06, 0.09, 0.12])))} {prose(rng, 20)}"))
    want = brute(rows, items)
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in find_passages(make_docs(rows), bench(spark, items)).collect()} == want
    assert sum(edits > 0.08 * min(len(plain(dict(items)[j])), d.SEGMENT) for (_, j), edits in want.items()) > 5


def test_copied_parts_of_items_are_found(spark, make_docs):
    """Every run of SEGMENT + STRIDE - 1 bytes of an item, edited or not, and nothing else."""
    rng = random.Random(31)
    items = [(i, prose(rng, n)) for i, n in enumerate([24, 26, 28, 30, 60, 90])]
    rows = [(0, prose(rng, 80))]
    for i, text in items:
        p = plain(text).decode()
        run = d.SEGMENT + d.STRIDE - 1
        for at in rng.sample(range(len(p) - run + 1), 6):
            rows += [(100 + i, f"{prose(rng, 12)} {p[at:at + run]} {prose(rng, 12)}")]
        rows += [(200 + i, f"{prose(rng, 12)} {p[:150]}"), (300 + i, f"{prose(rng, 12)} {mutate(rng, p[:150], 9)} {prose(rng, 5)}")]
    got = find_passages(make_docs(rows), bench(spark, items)).collect()
    for i, _ in items:
        assert sum((r["doc_id"], r["item_id"], r["edits"]) == (100 + i, i, 0) for r in got) == 6
    assert {(200 + i, i) for i, _ in items} | {(300 + i, i) for i, _ in items} <= {(r["doc_id"], r["item_id"]) for r in got}
    # Against the alignment of every part of every item.
    for doc, text in rows:
        t = plain(text)
        for i, item in items:
            p = plain(item)
            near = any(distance_within(p[s:s + d.SEGMENT], t) <= 10 for s in range(0, len(p) - d.SEGMENT + 1, d.STRIDE))
            assert not near or any((r["doc_id"], r["item_id"]) == (doc, i) for r in got)
    assert not any(r["doc_id"] == 0 for r in got)


def test_edits_that_crowd_in_one_place_stay_within_the_whole_item(spark, make_docs):
    rng = random.Random(32)
    p = plain(prose(rng, 40)).decode()[:150]
    crowded = p[:68] + "7" * 14 + p[82:]
    assert all(distance_within(p[s:s + 100].encode(), crowded.encode()) > 10 for s in (0, 25, 50))
    got = find_passages(make_docs([(1, f"{prose(rng, 9)} {crowded} {prose(rng, 9)}")]), bench(spark, [(7, p)])).collect()
    assert [r["item_id"] for r in got] == [7]


def test_short_items_are_found_exactly(spark, make_docs):
    items = [(1, "Rome, in the year 509."), (2, "four score and seven"), (3, "the and of"), (4, "a b c d e f"), (5, "2+2=4 5x7=35"), (6, "é"), (7, "?!"), (8, "The and, of")]
    rows = [(1, "It began: rome in the year 509 (or so)."), (2, "It began: rome in a year 509."), (3, "Four SCORE and seven years"), (4, "the and of"),
            (5, "a b c d e f"), (6, "2+2=4 5x7=35"), (7, "xa b c d e f"), (8, "... THE and -- of; the and of"), (9, "bathe and of"), (10, "the and offer"), (11, "x É é"), (12, "")]
    got = find_passages(make_docs(rows), bench(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(1, 1, 0), (3, 2, 0), (4, 3, 0), (4, 8, 0), (5, 4, 0), (6, 5, 0), (8, 3, 0), (8, 8, 0), (11, 6, 0)}
    text = dict(rows)
    shown = {(r["doc_id"], r["item_id"]): text[r["doc_id"]][r["start"]:r["end"]] for r in got}
    assert shown[8, 3] == "THE and -- of" and shown[6, 5] == "2+2=4 5x7=35" and shown[11, 6] == "é"
    # Documents are dropped for items of sixteen bytes on, or of as few as asked for.
    assert {r["doc_id"] for r in drop_contaminated(make_docs(rows), bench(spark, items)).collect()} == set(range(1, 13)) - {1, 3}
    assert {r["doc_id"] for r in drop_contaminated(make_docs(rows), bench(spark, items), least=11).collect()} == set(range(1, 13)) - {1, 3, 5, 6}
