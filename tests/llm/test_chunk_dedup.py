import random

import numpy as np

from helpers import CLASHING, prose
from strata.llm.chunk_dedup import LEAST, REACH, SHORTEST, cuts, dedup_chunks, gear, _GEAR


def plain_cuts(raw: bytes) -> list[int]:
    """Cut positions by definition, one position at a time (texts without long gaps)."""
    table, n = _GEAR.tolist(), len(raw)
    h = []
    for i in range(n):
        h.append(sum(table[raw[i - k]] << k for k in range(32) if i - k >= 0) % 2**32)
    h = [x if i + 1 == n or raw[i + 1] & 0xC0 != 0x80 else 0 for i, x in enumerate(h)]
    tops = [i + 1 for i in range(n) if h[i] > max(h[max(0, i - REACH):i], default=0) and h[i] > max(h[i + 1:i + 1 + REACH], default=0)]
    return sorted({*tops, n})


def test_cuts_follow_the_definition():
    rng = random.Random(2)
    for text in (prose(rng, 300), "é" + prose(rng, 50) + "ü" * 30, "x"):
        raw = text.encode()
        assert cuts(np.frombuffer(raw, np.uint8)).tolist() == plain_cuts(raw)


def test_gear_depends_on_the_last_bytes_only():
    a, b = np.frombuffer(b"q" * 40 + b"z" * 64, np.uint8), np.frombuffer(b"r" * 9 + b"z" * 64, np.uint8)
    assert gear(a)[-1] == gear(b)[-1]


def test_periodic_text_is_cut_and_round_trips():
    for text in ("ab" * 5000, "é" * 3000, "\x00" * 2000):
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = cuts(raw)
        assert ends[-1] == len(raw) and np.diff(ends, prepend=0).max() <= 513
        starts = np.append(0, ends[:-1])
        assert "".join(raw[a:z].tobytes().decode() for a, z in zip(starts, ends)) == text


def test_shared_passages_go_from_all_but_the_first(make_docs):
    rng = random.Random(3)
    passages = [prose(rng, 60) for _ in range(5)]
    rows, holders = [], {}
    for i in range(60):
        parts = [prose(rng, 80), prose(rng, 70)]
        if i % 4 == 0:
            k = rng.randrange(5)
            parts.insert(1, passages[k])
            holders.setdefault(k, []).append(i)
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: r for r in dedup_chunks(make_docs(rows), spans=True).collect()}
    later = {i for h in holders.values() for i in h[1:]}
    assert {i for i, r in got.items() if r["n_removed_bytes"]} == later
    for i, text in rows:
        raw, spans = text.encode(), got[i]["removed_spans"]
        # Round trip: what is kept plus what was cut out is the text, and every cut stands earlier.
        kept, at = b"", 0
        for a, z in spans:
            kept += raw[at:a]
            assert any(raw[a:z][:SHORTEST] in t.encode() for j, t in rows if j < i)
            at = z
        assert (kept + raw[at:]).decode() == got[i]["text"]
    assert all(got[i]["n_removed_bytes"] > 0.3 * len(passages[k]) for k, h in holders.items() for i in h[1:])


def brute(rows, least):
    """{id: text} after removal, by one plain scan over the chunks of all texts in order of their ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw, kept, run, start = text.encode(), b"", b"", 0
        for end in plain_cuts(raw):
            chunk = raw[start:end]
            if len(chunk) >= SHORTEST and chunk in seen:
                run += chunk
            else:
                kept += (run if len(run) < least else b"") + chunk
                run = b""
                if len(chunk) >= SHORTEST:
                    seen.add(chunk)
            start = end
        out[i] = (kept + (run if len(run) < least else b"")).decode()
    return out


def test_whole_removal_matches_a_plain_scan(make_docs):
    """Shared passages of all lengths, within and across texts: short runs stay, long ones go."""
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (3, 8, 15, 25, 40, 60, 90)]
    rows = []
    for i in range(50):
        parts = [x for _ in range(3) for x in (prose(rng, rng.randint(5, 50)), rng.choice(passages))]
        rows.append((i * 3, " ".join(parts) + ("é" if i % 2 else "")))
    for least in (0, LEAST, 10_000):
        got = {r["doc_id"]: r["text"] for r in dedup_chunks(make_docs(rows), least=least).collect()}
        assert got == brute(rows, least)
    texts = [brute(rows, least) for least in (0, LEAST, 10_000)]
    assert texts[0] != texts[1] != texts[2] == dict(rows)


def test_insertions_do_not_shift_the_other_chunks(make_docs):
    rng = random.Random(4)
    text = prose(rng, 600)
    at = len(text) // 2
    got = {r["doc_id"]: r for r in dedup_chunks(make_docs([(1, text), (2, text[:at] + "INSERTED" + text[at:])]), spans=True).collect()}
    assert got[1]["text"] == text and len(got[2]["text"]) < 500 and "INSERTED" in got[2]["text"]


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, CLASHING)
    out = dedup_chunks(docs)
    assert out.schema.names == docs.schema.names
    text = {}
    for r in out.collect():
        text.setdefault(r["doc_id"], []).append(r["text"])
    assert sum(map(len, text.values())) == len(odd_rows)
    assert text[1] == [None] and text[2] == [""] and text[3] == [" \n\t "] and sorted(text[7]) == ["one", "two words"]
    assert text[5][0] == text[5][1] != odd_rows[4][1] and odd_rows[4][1] in text[None]
    assert dedup_chunks(make_docs([])).collect() == []
