import random

import duckdb
import pandas as pd
import pytest

from strata.llm.line_dedup import OP1_SQL, dedup_lines, line_dedup_stage
from helpers import CLASHING, prose

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    """Texts after removal, by a plain scan over all windows in (doc_id, position) order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(BLANK)]
        gone = set()
        for p in range(len(solid) - 2):
            key = tuple(lines[i].strip(BLANK) for i in solid[p:p + 3])
            if key in seen:
                gone.update(range(solid[p], solid[p + 2] + 1))
            seen.add(key)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    shared = [prose(rng, 45) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(1, 60)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(shared).replace("\n", "\n\n"))
        if i % 4 == 0:
            parts.append(rng.choice(shared))
        rows.append((i, "\n".join(parts)))
    return [*rows, (40, rows[3][1]), (41, "\n".join(["same"] * 10)), (42, "a\nb"), (43, "a\nb\n\n  c "), (44, "x\n a\t\nb\nc\ny")]


def test_matches_a_plain_scan_and_the_sql(make_docs, rows):
    got = {r["doc_id"]: r for r in dedup_lines(make_docs(rows).select("doc_id", "text"), counts=True).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute(rows)
    assert got[40]["text"] == "" and got[41]["text"] == "same" and got[44]["text"] == "x\ny"
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  (read by DuckDB)
    want = duckdb.sql(OP1_SQL).fetchall()
    assert sorted((i, t, n, k) for i, t, n, k in want) == sorted((i, r["text"], r["n_lines"], r["n_removed"]) for i, r in got.items())


def test_odd_rows_and_other_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows, CLASHING)
    out = line_dedup_stage(docs.sparkSession, docs, "")
    assert out.schema.names == docs.schema.names
    got = out.collect()
    assert len(got) == len(odd_rows)
    text = {}
    for r in got:
        text.setdefault(r["doc_id"], []).append(r["text"])
        assert (r["n_chars"] is None) == (r["text"] is None) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        assert all(r[c] == c for c in CLASHING)
    assert None in text[None] and "" in text[None] or text[None].count(None) == 1
    assert text[1] == [None] and text[2] == [""] and text[3] == [" \n\t "] and text[10] == ["line"]
    # The copy with a null id sorts first and stays; the equal rows of id 5 fare alike.
    assert text[5] == ["", ""] and text[6] == [""] and odd_rows[4][1] in text[None]


def test_empty_table(make_docs):
    assert dedup_lines(make_docs([])).collect() == []
