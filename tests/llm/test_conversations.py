"""Conversation repair against a plain search over all edits, row by row on the driver."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from helpers import CLASHING
from strata.llm import conversations as conv

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
RIGHT = re.compile("(s?(ua)+)?")
BLANK = "[^\\x20\\x09-\\x0D]"


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(BLANK, text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_repairs(rows):
    """Least (cost, audit, texts) by trying every edit of every row with up to two inserts anywhere."""
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    best, found = None, faults_of(rows)
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in found]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*options):
            cost, audit, kept = 0, "", []
            for i, (role, text) in enumerate(rows):
                for x in gaps[i]:
                    cost, audit, kept = cost + 2, audit + "I", [*kept, (conv.ROLE[x], "")]
                e = edits[i]
                cost += (3 if e == "D" else 0 if e == "K" else 2) + (e != "D" and found[i] == "truncated")
                audit += e if e in "DK" else "R"
                if e != "D":
                    kept.append((role if e == "K" else conv.ROLE[e], text))
            for x in gaps[-1]:
                cost, audit, kept = cost + 2, audit + "I", [*kept, (conv.ROLE[x], "")]
            if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


def searched(rows):
    """The same by whole audits per state of the plain pattern; for longer conversations."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}
    found, states = faults_of(rows), {"": (0, "", [])}

    def spread(states):
        for _ in range(3):
            for s, (cost, audit, kept) in list(states.items()):
                for x in "ua":
                    if (s, x) in after:
                        new = (cost + 2, audit + "I", [*kept, (conv.ROLE[x], "")])
                        states[after[s, x]] = min(states.get(after[s, x], new), new, key=lambda v: v[:2])
        return states

    for (role, text), fault in zip(rows, found):
        new = {}
        for s, (cost, audit, kept) in spread(dict(states)).items():
            moves = [(s, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                moves += [(after.get((s, role[:1])), cut, "K", [(role, text)])]
                moves += [(after.get((s, x)), 2 + cut, "R", [(conv.ROLE[x], text)]) for x in "ua"]
            for to, more, edit, keep in moves:
                if to is not None:
                    move = (cost + more, audit + edit, kept + keep)
                    new[to] = min(new.get(to, move), move, key=lambda v: v[:2])
        states = new
    return min((v for s, v in spread(states).items() if s in ("", "p")), key=lambda v: v[:2])


def brute_report(rows):
    kept = brute_damage(rows)
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [(r[2], r[3]) for r in own]
        found, initials = faults_of(pairs), [r[:1] for r, _ in pairs]
        cost, audit, texts = searched(pairs)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts).encode()).hexdigest())
    return out


def talk(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "s", "", "assistant"]
    texts = ["Yes.", "No!", "Why?", "and", "x.  ", "", " \t", "é?\n", "one. two"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.randint(0, 99)}" + rng.choice([".", "", "!"])) for _ in range(n)]


def fault_code(name):
    return ["", "blank", "duplicate", "truncated"].index(name)


@pytest.mark.parametrize("seed", range(4))
def test_repair_is_the_cheapest_of_all(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = talk(rng, rng.choice([0, 1, 2, 2]))
        assert searched(rows)[:2] == all_repairs(rows)[:2]
        assert searched(rows)[2] == all_repairs(rows)[2]
    for _ in range(300):
        rows = talk(rng, rng.randint(0, 14))
        plain = [(r, fault_code(f), 1) for (r, _), f in zip(rows, faults_of(rows))]
        ends = conv.advance(plain, conv.START)
        top = min(ends, key=lambda y: (ends[y][0] + 2 * len(conv.CLOSING[y]), ends[y][1]))
        edits = conv.edits_between(plain, conv.START, top)
        audit = "".join(e or "D" for e, _ in edits) + "I" * len(conv.CLOSING[top])
        assert (ends[top][0] + 2 * len(conv.CLOSING[top]), audit) == searched(rows)[:2]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in range(120):
        for i, (role, text) in enumerate(talk(rng, rng.randint(1, 12))):
            out.append((c, None if rng.random() < 0.05 else i + rng.choice([0, 0, 1]), role if rng.random() < 0.95 else None, text if rng.random() < 0.95 else None))
    out += [(500, i, *x) for i, x in enumerate(talk(rng, 300))]            # long
    out += [(501, 7, "user", "Same.")] * 40 + [(501, 8, "assistant", "Yes.")] * 3
    out += [(502, None, "user", "a."), (502, None, "assistant", "b."), (502, None, "user", "long " * 20_000 + ".")]
    out += [(None, 0, "user", "Q?"), (None, 1, "user", "R?"), (None, None, None, None)]
    dropped = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*out, (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("segment_rows,partitions", [(512, 8), (3, 5), (1, 2)])
def test_report(spark, rows, monkeypatch, segment_rows, partitions):
    """Whole conversations in one segment, and in many over several tasks."""
    monkeypatch.setattr(conv, "SEGMENT_ROWS", segment_rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        schema = T.StructType(SCHEMA.fields + [T.StructField(c, T.StringType()) for c in CLASHING])
        table = spark.createDataFrame([(*r, *CLASHING) for r in rows], schema)
        got = conv.repair_report(conv.damaged(table), table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got} == brute_report(rows)
    assert len(got) == len({r[0] for r in rows})


def test_repaired_turns_are_the_digested_ones(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    parts = conv.segments(conv.judged(table))
    edits = conv.repaired(parts, conv.plans(parts)).orderBy("conv_id", "segment", "position").collect()
    for c in {r[0] for r in rows}:
        kept = [r["role"][:1] for r in edits if r["conv_id"] == c and r["edit"] != "D"]
        assert RIGHT.fullmatch("".join(kept))
    assert sum(r["times"] for r in edits if r["edit"] != "I") == len(rows)


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conv.repair_report(conv.damaged(table), table).collect() == []
