"""Conversation structure repair: generalised LR repair over the role grammar.

A conversation is right if its role initials form ``(s?(ua)+)?``. The cheapest edits make it so:
keep a turn (0), rerole it to user or assistant (2), delete it (3; blank and repeated turns must
go), insert an empty user or assistant turn anywhere (2); a truncated turn that stays costs 1
more. Of equally cheap edits the audit, their initials in order, that is least in ASCII wins.

1. Rows are counted per (conversation, turn, role, text), combined map-side; a text's first turn
   per (conversation, role) comes from a combined minimum. Rows are then range-partitioned and
   sorted by conversation, turn (nulls first), role and text, and cut into segments of at most
   ``SEGMENT_ROWS`` rows or ``SEGMENT_BYTES`` of text. A conversation that holds a third of all
   rows is many segments in many tasks.
2. The LR(0) automaton of the grammar is built from its productions. Stacks share their tails:
   a stack is a node (state, node below), interned, so equal stack tops are one node and merge
   by the least (cost, audit). After every row each audit ends with that row's edit (inserts are
   put before the next row that stays), so no audit is a prefix of another and the order of
   two audits never changes when both grow: a rank per stack top stands for the whole audit.
3. A segment's answer is a table of moves: stack at entry, stack at exit, cost and rank. One row
   of a few dozen numbers per segment is folded along each conversation, which fixes the stacks
   that the best repair passes; every segment is then repaired by itself between them.
4. ``digests`` streams repaired turns, sorted inside their conversation, through one SHA-256 per
   conversation, which can only be computed in order; nothing but its state is held.

Defined cases: a null role or text is one space; a null conversation id is a conversation; turns that are
null come first. Rows with equal turns are ordered by role, then text, so copies are adjacent. A role's
initial is its first character, whatever follows. Equal rows are repeats of the first. Conversations of any
length and texts of any length are repaired whole; an empty table gives no row. Extra columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common

BLANKS = " \t\n\x0b\x0c\r"
SEGMENT_ROWS, SEGMENT_BYTES = 512, 1 << 16
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SOUND, BLANK, DUPLICATE, CUT = range(4)

# ---------------------------------------------------------------- grammar

#: (head, body): a system turn at most, then pairs of user and assistant turns.
GRAMMAR = [("chat", ()), ("chat", ("pairs",)), ("chat", ("s", "pairs")), ("pairs", ("pairs", "pair")), ("pairs", ("pair",)), ("pair", ("u", "a"))]
TERMINALS = "sua"
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


class Stacks:
    """The graph-structured stacks of the LR(0) automaton of a grammar, explored by need.

    ``nodes[i]`` is (state, node below); the first one is the empty stack. Only nodes that can
    shift are kept as tops; reductions are followed at once and may fork.
    """

    def __init__(self, grammar):
        self.grammar, start = grammar, grammar[0][0]
        self.states, self.state_ids = [], {}
        self.nodes, self.node_ids = [], {}
        self._goals = {(start, body, len(body)) for head, body in grammar if head == start}
        self.empty = self._node(self._state({(start, body, 0) for head, body in grammar if head == start}), None)

    def _state(self, kernel) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            _, body, dot = todo.pop()
            for head, more in self.grammar:
                if dot < len(body) and head == body[dot] and (head, more, 0) not in items:
                    items.add((head, more, 0))
                    todo.append((head, more, 0))
        key = frozenset(items)
        if key not in self.state_ids:
            self.state_ids[key] = len(self.states)
            self.states.append(key)
        return self.state_ids[key]

    def _node(self, state: int, below: int | None) -> int:
        key = (state, below)
        if key not in self.node_ids:
            self.node_ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self.node_ids[key]

    def _pushed(self, node: int, symbol: str) -> int | None:
        kernel = {(h, b, d + 1) for h, b, d in self.states[self.nodes[node][0]] if d < len(b) and b[d] == symbol}
        return self._node(self._state(kernel), node) if kernel else None

    def _reduced(self, node: int) -> tuple[set[int], bool]:
        """All tops that reductions reach from ``node`` (itself included), and whether one accepts."""
        found, todo, accepts = {node}, [node], False
        while todo:
            top = todo.pop()
            for head, body, dot in self.states[self.nodes[top][0]]:
                if dot < len(body):
                    continue
                base = top
                for _ in body:
                    base = self.nodes[base][1]
                if base == self.empty and (head, body, dot) in self._goals:
                    accepts = True
                    continue
                after = self._pushed(base, head)
                if after is not None and after not in found:
                    found.add(after)
                    todo.append(after)
        return found, accepts

    def accepts(self, node: int) -> bool:
        return self._reduced(node)[1]

    def shifted(self, node: int, terminal: str) -> set[int]:
        """Tops after a turn of role ``terminal``, reductions done."""
        after = self._pushed(node, terminal)
        if after is None:
            return set()
        return {x for x in self._reduced(after)[0] if any(d < len(b) and b[d] in TERMINALS for _, b, d in self.states[self.nodes[x][0]])}


def _explored(stacks: Stacks) -> list[int]:
    """All tops; the grammar is left-recursive, so there are few (and none for an unbounded one)."""
    found, todo = [stacks.empty], [stacks.empty]
    while todo:
        top = todo.pop()
        for t in TERMINALS:
            for x in sorted(stacks.shifted(top, t)):
                if x not in found:
                    found.append(x)
                    todo.append(x)
        if len(found) > 64:
            raise ValueError("the role grammar's stacks are not bounded")
    return found


def _inserts(stacks: Stacks, tops: list[int]) -> dict[int, dict[int, str]]:
    """Per top: the tops that inserted turns alone reach, with the fewest such turns."""
    out = {}
    for top in tops:
        reach, ring = {top: ""}, [top]
        while ring:
            after = []
            for x in ring:
                for t in ROLE:
                    for y in sorted(stacks.shifted(x, t)):
                        if y not in reach:
                            reach[y] = reach[x] + t
                            after.append(y)
            ring = after
        out[top] = reach
    return out


def _moves(stacks: Stacks, tops: list[int]) -> dict[tuple[bool, str], dict[int, list[tuple]]]:
    """For a turn (truncated?, initial or ""), per top: (next top, cost, edits, roles), the least of each next top."""
    inserts, out = _inserts(stacks, tops), {}
    for cut in (False, True):
        for initial in [*TERMINALS, ""]:
            table = out[cut, initial] = {}
            for top in tops:
                best = {top: (DELETE, "D", "")}
                for x, added in inserts[top].items():
                    for t in TERMINALS:
                        if t != initial and t not in ROLE:
                            continue
                        cost = len(added) * INSERT + (0 if t == initial else REROLE) + cut * TRUNCATED
                        move = (cost, "I" * len(added) + ("K" if t == initial else "R"), added + t)
                        for y in stacks.shifted(x, t):
                            best[y] = min(best.get(y, move), move)
                table[top] = [(y, *move) for y, move in sorted(best.items())]
    return out


_STACKS = Stacks(GRAMMAR)
TOPS = _explored(_STACKS)
MOVES = _moves(_STACKS, TOPS)
#: Per top, the roles of the fewest inserted turns that end the conversation there.
CLOSING = {top: min((r for x, r in reach.items() if _STACKS.accepts(x)), key=lambda r: (len(r), r)) for top, reach in _inserts(_STACKS, TOPS).items()}
START = _STACKS.empty


# ---------------------------------------------------------------- repair of a segment

def _key(fault: int, role: str) -> tuple[bool, str]:
    return fault == CUT, role[:1] if role[:1] in TERMINALS else ""


def advance(rows, entry: int, trace: list | None = None) -> dict[int, tuple[int, int]]:
    """Stack tops after the rows (role, fault, copies), from ``entry``: {top: (cost, rank of its audit)}.

    ``trace`` gets per row {top: (top before, edits, roles)}, None for rows that can only go.
    """
    fixed, tops = 0, {entry: (0, 0)}
    for role, fault, copies in rows:
        free = fault in (SOUND, CUT)
        fixed += DELETE * (copies - free)
        step = None
        if free:
            table, best = MOVES[_key(fault, role)], {}
            for x, (cost, rank) in tops.items():
                for y, more, edits, roles in table[x]:
                    move = (cost + more, rank, edits, x, roles)
                    if y not in best or move < best[y]:
                        best[y] = move
            order = sorted(best, key=lambda y: best[y][1:3])
            tops = {y: (best[y][0], i) for i, y in enumerate(order)}
            step = {y: (m[3], m[2], m[4]) for y, m in best.items()}
        if trace is not None:
            trace.append(step)
    return {y: (cost + fixed, rank) for y, (cost, rank) in tops.items()}


def edits_between(rows, entry: int, exit_: int) -> list[tuple[str, str]]:
    """(edits, roles) of every row of a segment on the best way from ``entry`` to ``exit_``."""
    trace: list = []
    advance(rows, entry, trace)
    out, top = [], exit_
    for step in reversed(trace):
        if step is None:
            out.append(("", ""))
        else:
            top, edits, roles = step[top]
            out.append((edits, roles))
    return out[::-1]


# ---------------------------------------------------------------- Spark

def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: dropped, emptied, cut short, repeated or reroled."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(h == 4, "user").otherwise(text_of("role"))
    return rows.where(h != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): different rows with the first fault of the first copy.

    The other copies are duplicates, or blank with it. ``rows`` may carry a number of ``copies``.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text_of = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    one = common.staged(rows.select("conv_id", "turn", text_of("role"), text_of("text"), copies.alias("copies"))
                        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    digest = F.md5(F.col("text").cast("binary"))
    first = (one.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(place).alias("first"), F.count("*").alias("times"))
             .where(F.col("times") > 1).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("digest"))
    later = F.coalesce(place != F.col("first"), F.lit(False))
    solid = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(solid == "", BLANK).when(later, DUPLICATE)
             .when(F.right(solid, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT))
    return one.join(first, on, "left").select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


_LISTS = {"roles": pa.string(), "texts": pa.string(), "faults": pa.int32(), "copies": pa.int64()}


def segments(turns: DataFrame) -> DataFrame:
    """Segments of the conversations in order: their rows as arrays, their moves, and what their ends show.

    ``segment`` numbers rise along a conversation. The first stack of a conversation is known only
    where its first row stands after another conversation's in the same task; other segments
    give their moves for every stack they may meet.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {id_type}, segment long, roles array<string>, texts array<string>, faults array<int>, copies array<long>, "
              "moves array<long>, illegal long, opens string, closes string")

    def cut(batches):
        number = TaskContext.get().partitionId() << 40
        conversation, rows, size, entries = None, [], 0, TOPS
        out: list[tuple] = []

        def close():
            nonlocal rows, size, entries, number
            if not rows:
                return
            plain = [(r[0], r[2], r[3]) for r in rows]
            found = {x: advance(plain, x) for x in entries}
            initials = [r[0][:1] for r in rows]
            illegal = sum(r[3] - 1 for r in rows) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            moves = [v for x, to in found.items() for y, (cost, rank) in to.items() for v in (x, y, cost, rank)]
            out.append((conversation[0], number, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], moves, illegal, initials[0], initials[-1]))
            entries = sorted({y for to in found.values() for y in to})
            number += 1
            rows, size = [], 0

        def emitted(id_arrow):
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], id_arrow), pa.array(columns[1], pa.int64())]
            arrays += [pa.array(c, pa.list_(t)) for c, t in zip(columns[2:6], _LISTS.values())]
            arrays += [pa.array(columns[6], pa.list_(pa.int64())), pa.array(columns[7], pa.int64()), pa.array(columns[8], pa.string()), pa.array(columns[9], pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "segment", *_LISTS, "moves", "illegal", "opens", "closes"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("conv_id").type
            for conv_id, role, text, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault", "copies"))):
                if conversation is None or conversation[0] != conv_id:
                    close()
                    if conversation is not None:
                        entries = [START]
                    conversation = (conv_id,)
                rows.append((role, text, fault, copies))
                size += len(text)
                if len(rows) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                    close()
            if out:
                yield emitted(id_arrow)
        close()
        if out:
            yield emitted(id_arrow)

    common.bound_batches(turns.sparkSession)
    ranged = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranged.select("conv_id", "role", "text", "fault", "copies").mapInArrow(cut, schema)


def plans(parts: DataFrame) -> DataFrame:
    """(conv_id, segment, entry, exit, closing, cost, illegal) per segment of ``parts``.

    ``closing`` (roles of inserted turns), the conversation's cost and its illegal steps stand at its
    last segment. A conversation's segments give one small row each to the task that folds them.
    """
    id_type = parts.schema["conv_id"].dataType.simpleString()

    def folded(conv_id, chain):
        tops, back, illegal, last = {START: (0, 0)}, [], 0, None
        for number, moves, inner, opens, closes in chain:
            illegal += inner + (last is not None and last + opens not in LEGAL)
            last, best = closes, {}
            for x, y, cost, rank in moves.reshape(-1, 4).tolist():
                if x in tops:
                    move = (tops[x][0] + cost, tops[x][1], rank, x)
                    if y not in best or move < best[y]:
                        best[y] = move
            order = sorted(best, key=lambda y: best[y][1:3])
            tops = {y: (best[y][0], i) for i, y in enumerate(order)}
            back.append((number, {y: m[3] for y, m in best.items()}))
        top = min(tops, key=lambda y: (tops[y][0] + INSERT * len(CLOSING[y]), tops[y][1]))
        closing, cost = CLOSING[top], tops[top][0] + INSERT * len(CLOSING[top])
        for number, before in reversed(back):
            yield conv_id, number, before[top], top, closing, cost, illegal
            top, closing, cost, illegal = before[top], None, None, None

    def fold(batches):
        conversation, chain = None, []

        def emitted(id_arrow):
            columns = list(zip(*folded(conversation[0], chain)))
            types = [id_arrow, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "segment", "entry", "exit", "closing", "cost", "illegal"])

        id_arrow, ready = None, []
        for batch in batches:
            id_arrow = batch.schema.field("conv_id").type
            moves = batch.column("moves")
            for i, (conv_id, *rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "illegal", "opens", "closes")))):
                if conversation is None or conversation[0] != conv_id:
                    if chain:
                        ready.append(emitted(id_arrow))
                    conversation, chain = (conv_id,), []
                chain.append((rest[0], moves[i].values.to_numpy(), *rest[1:]))
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if chain:
            yield emitted(id_arrow)

    columns = ["conv_id", "segment", "moves", "illegal", "opens", "closes"]
    return (parts.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
            .mapInArrow(fold, f"conv_id {id_type}, segment long, entry int, exit int, closing string, cost long, illegal long"))


def repaired(parts: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, segment, position, edit, times, role, text): the edits of all segments in order.

    ``edit`` is K, R, I or D; role and text are those of the turn that stays (null for D, which
    may stand for ``times`` equal rows).
    """
    id_type = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "segment", "position", "edit", "times", "role", "text"]

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = [[] for _ in names]

            def add(*values):
                for column, value in zip(out, values):
                    column.append(value)

            for conv_id, segment, roles, texts, faults, copies, entry, exit_, closing in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", *_LISTS, "entry", "exit", "closing"))):
                position = 0
                for (edits, kept), role, text, fault, times in zip(edits_between(list(zip(roles, faults, copies)), entry, exit_), roles, texts, faults, copies):
                    for edit, t in zip(edits, kept):
                        add(conv_id, segment, position, edit, 1, role if edit == "K" else ROLE[t], "" if edit == "I" else text)
                        position += 1
                    gone = times - (edits[-1:] in ("K", "R"))
                    if gone:
                        add(conv_id, segment, position, "D", gone, None, None)
                        position += 1
                for t in closing or "":
                    add(conv_id, segment, position, "I", 1, ROLE[t], "")
                    position += 1
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    joined = parts.drop("conv_id", "moves", "illegal", "opens", "closes").join(planned.select("conv_id", "segment", "entry", "exit", "closing"), "segment")
    return joined.mapInArrow(apply, f"conv_id {id_type}, segment long, position long, edit string, times long, role string, text string")


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): edits' initials, and the digest of the repaired ``role:text`` lines."""
    id_type = edits.schema["conv_id"].dataType.simpleString()

    def stream(batches):
        conversation, audit, lines, digest = None, [], 0, None

        def done(into):
            for column, value in zip(into, (conversation[0], "".join(audit), digest.hexdigest())):
                column.append(value)

        def emitted(columns, id_arrow):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_arrow, pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])

        id_arrow = None
        for batch in batches:
            id_arrow, out = batch.schema.field("conv_id").type, [[], [], []]
            for conv_id, edit, times, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "times", "role", "text"))):
                if conversation is None or conversation[0] != conv_id:
                    if conversation is not None:
                        done(out)
                    conversation, audit, lines, digest = (conv_id,), [], 0, hashlib.sha256()
                audit.append(edit * times)
                if edit != "D":
                    digest.update(f"{chr(10) * bool(lines)}{role}:{text}".encode())
                    lines += 1
            if out[0]:
                yield emitted(out, id_arrow)
        if conversation is not None:
            out = [[], [], []]
            done(out)
            yield emitted(out, id_arrow)

    return (edits.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "position")
            .mapInArrow(stream, f"conv_id {id_type}, audit string, repaired_sha256 string"))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of judged turns."""
    rest = F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(F.col("fault") != BLANK, F.col("copies") - 1)
    per_turn = turns.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == BLANK, F.col("copies"))).alias("blank"), F.sum(rest).alias("duplicate"), F.sum((F.col("fault") == CUT).cast("long")).alias("truncated"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return per_turn.groupBy("conv_id").agg(gaps.alias("gaps"), none("blank"), none("duplicate"), none("truncated"))


def repair_report(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """One row per conversation of ``originals`` with the faults, cost, audit and digest of its ``rows``.

    The parts meet in one grouping, which keeps a null conversation id as a group of its own.
    """
    turns = common.staged(judged(rows), "judged")
    parts = common.staged(segments(turns), "segments")
    planned = common.staged(plans(parts), "plans")
    numbers, texts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]

    def shaped(df):
        return df.select("conv_id", *[(F.col(c) if c in df.columns else F.lit(None)).cast("long").alias(c) for c in numbers],
                         *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in texts])

    pieces = [originals.select("conv_id").distinct(), faults(turns), planned.where(F.col("cost").isNotNull()).select("conv_id", "illegal", "cost"), digests(repaired(parts, planned))]
    every = shaped(pieces[0])
    for p in pieces[1:]:
        every = every.unionByName(shaped(p))
    nothing = {**dict.fromkeys(numbers, F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), nothing[c]).alias(c) for c in [*numbers, *texts]])


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(rows), rows)
