"""SimHash: fingerprints, the Gray-order index and components against plain restatements."""
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from helpers import CLASHING, prose
from strata.llm import simhash


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable, by a plain search over all pairs; prints: {id: fingerprint}."""
    left, out = set(prints), {}
    for i in sorted(prints):
        if i in out:
            continue
        todo, left = [i], left - {i}
        while todo:
            x = todo.pop()
            out[x] = i
            near = {j for j in left if (prints[x] ^ prints[j]).bit_count() <= 4}
            left -= near
            todo += near
    return out


def clustered(rng, groups, each, flips):
    """Fingerprints in balls: ``each`` around every one of ``groups`` centres."""
    out = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_fingerprint_of_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "One", "one TWO three", "a b c d", "É é A\x0bb\x0cc\rd é", *(prose(rng, n) for n in (4, 5, 60, 700))]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, 300), "x" * 500 + " a b " + "y" * 300, "a " * 100]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 16)
    assert [simhash.fingerprint(t) for t in texts] == whole


def test_gray_ranks_are_positions_and_go_back():
    prints = np.array([random.Random(i).getrandbits(64) for i in range(500)], np.uint64)
    for order in range(len(simhash.ORDERS)):
        rank = simhash.gray_rank(prints, order)
        assert (simhash.from_rank(rank, order) == prints).all()
    small = np.arange(64, dtype=np.uint64)
    step = simhash.from_rank(small, 0)
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(step, step[1:]))  # neighbours in Gray order
    assert sum(simhash.BANDS) == 64 and len(simhash.BANDS) == simhash.RADIUS + 2


@pytest.mark.parametrize("seed,n,flips", [(1, 300, 4), (2, 2500, 3), (3, 17, 6)])
def test_walk_of_the_index_finds_every_pair(seed, n, flips):
    rng = random.Random(seed)
    one, two = (np.array(clustered(rng, 4, n // 4, flips), np.uint64) for _ in range(2))
    two = np.unique(np.r_[two, one[::3] ^ np.uint64(5)])
    for a, b in ((one, one), (one, two)):
        left = simhash.Index(a, np.array([0]))
        right = left if a is b else simhash.Index(b, np.array([0]))
        got = set()
        for x, y in simhash.linked(left, right, np.array([0]), np.array([0])):
            pairs = list(zip(x.tolist(), y.tolist()))
            assert not got & set(pairs)
            got |= set(pairs)
        near = np.bitwise_count(a[:, None] ^ b[None, :]) <= simhash.RADIUS
        want = {(i, j) for i, j in zip(*(v.tolist() for v in np.nonzero(near))) if a is not b or i < j}
        assert got == want


@pytest.mark.parametrize("block,rows,partitions", [(2048, 1 << 16, 3), (8, 64, 5), (2, 3, 1)])
def test_links_connect_the_components(spark, monkeypatch, block, rows, partitions):
    """Runs over many blocks, batches and partitions: same components as all pairs."""
    rng = random.Random(9)
    prints = clustered(rng, 6, 60, 3) + [0, 1, 3, (1 << 64) - 1]
    prints = sorted(set(prints))
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "RUN_ROWS", rows)
    data = []
    for order in range(len(simhash.ORDERS)):
        data += [(order, r) for r in sorted(simhash._signed(simhash.gray_rank(np.array(prints, np.uint64), order)).tolist())]
    cut = sorted(rng.sample(range(len(data)), partitions - 1))
    edges, blocks = [], []
    for part in (data[a:z] for a, z in zip([0, *cut], [*cut, len(data)])):
        batches = [pa.RecordBatch.from_pydict({"order": pa.array([o for o, _ in part[i:i + 50]], pa.int32()), "rank": pa.array([r for _, r in part[i:i + 50]], pa.int64())})
                   for i in range(0, len(part), 50)]
        for out in simhash.block_links(iter(batches)):
            for r in out.to_pylist():
                (edges if r["ranks"] is None else blocks).append(r)
    pairs = [(x, y) for x in blocks for y in blocks if (x["order"], x["lead"]) == (y["order"], y["lead"]) and x["first"] < y["first"]]
    for x, y in pairs:
        batch = pa.RecordBatch.from_pydict({"order": [x["order"]], "ranks": [x["ranks"]], "others": [y["ranks"]]})
        edges += [r for out in simhash.pair_links(iter([batch])) for r in out.to_pylist()]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for e in edges:
        a, b = (find(e[c] % (1 << 64)) for c in "ab")
        assert (e["a"] % (1 << 64) ^ e["b"] % (1 << 64)) in range(1 << 64)
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == brute_components({p: p for p in prints})


def test_documents_against_all_pairs(make_docs, odd_rows):
    rng = random.Random(6)
    rows = list(odd_rows)
    for i in range(20):
        words = prose(rng, 200).split(" ")
        rows.append((100 + 3 * i, " ".join(words)))
        rows.append((101 + 3 * i, " ".join(words[:-1] + ["x"])))
        rows.append((102 + 3 * i, " ".join(words[:100] + ["x", "y"] + words[100:])))
    got = simhash.near_duplicates(make_docs(rows, CLASHING)).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(i, set()).add(brute_print(t))
    by_print = {}
    for i, fs in prints.items():
        for f in fs:
            by_print.setdefault(f, []).append(i)
    groups = brute_components({f: f for f in by_print})
    least = {}
    for f, root in groups.items():
        least[root] = min([*filter(None, by_print[f]), *filter(None, [least.get(root)])], default=None)
    want = sorted(((i, f"{brute_print(t):016x}", least[groups[brute_print(t)]]) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert len({r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
