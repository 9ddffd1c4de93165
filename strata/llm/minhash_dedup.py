"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct ``shingle``-word shingles (64-bit hashes of lower-cased
words; a text with fewer words is one shingle). Documents with equal sets form a node before
anything is paired, so exact copies cost one row per task and never meet each other.

1. Each node gets 128 MinHash values, cut into 32 bands of 4. Two sets at the threshold 0.8
   share no band with probability 5e-8.
2. Round one pairs every node of a bucket with the bucket's leader, the node that shares its
   buckets with most others (the text that the others are edits of): linear in the bucket.
   Candidates are compared 16 values at a time and dropped as soon as the posterior
   probability (uniform prior) that their similarity reaches the threshold falls below
   ``MISS``; what survives is verified exactly on the full sets.
3. Round two takes the buckets whose nodes round one left in different components and tests
   the remaining pairs across components in blocks of bounded size: the same sequential
   test, then the full sets. A pair is tested in the first bucket that it shares, and a task
   returns only links that join components it still sees apart, at most one per node. After
   it every candidate pair is either tested or inside one component, so no link between
   different texts is lost.
4. Components by star contraction; a component's id is its smallest doc_id.

Texts move only for one document of each node that shares a bucket: a bit filter of fixed size (``FILTER_WORDS``
64-bit words, whatever the input) marks their ids, an exact join follows.

Defined cases: null or empty texts have no set, size 0 and stay by themselves; so do rows
with a null id (component null, kept); rows that share an id but not a text are apart, each in
its own component, whose ids may repeat; repeated rows get equal results; an empty table gives
no row. Only ``doc_id`` and ``text`` are read, so extra columns cannot clash.
"""
from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import common, graph
from strata.llm.kernels import Words, mix, sequence_hashes, slices

THRESHOLD = (80, 100)
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
MISS = 1e-7
BLOCK = 512
FILTER_WORDS = 1 << 20
SHINGLE, PIPELINE_SHINGLE = 4, 5

_RNG = np.random.Generator(np.random.PCG64(20240610))
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def _sets(texts: pa.Array, shingle: int):
    """Per text of a column: row and its sorted distinct shingle hashes."""
    for first, stop, raw, offsets in slices(texts):
        words = Words(raw, offsets)
        hashes = words.hashes()
        runs = sequence_hashes(hashes, shingle)
        for i in range(stop - first):
            a, z = words.bounds[i], words.bounds[i + 1]
            if z - a >= shingle:
                yield first + i, np.unique(runs[a:z - shingle + 1])
            elif z > a:
                yield first + i, sequence_hashes(hashes[a:z], z - a) ^ np.uint64(z - a)
            else:
                yield first + i, np.zeros(0, np.uint64)


def _node(shingles: np.ndarray) -> int:
    """64-bit digest of a set."""
    sums = np.array([mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), mix(shingles).sum(dtype=np.uint64)])
    return int(mix(mix(sums[:1] + np.uint64(len(shingles))) + sums[1:])[0].view(np.int64))


def _signatures(shingles: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per (non-empty) set."""
    out = np.empty((len(shingles), HASHES), np.uint32)
    flat = np.concatenate(shingles)
    starts = np.cumsum([0] + [len(s) for s in shingles[:-1]])
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), starts)
    return out


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, node, n_shingles, signature) per row; node and signature are null for empty sets."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def emit(ids, rows, sets):
        full = [s for s in sets if len(s)]
        signatures = iter(_signatures(full) if full else ())
        values = [(_node(s), next(signatures).tobytes()) if len(s) else (None, None) for s in sets]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array([v[0] for v in values], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([v[1] for v in values], pa.binary())],
            ["doc_id", "node", "n_shingles", "signature"])

    def run(batches):
        for batch in batches:
            rows, sets, size = [], [], 0
            for i, s in _sets(batch.column("text"), shingle):
                rows.append(i)
                sets.append(s)
                size += len(s)
                if size > 300_000:
                    yield emit(batch.column("doc_id"), rows, sets)
                    rows, sets, size = [], [], 0
            if rows:
                yield emit(batch.column("doc_id"), rows, sets)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, node long, n_shingles long, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of an Arrow binary column as rows of a matrix."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint32).reshape(len(column), HASHES)


def least_matches(n: int, miss: float = MISS) -> int:
    """Fewest matches among ``n`` values that keep P(similarity >= threshold) at ``miss`` or more.

    With a uniform prior the posterior after k matches is Beta(k + 1, n - k + 1), whose mass
    above t is the chance of at most k successes in n + 1 trials of probability t.
    """
    t, mass = THRESHOLD[0] / THRESHOLD[1], 0.0
    for k in range(n + 1):
        mass += comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k)
        if mass >= miss:
            return k
    return n


_LEAST = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def _sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the signature pairs (rows of a and b) that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in _LEAST:
        if not len(alive):
            break
        matches[alive] += (a[alive, n - STEP:n] == b[alive, n - STEP:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * THRESHOLD[1] >= F.greatest(a, b) * THRESHOLD[0]


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket of every band of every signature."""
    halves = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), BANDS, ROWS // 2)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(np.uint64)), halves.shape[:2])
    for k in range(ROWS // 2):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + halves[:, :, k])
    return key.view(np.int64)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, m) of every band whose bucket holds m > 1 nodes."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_matrix(batch.column("signature")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["bucket", "node"])

    bands = nodes.select("node", "signature").mapInArrow(run, "bucket long, node long")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    return bands.join(sizes, "bucket")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): every node of a bucket with the leader of the bucket."""
    weights = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    leaders = shared.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("leader"))
    return shared.join(leaders, "bucket").where(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def _tested(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the size bound and the sequential test."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").where(_sizes_fit("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alive = pa.array(_sequential(_matrix(batch.column("s_a")), _matrix(batch.column("s_b"))))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(alive), batch.column("b").take(alive)], ["a", "b"])

    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _marked(wanted: DataFrame) -> np.ndarray:
    """Bit filter of the ids: ``FILTER_WORDS`` words at most, whatever the number of ids."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))
    words = (wanted.select(F.floor(bit / 64).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    out = np.zeros(FILTER_WORDS, np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def node_sets(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, by the text of one document (wanted: node, doc_id)."""
    wanted = common.staged(wanted, "wanted")
    marked = docs.sparkSession.sparkContext.broadcast(_marked(wanted))

    def pick(batches):
        for batch in batches:
            bits = marked.value
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1)).select(["doc_id", "text"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64)).alias("slot")
    found = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", slot).mapInArrow(pick, f"doc_id {id_type}, text string")

    def sets(batches):
        for batch in batches:
            nodes_, sets_ = [], []
            for _, s in _sets(batch.column("text"), shingle):
                if len(s):
                    nodes_.append(_node(s))
                    sets_.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array(sets_, pa.binary())], ["node", "shingles"])

    texts = found.join(wanted.select("doc_id"), "doc_id", "left_semi").select("text")
    return texts.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))

    def confirm(batches):
        for batch in batches:
            keep = [i for i in range(batch.num_rows) if _linked(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("s_a", "s_b")))]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(confirm, "a long, b long")


def links_across(shared: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): roots of components that some pair of a bucket still to be tested links."""
    placed = shared.join(roots, "node", "left").select("bucket", "node", "m", F.coalesce("root", "node").alias("root"))
    mixed = (placed.where(F.col("m") > 2).groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where(F.col("lo") != F.col("hi")).select("bucket"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = placed.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block pair (i, j), i <= j: a member of block k joins (min(k, x), max(k, x)) for every block x.
    dealt = (members.withColumn("x", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("bucket", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "node", "root")
             .join(nodes.select("node", "n_shingles", "signature").join(sets, "node"), "node"))

    def test(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, root, size = (table.column(c).to_numpy() for c in ("block", "root", "n_shingles"))
        bucket, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        shingles = table.column("shingles").chunk(0)
        signatures = _matrix(table.column("signature").chunk(0))
        keys = _band_keys(signatures)
        here = keys == bucket
        group = root.copy()  # components as this task sees them, after the links it found
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(group[y] != group[x]) & (np.minimum(size[y], size[x]) * THRESHOLD[1] >= np.maximum(size[y], size[x]) * THRESHOLD[0])]
            if len(y):
                same = keys[y] == keys[x]
                y = y[here[x][same.argmax(axis=1)]]  # the first band that the pair shares is this bucket's
            if len(y):
                y = y[_sequential(np.broadcast_to(signatures[x], (len(y), HASHES)), signatures[y])]
            mine = np.frombuffer(shingles[x].as_buffer(), np.uint64)
            for z in y:
                if group[z] != group[x] and _linked(mine, np.frombuffer(shingles[z].as_buffer(), np.uint64)):
                    out_a.append(root[x])
                    out_b.append(root[z])
                    group[group == group[z]] = group[x]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(test, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = common.staged(document_sets(docs, shingle), "sets")
    nodes = common.staged(rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node")
                          .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    shared = common.staged(shared_buckets(nodes), "buckets")
    sets = common.staged(node_sets(shared.select("node").distinct().join(nodes.select("node", "doc_id"), "node"), docs, shingle), "shingles")
    roots = graph.components(_verified(_tested(star_pairs(shared), nodes), sets))
    more = common.staged(links_across(shared, nodes, sets, roots), "links")
    if not more.isEmpty():
        joined = graph.components(more).select(F.col("node").alias("root"), F.col("root").alias("to"))
        # Nodes without a link in round one are their own roots.
        alone = joined.join(roots.select("node"), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
        roots = roots.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(alone)
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    ids = rooted.join(least, "root").select("node", "least")
    component = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return (rows.select("doc_id", "node", "n_shingles").join(ids, "node", "left").withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles): the smallest id.

    Rows with a null id all stay; of equal rows one stays.
    """
    kept = near_duplicates(docs, PIPELINE_SHINGLE).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
