"""Exact Ward agglomeration (M2) by contracting mutual nearest neighbours in rounds.

Ward's cost of a merge, (w_a w_b / (w_a + w_b)) · ||c_a − c_b||², is reducible: a merge never
brings the merged cluster nearer to a third one than its parts were. So all pairs that are each
other's nearest may be merged at once, and the tree is that of merging the cheapest pair again and again.

Most merges are near ones. While there are many clusters they are dealt to tiles, the leaves of a k-d tree
over a bounded sample, and each tile is contracted by itself: a pair may merge where its cost is below what
either could have with any cluster of another tile, which is bounded by the other tiles' boxes and least weights. A merged
cluster's centre stays in the box of its tile and weights only grow, so the bound holds whatever the other tiles
do meanwhile, and the sample decides how far a tile gets, never what merges. The clusters left are dealt to new,
wider tiles. Where tiles no longer help (many dimensions), rounds over all pairs follow.

One such round: the clusters whose nearest neighbour is not known (new ones, and those whose
neighbour was merged) look for it among all clusters, block against block, each pair of
blocks one group of an Arrow function that returns one candidate per cluster; a combined minimum
per cluster picks the neighbour; mutual pairs merge. A round merges a good part of the clusters, and
cached neighbours shrink its work with it. What fits one block is contracted inside it by the
same rounds. Their work is quadratic in the clusters that are left, memory per task two blocks.

Equal costs go to the smaller id; ids follow the order of the points. A merge is recorded
as (a, b, cost, size, round): b, the larger id, is absorbed by a. Costs never fall along the tree.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
MERGES = "a long, b long, cost double, size double, round int"
_STATE = ["id", "w", "c", "height", "nn", "nn_cost"]
TILE_ROWS, TILE_SAMPLE = 2048, 32_768      # clusters of a tile; clusters that place the tiles
TILE_GAIN = 0.2                            # share of the clusters that tiles must merge to go on
NEAR_TILES = 64                            # tiles whose boxes bound a cluster one by one; the others do together
_TILED = "a long, b long, cost double, size double, round int, c array<double>"


def nearest(t: np.ndarray, wt: np.ndarray, tid: np.ndarray, r: np.ndarray, wr: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest partner of every target among the references (sorted by id): cost and id.

    Differences are taken coordinate by coordinate, so that equal pairs cost the same both ways
    and points far from the origin lose no digits. No partner: cost inf, id −1.
    """
    cost, who = np.full(len(t), np.inf), np.full(len(t), -1, np.int64)
    if not len(r):
        return cost, who
    step = max(1, 1_000_000 // len(r))
    for a in range(0, len(t), step):
        z = slice(a, a + step)
        d = np.zeros((len(t[z]), len(r)))
        for k in range(t.shape[1]):
            x = t[z, k][:, None] - r[None, :, k]
            d += x * x
        d *= wt[z][:, None] * wr[None, :] / (wt[z][:, None] + wr[None, :])
        d[tid[z][:, None] == rid[None, :]] = np.inf
        best = d.argmin(axis=1)
        cost[z] = d[np.arange(len(best)), best]
        who[z] = np.where(np.isinf(cost[z]), -1, rid[best])
    return cost, who


def contract(ids: np.ndarray, w: np.ndarray, c: np.ndarray, height: np.ndarray, first_round: int = 0, limit=None) -> tuple[list[tuple], tuple]:
    """The merges of a block of clusters (sorted by id) down to one, by the same rounds in memory, and what is left of it.

    ``limit`` (centres, weights) → costs bounds what a cluster could cost with one outside the block: only
    pairs below it on both sides merge.
    """
    ids, w, c, height = ids.copy(), w.astype(float).copy(), c.astype(float).copy(), height.astype(float).copy()
    nn, cost = np.full(len(ids), -1, np.int64), np.full(len(ids), np.inf)
    most = np.zeros(len(ids)) if limit is None else limit(c, w)
    out, round_ = [], first_round
    stale = np.ones(len(ids), bool)
    while len(ids) > 1:
        anew = stale.all()
        cost[stale], nn[stale] = nearest(c[stale], w[stale], ids[stale], c, w, ids)
        at = np.searchsorted(ids, nn)
        mutual = (nn[at] == ids) & (ids < nn)
        if limit is not None:
            mutual &= (cost < most) & (cost < most[at])
        if not mutual.any():
            if anew and limit is not None:
                break
            stale = np.ones(len(ids), bool)  # ties among cached neighbours: look again from scratch
            continue
        i, j = np.flatnonzero(mutual), at[mutual]
        total = w[i] + w[j]
        high = np.maximum(cost[i], np.maximum(height[i], height[j]))
        out += zip(ids[i].tolist(), ids[j].tolist(), high.tolist(), total.tolist(), [round_] * len(i))
        c[i] = (c[i] * w[i][:, None] + c[j] * w[j][:, None]) / total[:, None]
        w[i], height[i] = total, high
        if limit is not None:
            most[i] = limit(c[i], w[i])
        merged = np.zeros(len(ids), bool)
        merged[i] = merged[j] = True
        stale = merged | merged[at]
        keep = np.ones(len(ids), bool)
        keep[j] = False
        ids, w, c, height, nn, cost, most, stale = (x[keep] for x in (ids, w, c, height, nn, cost, most, stale))
        round_ += 1
    return out, (ids, w, c, height)


def _points(table: pa.Table) -> np.ndarray:
    return np.stack(table.column("c").to_numpy()) if table.num_rows else np.zeros((0, 0))


def _block_nearest(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("id")
    target, ids, w, c = table.column("target").to_numpy(), table.column("id").to_numpy(), table.column("w").to_numpy(), _points(table)
    of, refs = np.flatnonzero(target), np.flatnonzero(~target)
    cost, who = nearest(c[of], w[of], ids[of], c[refs], w[refs], ids[refs])
    found = who >= 0
    return pa.table({"id": pa.array(ids[of][found]), "cost": pa.array(cost[found]), "nn": pa.array(who[found])})


def _neighbours(clusters: DataFrame, blocks: int) -> DataFrame:
    """(id, nn, nn_cost) of the clusters without a known neighbour."""
    dealt = clusters.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    targets = dealt.where(F.col("nn").isNull()).select(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("target"), "id", "w", "c")
    refs = dealt.select(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("target"), "id", "w", "c")
    found = targets.unionByName(refs).groupBy("i", "j").applyInArrow(_block_nearest, "id long, cost double, nn long")
    best = F.min(F.struct("cost", "nn"))
    return found.groupBy("id").agg(best.alias("best")).select("id", F.col("best.nn").alias("nn"), F.col("best.cost").alias("nn_cost"))


def _whole_block(round_: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        found, _ = contract(table.column("id").to_numpy(), table.column("w").to_numpy(), _points(table), table.column("height").to_numpy(), round_)
        columns = list(zip(*found)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "cost", "size", "round"])

    return run


def _splits(sample: np.ndarray, depth: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """A k-d tree in level order: of each inner node the dimension and the greatest value of its left side."""
    dims, at, parts = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf), {0: sample}
    for node in range(len(dims)):
        here = parts.pop(node)
        if len(here) > 1:
            dims[node] = np.ptp(here, axis=0).argmax()
            at[node] = np.quantile(here[:, dims[node]], share, method="lower")
        left = here[:, dims[node]] <= at[node]
        parts[2 * node + 1], parts[2 * node + 2] = here[left], here[~left]
    return dims, at


def _tile_of(dims: np.ndarray, at: np.ndarray, depth: int):
    @F.pandas_udf("int")
    def tile(centres: pd.Series) -> pd.Series:
        if not len(centres):
            return pd.Series([], dtype="int32")
        x, node = np.stack(centres.to_numpy()), np.zeros(len(centres), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > at[node])
        return pd.Series(node.astype("int32"))

    return tile


def _outside(tile: int, tiles: np.ndarray, low: np.ndarray, high: np.ndarray, light: np.ndarray):
    """(centres, weights) → the least that a cluster of ``tile`` could cost with one of any other tile."""
    me, others = np.flatnonzero(tiles == tile)[0], tiles != tile
    gap = np.maximum(np.maximum(low[others] - high[me], low[me] - high[others]), 0.0)
    far = (gap * gap).sum(axis=1)
    order = np.argsort(far, kind="stable")
    near, rest = np.flatnonzero(others)[order[:NEAR_TILES]], order[NEAR_TILES:]
    rest_far, rest_light = (far[rest].min(), light[others][rest].min()) if len(rest) else (np.inf, 1.0)

    def limit(c: np.ndarray, w: np.ndarray) -> np.ndarray:
        least = w * rest_light / (w + rest_light) * rest_far
        for t in near:
            off = np.maximum(np.maximum(low[t] - c, c - high[t]), 0.0)
            least = np.minimum(least, w * light[t] / (w + light[t]) * (off * off).sum(axis=1))
        return least * (1.0 - 1e-9)

    return limit


def _in_tiles(clusters: DataFrame, n: int, rows: int, phase: int, round_: int) -> DataFrame:
    """Merges inside tiles (b given), and the clusters that are left (b NULL: id, height, weight as a, cost, size)."""
    depth = max(1, int(np.ceil(np.log2(n / rows))))
    sample = clusters.where(F.pmod(F.xxhash64("id", F.lit(phase)), F.lit(max(1, n // TILE_SAMPLE))) == 0).select("c").orderBy("c").collect()
    if not sample:
        return clusters.limit(0).selectExpr("id a", "id b", "w cost", "w size", "0 round", "c")
    dims, at = _splits(np.nan_to_num(np.array([r["c"] for r in sample], dtype=float)), depth, 0.5 + (0.0, -0.12, 0.12, -0.06, 0.06)[phase % 5])
    dealt = staged(clusters.select("id", "w", "c", "height", _tile_of(dims, at, depth)("c").alias("tile")), "ward-tiles")
    width = len(sample[0]["c"])
    boxes = dealt.groupBy("tile").agg(F.min("w"), *[f(F.col("c")[k]) for f in (F.min, F.max) for k in range(width)]).orderBy("tile").collect()  # one row per tile
    table = np.nan_to_num(np.array([list(r) for r in boxes], dtype=float))
    tiles, light, low, high = table[:, 0].astype(int), table[:, 1], table[:, 2:2 + width], table[:, 2 + width:]
    slack = 1e-12 * np.maximum(np.abs(low), np.abs(high)).max(axis=0)  # of rounded centres
    low, high = low - slack, high + slack

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by("id")
        limit = _outside(part.column("tile")[0].as_py(), tiles, low, high, light)
        given = (part.column("id").to_numpy(), part.column("w").to_numpy(), _points(part), part.column("height").to_numpy())
        odd = np.isnan(given[2]).any(axis=1)  # points that lack a coordinate wait for the rounds over all pairs
        merges, rest = contract(*[g[~odd] for g in given], round_, limit)
        ids, w, c, height = (np.concatenate([x, g[odd]]) for x, g in zip(rest, given))
        a, b, cost, size, rounds = zip(*merges) if merges else ((),) * 5
        none = [None] * len(ids)
        return pa.table([pa.array([*a, *ids.tolist()], pa.int64()), pa.array([*b, *none], pa.int64()), pa.array([*cost, *height.tolist()], pa.float64()),
                         pa.array([*size, *w.tolist()], pa.float64()), pa.array([*rounds, *none], pa.int32()),
                         pa.array([*[None] * len(a), *list(c)], pa.list_(pa.float64()))], names=["a", "b", "cost", "size", "round", "c"])

    # a task's work is its tiles, not its bytes: a fixed number of partitions, which Spark does not merge
    return staged(dealt.repartition(len(tiles), "tile").groupBy("tile").applyInArrow(run, _TILED), "ward-tiled")


def ward_merges(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cost, size, round): the whole merge tree of ``points`` (id long, w double, c array<double>)."""
    none = F.lit(None)
    clusters = staged(points.select("id", F.col("w").cast("double").alias("w"), "c", F.lit(0.0).alias("height"), none.cast("long").alias("nn"), none.cast("double").alias("nn_cost")), "ward")
    done: list[DataFrame] = []
    round_, phase, tiled = 0, 0, True
    while True:
        n, width = clusters.agg(F.count("*"), F.max(F.size("c"))).first()
        rows = max(2, min(block_rows, BLOCK_BYTES // (8 * max(1, width or 1))))
        if n <= rows:
            rest = clusters.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(_whole_block(round_), MERGES)
            out = staged(rest, "ward-merges")
            for d in done:
                out = out.unionByName(d)
            return out
        if tiled:
            found = _in_tiles(clusters, n, min(rows, TILE_ROWS), phase, round_)
            merged, last = found.where(F.col("b").isNotNull()).agg(F.count("*"), F.max("round")).first()
            tiled, phase = merged >= TILE_GAIN * n, phase + 1
            if merged:
                done.append(found.where(F.col("b").isNotNull()).select("a", "b", "cost", "size", "round"))
                clusters = found.where(F.col("b").isNull()).select(F.col("a").alias("id"), F.col("size").alias("w"), "c", F.col("cost").alias("height"),
                                                                   none.cast("long").alias("nn"), none.cast("double").alias("nn_cost"))
                round_ = last + 1
            continue
        known = staged(clusters.where(F.col("nn").isNotNull()).select(*_STATE).unionByName(
            clusters.where(F.col("nn").isNull()).drop("nn", "nn_cost").join(_neighbours(clusters, -(-n // rows)), "id").select(*_STATE)), "ward")
        other = known.select(*[F.col(c).alias(f"{c}_") for c in ("id", "w", "c", "height", "nn")])
        pairs = staged(known.join(other, (F.col("nn") == F.col("id_")) & (F.col("nn_") == F.col("id")) & (F.col("id") < F.col("id_"))), "ward-pairs")
        if pairs.isEmpty():  # ties among cached neighbours: all look again
            clusters = staged(known.withColumn("nn", none.cast("long")), "ward")
            continue
        high = F.greatest("nn_cost", "height", "height_")
        pairs = pairs.withColumnRenamed("w", "w0")  # a new "w" stands beside it below
        total = F.col("w0") + F.col("w_")
        done.append(pairs.select(F.col("id").alias("a"), F.col("id_").alias("b"), high.alias("cost"), total.alias("size"), F.lit(round_).alias("round")))
        middle = F.zip_with("c", "c_", lambda x, y: (x * F.col("w0") + y * F.col("w_")) / total)
        new = pairs.select("id", total.alias("w"), middle.alias("c"), high.alias("height"), none.cast("long").alias("nn"), none.cast("double").alias("nn_cost"))
        gone = pairs.select(F.explode(F.array("id", "id_")).alias("gone"))
        left = known.join(gone, F.col("id") == F.col("gone"), "left_anti")
        lost = left.join(gone, F.col("nn") == F.col("gone"), "left")
        left = lost.select("id", "w", "c", "height", F.when(F.col("gone").isNull(), F.col("nn")).alias("nn"), "nn_cost")
        clusters = staged(left.unionByName(new), "ward")
        round_ += 1


def cut_tree(merges: DataFrame, n_clusters: int) -> DataFrame:
    """(id, root) of every absorbed point after the cheapest merges, down to ``n_clusters`` clusters.

    Only the ``n_clusters`` − 1 dearest merges are looked up by the driver; the others are followed by
    pointer doubling. Points that absorb and are not absorbed are roots themselves.
    """
    dear = [r["b"] for r in merges.orderBy(F.desc("cost"), F.desc("round"), F.desc("a")).limit(max(0, n_clusters - 1)).collect()]
    kept = merges.where(~F.col("b").isin(dear)) if dear else merges
    up = staged(kept.select(F.col("b").alias("id"), F.col("a").alias("root")), "ward-up")
    while True:
        on = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = staged(up.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ward-up")
        up = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return up


def numbered_points(df: DataFrame, features: str) -> DataFrame:
    """(id, w, c): the distinct points with their multiplicities; ids follow the points' order."""
    distinct = df.groupBy(F.col(features).alias("c")).agg(F.count("*").cast("double").alias("w"))
    return staged(distinct.repartitionByRange("c").sortWithinPartitions("c").withColumn("id", F.monotonically_increasing_id()).select("id", "w", "c"), "ward-points")
