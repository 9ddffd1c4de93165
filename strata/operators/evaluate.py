"""Cluster evaluation on any integer label column.

Label −1 is noise: it is counted in sizes but left out of the metrics.
Features are a ``features`` column holding ARRAY<DOUBLE> (or an ML vector).
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import round_half_even
from ..functions.types import number, q
from ..session import staged
from .quantiles import exact_quantiles, group_key
from .stats import modes, value_freq

NOISE = -1


def as_array(df: DataFrame, features: str) -> DataFrame:
    """Features as ARRAY<DOUBLE> (accepts ML vectors and float arrays)."""
    dt = df.schema[features].dataType
    if isinstance(dt, T.ArrayType):
        if isinstance(dt.elementType, T.DoubleType):
            return df
        return df.withColumn(features, F.col(features).cast("array<double>"))
    return df.withColumn(features, vector_to_array(F.col(features)))


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per label including noise (−1)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def cluster_share(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Size and % of total (1 dp)."""
    sizes = cluster_sizes(df, label)
    # the total is the sum of the (few) group sizes: one scalar, attached once
    total = sizes.select(F.sum("n")).scalar()
    t = F.col("__t")
    return sizes.withColumn("__t", total).select(
        label, "n", F.when(t > 0, round_half_even(F.col("n") / t * 100, 1)).otherwise(F.lit(0.0)).alias("pct"))


def moments(df: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """(cluster, n, mean, ss) per cluster, noise left out: sizes, centroids and centred sums of squares.

    Vector moments are merged map-side, so a task gives one row per cluster whatever the number of
    rows and dimensions; E2, E3 and E5 read nothing else but this table (E3 also the distances to it).
    """
    rows = as_array(df, features).where(F.col(label) != NOISE).select(label, array_to_vector(features).alias("v"))
    got = rows.groupBy(label).agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s"))
    n = F.col("s.count")
    return got.select(label, n.alias("n"), vector_to_array("s.mean").alias("mean"),
                      F.transform(vector_to_array("s.variance"), lambda x: x * (n - 1)).alias("ss"))


def _sum(xs) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def inertia(df: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """E5: sum of squared distances to the own-cluster centroid (one row)."""
    return moments(df, features, label).agg(F.coalesce(F.sum(_sum(F.col("ss"))), F.lit(0.0)).alias("inertia"))


def calinski_harabasz(df: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """(B/(k−1)) / (W/(n−k)); W = 0 gives 1.0; fewer than 2 clusters gives NULL."""
    one = moments(df, features, label).agg(F.sort_array(F.collect_list(F.struct(label, "n", "mean", "ss"))).alias("c"))  # one row per cluster
    total = _sum(F.transform("c", lambda c: c["n"].cast("double")))
    dims = F.sequence(F.lit(0), F.size(F.col("c")[0]["mean"]) - 1)
    sized = one.select("c", total.alias("n"), F.size("c").alias("k"))
    centred = sized.withColumn("gm", F.transform(dims, lambda d: _sum(F.transform("c", lambda c: c["n"] * F.get(c["mean"], d))) / F.col("n")))
    between = _sum(F.transform("c", lambda c: c["n"] * _sum(F.zip_with(c["mean"], F.col("gm"), lambda x, y: (x - y) * (x - y)))))
    found = centred.select("n", "k", between.alias("B"), _sum(F.transform("c", lambda c: _sum(c["ss"]))).alias("W"))
    k = F.col("k")
    return found.select(F.when(k < 2, F.lit(None).cast("double"))
                        .when(F.col("W") == 0, F.lit(1.0))
                        .otherwise((F.col("B") / (k - 1)) / (F.col("W") / (F.col("n") - k))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features: str = "features", label: str = "cluster") -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d_ij, s = mean distance to the centroid.

    Works on the moments' centroids and one pass for s; the k×k step runs on one row of k centroids.
    """
    a = as_array(df, features).where(F.col(label) != NOISE)
    cen = moments(df, features, label).select(label, F.col("mean").alias("centroid"))
    s = a.join(cen, label).select(label, F.sqrt(_sum(F.zip_with(features, "centroid", lambda x, y: (x - y) * (x - y)))).alias("d")).groupBy(label).agg(F.avg("d").alias("s"))
    cs = cen.join(s, label)
    # the k centroids (one row each) are gathered into one array row; the k×k ratios are
    # array expressions on that row — no join between clusters
    allc = cs.agg(F.collect_list(F.struct(F.col(label).alias("id"), "centroid", "s")).alias("c"))

    def dist(a, b):
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))

    per = F.transform("c", lambda ci: F.array_max(F.transform(
        F.filter("c", lambda cj: cj["id"] != ci["id"]),
        lambda cj: F.when(dist(ci["centroid"], cj["centroid"]) == 0, F.lit(0.0))
        .otherwise((ci["s"] + cj["s"]) / dist(ci["centroid"], cj["centroid"])))))
    return allc.select(F.when(F.size("c") < 2, F.lit(None).cast("double")).otherwise(_sum(per) / F.size("c")).alias("davies_bouldin"))


# ---------------------------------------------------------------- silhouette

BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 65_536  # features and points of one block at most: a task holds two
FEW_ROWS, MANY_BLOCKS = 4096, 20           # smaller blocks, for more tasks, as long as there are not many
TILE_ROWS, TILE_COLUMNS = 128, 512         # distances held at once, in the cache of a core; the second a multiple of the first
HELD_RUNS = 32                             # runs whose sums are held before they are dealt to the columns
SUM_BYTES = 1 << 20                        # distance sums of one row of bytes
PAIR_PARTITIONS = 2                        # partitions for each pair of blocks, so that few tasks hold two


def _gram_sides(t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product holds the squared distances of ``t`` to ``r``."""
    one = lambda x: np.ones((len(x), 1))
    return (np.hstack([t, (t * t).sum(axis=1)[:, None], one(t)]), np.hstack([-2.0 * r, one(r), (r * r).sum(axis=1)[:, None]]))


def _pack_block(table: pa.Table) -> pa.Table:
    """Function of one block: its points as one row of bytes, in the order of their labels in all columns."""
    labels = np.stack(table.column("li").to_numpy()).astype(np.int32)
    order = np.lexsort((table.column("pid").to_numpy(), *labels.T[::-1]))
    x, w = np.stack(table.column("x").to_numpy()).astype(float)[order], table.column("w").to_numpy()[order]
    cells = {"x": x.tobytes(), "li": labels[order].tobytes(), "w": w.tobytes()}
    return pa.table({"b": pa.array([table.column("b")[0].as_py()], pa.int32()), "n": pa.array([len(order)], pa.int64())} | {c: pa.array([v], pa.binary()) for c, v in cells.items()})


def _cells(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, labels and weights of a packed row; ``width`` label columns."""
    return np.frombuffer(row["x"]).reshape(row["n"], -1) if row["x"] else np.zeros((row["n"], 0)), np.frombuffer(row["li"], np.int32).reshape(row["n"], width), np.frombuffer(row["w"])


def _pair_sums(offsets: list[int], width: int):
    """Function of one pair of packed blocks: per point of either, its distance sums to every cluster of the other.

    The clusters of all label columns stand side by side (``offsets``), so each distance is
    taken once whatever the number of columns. Blocks are in the order of the labels, so a tile of
    distances has few runs of equally labelled points: weights add up each run, then the runs are dealt to the columns.
    A block paired with itself counts once, and its rows carry the labels and weights of the points.
    """
    def runs(labels: np.ndarray, weight: np.ndarray, size: int) -> tuple[list[tuple[slice, np.ndarray, slice]], np.ndarray]:
        """Tiles of ``size`` points: their weights by run, and the numbers of their runs; and the columns of all runs."""
        tiles, dealt, done = [], [], 0
        for a in range(0, len(labels), size):
            at = slice(a, min(a + size, len(labels)))
            new = np.r_[True, (labels[at][1:] != labels[at][:-1]).any(axis=1)]
            kinds, run = labels[at][new], np.cumsum(new) - 1
            member, columns = np.zeros((len(run), len(kinds))), np.zeros((len(kinds), width))
            member[np.arange(len(run)), run] = weight[at]
            for m, offset in enumerate(offsets):
                there = np.flatnonzero(kinds[:, m] >= 0)
                columns[there, offset + kinds[there, m]] = 1.0
            if len(kinds) > width:
                member, columns = member @ columns, np.eye(width)
            tiles.append((at, member, slice(done, done + len(columns))))
            dealt.append(columns)
            done += len(columns)
        return tiles, np.concatenate(dealt)

    def sums(table: pa.Table) -> pa.Table:
        blocks = {row["b"]: row for row in table.to_pylist()}
        first, second = min(blocks), max(blocks)
        own = first == second
        (x, xl, xw), (y, yl, yw) = (_cells(blocks[b], len(offsets)) for b in (first, second))
        t, r = _gram_sides(x, y)
        r = np.ascontiguousarray(r.T)
        left = np.zeros((len(x), width))
        right = left if own else np.zeros((len(y), width))
        (down, down_columns), (across, columns) = runs(xl, xw, TILE_ROWS), runs(yl, yw, TILE_COLUMNS)
        held, begun, turned = np.empty(TILE_ROWS * TILE_COLUMNS), 0, None
        for i, (rows, row_member, row_runs) in enumerate(down):
            turn, part = np.ascontiguousarray(row_member.T), np.zeros((rows.stop - rows.start, len(columns)))
            if turned is None:  # sums of the other block's points for the next runs of this one
                turned, begun = np.zeros((max(HELD_RUNS, len(turn)), len(y))), row_runs.start
            place = slice(row_runs.start - begun, row_runs.stop - begun)
            for cols, member, col_runs in across:
                if own and cols.stop <= rows.start:
                    continue  # taken from the other side
                d = held[:(rows.stop - rows.start) * (cols.stop - cols.start)].reshape(rows.stop - rows.start, -1)
                np.matmul(t[rows], r[:, cols], out=d)
                np.maximum(d, 0.0, out=d)
                np.sqrt(d, out=d)
                inside = own and cols.start <= rows.start
                if inside:  # a point and itself; both orders of the other pairs are in such tiles
                    same = np.arange(rows.start, rows.stop)
                    d[same - rows.start, same - cols.start] = 0.0
                part[:, col_runs] = d @ member
                if not inside:
                    turned[place, cols] += turn @ d
            left[rows] += part @ columns
            if i + 1 == len(down) or down[i + 1][2].stop - begun > len(turned):
                right += turned[:place.stop].T @ down_columns[begun:row_runs.stop]
                turned = None
        out = []
        for b, labels, weight, found in [(first, xl, xw, left)] + ([] if own else [(second, yl, yw, right)]):
            step = max(64, SUM_BYTES // (8 * width))
            for c, a in enumerate(range(0, len(found), step)):
                part = slice(a, a + step)
                out.append((b, c, found[part].tobytes(), *((labels[part].tobytes(), weight[part].tobytes()) if own else (None, None))))
        return pa.table([pa.array(v, kind) for v, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["b", "c", "sums", "li", "w"])

    return sums


def _added(columns: int, width: int):
    """Function of one part of a block: its rows of distance sums added up, a row for each point."""
    def add(table: pa.Table) -> pa.Table:
        total, labels, weight = 0.0, None, None
        for sums, li, w in zip(table.column("sums"), table.column("li"), table.column("w")):
            total = total + np.frombuffer(sums.as_buffer())
            if li.is_valid:
                labels, weight = np.frombuffer(li.as_buffer(), np.int32), np.frombuffer(w.as_buffer())
        lists = lambda flat, per: pa.ListArray.from_arrays(pa.array(np.arange(len(weight) + 1) * per, pa.int32()), pa.array(flat))
        return pa.table([lists(total, width), lists(labels, columns), pa.array(weight)], names=["sums", "li", "w"])

    return add


def block_count(rows: int, dims: int | None, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that the points are dealt to. Every point is copied, and gives a row of sums, once per block."""
    return max(1, -(-rows * 8 * max(1, dims or 1) // block_bytes), -(-rows // BLOCK_ROWS), min(MANY_BLOCKS, -(-rows // FEW_ROWS)))


def silhouettes(df: DataFrame, labels: Sequence[str], features: str = "features", weight: str | None = None,
                block_bytes: int = BLOCK_BYTES) -> dict[str, float | None]:
    """E1 of several label columns in one pass over the distances: {label column: mean silhouette}.

    Points are dealt to even blocks, in the order of the finest label column and a hash. Each unordered pair of blocks is one group of an Arrow
    function, which takes the distances once and adds them up for the clusters of all label
    columns; it returns sums per point, never per pair, in rows of bytes that a last function adds up. The
    work is quadratic in the rows and hardly grows with the columns; the driver sees the cluster
    sizes and one mean per column.

    A column's score is None for fewer than 2 clusters or more clusters than n − 1; a point alone in its
    cluster or with all distances 0 scores 0; label −1 leaves a point out. ``weight`` names a
    multiplicity column: the result equals the silhouette over the expanded rows.
    """
    names = list(labels)
    raw = as_array(df, features).select(q(features).alias("x"), F.array(*[q(c).cast("int") for c in names]).alias("l"),
                                        (q(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    # Written once: a point's id must be the same in all its pairs of blocks.
    fixed = staged(raw.select(F.monotonically_increasing_id().alias("pid"), "l", "x", "w"), "points")
    found = fixed.select("w", F.posexplode("l").alias("m", "c")).where(F.col("c") != NOISE).groupBy("m", "c").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"))
    sizes: list[dict[int, float]] = [{} for _ in names]
    starts: list[list[int]] = [[0] for _ in names]
    for row in found.orderBy("m", "c").collect():  # one row per cluster
        sizes[row["m"]][row["c"]] = float(row["n"])
        starts[row["m"]].append(starts[row["m"]][-1] + row["rows"])
    scored = [m for m, of in enumerate(sizes) if 2 <= len(of) <= sum(of.values()) - 1]
    out: dict[str, float | None] = dict.fromkeys(names)
    if not scored:
        return out
    offsets = [sum(len(sizes[m]) for m in scored[:i]) for i in range(len(scored))]
    width = sum(len(sizes[m]) for m in scored)
    place = [F.create_map(*[x for i, c in enumerate(sizes[m]) for x in (F.lit(c), F.lit(i))])[F.col("l")[m]] for m in scored]
    index = F.array(*[F.coalesce(p, F.lit(NOISE)) for p in place])
    fixed = fixed.select("pid", index.alias("li"), "x", "w")
    rows, dims = fixed.agg(F.count("*"), F.max(F.size("x"))).first()
    blocks = block_count(rows, dims, block_bytes)
    # a point's place among all: its cluster's span in the column with most clusters, and in that a hash
    finest = max(range(len(scored)), key=lambda i: len(sizes[scored[i]]))
    ends, li, share = starts[scored[finest]], F.col("li")[finest], F.pmod(F.xxhash64("pid"), F.lit(1 << 20)) / float(1 << 20)
    spans = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b - a)).alias("n")) for a, b in zip(ends, [*ends[1:], rows])])
    span = F.get(spans, F.when(li == NOISE, len(ends) - 1).otherwise(li))
    place = (span["a"] + share * span["n"]) * float(blocks) / float(rows)
    packed = fixed.withColumn("b", F.least(place.cast("int"), F.lit(blocks - 1))).groupBy("b").applyInArrow(_pack_block, "b int, n long, x binary, li binary, w binary")
    dealt = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "n", "x", "li", "w")
    # a task's work is its pairs of blocks, not its bytes: partitions by the pairs, which Spark does not merge
    sums = (dealt.repartition(PAIR_PARTITIONS * (blocks * (blocks + 1) // 2), "i", "j").groupBy("i", "j")
            .applyInArrow(_pair_sums(offsets, width), "b int, c int, sums binary, li binary, w binary"))
    added = sums.groupBy("b", "c").applyInArrow(_added(len(scored), width), "sums array<double>, li array<int>, w double")

    def score(i: int):
        size = F.array(*[F.lit(n) for n in sizes[scored[i]].values()])
        mine, li = F.slice("sums", offsets[i] + 1, len(sizes[scored[i]])), F.col("li")[i]
        own = size[li]
        inner = mine[li] / (own - 1)
        means = F.transform(mine, lambda s, c: F.when(c != li, s / F.element_at(size, c + 1)))
        outer = F.array_min(F.filter(means, lambda m: m.isNotNull()))
        widest = F.greatest(inner, outer)
        return F.when((own <= 1) | (widest == 0), 0.0).otherwise((outer - inner) / widest)

    there = [F.col("li")[i] != NOISE for i in range(len(scored))]
    means = added.agg(*[F.sum(F.when(there[i], score(i) * F.col("w"))) / F.sum(F.when(there[i], F.col("w"))) for i in range(len(scored))]).first()
    return out | {names[m]: float(v) for m, v in zip(scored, means) if v is not None}


def silhouette(df: DataFrame, features: str = "features", label: str = "cluster", weight: str | None = None,
               block_bytes: int = BLOCK_BYTES) -> float | None:
    """Mean Euclidean silhouette over all rows (NOT the squared-distance variant of Spark ML); see ``silhouettes``."""
    return silhouettes(df, [label], features, weight, block_bytes)[label]


def _labelled_points(df: DataFrame, features: str, label: str, weight: str | None) -> tuple[DataFrame, list[int], list[float]]:
    """(l, x, w) of the rows that are not noise, the labels in order, and their weights."""
    points = as_array(df, features).where(q(label) != NOISE).select(
        q(label).cast("int").alias("l"), q(features).alias("x"), (q(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    sizes = {int(r["l"]): float(r["n"]) for r in points.groupBy("l").agg(F.sum("w").alias("n")).collect()}
    labels = sorted(sizes)
    return points, labels, [sizes[x] for x in labels]


def centroid_silhouette(df: DataFrame, features: str = "features", label: str = "cluster", weight: str | None = None) -> float | None:
    """Simplified silhouette over all rows, by distances to the cluster centres: linear work.

    A score of its own, not an estimate of ``silhouette``: for a row, (b − a) / max(a, b) with a
    the distance to its own centre and b to the nearest other one.
    """
    points, labels, counts = _labelled_points(df, features, label, weight)
    if len(labels) < 2 or len(labels) > sum(counts) - 1:
        return None
    cells = points.select("l", "w", F.posexplode("x").alias("dim", "v"))
    rows = cells.groupBy("l", "dim").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).collect()  # clusters × dimensions
    centre: dict[int, dict[int, float]] = {}
    for r in rows:
        centre.setdefault(r["l"], {})[r["dim"]] = r["m"]

    def to(one: int):
        middle = F.array(*[F.lit(centre[one][d]) for d in sorted(centre[one])])
        return F.sqrt(F.aggregate(F.zip_with("x", middle, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda acc, v: acc + v))

    far = points.select("l", "w", F.array(*[F.struct(F.lit(one).alias("l"), to(one).alias("d")) for one in labels]).alias("far"))
    own = F.filter("far", lambda s: s["l"] == F.col("l"))[0]["d"]
    other = F.array_min(F.transform(F.filter("far", lambda s: s["l"] != F.col("l")), lambda s: s["d"]))
    score = far.select("w", own.alias("a"), other.alias("b")).select("w", F.when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    value = score.agg(F.sum(F.col("s") * F.col("w")) / F.sum("w")).first()[0]
    return None if value is None else float(value)


# ---------------------------------------------------------------- profiles

def numeric_profile(df: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """(cluster, column, mean, median, std) on original values; one pass for all columns.

    std uses ddof 1 and is NULL with fewer than 2 values; the median is exact.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns])
    base = df.select(group_key([label]).alias("__k"), F.inline(cells)).groupBy("__k", "column").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    middle = exact_quantiles(df, columns, (0.5,), [label]).select(group_key([label]).alias("__k"), "column", F.col("q")[0].alias("median"))
    return base.join(middle, ["__k", "column"], "left").select(
        F.col("__k")["k0"].alias(label), "column", "mean", "median", "std")


def category_profile(df: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """(cluster, column, value, n, is_mode) for non-numeric columns; mode = most frequent, ties → smallest."""
    fr = value_freq(df, columns, by=[label])
    mode = modes(df, columns, by=[label]).select(label, "column", F.col("value").alias("__mode"))
    return fr.join(mode, [label, "column"]).select(
        label, "column", "value", "n", (F.col("value") == F.col("__mode")).alias("is_mode"))
