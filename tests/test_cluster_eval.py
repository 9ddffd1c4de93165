import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import cluster as C
from strata.operators import evaluate as E
from strata.functions import ladders as L


def brute_silhouette(X, lab):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    labs = sorted(set(lab))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in labs if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def make(spark, X, lab):
    return spark.createDataFrame([(list(map(float, x)), int(l)) for x, l in zip(X, lab)],
                                 "features array<double>, cluster int")


def test_silhouette_exact_vs_brute_force(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (15, 3)), rng.normal(0, 1, (1, 3)) + 9])
    lab = np.array([0] * 20 + [1] * 15 + [2])
    df = make(spark, X, lab)
    assert E.silhouette(df) == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    # several blocks give the same value
    assert E.silhouette(df, block_bytes=170) == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    # noise label −1 is excluded; one cluster → None
    noisy = make(spark, np.vstack([X, [[50, 50, 50]]]), np.append(lab, -1))
    assert E.silhouette(noisy) == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    assert E.silhouette(make(spark, X[:5], [0] * 5)) is None


def test_ch_db_inertia_vs_formulas(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(5, 1, (20, 2)), rng.normal(-5, 2, (10, 2))])
    lab = np.array([0] * 30 + [1] * 20 + [2] * 10)
    df = make(spark, X, lab)
    mu = X.mean(0)
    cents = {c: X[lab == c].mean(0) for c in range(3)}
    W = sum(((X[lab == c] - cents[c]) ** 2).sum() for c in range(3))
    B = sum((lab == c).sum() * ((cents[c] - mu) ** 2).sum() for c in range(3))
    ch = (B / 2) / (W / (60 - 3))
    s = {c: np.sqrt(((X[lab == c] - cents[c]) ** 2).sum(1)).mean() for c in range(3)}
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(3) if j != i)
                  for i in range(3)])
    assert E.calinski_harabasz(df).first()[0] == pytest.approx(ch)
    assert E.davies_bouldin(df).first()[0] == pytest.approx(db)
    assert E.inertia(df).first()[0] == pytest.approx(W)


def test_k_range_elbow_choice():
    assert C.k_range(100) == list(range(2, 11))
    assert C.k_range(30) == [2, 3]
    assert C.k_range(3) == [2]


def test_choice_over_the_curve_table(spark):
    def curve(ks, inertia=None, silhouette=None):
        return C.curve_table(spark, [(k, (inertia or ks)[i], (silhouette or ks)[i]) for i, k in enumerate(ks)])

    assert C.elbow(curve([2, 3], [10, 5])).first()["k"] == 2
    assert C.elbow(curve([2, 3, 4, 5, 6], [100, 40, 30, 25, 22])).first()["k"] == 3
    assert C.elbow(curve([2, 3, 4], [7, 7, 7])).first()["k"] == 2
    chosen = lambda ks, s: tuple(C.two_regime_k(curve(ks, silhouette=s)).first())
    assert chosen([2, 3, 4, 5], [0.3, 0.6, 0.4, 0.35]) == (3, False)
    assert chosen([2, 3, 4, 5, 6], [0.20, 0.21, 0.215, 0.22, 0.225]) == (4, True)
    assert chosen([5, 6], [0.20, 0.21]) == (6, True)
    assert chosen([2], [0.1]) == (2, False)


def test_coincident_points_and_centroid_score(spark):
    df = make(spark, np.zeros((4, 2)), [0, 0, 1, 1])
    assert E.silhouette(df) == 0.0 and E.centroid_silhouette(df) == 0.0
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(9, 1, (15, 3))])
    lab = np.array([0] * 20 + [1] * 15)
    centres = np.array([X[lab == c].mean(0) for c in (0, 1)])
    d = np.sqrt(((X[:, None] - centres[None]) ** 2).sum(-1))
    a, b = d[np.arange(35), lab], d[np.arange(35), 1 - lab]
    assert E.centroid_silhouette(make(spark, X, lab)) == pytest.approx(((b - a) / np.maximum(a, b)).mean())


def test_kmeans_labels_cover_rows_and_are_layout_stable(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 0.3, (40, 2)), rng.normal(3, 0.3, (30, 2)), rng.normal((0, 3), 0.3, (20, 2))])
    df = spark.createDataFrame([(list(map(float, x)),) for x in X], "features array<double>")
    out = []
    for parts in (1, 3, 7):
        feats = C.stable_layout(df.repartition(parts), partitions=parts).cache()
        lab = C.assign(feats, C.kmeans(feats, 3, n_init=2))
        assert lab.count() == 90
        out.append(sorted((tuple(r["features"]), r["cluster"]) for r in lab.collect()))
    assert out[0] == out[1] == out[2]
    sizes = sorted(r["n"] for r in E.cluster_sizes(lab).collect())
    assert sizes == [20, 30, 40]


def test_hierarchical_on_spark(spark):
    rows = [([float(x), 0.0],) for x in (0, 0.1, 0.2, 5, 5.1, 9)]
    df = spark.createDataFrame(rows, "features array<double>")
    lab = {tuple(r["features"]): r["cluster"] for r in C.hierarchical(df, 3).collect()}
    assert lab[(0.0, 0.0)] == lab[(0.1, 0.0)] == 0 and lab[(5.0, 0.0)] == lab[(5.1, 0.0)]


def test_refinement_gate():
    assert C.should_refine(0.10, 0) and not C.should_refine(0.40, 0) and not C.should_refine(0.10, 1)
    assert not C.should_refine(None, 0) and not C.should_refine(float("nan"), 0)


def test_quality_ladders(spark):
    for s, want in [(0.10, "alta"), (0.24, "alta"), (0.25, "media"), (0.49, "media"), (0.50, "baja"),
                    (None, "alta"), (float("nan"), "alta"), (True, "alta"), (float("inf"), "alta")]:
        assert L.caution_from_silhouette(s) == want
    for s, want in [(0.55, "A"), (0.35, "B"), (0.20, "C"), (0.05, "D"), (None, "—"), (float("nan"), "—")]:
        assert L.quality_grade(s)[0] == want
    for n, want in [(10, "alta"), (29, "alta"), (30, "media"), (99, "media"), (100, "baja")]:
        assert L.caution_from_group_size(n) == want
    assert L.raise_caution("alta", "media") == "alta" and L.raise_caution("baja", "media") == "media"
    df = spark.createDataFrame([(0.55,), (0.35,), (0.2,), (0.05,), (None,), (float("nan"),)], "s double")
    got = [r[0] for r in df.select(L.grade_col(F.col("s"))).collect()]
    assert got == ["A", "B", "C", "D", "—", "—"]


def test_weighted_distinct_rows_keep_silhouette_and_cost(spark):
    rng = np.random.default_rng(6)
    base = np.vstack([rng.integers(1, 4, (6, 3)), rng.integers(4, 7, (6, 3))]).astype(float)
    X = np.repeat(base, rng.integers(1, 9, len(base)), axis=0)        # heavy duplicates
    lab = (X.sum(1) > 9).astype(int)
    rows = make(spark, X, lab)
    collapsed = rows.groupBy("features", "cluster").agg(F.count(F.lit(1)).alias("w"))
    assert E.silhouette(collapsed, weight="w") == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    df = spark.createDataFrame([(list(map(float, x)),) for x in X], "features array<double>")
    wt = C.weighted_rows(df)
    assert wt.count() <= len(base) and wt.agg(F.sum(C.WEIGHT)).first()[0] == len(X)
    s = C.search_k(df, k_max=3, n_init=2)
    direct = C.kmeans(df, 2, n_init=2)
    assert dict((k, i) for k, i, _ in s.curve)[2] == pytest.approx(direct.cost, rel=1e-6)


def test_restarts_share_their_passes_and_equal_sparks_fits(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(8)
    X = rng.normal(0, 1, (400, 3)) + 100.0
    X[:50] = X[50:100]
    rows = C.weighted_rows(spark.createDataFrame([(list(map(float, x)),) for x in X], "features array<double>"))
    passes, made = [], C._pass
    monkeypatch.setattr(C, "_pass", lambda centres: passes.append(len(centres)) or made(centres))
    tasks = [(k, s) for k in (2, 5) for s in range(42, 45)]
    fits = C._fits(rows, tasks)
    spread, steps = C.mean_variance(rows), []
    for (k, seed), fit in zip(tasks, fits):
        one = KMeans(k=k, seed=seed, maxIter=C.MAX_ITER, tol=(1e-4 * spread / k) ** 0.5, featuresCol="__vec", weightCol=C.WEIGHT).fit(rows)
        steps.append(one.summary.numIter)
        assert np.allclose(fit.centers, one.clusterCenters()) and fit.cost == pytest.approx(one.summary.trainingCost)
    assert passes[0] == len(tasks) and len(passes) == max(steps) and sum(passes) == sum(steps)


def test_silhouettes_in_tiles_and_few_blocks(spark):
    """Many points copied to few blocks; several labelings, weights and noise over more than one tile of distances."""
    assert E.block_count(900_000, 10) <= 20 and E.block_count(15_000, 10) == 4 and E.block_count(5_400_000, 10) <= 83
    rng = np.random.default_rng(9)
    X, w = rng.normal(0, 1, (1500, 2)), rng.integers(1, 3, 1500)
    one, two = rng.integers(0, 3, 1500), rng.integers(-1, 4, 1500)
    df = spark.createDataFrame([(list(map(float, x)), int(a), int(b), float(c)) for x, a, b, c in zip(X, one, two, w)], "features array<double>, a int, b int, w double")
    whole, many = np.repeat(X, w, axis=0), np.repeat(two, w)
    for block_bytes in (E.BLOCK_BYTES, 9000):
        got = E.silhouettes(df, ["a", "b"], weight="w", block_bytes=block_bytes)
        assert got["a"] == pytest.approx(brute_silhouette(whole, np.repeat(one, w)), abs=1e-7)
        assert got["b"] == pytest.approx(brute_silhouette(whole[many >= 0], many[many >= 0]), abs=1e-7)


def test_bisecting_fits_on_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "BISECT_ROWS", 20)
    laid, made = [], C.weighted_rows
    monkeypatch.setattr(C, "weighted_rows", lambda *a, **k: laid.append(made(*a, **k)) or laid[-1])
    df = spark.createDataFrame([([float(i % 50), float(i // 50) * 100],) for i in range(100)], "features array<double>")
    out = C.bisecting(df, 2)
    assert laid[0].rdd.getNumPartitions() == 5
    assert sorted(r["n"] for r in E.cluster_sizes(out).collect()) == [50, 50]


def test_a_pair_of_packed_blocks_takes_each_distance_once(monkeypatch):
    """Sums of both blocks by every cluster, in few rows; a block with itself takes little over half its distances."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    X, w = rng.normal(0, 1, (2600, 3)), rng.integers(1, 4, 2600).astype(float)
    labels = np.stack([rng.integers(0, 3, 2600), rng.integers(-1, 9, 2600)], axis=1).astype(np.int32)
    X[5] = X[6]

    def packed(b, at):
        return E._pack_block(pa.table({"b": pa.array([b] * len(at), pa.int32()), "pid": at, "li": pa.array(list(labels[at])), "x": pa.array(list(X[at])), "w": w[at]}))

    def order(at):
        return at[np.lexsort((at, labels[at, 1], labels[at, 0]))]

    def sums(rows, against):
        D = np.sqrt(((X[rows][:, None] - X[against][None]) ** 2).sum(-1)) * w[against]
        return np.hstack([np.stack([D[:, labels[against, m] == c].sum(axis=1) for c in range(n)], axis=1) for m, n in ((0, 3), (1, 9))])

    def found(table, b):
        return np.concatenate([np.frombuffer(r["sums"]) for r in table.to_pylist() if r["b"] == b]).reshape(-1, 12)

    taken, root = [], np.sqrt
    monkeypatch.setattr(E.np, "sqrt", lambda d, out: taken.append(d.size) or root(d, out=out))
    left, right = np.arange(1400), np.arange(1400, 2600)
    own, pair = E._pair_sums([0, 3], 12)(packed(0, left)), E._pair_sums([0, 3], 12)(pa.concat_tables([packed(1, right), packed(0, left)]))
    monkeypatch.undo()
    assert sum(taken) <= 0.7 * 1400 ** 2 + 1400 * 1200 and own.num_rows == 1 and pair.num_rows == 2
    assert np.allclose(found(own, 0), sums(order(left), order(left)), atol=1e-5)
    assert np.allclose(found(pair, 0), sums(order(left), order(right))) and np.allclose(found(pair, 1), sums(order(right), order(left)))


def test_equally_near_centres_leave_the_rows_to_the_first():
    import pyarrow as pa

    x, w = np.array([[0.0, 1.0], [2.0, 1.0], [0.0, 3.0]]), np.array([1.0, 2.0, 4.0])
    batch = pa.record_batch([pa.array([x.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["x", "w"])
    fits = [np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([[0.0, 1.0], [2.0, 1.0], [0.0, 4.0]])]
    got = np.frombuffer(next(C._pass(fits)(iter([batch]))).column("part")[0].as_py())
    assert got[:10].tolist() == [4.0, 15.0, 0.0, 0.0, 0.0, 1.0, 4.0, 2.0, 0.0, 12.0] and got[10:15].tolist() == [7.0, 0.0, 1.0, 2.0, 4.0]
    assert got[15:] == pytest.approx([1.0 + 2.0 + 4 * 5.0, 4.0])


def test_first_centres_come_from_vectors_that_spark_keeps(spark, monkeypatch):
    """A cached table would be decoded in each pass over it: the fit gets a projection, which Spark keeps for its passes."""
    rows = C.weighted_rows(spark.createDataFrame([([float(i % 7), float(i)],) for i in range(60)], "features array<double>"))
    plain = C.KMeans(k=3, seed=5, maxIter=0, featuresCol="__vec", weightCol=C.WEIGHT).fit(rows).clusterCenters()
    kept, fit = [], C.KMeans.fit
    monkeypatch.setattr(C.KMeans, "fit", lambda self, df: kept.append(df.storageLevel) or fit(self, df))
    assert np.allclose(C._first_centres(rows, 3, 5), plain) and not kept[0].useMemory


def test_customer_features_are_written_once(spark, tmp_path):
    """The passes of the k search and the flagship read written features, not the aggregated orders."""
    from strata.plans import catalog_cluster as Q

    spark.createDataFrame([(i, f"c{i}", i % 3, i * 10.0, "AB"[i % 2]) for i in range(6)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, i % 5, 1.5 * i) for i in range(20)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    once = Q.staged_features(spark, str(tmp_path))
    assert all("strata-customers" in f for f in once.inputFiles()) and once.schema == Q.customer_features(spark, str(tmp_path)).schema
    assert sorted(map(str, once.collect())) == sorted(map(str, Q.customer_features(spark, str(tmp_path)).collect()))
