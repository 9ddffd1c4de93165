import tempfile

import pytest

from pyspark.sql import functions as F

from strata.plans.segment import SegmentConfig, segment
from strata.sources.generator import planted_segments
from strata.sources.runs import RunStore


def test_planted_segments_recovered_and_run_roundtrip(spark):
    gen = planted_segments(spark, 600, seed=7)
    res = segment(gen, SegmentConfig(columns=["row_id", "hours", "sessions", "wellbeing", "age", "slot", "device"],
                                     n_init=2, k_max=6))
    assert res.labelled.count() == 600
    # rule: row_id is an identifier and is not a feature; unselected columns still travel with the rows
    assert ("row_id", "identifier") in res.report.dropped and "profile" in res.labelled.columns
    # purity of recovered groups against the planted profile
    pur = res.labelled.groupBy("cluster", "profile").count().groupBy("cluster").agg(
        (F.max("count") / F.sum("count")).alias("p")).agg(F.min("p")).first()[0]
    assert res.metrics["optimal_k"] == 4 and pur > 0.9

    root = tempfile.mkdtemp(prefix="strata-runs-", dir="/tmp")
    store = RunStore(spark, root)
    rid = store.save_run(res, file_name="planted.csv", created_at="2026-01-01T00:00:00+00:00")
    rid2 = store.save_run(res, file_name="second.csv", created_at="2026-01-02T00:00:00+00:00")
    listing = store.list_runs().collect()
    assert [r["run_id"] for r in listing] == [rid2, rid]
    assert listing[0]["n_segments"] == 4
    store.edit_segment(rid, 0, label="Night owls", barriers=["  sleep ", "", "work"], validated=True)
    seg = {r["cluster"]: r for r in store.get_run(rid)["segments"].collect()}
    assert seg[0]["label"] == "Night owls" and seg[0]["barriers"] == ["sleep", "work"] and seg[0]["validated"]
    assert seg[1]["label"] == "Segment 1"
    gid = store.save_group(rid, "heavy users", [{"column": "hours", "op": "gt", "value": 6}], 150, 25.0)
    assert store.delete_group(rid, gid) and not store.delete_group(rid, gid)
    assert store.get_run("../etc") is None and store.get_run("0" * 12) is None
    assert store.delete_run(rid) and store.get_run(rid) is None
    assert [r["run_id"] for r in store.list_runs().collect()] == [rid2]


def test_model_labels_new_rows_like_the_run(spark):
    gen = planted_segments(spark, 400, seed=3)
    res = segment(gen, SegmentConfig(columns=["hours", "sessions", "wellbeing", "age", "slot", "device"], n_init=2, k_max=5))
    assert res.metrics["optimal_k"] == 4 and res.metrics["noise_points"] == 0 and res.metrics["warning"] is None
    again = {r["row_id"]: r["cluster"] for r in res.model.transform(gen).collect()}
    assert again == {r["row_id"]: r["cluster"] for r in res.labelled.collect()}


def test_linear_score_pca_and_map(spark):
    from strata.plans.segment import segment_map

    gen = planted_segments(spark, 300, seed=5)
    res = segment(gen, SegmentConfig(columns=["hours", "sessions", "wellbeing", "age"], n_init=1, k_min=4, k_max=4,
                                     score="centroid_silhouette", pca_components=3))
    assert res.metrics["score"] == "centroid_silhouette" and res.metadata["feature_names"] == ["PC1", "PC2", "PC3"]
    pts = segment_map(res, keep=["row_id"]).collect()
    assert len(pts) == 300 and all(r["PC1"] is not None for r in pts)


def test_segment_refuses_tables_without_patterns(spark):
    from strata.sources.tables import SourceError

    for rows, schema in (([], "a int, b int"), ([(1,), (2,)], "a int"), ([(1, 2)], "a int, b int")):
        with pytest.raises(SourceError):
            segment(spark.createDataFrame(rows, schema))


def small_run(spark, store, run_id, columns=("age", "cluster"), publish=True):
    base = spark.createDataFrame([(0, "s0"), (1, "s1")], "cluster int, label string")
    store.write("segments", run_id, base)
    store.write("labelled_rows", run_id, spark.createDataFrame([("v", 0)], list(columns)))
    if publish:
        store.publish(run_id, ["segments", "labelled_rows"], created_at="t", file_name=run_id)


def test_store_keeps_schemas_ids_and_edit_order(spark, tmp_path):
    from strata.sources.runs import RunExists, RunNotFound

    store = RunStore(spark, str(tmp_path))
    assert store.list_runs().collect() == []
    one, two, bad = "001234567890", "00000000000a", "00000000000b"
    for run_id, columns in ((one, ["age", "cluster"]), (two, ["city", "cluster"]), (bad, ["x", "cluster"])):
        small_run(spark, store, run_id, columns)
    assert store.read("labelled_rows", two).columns == ["city", "cluster", "run_id"]
    assert store.read("labelled_rows", one).first()["run_id"] == one and store.read("k_curve", one) is None
    assert [store.edit_segment(one, 0, label=f"v{i}") for i in range(6)] == [1, 2, 3, 4, 5, 6]
    assert {r["cluster"]: r["label"] for r in store.effective_segments(one).collect()} == {0: "v5", 1: "s1"}
    for run_id, cluster in ((one, 9), ("f" * 12, 0)):
        with pytest.raises(RunNotFound):
            store.edit_segment(run_id, cluster, label="x")
    with pytest.raises(RunNotFound):
        store.save_group("f" * 12, "d", [], 1, 1.0)
    with pytest.raises(RunExists):
        store.publish(one, ["segments"])
    with pytest.raises(RunExists):
        store.write("segments", one, spark.createDataFrame([(0, "x")], "cluster int, label string"))
    with pytest.raises(ValueError):
        store.publish("0" * 12, [], no_field=1)
    (tmp_path / "log" / bad / "000000000000.json").write_bytes(b"damaged")
    listing = {r["run_id"]: r["segment_labels"] for r in store.list_runs().collect()}
    assert listing == {one: ["v5", "s1"], two: ["s0", "s1"]} and store.get_run(bad) is None


def test_a_run_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A writer that stops after any of its tables leaves no run behind, and the id can be saved again."""
    gen = planted_segments(spark, 200, seed=5)
    res = segment(gen, SegmentConfig(columns=["hours", "sessions", "wellbeing", "age"], n_init=1, k_min=2, k_max=2, score="centroid_silhouette"))
    store, run_id, write = RunStore(spark, str(tmp_path)), "0000000000aa", RunStore.write
    tables = ["segments", "cluster_sizes", "k_curve", "numeric_profile", "numeric_evidence", "labelled_rows"]
    for stop in tables:
        def until(self, table, rid, df, stop=stop):
            write(self, table, rid, df)
            if table == stop:
                raise KeyboardInterrupt

        monkeypatch.setattr(RunStore, "write", until)
        with pytest.raises(KeyboardInterrupt):
            store.save_run(res, run_id)
        assert store.list_runs().collect() == [] and store.get_run(run_id) is None and store.read("segments", run_id) is None
    monkeypatch.setattr(RunStore, "write", write)
    assert store.save_run(res, run_id) == run_id
    run = store.get_run(run_id)
    assert set(tables) <= set(run) and run["labelled_rows"].count() == 200 and run["runs"].first()["n_rows"] == 200
    assert [r["run_id"] for r in store.list_runs().collect()] == [run_id]


def test_writers_never_share_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store, run_id = RunStore(spark, str(tmp_path)), "0000000000ab"
    small_run(spark, store, run_id)
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: store.log.append(run_id, {"kind": "edit", "at": str(i), "cluster": i % 2, "description": f"d{i}"}), range(40)))
    assert sorted(numbers) == list(range(1, 41)) == store.log.numbers(run_id)[1:]
    last = {c: max((n, i) for i, n in enumerate(numbers) if i % 2 == c)[1] for c in (0, 1)}
    assert {r["cluster"]: r["description"] for r in store.effective_segments(run_id).collect()} == {c: f"d{i}" for c, i in last.items()}
    assert not [f for f in (tmp_path / "log" / run_id).iterdir() if not f.name.endswith(".json")]
    assert not store.log.put(run_id, 3, {"kind": "edit"})


def test_overlaps_of_many_groups(spark):
    """More groups than one word of bits holds, NULLs, groups without rows."""
    from strata.operators.groups import GroupError, group_overlaps

    df = spark.createDataFrame([(i if i % 7 else None, "ab"[i % 2]) for i in range(300)], "x int, t string")
    groups = {f"g{i}": [("x", "lt", i * 4)] for i in range(70)} | {"a": [("t", "eq", "A")], "none": [("x", "gt", 999)], "all": []}
    got = {(r["group_a"], r["group_b"]): (r["n"], r["share"], r["share_of_a"]) for r in group_overlaps(df, groups).collect()}
    rows = [(i if i % 7 else None, "ab"[i % 2]) for i in range(300)]
    member = {f"g{i}": {j for j, (x, _) in enumerate(rows) if x is not None and x < i * 4} for i in range(70)}
    member |= {"a": {j for j, (_, t) in enumerate(rows) if t == "a"}, "none": set(), "all": set(range(300))}
    want = {(a, b): len(member[a] & member[b]) for a in member for b in member if a == b or member[a] & member[b]}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["a", "all"] == (150, 50.0, 100.0) and got["none", "none"] == (0, 0.0, 0.0)
    with pytest.raises(GroupError):
        group_overlaps(df, {})


def test_segment_hierarchical_path(spark):
    gen = planted_segments(spark, 300, seed=5)
    cols = ["hours", "sessions", "wellbeing", "age", "slot", "device"]
    res = segment(gen, SegmentConfig(columns=cols, n_init=1, k_min=4, k_max=4, algorithm="hierarchical"))
    sizes = [r["n"] for r in res.sizes.orderBy("cluster").collect()]
    assert len(sizes) == 4 and sum(sizes) == 300 and sizes == sorted(sizes, reverse=True)
    assert res.metrics["silhouette"] > 0.5 and res.model is None
