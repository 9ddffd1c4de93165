"""Run persistence (S11, S12) with curation (E14) and custom groups (H4).

A run is a set of tables, each in a folder of its own ``<root>/<table>/run_id=<id>`` on
shared storage, with the run's own schema: runs of different tables never share columns, and
an id is text whatever it looks like. Commit 0 of its log (``<root>/log/<id>``), written after all
tables, names them and holds the run's summary and segment names: before it the run does not
exist, so it appears whole or not at all. Edits, custom groups and their removal are later commits in
order of their numbers (``commits.CommitLog``): nothing stored is ever rewritten. A listing is one scan
of the logs.
"""
from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from typing import Any, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.predicates import Filter, as_filters
from .commits import CommitLog
from .sinks import LIST_FIELDS

RUN_ID = re.compile(K.RUN_ID_REGEX)
TABLES = ("segments", "cluster_sizes", "k_curve", "numeric_profile", "category_profile",
          "numeric_evidence", "categorical_evidence", "labelled_rows")
TEXT_FIELDS = ("label", "description", "main_behaviour", "caution_reason")
SAVED, EDIT, GROUP, GROUP_REMOVED = "saved", "edit", "group", "group_removed"

#: Fields of a run's summary.
SUMMARY = {"created_at": "string", "file_name": "string", "dataset_context": "string", "n_rows": "long", "n_cols": "long", "optimal_k": "int",
           "n_clusters": "long", "silhouette": "double", "calinski_harabasz": "double", "davies_bouldin": "double", "grade": "string",
           "grade_label": "string", "caution": "string", "flat_k_curve": "boolean", "forced_k_min": "boolean", "refinements": "int"}
_SCHEMA = ("log string, number long, kind string, at string, tables array<string>, summary struct<" + ", ".join(f"{k}: {v}" for k, v in SUMMARY.items()) +
           ">, segments array<struct<cluster: int, label: string>>, cluster int, validated boolean, " +
           ", ".join(f"{f} string" for f in TEXT_FIELDS) + ", " + ", ".join(f"{f} array<string>" for f in LIST_FIELDS) +
           ", group_id string, filters string, n long, share double")


def new_run_id() -> str:
    return uuid.uuid4().hex[:12]


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


class RunNotFound(LookupError):
    pass


class RunExists(ValueError):
    pass


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    def _path(self, table: str, run_id: str) -> str:
        return f"{self.root}/{table}/run_id={run_id}"

    @staticmethod
    def valid_id(run_id: str) -> bool:
        return bool(isinstance(run_id, str) and RUN_ID.fullmatch(run_id))

    def _commits(self, run_id: str) -> DataFrame | None:
        found = self.log.read(_SCHEMA, run_id) if self.valid_id(run_id) else None
        return None if found is None else found.where(F.col("kind").isNotNull())

    def _manifest(self, run_id: str):
        found = self._commits(run_id)
        return None if found is None else found.where(F.col("kind") == SAVED).first()

    def _need(self, run_id: str):
        found = self._manifest(run_id)
        if found is None:
            raise RunNotFound(f"no run {run_id!r}")
        return found

    # -- write
    def write(self, table: str, run_id: str, df: DataFrame) -> None:
        """One table of a run that is not published yet."""
        if not self.valid_id(run_id):
            raise ValueError(f"invalid run id {run_id!r}")
        if self.log.numbers(run_id):
            raise RunExists(f"run {run_id} is published: its tables stay as they are")
        df.drop("run_id").write.mode("overwrite").parquet(self._path(table, run_id))

    def publish(self, run_id: str, tables: Sequence[str], **summary: Any) -> None:
        """Commit 0: the run's tables, summary fields and segment names; from now on it exists."""
        unknown = set(summary) - set(SUMMARY)
        if unknown:
            raise ValueError(f"not fields of a summary: {sorted(unknown)}")
        names = []
        if "segments" in tables:
            stored = self.spark.read.parquet(self._path("segments", run_id)).select("cluster", "label").orderBy("cluster")
            names = [{"cluster": int(r["cluster"]), "label": r["label"]} for r in stored.collect()]  # one row per segment
        entry = {"kind": SAVED, "at": now_iso(), "tables": list(tables), "segments": names, "summary": {"created_at": now_iso(), **summary}}
        if not self.log.put(run_id, 0, entry):
            raise RunExists(f"run {run_id} is already published")

    def save_run(self, result, run_id: str | None = None, file_name: str = "analysis",
                 dataset_context: str = "", created_at: str | None = None) -> str:
        """Persist every result table of a ``SegmentationResult``, then publish the run."""
        run_id = run_id or new_run_id()
        m, n_rows = result.metrics, result.metadata.get("n_rows")
        seg = result.segments
        for f in LIST_FIELDS:
            if f not in seg.columns:
                seg = seg.withColumn(f, F.array().cast("array<string>"))
        for f in TEXT_FIELDS:
            if f not in seg.columns:
                seg = seg.withColumn(f, F.lit("").cast("string"))
        given = {"segments": seg, "cluster_sizes": result.sizes, "k_curve": result.k_curve,
                 **{name: getattr(result, name) for name in ("numeric_profile", "category_profile", "numeric_evidence", "categorical_evidence")},
                 "labelled_rows": result.labelled.drop("features")}
        tables = {name: df for name, df in given.items() if df is not None}
        for name, df in tables.items():
            self.write(name, run_id, df)
        number = lambda key: None if m[key] is None else float(m[key])
        self.publish(run_id, list(tables), created_at=created_at or now_iso(), file_name=file_name, dataset_context=dataset_context,
                     n_rows=int(n_rows or 0), n_cols=len(result.labelled.columns), optimal_k=int(m["optimal_k"]), n_clusters=int(m["n_clusters"]),
                     silhouette=number("silhouette"), calinski_harabasz=number("calinski_harabasz"), davies_bouldin=number("davies_bouldin"),
                     grade=m["grade"], grade_label=m["grade_label"], caution=m["caution"], flat_k_curve=bool(m["flat_k_curve"]),
                     forced_k_min=bool(m["forced_k_min"]), refinements=int(m["refinements"]))
        return run_id

    # -- read
    def read(self, table: str, run_id: str) -> DataFrame | None:
        """One table of a published run with its ``run_id`` as text; None where there is none."""
        manifest = self._manifest(run_id)
        if manifest is None or table not in manifest["tables"]:
            return None
        return self.spark.read.parquet(self._path(table, run_id)).withColumn("run_id", F.lit(run_id))

    def get_run(self, run_id: str) -> dict[str, DataFrame] | None:
        """Every table of one run, its summary (``runs``) and groups; None when the id is malformed or unknown."""
        manifest = self._manifest(run_id)
        if manifest is None:
            return None
        out = {t: self.spark.read.parquet(self._path(t, run_id)).withColumn("run_id", F.lit(run_id)) for t in manifest["tables"]}
        commits = self._commits(run_id)
        out["runs"] = commits.where(F.col("kind") == SAVED).select(F.col("log").alias("run_id"), "summary.*")
        out["custom_groups"] = self.groups(run_id)
        if "segments" in out:
            out["segments"] = self.effective_segments(run_id)
        return out

    def delete_run(self, run_id: str) -> bool:
        """The log goes first: from then on the run does not exist, whatever is left of its tables."""
        manifest = self._manifest(run_id)
        if manifest is None:
            return False
        self.log.drop(run_id)
        jvm = self.spark.sparkContext._jvm
        for t in manifest["tables"]:
            path = jvm.org.apache.hadoop.fs.Path(self._path(t, run_id))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return True

    def list_runs(self) -> DataFrame:
        """Newest first, with defaults for missing fields and the latest segment labels in order.

        One scan of all logs: labels are the latest per (run, cluster), then one row per run. A run
        whose manifest is missing or damaged is no run.
        """
        empty = ("run_id string, created_at string, file_name string, n_rows long, n_cols long, n_segments long, optimal_k int, "
                 "grade string, grade_label string, silhouette double, segment_labels array<string>")
        commits = self.log.read(_SCHEMA)
        if commits is None:
            return self.spark.createDataFrame([], empty)
        saved = F.col("kind") == SAVED
        named = F.struct(F.col("cluster").alias("c"), F.col("label").alias("name"))
        cells = F.when(saved, F.concat(F.array(F.struct(F.lit(None).cast("int").alias("c"), F.lit(None).cast("string").alias("name"))),
                                       F.transform("segments", lambda s: F.struct(s["cluster"].alias("c"), s["label"].alias("name")))))
        rows = (commits.where(F.col("kind").isin(SAVED, EDIT)).select(F.col("log").alias("run_id"), "number", F.when(saved, F.col("summary")).alias("summary"),
                                                                      F.inline(F.coalesce(cells, F.array(named)))))
        latest = rows.groupBy("run_id", "c").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("number"))).alias("name"), F.max("summary").alias("summary"))
        labels = F.transform(F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "name")))), lambda s: s["name"])
        runs = latest.groupBy("run_id").agg(labels.alias("segment_labels"), F.max("summary").alias("s")).where(F.col("s").isNotNull())
        default = {"created_at": "", "file_name": "analysis", "n_rows": 0, "n_cols": 0, "grade": K.GRADE_MISSING[0], "grade_label": K.GRADE_MISSING[1]}
        given = lambda f: F.coalesce(F.col("s")[f], F.lit(default[f])).alias(f) if f in default else F.col("s")[f].alias(f)
        return (runs.select("run_id", given("created_at"), given("file_name"), given("n_rows"), given("n_cols"),
                            F.size("segment_labels").cast("long").alias("n_segments"), given("optimal_k"), given("grade"), given("grade_label"),
                            given("silhouette"), "segment_labels").orderBy(F.desc("created_at"), "run_id"))

    # -- curation
    def edit_segment(self, run_id: str, cluster: int, validated: bool | None = None, **changes: Any) -> int:
        """Partial edit of label / text / list fields; lists are trimmed and blanks removed.
        The caution level is not editable. One commit, whose number is returned."""
        bad = set(changes) - set(LIST_FIELDS) - set(TEXT_FIELDS)
        if bad:
            raise ValueError(f"not editable: {sorted(bad)}")
        if int(cluster) not in {s["cluster"] for s in self._need(run_id)["segments"]}:
            raise RunNotFound(f"run {run_id} has no cluster {cluster}")
        given = dict(changes)
        for f in set(changes) & set(LIST_FIELDS):
            stripped = (str(entry).strip() for entry in changes[f])
            given[f] = list(filter(None, stripped))
        return self.log.append(run_id, {"kind": EDIT, "at": now_iso(), "cluster": int(cluster), "validated": validated, **given})

    def effective_segments(self, run_id: str) -> DataFrame:
        """Base segments with the latest non-NULL edit of each field laid over them."""
        self._need(run_id)
        base = self.spark.read.parquet(self._path("segments", run_id)).withColumn("run_id", F.lit(run_id))
        edits = self._commits(run_id).where(F.col("kind") == EDIT)
        fields = [*TEXT_FIELDS, *LIST_FIELDS, "validated"]
        latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("number"))).alias(f"__e_{f}") for f in fields]
        last = edits.groupBy("cluster").agg(F.max_by("at", "number").alias("curated_at"), *latest)
        shown = [F.coalesce(F.col(f"__e_{f}"), F.col(f)).alias(f) if f in base.columns else F.col(f"__e_{f}").alias(f) for f in fields]
        kept = [c for c in base.columns if c not in fields]
        return base.join(last, "cluster", "left").select(*kept, *shown, "curated_at")

    # -- custom groups (H4)
    def save_group(self, run_id: str, description: str, filters: Sequence[Any], n: int, share: float) -> str:
        self._need(run_id)
        gid = new_run_id()
        payload = json.dumps([f.__dict__ if hasattr(f, "__dict__") else f for f in filters])
        self.log.append(run_id, {"kind": GROUP, "at": now_iso(), "group_id": gid, "description": description, "filters": payload, "n": int(n), "share": float(share)})
        return gid

    def groups(self, run_id: str) -> DataFrame:
        """(group_id, created_at, description, filters, n, share) of the groups that were not removed."""
        self._need(run_id)
        commits = self._commits(run_id)
        removed = commits.where(F.col("kind") == GROUP_REMOVED).select("group_id")
        return (commits.where(F.col("kind") == GROUP).join(removed, "group_id", "left_anti")
                .select("group_id", F.col("at").alias("created_at"), "description", "filters", "n", "share"))

    def group_filters(self, run_id: str) -> dict[str, list[Filter]]:
        """The filters of every saved group by its id: a handful of user-made rows."""
        return {r["group_id"]: as_filters(json.loads(r["filters"])) for r in self.groups(run_id).orderBy("created_at", "group_id").collect()}

    def delete_group(self, run_id: str, group_id: str) -> bool:
        if self._manifest(run_id) is None or self.groups(run_id).where(F.col("group_id") == group_id).isEmpty():
            return False
        self.log.append(run_id, {"kind": GROUP_REMOVED, "at": now_iso(), "group_id": group_id})
        return True
