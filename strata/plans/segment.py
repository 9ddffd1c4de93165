"""End-to-end segmentation: a plain function holding DataFrames, every data stage a Spark job.

validate (S6) → select columns → rules (C*) → prepare (T*) → k search (M3–M6) → fit (M1) →
refinement gate (M7) → labels (M8) → metrics (E1–E5) → profiles and evidence (E6–E9) →
grade and caution (E11, E12) → segment table (E13). Fits and scores run on the weighted
distinct feature rows, the only thing that is shuffled and cached for them; the original rows
are labelled in place by a projection. The driver only sees per-column statistics, the
≤ 9-point k curve and k centroids. Nothing here depends on the number of rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ladders import caution_from_silhouette, quality_grade
from ..functions.rounding import round_half_even
from ..functions.types import dtype_of, is_numeric, number, q
from ..operators import cluster as C
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators.prepare import Strategy, derive_strategy, fit_features
from ..operators.rules import apply_rules, select_columns, year_of
from ..sources.tables import validate_table


@dataclass
class SegmentConfig:
    columns: Sequence[str] | None = None
    k_min: int = K.K_MIN
    k_max: int = K.K_MAX
    n_init: int = K.KMEANS_N_INIT
    refine_n_init: int = K.REFINE_N_INIT
    score: str = "silhouette"               # silhouette (exact, quadratic work) | centroid_silhouette (linear)
    ordinal_mappings: dict[str, list] = field(default_factory=dict)
    extract_datetime: bool = True
    algorithm: str = "kmeans"               # kmeans | hierarchical | bisecting
    pca_components: Any = None              # None: no reduction; a count, or a share of the variance


@dataclass
class SegmentModel:
    """A fitted segmentation: feature plan + KMeans model + id renumbering.

    ``transform`` is projection + model scoring only, so it applies to new batch data and
    to streaming DataFrames (``readStream``) without refitting.
    """
    plan: Any
    fit: C.Fit
    mapping: dict[int, int]
    names: dict[int, str] = field(default_factory=dict)
    features: str = "features"

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None, out: str = "cluster",
                  segment_col: str | None = "segment") -> DataFrame:
        res = C.assign(self.plan.transform(df, keep, self.features), self.fit, self.features, out, self.mapping)
        if segment_col:
            pairs = [x for k, v in self.names.items() for x in (F.lit(k), F.lit(v))]
            name = F.create_map(*pairs)[F.col(out)] if pairs else F.lit(None).cast("string")
            res = res.withColumn(segment_col, F.coalesce(name, F.lit(K.UNKNOWN_SEGMENT)))
        return res


@dataclass
class SegmentationResult:
    labelled: DataFrame                 # original rows + derived years + features + cluster
    k_curve: DataFrame
    metrics: dict[str, Any]
    sizes: DataFrame
    numeric_profile: DataFrame
    category_profile: DataFrame
    numeric_evidence: DataFrame
    categorical_evidence: DataFrame
    segments: DataFrame
    report: Any
    metadata: dict[str, Any]
    model: SegmentModel | None = None


def _feature_plan(table: DataFrame, columns: Sequence[str], cfg: SegmentConfig):
    """The fitted plan; where the derived strategy fails on odd data, that of the plain one."""
    derived = derive_strategy(table.select(*[q(c) for c in columns]), cfg.ordinal_mappings)
    derived.pca_components = cfg.pca_components
    try:
        return fit_features(table, derived, columns=columns), None
    except (ValueError, ArithmeticError, PySparkException) as exc:  # what odd data raise: fall back once, and say so
        return fit_features(table, Strategy(pca_components=cfg.pca_components), columns=columns), f"{type(exc).__name__}: {exc}"


def segment(df: DataFrame, config: SegmentConfig | None = None) -> SegmentationResult:
    cfg = config or SegmentConfig()
    spark = df.sparkSession
    validate_table(df)
    selected = select_columns(df, cfg.columns)
    _, report = apply_rules(selected, cfg.extract_datetime)
    if not report.kept:
        raise ValueError("every column was filtered out; choose other columns")
    years = [year_of(selected, o, report.date_formats.get(o)).alias(n) for o, n in report.datetime_extracted]
    # every original column travels with the row; only the selection feeds the features
    base = df.select("*", *years)
    kept = report.kept
    plan, fallback = _feature_plan(base, kept, cfg)
    if not plan.names:
        raise ValueError("no usable feature after preparation")
    rows = C.weighted_rows(plan.transform(base, keep=[]))
    n = int(rows.agg(F.sum(C.WEIGHT)).first()[0])
    search = C.search_k(rows, k_min=cfg.k_min, k_max=cfg.k_max, n_init=cfg.n_init, seed=K.RANDOM_SEED, score=cfg.score)
    k, model, refinements = search.optimal_k, None, 0
    features = plan.transform(base)
    if cfg.algorithm in ("hierarchical", "bisecting"):
        labelled = (C.hierarchical if cfg.algorithm == "hierarchical" else C.bisecting)(features, k)
        score = C.SCORES[cfg.score](labelled, "features", "cluster")
    else:
        fit, score = search.fits[k], dict((kk, s) for kk, _, s in search.curve)[k]
        if C.should_refine(score, 0):
            # seeds seed..seed+n_init−1 were already fitted in the search (fits are deterministic
            # per seed): only the remaining refinement seeds are new work
            extra = max(0, cfg.refine_n_init - cfg.n_init)
            refit = C.kmeans(rows, k, n_init=extra, seed=K.RANDOM_SEED + cfg.n_init) if extra else fit
            refinements = 1
            if refit.cost < fit.cost:
                fit, score = refit, C.score_fit(rows, refit, cfg.score)
        mapping = C.renumber_map(fit.predict(rows), "__pred", fit.centers)
        model = SegmentModel(plan, fit, mapping, {new: f"Segment {new}" for new in mapping.values()})
        labelled = C.assign(features, fit, mapping=mapping)
    rows.unpersist()
    grade, grade_label = quality_grade(score)
    sizes = E.cluster_share(labelled)
    found = {r["cluster"]: r["n"] for r in sizes.collect()}  # one row per cluster
    noise = found.pop(E.NOISE, 0)
    warning = None if len(found) >= 2 else "fewer than 2 clusters besides noise: no metric can be computed"
    metrics = {"silhouette": score, "calinski_harabasz": None if warning else E.calinski_harabasz(labelled).first()[0],
               "davies_bouldin": None if warning else E.davies_bouldin(labelled).first()[0],
               "n_clusters": len(found), "noise_points": noise, "warning": warning, "optimal_k": k, "grade": grade, "grade_label": grade_label,
               "caution": caution_from_silhouette(score), "refinements": refinements, "flat_k_curve": search.flat,
               "forced_k_min": search.forced_k_min, "elbow_k": search.elbow_k, "score": cfg.score}
    described = list(selected.columns) + [name for _, name in report.datetime_extracted]
    numeric = [c for c in described if is_numeric(dtype_of(base, c))]
    others = [c for c in described if c not in numeric]

    def over(columns: Sequence[str], make):
        return make(labelled, list(columns)) if columns else None

    segments = sizes.select(
        "cluster", F.concat(F.lit("Segment "), F.col("cluster").cast("string")).alias("label"),
        F.col("n").alias("size"), F.col("pct").alias("prevalence"),
        F.lit(metrics["caution"]).alias("caution"))
    return SegmentationResult(
        labelled, search.to_df(spark), metrics, sizes, over(numeric, E.numeric_profile), over(others, E.category_profile),
        over([c for c in kept if c in numeric], V.numeric_evidence), over([c for c in kept if c in others], V.categorical_evidence),
        segments, report, {"prepare": plan.metadata, "prepare_fallback": fallback, "feature_names": plan.names,
                           "k_search": search.curve, "n_rows": n}, model)


def summary_table(res: SegmentationResult) -> DataFrame:
    """Flagship output: one row per segment with size, prevalence and the run's quality."""
    m = res.metrics
    sil = m["silhouette"]
    return res.segments.select(
        "cluster", "label", "size", "prevalence", "caution",
        F.lit(None if sil is None else float(sil)).cast("double").alias("silhouette"),
        F.lit(m["grade"]).alias("grade"), F.lit(int(m["optimal_k"])).alias("k"),
    ).withColumn("silhouette", round_half_even(F.col("silhouette"), 4))


def segment_map(res: SegmentationResult, keep: Sequence[str] = ()) -> DataFrame:
    """G1 for a segmentation: PCA of the prepared features when they have ≥ 2 dimensions,
    else of the standardised raw numeric columns (means fill NULLs); fewer than 2 → empty."""
    from ..operators.charts import pca_map
    from ..operators.prepare import scaler_params, scale_expr

    lab = res.labelled
    if len(res.metadata.get("feature_names", [])) >= 2:
        return pca_map(lab, "features", "cluster", keep=keep)
    numeric = [c for c in lab.columns if c not in ("cluster", "features") and is_numeric(dtype_of(lab, c))]
    if len(numeric) < 2:
        return pca_map(lab.withColumn("features", F.array().cast("array<double>")), "features", "cluster", keep=keep)
    means = lab.agg(*[F.avg(number(lab, c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
    carried = [*[q(c) for c in keep], F.col("cluster")]
    filled = lab.select(*carried, *[F.coalesce(number(lab, c), F.lit(means[i] or 0.0)).alias(f"__n{i}") for i, c in enumerate(numeric)])
    names = [f"__n{i}" for i in range(len(numeric))]
    params = scaler_params(filled, names, "standard")
    return pca_map(filled.select(*carried, F.array(*[scale_expr(c, params[c]) for c in names]).alias("features")), "features", "cluster", keep=keep)
