"""The three prediction tasks over the driver tables: training frames, open frames, the trained registry.

T1 risk of a term (gpa < 2), T2 its GPA, T3 the score of a course item.  The
panel's total score is a multiple of its continuous assessment, which would
make T3 a leak; its label is assessment plus an exam taken from the tax
column instead (0 to 70), graded like any score.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.bands import risk_tier
from panelspark.functions.constants import CV_FOLDS, GPA_SCALE
from panelspark.functions.rows import assert_no_leakage, blend_running_mean, column_types, drop_protected, prediction_interval
from panelspark.functions.bands import clip
from panelspark.operators import fairness as FA
from panelspark.plans import features as FT
from panelspark.plans import views as V
from panelspark.plans.model_store import ModelStore
from panelspark.plans.prep import group_folds, prep_stages, smote, stratified_group_folds, temporal_split
from panelspark.plans.train import Result, estimator, search
from panelspark.session import checkpoint_dir, cut_lineage


@dataclass(frozen=True)
class Task:
    name: str
    kind: str
    label: str
    scale: float          # of the label, for the fairness audit
    key: tuple[str, ...]


TASKS = {
    "risk_classification": Task("risk_classification", "classification", "risk_label", 1.0, V.KEY),
    "gpa_regression": Task("gpa_regression", "regression", "target_gpa", GPA_SCALE, V.KEY),
    "course_score": Task("course_score", "regression", "target_total_score", 100.0, ("student_id", "course_id", *V.PERIOD)),
}
GROUP_COLUMNS = ("entry_mode", "employment_status", "accommodation")

# Smaller grids for the registered queries; the library's default is the published ones.
SHORT_GRIDS = {
    "classification": {
        "logistic_regression": {"C": [0.1, 10.0]}, "decision_tree": {"max_depth": [4, 8]},
        "random_forest": {"n_estimators": [20], "max_depth": [6]}, "gradient_boosting": {"n_estimators": [8], "max_depth": [3]},
        "svm": {"C": [1.0]}, "mlp": {"hidden": [[16]]}},
    "regression": {
        "linear_regression": {}, "decision_tree": {"max_depth": [4, 8]},
        "random_forest": {"n_estimators": [20], "max_depth": [6]}, "gradient_boosting": {"n_estimators": [8], "max_depth": [3]},
        "glm": {"C": [1.0]}, "factorization_machine": {"factors": [2]}},
}
# What the queries that need a registry train.
SERVED_GRIDS = {
    "classification": {"logistic_regression": {"C": [1.0]}, "decision_tree": {"max_depth": [4]}},
    "regression": {"linear_regression": {}, "decision_tree": {"max_depth": [4]}},
}


def item_enrolments(t) -> DataFrame:
    """Course items with attendance counts and, when completed, assessment plus exam as their score."""
    e = V.enrolments(t, "l_tax").withColumns({
        "sessions_attended": F.floor(F.col("attendance_rate") * 20 + 0.5).cast("int"), "sessions_held": F.lit(20)})
    return e.withColumn("total_score", F.when(F.col("status") == "completed", F.col("ca_score") + F.col("l_tax") * 875)).drop("l_tax")


def feature_set(t, task: str, ongoing: bool = False) -> FT.FeatureSet:
    """Features of the completed (or the open) rows of a task, guarded against leaks, without protected attributes."""
    if task == "course_score":
        fs = FT.item_features(item_enrolments(t), ongoing=ongoing)
    else:
        fs = _once(t, ("panel", ongoing), lambda: _panel(t, ongoing))
    assert_no_leakage(fs.df, task, fs.feature_cols)
    clean = drop_protected(fs.df)
    return FT.FeatureSet(clean, tuple(c for c in fs.feature_cols if c in clean.columns), fs.label_cols, fs.meta_cols)


def _panel(t, ongoing: bool) -> FT.FeatureSet:
    from panelspark.plans.catalog_features import panel_featureset
    return panel_featureset(t, include_current=ongoing)


def _once(t, what: tuple, make):
    """What ``make`` returned for these tables the first time; other threads wait for it."""
    made = t.__dict__.setdefault("_made", {})
    with t.__dict__.setdefault("_making", {}).setdefault(what, Lock()):
        if what not in made:
            made[what] = make()
        return made[what]


def completed_rows(t, task: str) -> tuple[FT.FeatureSet, DataFrame]:
    """The completed rows' features of a task and its rows, written once for the tasks that share them."""
    fs = feature_set(t, task)
    return fs, _once(t, ("rows", *fs.df.columns), lambda: cut_lineage(fs.df, "training-rows"))


def training_frame(t, task: str) -> tuple[DataFrame, list[str], list[str], int]:
    """(rows with folds, numeric, categorical, number of folds): whole students, stratified for classification; ``CV_FOLDS`` whatever the size."""
    spec = TASKS[task]
    fs, df = completed_rows(t, task)
    numeric, categorical = column_types(fs.df, fs.feature_cols)
    folded = stratified_group_folds(df, V.ENTITY, spec.label, CV_FOLDS) if spec.kind == "classification" else group_folds(df, V.ENTITY, CV_FOLDS)
    return folded, numeric, categorical, CV_FOLDS


def train_task(t, task: str, grids=None, variants=None) -> list[Result]:
    """All algorithms and variants of a task over the driver tables."""
    spec = TASKS[task]
    df, numeric, categorical, k = training_frame(t, task)
    kept = _once(t, ("splits", task), dict)
    return search(df, task, spec.kind, numeric, categorical, spec.label, "session", spec.key, k, grids, variants, kept=kept)


def trained_store(t, *tasks: str) -> ModelStore:
    """The registry for a folder of tables under the shared folder; trains those of ``tasks`` (all without any) that have no rows yet."""
    at = hashlib.md5(t.base.encode()).hexdigest()[:12]
    store = ModelStore(t.spark, f"{checkpoint_dir(t.spark)}/registry-{at}")
    have = {r["task"] for r in store.registry().select("task").distinct().collect()}   # three tasks
    todo = [task for task in TASKS if task not in have and (not tasks or task in tasks)]
    with ThreadPoolExecutor(max(1, len(todo))) as pool:   # driver threads that wait for Spark; tasks fill each other's idle cores
        for results in pool.map(lambda task: train_task(t, task, SERVED_GRIDS[TASKS[task].kind]), todo):
            store.register(results)
    return store


PERIOD_TASKS = ("risk_classification", "gpa_regression")   # whose models score an open period


def score_risk(features: DataFrame, model) -> DataFrame:
    """Probability and tier from a fitted classifier."""
    x = model.transform(features).withColumn("probability", vector_to_array("probability")[1])
    return x.withColumn("risk_tier", risk_tier("probability"))


def score_open(t, store: ModelStore) -> DataFrame:
    """P1 and P2's GPA in one pass: a row per open (student, period) with the active models' predictions.

    probability and risk_tier, predicted GPA (clipped) with an interval of
    the active model's RMSE, and the CGPA that the prediction leads to.
    """
    risk, risk_algorithm = store.load_active("risk_classification")
    gpa, gpa_algorithm = store.load_active("gpa_regression")
    x = cut_lineage(feature_set(t, "risk_classification", ongoing=True).df, "open-rows")
    meta = [*V.KEY, "prior_cgpa", "semesters_completed", "probability", "risk_tier"]
    keep = F.struct(*[F.col(c) for c in ("prior_cgpa", "semesters_completed")]).alias("_raw")
    scored = score_risk(x.select("*", keep), risk).select(*V.KEY, "_raw", "probability", "risk_tier")
    points = gpa.transform(x).select(*V.KEY, F.col("prediction").alias("_gpa"))
    y = scored.join(points, list(V.KEY)).crossJoin(F.broadcast(store.rmse("gpa_regression")))
    point, low, high = prediction_interval("_gpa", "rmse", 0.0, GPA_SCALE)
    # the interval is taken around the clipped point
    y = y.withColumn("predicted_gpa", point)
    _, low, high = prediction_interval("predicted_gpa", "rmse", 0.0, GPA_SCALE)
    y = y.withColumns({"gpa_lower": low, "gpa_upper": high, "prior_cgpa": F.col("_raw.prior_cgpa"),
                       "semesters_completed": F.col("_raw.semesters_completed")})
    y = y.withColumn("projected_cgpa", clip(blend_running_mean("prior_cgpa", "semesters_completed", F.col("predicted_gpa")), 0.0, GPA_SCALE))
    return y.select(*meta, "predicted_gpa", "gpa_lower", "gpa_upper", "projected_cgpa", F.lit(risk_algorithm).alias("risk_algorithm"),
                    F.lit(gpa_algorithm).alias("gpa_algorithm"))


def score_open_items(t, store: ModelStore) -> DataFrame:
    """A row per open course item with the active model's score, clipped to 0-100."""
    model, algorithm = store.load_active("course_score")
    x = model.transform(feature_set(t, "course_score", ongoing=True).df)
    return x.select("student_id", "course_id", *V.PERIOD, clip("prediction", 0.0, 100.0).alias("predicted_score"),
                    F.lit(algorithm).alias("score_algorithm"))


def holdout_predictions(t, task: str, store: ModelStore) -> tuple[DataFrame, str]:
    """(latest period's rows with y_true, y_pred and the group columns, algorithm): the active parameters refitted on earlier periods."""
    spec, row = TASKS[task], store.active_row(task)
    fs, rows = completed_rows(t, task)
    numeric, categorical = column_types(fs.df, fs.feature_cols)
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.key])
    data = rows.withColumns({"label": F.col(spec.label).cast("double"), "row_id": key}).filter(F.col("label").isNotNull())
    split = _once(t, ("splits", task), dict).get("temporal")
    if split is not None and row["use_smote"] in split.train:   # the search prepared the same rows
        _, late = temporal_split(data, "session")
        prep, train = split.prep, split.train[row["use_smote"]]
    else:
        early, late = temporal_split(cut_lineage(data, "holdout"), "session")
        prep = Pipeline(stages=prep_stages(numeric, categorical)).fit(early)
        train = prep.transform(early).select("row_id", "features", "label")
        if row["use_smote"]:
            train = train.unionByName(smote(train, "features", "label", "row_id"))
        train = cut_lineage(train, "holdout-train")
    width = len(train.select("features").first()["features"])
    params = {k: json.loads(v) for k, v in row["hyperparameters"].items()}
    model = Pipeline(stages=estimator(spec.kind, row["algorithm"], params, train.count(), width)).fit(train)
    scored = model.transform(prep.transform(late)).select("student_id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    from panelspark.plans.catalog_features import panel_inputs
    groups = panel_inputs(t)[2].select("student_id", *GROUP_COLUMNS)
    return cut_lineage(scored.join(groups, "student_id", "left"), "holdout-scored"), row["algorithm"]


def fairness_on_holdout(t, task: str, store: ModelStore) -> tuple[DataFrame, DataFrame, dict]:
    """(numbers per group, gaps and flags, nested report) of the active model on the latest period; kept in the registry."""
    spec = TASKS[task]
    scored, algorithm = holdout_predictions(t, task, store)
    if spec.kind == "classification":
        rates, flags = FA.fairness_report(scored, GROUP_COLUMNS)
    else:
        rates, flags = FA.regression_fairness_report(scored, GROUP_COLUMNS, spec.scale)
    rates, flags = cut_lineage(rates, "fairness-rates"), cut_lineage(flags, "fairness-gaps")
    # a row per group value of three declared columns
    report = {"task": task, "algorithm": algorithm, "n_test_rows": scored.count(), "groups": {}}
    for a in GROUP_COLUMNS:
        per = {r["value"]: {k: v for k, v in r.asDict().items() if k not in ("attribute", "value")}
               for r in rates.filter(F.col("attribute") == a).collect()}
        gaps = {r["metric"]: r for r in flags.filter(F.col("attribute") == a).collect()}
        report["groups"][a] = {"per_group": per, "gaps": {m: r["gap"] for m, r in sorted(gaps.items())}, "flagged": any(r["flagged"] for r in gaps.values())}
    report["any_group_flagged"] = any(g["flagged"] for g in report["groups"].values())
    store.attach_fairness(task, report)
    return rates, flags, report
