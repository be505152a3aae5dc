"""Training and model selection (L1-L8) with Spark ML.

Algorithms per task (same folds, same prep stages):
  classification: logistic regression, decision tree, random forest,
  gradient-boosted trees, linear SVM with Platt scaling, multilayer perceptron;
  regression: linear regression, decision tree, random forest,
  gradient-boosted trees, generalized linear model, factorization machine.
Kernel SVM / SVR / MLP regression have no Spark ML counterpart and are not built.

``search`` prepares every split once (imputation, scaling and encoding fitted
on its training rows, in passes that all splits share, synthetic minority rows added to those only), writes the
prepared split to the shared folder, fits the whole grid of every
algorithm on it, keeps the scored rows and deletes the split; two splits are there at a time.
Driver threads only submit fits.  A result row holds the
best parameters of one (algorithm, variant) with its out-of-fold, in-sample
and later-period metrics.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from panelspark.functions.constants import LEAKAGE_ACCURACY_THRESHOLD, LEAKAGE_R2_THRESHOLD, SEED
from panelspark.operators import metrics as M
from panelspark.plans.prep import fit_preps, smote, temporal_split
from panelspark.session import cut_lineage, forget, free_shuffles

# --- FIXED VALUES: published grids; C is the inverse of n times Spark's regParam, depth 30 (Spark's limit) stands for unlimited.
# glm and factorization_machine stand in for SVR and MLP regression, which Spark has not; their values are our own.
CLASSIFICATION_GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0]},
    "decision_tree": {"max_depth": [4, 8, 30]},
    "random_forest": {"n_estimators": [150, 300], "max_depth": [8, 30]},
    "gradient_boosting": {"n_estimators": [150, 300], "max_depth": [3, 6]},
    "svm": {"C": [1.0, 10.0]},
    "mlp": {"hidden": [[32], [64, 32]]},
}
REGRESSION_GRIDS: dict[str, dict[str, list]] = {
    "linear_regression": {},
    "decision_tree": {"max_depth": [4, 8, 30]},
    "random_forest": {"n_estimators": [150, 300], "max_depth": [8, 30]},
    "gradient_boosting": {"n_estimators": [150, 300], "max_depth": [3, 6]},
    "glm": {"C": [1.0, 10.0]},
    "factorization_machine": {"factors": [4, 8]},
}
SPLITS = 2   # that are on disk at a time
PRIMARY = {"classification": "f1_macro", "regression": "r2"}


class F1MacroEvaluator(Evaluator):
    """Macro-averaged F1 over the two classes (the built-in 'f1' is weighted)."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        row = M.confusion_and_prf(dataset, self.labelCol, self.predictionCol).select("f1_macro").first()
        return float(row["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


class R2Evaluator(Evaluator):
    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(M.regression_metrics(dataset, self.labelCol, self.predictionCol).first()["r2"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def platt_svm(features: str = "features", label: str = "label", reg: float = 0.0) -> list:
    """Linear SVM + Platt scaling: a logistic regression on the SVM margin yields probabilities."""
    return [LinearSVC(featuresCol=features, labelCol=label, regParam=reg, maxIter=50, rawPredictionCol="svm_raw",
                      predictionCol="svm_pred"),
            VectorSlicer(inputCol="svm_raw", outputCol="svm_margin_vec", indices=[1]),
            LogisticRegression(featuresCol="svm_margin_vec", labelCol=label)]


def estimator(kind: str, algorithm: str, params: Mapping, n_rows: int, n_features: int) -> list:
    """Unfitted stages of an algorithm over ``features`` and ``label``; unknown names raise KeyError."""
    cols = {"featuresCol": "features", "labelCol": "label"}
    reg = 1.0 / (params["C"] * max(n_rows, 1)) if "C" in params else 0.0
    depth, trees = params.get("max_depth", 5), params.get("n_estimators", 30)
    if kind == "classification":
        make = {
            "logistic_regression": lambda: [LogisticRegression(**cols, maxIter=50, regParam=reg)],
            "decision_tree": lambda: [DecisionTreeClassifier(**cols, maxDepth=depth, seed=SEED)],
            "random_forest": lambda: [RandomForestClassifier(**cols, numTrees=trees, maxDepth=depth, seed=SEED)],
            "gradient_boosting": lambda: [GBTClassifier(**cols, maxIter=trees, maxDepth=depth, seed=SEED)],
            "svm": lambda: platt_svm(reg=reg),
            "mlp": lambda: [MultilayerPerceptronClassifier(**cols, layers=[n_features, *params.get("hidden", [16]), 2],
                                                           maxIter=50, seed=SEED)],
        }
    else:
        make = {
            "linear_regression": lambda: [LinearRegression(**cols)],
            "decision_tree": lambda: [DecisionTreeRegressor(**cols, maxDepth=depth, seed=SEED)],
            "random_forest": lambda: [RandomForestRegressor(**cols, numTrees=trees, maxDepth=depth, seed=SEED)],
            "gradient_boosting": lambda: [GBTRegressor(**cols, maxIter=trees, maxDepth=depth, seed=SEED)],
            "glm": lambda: [GeneralizedLinearRegression(**cols, family="gaussian", regParam=reg)],
            "factorization_machine": lambda: [FMRegressor(**cols, factorSize=params.get("factors", 4), maxIter=50, seed=SEED)],
        }
    return make[algorithm]()


def expand_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the first values first; one empty combination for an empty grid."""
    return [dict(zip(grid, v)) for v in itertools.product(*grid.values())]


@dataclass
class Result:
    """Best parameters of one (algorithm, variant) and what they reach."""
    task: str
    kind: str
    algorithm: str
    smote: bool
    params: dict
    fold_scores: list[float]
    metrics: dict            # out of fold; numbers are None when redacted
    temporal: dict           # fitted on earlier periods, measured on the latest
    in_sample: float
    leakage_flag: bool
    n_rows: int
    features: list[str]
    model: PipelineModel = field(repr=False)

    @property
    def score(self) -> float | None:
        return self.metrics.get(PRIMARY[self.kind])

    @property
    def cv_mean(self) -> float:
        return sum(self.fold_scores) / len(self.fold_scores)

    @property
    def cv_std(self) -> float:
        m = self.cv_mean
        return (sum((x - m) ** 2 for x in self.fold_scores) / len(self.fold_scores)) ** 0.5


@dataclass
class _Split:
    name: str
    train: dict[bool, DataFrame]     # by variant
    test: DataFrame
    n_rows: dict[bool, int]
    prep: PipelineModel


def _prepare(name: str, train: DataFrame, test: DataFrame, prep: PipelineModel, variants: Sequence[bool]) -> _Split:
    te = cut_lineage(prep.transform(test).select("row_id", "features", "label", "fold"), f"split-{name}-test")
    # all rows are both sides of the full split
    tr = te.drop("fold") if train is test else cut_lineage(prep.transform(train).select("row_id", "features", "label"), f"split-{name}")
    frames = {False: tr}
    if True in variants:
        frames[True] = tr.unionByName(smote(tr, "features", "label", "row_id"))
    return _Split(name, {v: frames[v] for v in variants}, te, {v: frames[v].count() for v in variants}, prep)


def _redact(kind: str, metrics: dict) -> tuple[dict, bool]:
    high = metrics["accuracy"] > LEAKAGE_ACCURACY_THRESHOLD if kind == "classification" else (metrics["r2"] or 0) > LEAKAGE_R2_THRESHOLD
    return ({k: None for k in metrics}, True) if high else (metrics, False)


def _scored(kind: str, rows: DataFrame, name: str) -> DataFrame:
    """Scored rows without their vectors, written: several metrics read them, and the split may go."""
    more = [vector_to_array("probability")[1].alias("y_score")] if kind == "classification" else []
    return cut_lineage(rows.select("fold", "label", "prediction", *more), f"scored-{name}")


def _measure(kind: str, scored: DataFrame) -> dict:
    if kind == "classification":
        m = M.confusion_and_prf(scored, "label", "prediction").first().asDict()
        m["roc_auc"] = M.roc_auc(scored, "label", "y_score").first()["roc_auc"]
        return m
    return M.regression_metrics(scored, "label", "prediction").first().asDict()


def _fold_scores(kind: str, oof: DataFrame, k: int) -> list[float]:
    """Primary metric of every fold from one job (a row per fold)."""
    if kind == "classification":
        got = {r["fold"]: r["f1_macro"] for r in M.confusion_and_prf(oof, "label", "prediction", by=["fold"]).collect()}
    else:
        e = F.col("label") - F.col("prediction")
        r2 = 1 - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))
        got = {r["fold"]: r["r2"] for r in oof.groupBy("fold").agg(r2.alias("r2")).collect()}
    return [float(got.get(i) or 0.0) for i in range(k)]


def search(df: DataFrame, task: str, kind: str, numeric: Sequence[str], categorical: Sequence[str], label_col: str,
           time_col: str, key: Sequence[str], k: int, grids: Mapping[str, Mapping[str, Sequence]] | None = None,
           variants: Sequence[bool] | None = None, parallelism: int = 8, kept: dict | None = None) -> list[Result]:
    """The whole grid of every algorithm over the folds; one result per (algorithm, variant).

    ``df`` carries a ``fold`` column (``prep.group_folds``) and unique
    ``key`` columns.  Variants are without and, for classification, with
    synthetic minority rows.  The best parameters (first of equals) are
    refitted on all rows (the model that is kept) and on all but the latest
    period (the later-period metrics).  ``kept`` receives the prepared split
    of the latest period.
    """
    grids = grids or (CLASSIFICATION_GRIDS if kind == "classification" else REGRESSION_GRIDS)
    variants = tuple(variants if variants is not None else ((False, True) if kind == "classification" else (False,)))
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    data = cut_lineage(df.withColumns({"label": F.col(label_col).cast("double"), "row_id": name}).filter(F.col("label").isNotNull()), "search")
    early, late = temporal_split(data, time_col)
    halves = [(f"fold{i}", data.filter(F.col("fold") != i), data.filter(F.col("fold") == i)) for i in range(k)]
    halves += [("full", data, data), ("temporal", early, late)]
    # every training side is a union of the groups (fold, before the latest period)
    latest = data.agg(F.max(time_col)).first()[0]
    sides: dict[str, Callable[[Row], bool]] = {f"fold{i}": lambda r, i=i: r["fold"] != i for i in range(k)}
    sides |= {"full": lambda r: True, "temporal": lambda r: bool(r["_early"])}
    preps = fit_preps(data.withColumn("_early", F.col(time_col) < F.lit(latest)), numeric, categorical, ["fold", "_early"], sides,
                      {name: train for name, train, _ in halves})
    free_shuffles(df.sparkSession)
    data_rows = data.count()

    def on_split(pool: ThreadPoolExecutor, half: tuple, jobs: Sequence[tuple[str, bool, dict]], made: Callable, keep: bool = False) -> list:
        """``made(split, fitted, job)`` of every job; the split is there that long."""
        split = _prepare(*half, preps[half[0]], variants)
        row = split.train[variants[0]].select("features").first()
        n_features = len(row["features"]) if row else 0
        if kept is not None and keep:
            kept[split.name] = split

        def one(job: tuple[str, bool, dict]):
            algorithm, variant, params = job
            stages = estimator(kind, algorithm, params, split.n_rows[variant], n_features)
            return made(split, Pipeline(stages=stages).fit(split.train[variant]), job)
        try:
            return list(pool.map(one, jobs))
        finally:
            if kept is None or not keep:
                for table in (split.test, *split.train.values()):
                    forget(table)
            free_shuffles(df.sparkSession)

    def held_out(split: _Split, fitted: PipelineModel, job: tuple) -> DataFrame:
        return _scored(kind, fitted.transform(split.test), split.name)

    def inside(split: _Split, fitted: PipelineModel, job: tuple) -> tuple[PipelineModel, DataFrame]:
        return PipelineModel(stages=[split.prep, *fitted.stages]), held_out(split, fitted, job)

    jobs = [(a, v, p) for a in grids for v in variants for p in expand_grid(grids[a])]
    # driver threads that wait for Spark; a split is prepared while the one before is fitted on
    with ThreadPoolExecutor(max(1, parallelism)) as pool, ThreadPoolExecutor(SPLITS) as some:
        folds = list(some.map(lambda half: on_split(pool, half, jobs, held_out), halves[:k]))
        out_of_fold = [reduce(DataFrame.unionByName, parts) for parts in zip(*folds)]
        best: dict[tuple[str, bool], tuple] = {}
        for job, oof, scores in zip(jobs, out_of_fold, pool.map(lambda oof: _fold_scores(kind, oof, k), out_of_fold)):
            have = best.get(job[:2])
            if have is None or sum(scores) > sum(have[1]):
                best[job[:2]] = (job, scores, oof)
        found = list(best.values())
        chosen = [job for job, _, _ in found]
        last = [some.submit(on_split, pool, halves[k], chosen, inside), some.submit(on_split, pool, halves[k + 1], chosen, held_out, True)]
        full, later = (x.result() for x in last)
        measured = list(pool.map(lambda rows: _measure(kind, rows), [*[x for _, x in full], *later, *[oof for _, _, oof in found]]))
    for rows in [*[x for _, x in full], *later, *out_of_fold, data]:
        forget(rows)
    results, n = [], len(found)
    for i, ((algorithm, variant, params), scores, _) in enumerate(found):
        in_sample, (metrics, flag), (temporal, flag_late) = measured[i], _redact(kind, measured[2 * n + i]), _redact(kind, measured[n + i])
        results.append(Result(task, kind, algorithm, variant, params, scores, metrics, temporal,
                              in_sample["accuracy"] if kind == "classification" else in_sample["r2"], flag or flag_late, data_rows,
                              [*numeric, *categorical], full[i][0]))
    return results


def results_frame(spark, results: Sequence[Result]) -> DataFrame:
    """One row per (task, algorithm, variant); metrics that crossed the leakage limit are null."""
    rows = []
    for r in results:
        m, t = r.metrics, r.temporal
        num = lambda v: None if v is None else float(v)
        rows.append((r.task, r.algorithm, r.smote, json.dumps(r.params, sort_keys=True), num(r.score), num(r.cv_mean), num(r.cv_std),
                     num(m.get("accuracy")), num(m.get("roc_auc")), num(m.get("rmse")), num(m.get("mae")), num(r.in_sample),
                     num(r.in_sample - r.cv_mean), num(t.get(PRIMARY[r.kind])), num(t.get("accuracy")), num(t.get("rmse")),
                     r.leakage_flag, r.n_rows))
    return spark.createDataFrame(rows, "task string, algorithm string, smote boolean, params string, cv_score double, cv_mean double, "
                                       "cv_std double, cv_accuracy double, roc_auc double, rmse double, mae double, in_sample double, "
                                       "train_test_gap double, temporal_score double, temporal_accuracy double, temporal_rmse double, "
                                       "leakage_flag boolean, training_rows long")


def best_variants(results: Sequence[Result]) -> list[Result]:
    """The better variant of every (task, algorithm); no score or 0 ranks last, the first of equals stays."""
    best: dict[tuple[str, str], Result] = {}
    for r in results:
        have = best.get((r.task, r.algorithm))
        if have is None or (r.score or float("-inf")) > (have.score or float("-inf")):
            best[(r.task, r.algorithm)] = r
    return list(best.values())


def champion(results: Sequence[Result]) -> Result | None:
    """The best scored, unflagged result; the first by name of equals; None without any."""
    fit = [r for r in results if not r.leakage_flag and r.score is not None]
    return min(fit, key=lambda r: (-r.score, r.algorithm), default=None)


def redact_suspicious(metrics: DataFrame, kind: str, acc_col: str = "cv_accuracy", r2_col: str = "cv_score") -> DataFrame:
    """Accuracy > .96 (classification) or R2 > .95 (regression), strict, flags leakage and
    nulls every numeric metric; non-scalar columns are kept; nothing is dropped."""
    flag = (F.col(acc_col) > LEAKAGE_ACCURACY_THRESHOLD) if kind == "classification" else (F.col(r2_col) > LEAKAGE_R2_THRESHOLD)
    flag = F.coalesce(flag, F.lit(False))
    numeric = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("double", "float")]
    x = metrics.withColumn("leakage_flag", flag)
    return x.withColumns({c: F.when(~F.col("leakage_flag"), F.col(c)) for c in numeric})


def select_champion(metrics: DataFrame, score: str = "cv_score", variant: str | None = "smote") -> DataFrame:
    """L8 over a metrics table: best variant per (task, algorithm), then the best unflagged algorithm per task.

    Among variants no score or 0 ranks last; a task without any score has no
    champion.  Equal scores: the variant without synthetic rows, then the
    last algorithm by name.
    """
    x = metrics
    if variant and variant in metrics.columns:
        low = F.when(F.col(score) == 0.0, F.lit(None)).otherwise(F.col(score))
        order = F.struct(F.coalesce(low, F.lit(float("-inf"))), ~F.col(variant))
        x = (x.withColumn("_o", order).groupBy("task", "algorithm").agg(F.max_by(F.struct(*metrics.columns), F.col("_o")).alias("_r"))
             .select("_r.*"))
    x = x.filter(~F.coalesce(F.col("leakage_flag"), F.lit(False)) & F.col(score).isNotNull())
    best = x.groupBy("task").agg(F.max(F.struct(F.col(score).alias("s"), "algorithm")).alias("_b"))
    return best.select("task", F.col("_b.algorithm").alias("algorithm"), F.col("_b.s").alias(score))


def activate_exclusive(registry: DataFrame, task: str, version: str) -> DataFrame:
    """Exactly one active version per task (only that task's rows change)."""
    return registry.withColumn("is_active", F.when(F.col("task") == task, F.col("version") == version)
                               .otherwise(F.col("is_active")))


def activate_champions(registry: DataFrame, champions: DataFrame) -> DataFrame:
    """L9 for all tasks at once: in a task with a champion only its version is active; the others stay as they are."""
    won = champions.select("task", F.concat_ws("__", "task", "algorithm").alias("_won"))
    x = registry.join(F.broadcast(won), "task", "left")   # a row per task
    return x.withColumn("is_active", F.coalesce(F.col("version") == F.col("_won"), F.col("is_active"))).select(*registry.columns)


def comparison_table(registry: DataFrame) -> DataFrame:
    """Metric name per task, value read from the JSON metrics, leakage flag; ordered."""
    name = F.when(F.col("task") == "risk_classification", F.lit("f1_macro")).otherwise(F.lit("r2"))
    value = F.when(F.col("task") == "risk_classification", F.get_json_object("metrics", "$.f1_macro")) \
        .otherwise(F.get_json_object("metrics", "$.r2")).cast("double")
    flag = F.coalesce(F.get_json_object("metrics", "$.leakage_flag").cast("boolean"), F.lit(False))
    return (registry.select("task", "algorithm", "version", name.alias("metric_name"), value.alias("metric_value"),
                            flag.alias("leakage_flag"), F.lit(None).cast("double").alias("cv_std"),
                            F.lit(None).cast("double").alias("train_test_gap"), "is_active")
            .orderBy("task", "algorithm"))


def grid_search(df: DataFrame, stages: list, estimator, grid: dict, kind: str, k: int = 3, parallelism: int = 2):
    """L3 for any single estimator: exhaustive grid over entity folds (``fold`` column), refit of the best on all rows.

    As ``CrossValidator`` over the pipeline of ``stages`` and ``estimator``,
    but the stages, which the grid does not change, are fitted once per fold
    and the prepared rows are written; only the estimator is fitted per
    combination.
    """
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(getattr(estimator, param), values)
    maps = builder.build()
    evaluator = F1MacroEvaluator() if kind == "classification" else R2Evaluator()
    inputs = [estimator.getFeaturesCol(), estimator.getLabelCol()]

    def prepared(name: str, train: DataFrame, *others: DataFrame) -> tuple[PipelineModel, list[DataFrame]]:
        prep = Pipeline(stages=stages).fit(train)
        return prep, [cut_lineage(prep.transform(x).select(*inputs), f"grid-{name}-{i}") for i, x in enumerate((train, *others))]

    def fold_scores(i: int) -> list[float]:
        _, (train, held) = prepared(f"fold{i}", df.filter(F.col("fold") != i), df.filter(F.col("fold") == i))
        return [evaluator.evaluate(estimator.fit(train, m).transform(held)) for m in maps]

    with ThreadPoolExecutor(max(1, parallelism)) as pool:   # driver threads that wait for Spark
        scores = list(pool.map(fold_scores, range(k)))
    mean = [sum(s) / k for s in zip(*scores)]
    best = max(range(len(maps)), key=lambda j: mean[j])   # the first of equals
    prep, (rows,) = prepared("full", df)
    model = PipelineModel(stages=[prep, estimator.fit(rows, maps[best])])
    return GridResult(model, mean, maps)


@dataclass
class GridResult:
    """What a grid search found, under the names of ``CrossValidatorModel``."""
    bestModel: PipelineModel = field(repr=False)
    avgMetrics: list[float]
    maps: list[dict] = field(repr=False)

    def getEstimatorParamMaps(self) -> list[dict]:
        return self.maps
