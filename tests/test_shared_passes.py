"""Steps that several splits or tasks have in common are done once for all of them."""

import math
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelspark.operators import stats
from panelspark.plans import prep as P
from panelspark.plans import tasks as TK
from panelspark.plans import train as TR
from panelspark.plans.features import FeatureSet
from panelspark.sources.tables import Tables

FRAMES = {"fold0": lambda r: r["fold"] != 0, "fold1": lambda r: r["fold"] != 1, "full": lambda r: True, "early": lambda r: bool(r["early"]),
          "none": lambda r: False}


def rows(spark):
    i = F.col("id")
    return spark.range(3000).select(
        i, (i % 2).cast("int").alias("fold"), F.when(i % 11 > 0, i < 1200).alias("early"), (i * 37 % 1009 / 7.0).alias("a"),
        F.when(i % 5 > 0, i % 4).cast("double").alias("crowded"), F.when(i % 3 == 0, i.cast("double")).alias("rising"),
        F.lit(None).cast("double").alias("nothing"), F.when(i % 7 > 0, F.when(i % 3 == 0, "x").when(i % 3 == 1, "y").otherwise("long")).alias("s"),
        (i % 2 == 0).alias("flag"))


def own(name):
    return {"fold0": F.col("fold") != 0, "fold1": F.col("fold") != 1, "full": F.lit(True), "early": F.col("early"), "none": F.lit(False)}[name]


@pytest.mark.parametrize("keep", [5, 10_000])
def test_medians_of_frames_are_those_of_each_frame(spark, keep):
    df, cols = rows(spark), ["a", "crowded", "rising", "nothing"]
    got = stats.medians_of_frames(df, cols, ["fold", "early"], FRAMES, keep)
    assert got == {f: stats.exact_medians(df.filter(own(f)), cols, keep) for f in FRAMES}


def test_preps_of_frames_are_those_of_each_frame(spark):
    df, numeric, categorical = rows(spark), ["a", "crowded", "rising"], ["s", "flag"]
    got = P.fit_preps(df, numeric, categorical, ["fold", "early"], {f: h for f, h in FRAMES.items() if f != "none"},
                      {f: df.filter(own(f)) for f in FRAMES if f != "none"})
    for f, model in got.items():
        want = Pipeline(stages=P.prep_stages(numeric, categorical)).fit(df.filter(own(f)))
        a, b = ({r.id: r.v for r in m.transform(df).select("id", vector_to_array("features").alias("v")).collect()} for m in (model, want))
        assert a.keys() == b.keys() and all(math.isclose(x, y, abs_tol=1e-9) for i in a for x, y in zip(a[i], b[i], strict=True))


def test_search_fits_no_split_by_itself(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(P.ExactMedianImputer, "_fit", lambda self, df: fits.append(1))
    df = rows(spark).limit(400).withColumns({"session": (F.col("id") % 4).cast("int"), "y": F.col("a") * 2.0 + F.col("fold")})
    got = TR.search(df, "t", "regression", ["a"], ["s"], "y", "session", ["id"], 2, {"linear_regression": {}})
    assert not fits and len(got) == 1 and got[0].n_rows == 400 and got[0].leakage_flag   # the label is all but a multiple of a


def test_tasks_of_a_period_share_their_rows(spark, tmp_path, monkeypatch):
    made = []
    df = spark.range(40).select((F.col("id") % 9).alias("student_id"), F.col("id").alias("prior_cgpa"), (F.col("id") % 2).alias("risk_label"))
    monkeypatch.setattr(TK, "_panel", lambda t, ongoing: made.append(ongoing) or FeatureSet(df, ("prior_cgpa",), ("risk_label",), ("student_id",)))
    t = Tables(spark, str(tmp_path))
    frames = [TK.training_frame(t, task)[0] for task in TK.PERIOD_TASKS]
    assert made == [False] and frames[0].count() == frames[1].count() == df.count()


def test_tasks_are_trained_side_by_side_and_registered_in_order(spark, tmp_path, monkeypatch):
    registered, all_three = [], threading.Barrier(3, timeout=20)
    monkeypatch.setattr(TK, "ModelStore", lambda *_: SimpleNamespace(registry=lambda: spark.createDataFrame([], "task string"), register=registered.append))
    monkeypatch.setattr(TK, "train_task", lambda t, task, grids: all_three.wait() >= 0 and task)
    TK.trained_store(Tables(spark, str(tmp_path)))
    assert registered == list(TK.TASKS)


def test_what_is_made_once_is_awaited_by_other_threads(spark, tmp_path):
    made, t = [], Tables(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: TK._once(t, ("x",), lambda: time.sleep(0.2) or made.append(1) or len(made)), range(4)))
    assert got == [1, 1, 1, 1]


def test_holdout_reads_the_split_that_the_search_prepared(spark, tmp_path, monkeypatch):
    from panelspark.plans import catalog_features
    i = F.col("id")
    df = spark.range(240).select((i % 60).alias("student_id"), (2000 + F.floor(i / 60)).cast("int").alias("session"), F.lit(1).alias("semester"),
                                 F.when(i % 7 > 0, i * 37 % 101 / 20.0).alias("prior_cgpa"), (i * 37 % 101 + i % 5 * 3 < 35).cast("int").alias("risk_label"))
    monkeypatch.setattr(TK, "_panel", lambda t, ongoing: FeatureSet(df, ("prior_cgpa",), ("risk_label",), ("student_id", "session", "semester")))
    groups = spark.range(60).select(i.alias("student_id"), *[(i % 2).cast("string").alias(c) for c in TK.GROUP_COLUMNS])
    monkeypatch.setattr(catalog_features, "panel_inputs", lambda t: (None, None, groups))
    fits, fit = [], P.ExactMedianImputer._fit
    monkeypatch.setattr(P.ExactMedianImputer, "_fit", lambda self, x: fits.append(1) or fit(self, x))
    t = Tables(spark, str(tmp_path))
    TK.train_task(t, "risk_classification", {"decision_tree": {"max_depth": [3]}})
    for use_smote in (True, False):
        row = {"algorithm": "decision_tree", "use_smote": use_smote, "hyperparameters": {"max_depth": "3"}}
        store = SimpleNamespace(active_row=lambda task: row)
        got, want = (sorted(TK.holdout_predictions(x, "risk_classification", store)[0].collect()) for x in (t, Tables(spark, str(tmp_path))))
        assert got == want and len(got) == 60
    assert len(fits) == 2   # the tables without a search only


@pytest.mark.parametrize("task", TK.PERIOD_TASKS)
def test_large_tables_have_as_many_folds_as_small_ones(spark, tmp_path, monkeypatch, task):
    df = spark.range(15_000).select((F.col("id") % 3000).alias("student_id"), F.col("id").alias("prior_cgpa"), (F.col("id") % 2).alias("risk_label"))
    monkeypatch.setattr(TK, "_panel", lambda t, ongoing: FeatureSet(df, ("prior_cgpa",), ("risk_label",), ("student_id",)))
    folded, _, _, k = TK.training_frame(Tables(spark, str(tmp_path)), task)
    assert k == 5 and sorted((r["fold"], r["count"]) for r in folded.groupBy("fold").count().collect()) == [(i, 3000) for i in range(5)]


def test_a_split_is_deleted_once_it_is_fitted_on(spark, monkeypatch):
    import os
    folders, there, cut, fit = [], [], TR.cut_lineage, TR.estimator
    monkeypatch.setattr(TR, "cut_lineage", lambda df, name="cut": (lambda x: folders.append((name, x.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])) or x)(cut(df, name)))

    def estimator(*args):
        there.append({f for n, f in folders if n.startswith("split-") and os.path.exists(f.removeprefix("//"))})
        return fit(*args)

    monkeypatch.setattr(TR, "estimator", estimator)
    i = F.col("id")
    df = rows(spark).limit(400).withColumns({"session": (i % 4).cast("int"), "y": (i % 5 == 0).cast("int"), "fold": (i % 4).cast("int")})
    kept: dict = {}
    got = TR.search(df, "t", "classification", ["a"], ["s"], "y", "session", ["id"], 4, {"decision_tree": {"max_depth": [2]}}, kept=kept)
    assert len(got) == 2 and kept["temporal"].train[True].count() > 300 and max(map(len, there)) <= 4   # two splits of two tables each
    left = {n for n, f in folders if os.path.exists(f.removeprefix("//"))}
    assert left == {"split-temporal", "split-temporal-test"}
