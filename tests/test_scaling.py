import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import stats
from panelspark.plans import prep as P
from panelspark.plans import tasks as TK
from panelspark.plans import train as TR


def test_median_between_two_crowded_values_is_found(spark, monkeypatch):
    passes, first = itertools.count(), DataFrame.first

    def counted(df):
        assert next(passes) < 20, "the bracket does not get narrower"
        return first(df)

    monkeypatch.setattr(DataFrame, "first", counted)
    df = spark.range(2000).select((F.col("id") % 50).cast("double").alias("q"), F.lit(3.0).alias("c"), F.lit(None).cast("double").alias("n"))
    assert stats.exact_medians(df, ["q", "c", "n"], keep=10) == [24.5, 3.0, None]
    assert stats.exact_medians(df.limit(0), ["q"], keep=10) == [None]


def test_only_the_named_tasks_are_trained(spark, tmp_path, monkeypatch):
    from panelspark.sources.tables import Tables
    trained = []

    class Store:
        def __init__(self, *_):
            pass

        def registry(self):
            return spark.createDataFrame([("gpa_regression",)], "task string")

        def register(self, results):
            trained.append(results)

    monkeypatch.setattr(TK, "ModelStore", Store)
    monkeypatch.setattr(TK, "train_task", lambda t, task, grids: task)
    t = Tables(spark, str(tmp_path))
    TK.trained_store(t, *TK.PERIOD_TASKS)
    assert trained == ["risk_classification"]
    TK.trained_store(t)
    assert trained[1:] == ["risk_classification", "course_score"]


def test_grid_search_prepares_every_fold_once(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from pyspark.ml import Pipeline
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"),
                                 (F.col("id") % 5).cast("string").alias("c"), (F.col("id") * 37 % 101 + F.col("id") % 5 * 9 > 60).cast("double").alias("label"))
    fits, fit = [], P.ExactMedianImputer._fit
    monkeypatch.setattr(P.ExactMedianImputer, "_fit", lambda self, x: fits.append(1) or fit(self, x))
    lr = LogisticRegression(maxIter=20)
    got = TR.grid_search(df, P.prep_stages(["x"], ["c"]), lr, {"regParam": [0.0, 0.1, 10.0]}, "classification", k=3)
    assert len(fits) == 4   # three folds and all rows, whatever the grid
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 10.0]).build()
    want = CrossValidator(estimator=Pipeline(stages=[*P.prep_stages(["x"], ["c"]), lr]), estimatorParamMaps=grid, evaluator=TR.F1MacroEvaluator(),
                          foldCol="fold", numFolds=3, seed=42).fit(df)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got.avgMetrics, want.avgMetrics)) and len(got.avgMetrics) == 3
    assert [m[lr.regParam] for m in got.getEstimatorParamMaps()] == [0.0, 0.1, 10.0]
    assert got.bestModel.transform(df).filter("prediction = label").count() == want.bestModel.transform(df).filter("prediction = label").count()


def test_smallest_is_the_stable_order():
    import numpy as np
    d = np.random.default_rng(1).integers(0, 6, (200, 40)).astype(float)
    d[3, 5:] = np.nan
    d[4] = np.nan
    d[5, 2] = np.inf
    for k in (1, 5, 39, 40, 60):
        assert (P._smallest(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_rows_without_a_turn_look_for_no_neighbours(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    looked, search = [], P._nearest_different
    monkeypatch.setattr(P, "_nearest_different", lambda x, k, seed: looked.append(x.filter("looks").count()) or search(x, k, seed))
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") < 45).cast("int").alias("label"),
                                 array_to_vector(F.array(F.col("id").cast("double"), F.col("id") * 2.0)).alias("features"))
    made = P.smote(df, "features", "label", "id", k=3).collect()
    assert len(made) == 10 and looked == [10]
    for r in made:
        at = float(r.id.split("-")[0])
        assert abs(r.features[0] - at) <= 3 and abs(r.features[1] - 2 * r.features[0]) < 1e-9
    twice = df.filter("id < 60").unionByName(df.filter("id < 60"))
    assert P.smote(twice.unionByName(df.filter("id >= 60")), "features", "label", "id", k=3).count() == 0
    assert P.smote(twice.unionByName(df.withColumn("label", F.lit(0))), "features", "label", "id", k=3).count() == 40


def test_medians_and_correlations_read_their_input_once(spark, monkeypatch):
    import panelspark.session as S
    cuts, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df, name="cut": cuts.append(name) or cut(df, name))
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    assert {r.r for r in stats.correlation_long(df, ["a", "b"]).collect()} == {1.0} and cuts == ["correlated"]
    from panelspark.plans.catalog_models import impute_medians
    from panelspark.sources.tables import Tables
    impute_medians(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert "median-columns" in cuts


def test_updates_are_written_and_upserted_by_many_tasks(spark, monkeypatch):
    import glob
    from panelspark.plans.registry import load_all
    load_all()
    from panelspark.plans import catalog_streams as CS
    from panelspark.session import scratch_path
    from panelspark.sources.versions import KeyedTable
    folders = []
    monkeypatch.setattr(CS, "scratch_path", lambda s, name: folders.append(scratch_path(s, name)) or folders[-1])
    base = spark.range(0, 400, 1, 4).select("id", F.lit(0).alias("v"))
    table = KeyedTable(spark, scratch_path(spark, "kept"), ["id"])
    table.create(base)
    sets = [base.withColumn("v", F.lit(n)).filter(F.col("id") % 2 == n % 2) for n in (1, 2, 3)]
    merge = lambda now, new: now.join(new, "id", "left_anti").unionByName(new)
    split = lambda b: (b.filter("v < 3"), b.filter("v >= 3"))
    rejects = scratch_path(spark, "set-aside")
    CS._arrive(spark, "many", sets, table, base.schema, merge, split, rejects)
    assert len(glob.glob(f"{folders[0].removeprefix('file:')}/*.parquet")) == 12
    assert {(r.v, r["count"]) for r in table.read(base.schema).groupBy("v").count().collect()} == {(1, 200), (2, 200)}
    assert [r.batch for r in spark.read.parquet(rejects).select("batch").distinct().collect()] == [2]


def test_records_of_one_line_are_not_shuffled(spark, tmp_path):
    from panelspark.sources import files as FS
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('x,y\n1,"two\n\n""lines"""\r\n\n2,b\r\n3,"c, d"\n')
    (folder / "b.csv").write_text("\nx,y\n4,e\n")
    rows = FS.read_csv_strings(spark, str(folder), ["x", "y"]).orderBy("line_no").collect()
    assert [(r.x, r.y, r.line_no) for r in rows] == [("1", 'two\n\n"lines"', 0), ("2", "b", 1), ("3", "c, d", 2), ("4", "e", 3)]
    (folder / "a.csv").write_text("x,y\n1,a\n")
    plain = FS.read_csv_strings(spark, str(folder), ["x", "y"], line_col=None)
    assert sorted(r.x for r in plain.collect()) == ["1", "4"] and "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
