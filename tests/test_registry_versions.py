"""Versioned tables, keyed upserts, the search, the registry and scoring with the champion."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import fairness as FA
from panelspark.operators import quality as Q
from panelspark.plans import model_store as MS
from panelspark.plans import prep as P
from panelspark.plans import train as TR
from panelspark.session import scratch_path
from panelspark.sources import files as FS
from panelspark.sources.versions import KeyedTable, VersionedTables
from panelspark.streaming import streams as ST


def test_a_reload_that_fails_in_between_leaves_the_old_tables(spark):
    base = scratch_path(spark, "reload")
    two = {"a": spark.range(3), "b": spark.range(5)}
    store = FS.replace_tables(spark, two, base)
    bad = spark.range(4).withColumn("id", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        FS.replace_tables(spark, {"a": spark.range(9), "b": bad}, base)
    assert (store.read("a").count(), store.read("b").count(), store.versions()) == (3, 5, [1])
    FS.replace_tables(spark, {"a": spark.range(9)}, base)   # the other table stays as it is
    assert (store.read("a").count(), store.read("b").count()) == (9, 5)
    assert store.read("a", version=1).count() == 3
    with pytest.raises(KeyError):
        store.read("c")


def test_old_versions_go_but_the_data_they_share_stays(spark):
    store = VersionedTables(spark, scratch_path(spark, "keep"), keep=2)
    store.commit({"a": spark.range(1), "fixed": spark.range(7)})
    for n in range(2, 6):
        store.commit({"a": spark.range(n)})
    assert store.versions() == [4, 5] and store.read("a").count() == 5 and store.read("fixed").count() == 7
    assert store.commit({"a": spark.range(99)}, tag="t") == 6 == store.commit({"a": spark.range(1)}, tag="t")
    assert store.read("a").count() == 99
    assert VersionedTables(spark, scratch_path(spark, "none")).manifest() == ({}, None)


def test_keyed_table_rewrites_only_touched_buckets(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["k"], buckets=8)
    table.create(df)
    before = table.versions.manifest()[0]
    merge = lambda now, new: FS.replace_by_key(now, new, "k")
    table.upsert(spark.createDataFrame([(5, 1), (900, 2)], "k long, v int"), df.schema, merge, "b0")
    after = table.versions.manifest()[0]
    assert 1 <= sum(before.get(n) != p for n, p in after.items()) <= 2
    got = {r.k: r.v for r in table.read(df.schema).collect()}
    assert len(got) == 201 and got[5] == 1 and got[900] == 2 and got[6] == 0
    table.upsert(spark.createDataFrame([(5, 77)], "k long, v int"), df.schema, merge, "b0")   # a replay
    assert {r.k: r.v for r in table.read(df.schema).collect()} == got
    table.upsert(df.limit(0), df.schema, merge, "b1")
    table.upsert(spark.createDataFrame([(5, 0)], "k long, v int"), df.schema, lambda now, new: now.limit(0), "b2")
    assert table.read(df.schema).count() < 201   # a bucket that became empty is gone


SCORES = "k long, ca_score double, exam_score double, seq int"
BASE = ("k long, ca_score double, exam_score double, total_score double, grade string, grade_point int, status string, is_carryover boolean")


def test_a_bad_update_does_not_stop_the_stream_and_a_replay_changes_nothing(spark):
    base = spark.createDataFrame([(k, 10.0, None, None, None, None, "ongoing", False) for k in range(6)], BASE)
    table = KeyedTable(spark, scratch_path(spark, "scores"), ["k"], buckets=4)
    table.create(base)
    src, rejects = scratch_path(spark, "score-src"), scratch_path(spark, "score-rejects")
    for rows in ([(1, None, 40.0, 1), (2, 99.0, None, 1)], [(3, None, float("nan"), 2), (3, 20.0, 50.0, 3)]):
        spark.createDataFrame(rows, SCORES).coalesce(1).write.mode("append").parquet(src)
    schema = spark.createDataFrame([], SCORES).schema
    run = lambda ckpt: ST.stream_updates(
        ST.file_stream(spark, src, schema, max_files=1), table, base.schema, lambda c, b: Q.apply_score_updates(c, b, ["k"]),
        ckpt, Q.split_score_updates, rejects).awaitTermination()
    run(scratch_path(spark, "ck"))
    first = {r.k: (r.status, r.grade, r.total_score) for r in table.read(base.schema).collect()}
    assert first[1] == ("completed", "C", 50.0) and first[2][0] == "ongoing" and first[3] == ("completed", "A", 70.0) and len(first) == 6
    bad = {(r.k, r.reason) for r in spark.read.parquet(rejects).collect()}
    assert bad == {(2, "ca_score must be between 0 and 30"), (3, "exam_score must be between 0 and 70")}
    run(scratch_path(spark, "ck"))   # all files once more
    assert {r.k: (r.status, r.grade, r.total_score) for r in table.read(base.schema).collect()} == first


def test_attendance_rejects(spark):
    up = spark.createDataFrame([(1, 4, 3), (2, -1, 0), (3, None, 1), (4, 2, 5)], "k long, sessions_held int, sessions_attended int")
    good, bad = Q.split_attendance_updates(up, enforce_le=True)
    assert [r.k for r in good.collect()] == [1]
    assert {r.k: r.reason for r in bad.collect()} == {2: "sessions_held must be 0 or more; sessions_attended exceeds sessions_held", 3: "sessions_held must be 0 or more",
                                                      4: "sessions_attended exceeds sessions_held"}


def test_latest_rows_without_stream_state(spark):
    src = scratch_path(spark, "latest-src")
    for rows in ([(1, 5, "a"), (2, 1, "b"), (1, 3, "c")], [(1, 4, "late"), (2, 9, "d"), (3, 0, "e")]):
        spark.createDataFrame(rows, "k long, ts long, v string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    table = KeyedTable(spark, scratch_path(spark, "latest"), ["k"], buckets=3)
    q = ST.stream_latest_table(ST.file_stream(spark, src, schema, max_files=1), table, schema, ["ts"], scratch_path(spark, "ck"))
    q.awaitTermination()
    assert {r.k: r.v for r in table.read(schema).collect()} == {1: "a", 2: "d", 3: "e"}
    assert all(not p.stateOperators for p in q.recentProgress)


def test_student_import_contract(spark):
    from panelspark.functions.constants import IMPORT_COLUMNS
    rules = Q.student_import_rules()
    assert {r.field for r in rules} <= set(IMPORT_COLUMNS)
    good = dict(zip(IMPORT_COLUMNS, "M1,Ada,Obi,female,2001-02-03,CS,BSc,100,UTME,250,Lagos,on_campus,yes,none,2020/2021".split(",")))
    bad = {**good, "gender": "x", "level": "150", "has_scholarship": None, "programme": " "}
    df = spark.createDataFrame([(*good.values(), 0), (*bad.values(), 1)], ", ".join(f"{c} string" for c in IMPORT_COLUMNS) + ", line_no long")
    valid, errors = Q.validate_rows(df, rules)
    assert valid.count() == 1 and {r.field for r in errors.collect()} == {"gender", "level", "has_scholarship", "programme"}


# ---------------------------------------------------------------- search and registry

def learnable(spark, n=240):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        x, c = rng.gauss(0, 1), rng.choice(["u", "v", None])
        y = int(x + (0.5 if c == "u" else 0) + rng.gauss(0, 0.7) > 1.0)
        rows.append((i % 40, i, x, None if rng.random() < 0.1 else rng.gauss(0, 1), c, y, 2.0 * x + rng.gauss(0, 1.2), 2019 + i % 3))
    return spark.createDataFrame(rows, "e long, i long, a double, b double, c string, y int, z double, year int")


GRIDS = {"logistic_regression": {"C": [0.01, 10.0]}, "decision_tree": {"max_depth": [2, 4]}}


@pytest.fixture(scope="module")
def searched(spark):
    df = learnable(spark)
    risk = TR.search(P.stratified_group_folds(df, "e", "y", 3), "risk_classification", "classification", ["a", "b"], ["c"], "y", "year",
                     ["e", "i"], 3, GRIDS)
    gpa = TR.search(P.group_folds(df, "e", 3), "gpa_regression", "regression", ["a", "b"], ["c"], "z", "year", ["e", "i"], 3,
                    {"linear_regression": {}, "decision_tree": {"max_depth": [3]}})
    return df, risk, gpa


def test_search_returns_every_variant_with_its_best_parameters(spark, searched):
    _, risk, gpa = searched
    assert [(r.algorithm, r.smote) for r in risk] == [(a, v) for a in GRIDS for v in (False, True)]
    assert [(r.algorithm, r.smote) for r in gpa] == [("linear_regression", False), ("decision_tree", False)]
    for r in risk + gpa:
        assert len(r.fold_scores) == 3 and r.n_rows == 240 and not r.leakage_flag and r.features == ["a", "b", "c"]
        assert set(r.params) == set((GRIDS | {"linear_regression": {}})[r.algorithm])
    assert all(0.5 < r.score < 1 for r in risk) and all(0.5 < r.score < 0.95 for r in gpa)
    t = TR.results_frame(spark, risk + gpa).collect()
    assert len(t) == 6 and all(abs(r.train_test_gap - (r.in_sample - r.cv_mean)) < 1e-12 for r in t)


def test_search_redacts_a_leak(spark, searched):
    df = P.group_folds(searched[0].withColumn("leak", F.col("z") * 3), "e", 3)
    got = TR.search(df, "gpa_regression", "regression", ["leak"], [], "z", "year", ["e", "i"], 3, {"linear_regression": {}})
    assert got[0].leakage_flag and got[0].score is None and TR.champion(got) is None
    assert TR.results_frame(spark, got).first().cv_score is None


def test_grids_and_champions():
    assert TR.expand_grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    assert TR.expand_grid({}) == [{}]
    with pytest.raises(KeyError):
        TR.estimator("classification", "nothing", {}, 10, 2)
    r = lambda a, s, smote=False, flag=False: TR.Result("t", "classification", a, smote, {}, [0.5], {"f1_macro": s}, {}, 0.5, flag, 1, [], None)
    best = TR.best_variants([r("a", 0.0), r("a", 0.1, True), r("b", None), r("b", None, True), r("c", 0.9, flag=True), r("d", 0.1)])
    assert [(x.algorithm, x.smote) for x in best] == [("a", True), ("b", False), ("c", False), ("d", False)]
    assert TR.champion(best).algorithm == "a" and TR.champion([r("b", None)]) is None


def test_select_champion_without_a_score(spark):
    m = spark.createDataFrame([("t", "a", None, False, False), ("u", "b", 0.3, False, False), ("u", "b", 0.3, True, False), ("u", "c", 0.0, True, False)],
                              "task string, algorithm string, cv_score double, smote boolean, leakage_flag boolean")
    assert [(r.task, r.algorithm) for r in TR.select_champion(m).collect()] == [("u", "b")]
    reg = m.filter("not smote").select("task", F.concat_ws("__", "task", "algorithm").alias("version"), F.lit(True).alias("is_active"))
    act = TR.activate_champions(reg.unionByName(reg.limit(0)), TR.select_champion(m))
    assert {r.version: r.is_active for r in act.collect()} == {"t__a": True, "u__b": True}


def test_registry_is_idempotent_and_scores_with_the_champion(spark, searched):
    df, risk, gpa = searched
    store = MS.ModelStore(spark, scratch_path(spark, "registry"))
    with pytest.raises(MS.NoActiveModel):
        store.load_active("risk_classification")
    assert store.rmse("gpa_regression").first().rmse == 0.3   # the fallback
    store.register(risk)
    store.register(gpa)
    plain = lambda: sorted(map(str, store.registry().drop("trained_at", "artifact_path").collect()))
    once = plain()
    assert len(once) == 4
    store.register(risk)
    store.register(gpa)
    assert plain() == once
    reg = store.registry().collect()
    assert sorted(r.task for r in reg if r.is_active) == ["gpa_regression", "risk_classification"]
    active = store.active_row("gpa_regression")
    assert active.algorithm == TR.champion(TR.best_variants(gpa)).algorithm
    model, algorithm = store.load_active("risk_classification")
    best = TR.champion(TR.best_variants(risk))
    assert algorithm == best.algorithm
    new = df.limit(25).withColumn("c", F.when(F.col("i") % 2 == 0, "never seen").otherwise(F.col("c")))
    score = lambda m: {r.i: round(float(r.probability[1]), 9) for r in m.transform(new).select("i", "probability").collect()}
    assert score(model) == score(best.model)
    assert abs(store.rmse("gpa_regression").first().rmse - TR.champion(TR.best_variants(gpa)).metrics["rmse"]) < 1e-12
    other = next(r.version for r in reg if r.task == "gpa_regression" and not r.is_active)
    store.activate("gpa_regression", other)
    assert store.active_row("gpa_regression").version == other
    with pytest.raises(MS.NoActiveModel):
        store.activate("gpa_regression", "gpa_regression__nothing")
    store.attach_fairness("gpa_regression", {"x": 1})
    assert store.active_row("gpa_regression").fairness_report == '{"x": 1}'


def test_regression_fairness(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "p"), (3.0, 3.0, "a", "q"), (2.0, 4.5, "b", None), (None, 1.0, None, "p")],
                               "y_true double, y_pred double, g string, h string")
    errors, flags = FA.regression_fairness_report(df, ["g", "h"], 5.0)
    e = {(r.attribute, r.value): (r.n, r.mae, r.mean_predicted) for r in errors.collect()}
    assert e["g", "a"] == (2, 0.5, 0.5) and e["g", "b"] == (1, 2.5, 0.9) and ("h", None) not in e
    f = {r.attribute: r for r in flags.collect()}
    assert abs(f["g"].gap - 0.4) < 1e-12 and f["g"].flagged and f["g"].metric == "mean_predicted"
