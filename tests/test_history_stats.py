import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import history as H
from panelspark.operators import stats as S


def _one_entity(spark, gpas):
    rows = [(1, 2000 + i // 2, 1 + i % 2, g, 10, 8) for i, g in enumerate(gpas)]
    return spark.createDataFrame(rows, "student_id long, session int, semester int, gpa double, "
                                       "credits_registered long, credits_earned long")


def test_trend_volatility_prior_sum_vector(spark):
    h = _one_entity(spark, [1.0, 2.0, 4.0, 7.0, 5.0]).withColumn("cgpa", F.col("gpa"))
    x = H.history_features(h).withColumn("psum", H.expanding_prior_sum_expr("gpa", "student_id", ["session", "semester"]))
    rows = x.orderBy("session", "semester").collect()
    assert [r.gpa_trend for r in rows] == [None, None, None, 3.0, 5.0]
    vol = [r.gpa_volatility for r in rows]
    assert vol[:2] == [None, None] and abs(vol[2] - 0.5) < 1e-9
    assert abs(vol[3] - 1.247219) < 1e-6 and abs(vol[4] - 2.054805) < 1e-6
    assert [r.psum for r in rows] == [None, 1.0, 3.0, 7.0, 14.0]
    assert [r.semesters_completed for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0].prior_gpa is None and rows[1].prior_gpa == 1.0


def test_running_weighted_mean(spark):
    df = spark.createDataFrame([(1, 1, 1, 10, 5), (1, 1, 2, 30, 10)], "e long, s int, m int, pts long, un long")
    out = H.running_weighted_mean(df, "e", ["s", "m"], "pts", "un", "c").orderBy("m").collect()
    assert [round(r.c, 6) for r in out] == [2.0, round(40 / 15, 6)]


def test_zscore_constant_column_is_zero_everywhere(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "a double, k double")
    out = H.zscore(df, {"za": "a", "zk": "k"}).collect()
    assert [r.zk for r in out] == [0.0, 0.0, 0.0]
    assert out[1].za is None and out[0].za == -1.0 and out[2].za == 1.0


def test_peer_deviation_excludes_null_peers(spark):
    df = spark.createDataFrame([(1, 100, 10.0), (2, 100, 20.0), (3, None, 5.0)], "id long, lvl int, load double")
    out = {r.id: r.dev for r in H.peer_deviation(df, "load", ["lvl"], "dev").collect()}
    assert out == {1: -5.0, 2: 5.0, 3: None}


def test_latest_and_keep_first(spark):
    df = spark.createDataFrame([(1, 2000, 1, 1.0), (1, 2001, 2, 3.0), (1, 2001, 1, 2.0)], "e long, s int, m int, v double")
    assert H.latest_per_entity(df, "e", ["s", "m"]).first().v == 3.0
    lines = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "k string, line_no long")
    kept, dups = H.keep_first(lines, ["k"], "line_no")
    assert sorted(r.line_no for r in kept.collect()) == [0, 1] and [r.line_no for r in dups.collect()] == [2]


def test_extend_with_open_period_then_lag(spark):
    h = _one_entity(spark, [2.0, 3.0]).withColumn("cgpa", F.col("gpa"))
    open_keys = spark.createDataFrame([(1, 2001, 1), (1, 2001, 1)], "student_id long, session int, semester int")
    ext = H.extend_with_open_period(h, open_keys, ["credits_registered", "credits_earned", "gpa", "cgpa"])
    x = H.history_features(ext).filter(F.col("gpa").isNull()).collect()
    assert len(x) == 1 and x[0].prior_gpa == 3.0 and x[0].prior_cgpa == 3.0


def test_pairwise_correlation_fixture(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 1.0, 7.0), (3.0, None, 7.0), (None, 4.0, 7.0), (5.0, 9.0, 7.0)],
                               "a double, b double, k double")
    out = {(r.feature_a, r.feature_b): r.r for r in S.correlation_long(df, ["a", "b", "k"]).collect()}
    assert out[("a", "b")] == 0.937 and out[("b", "a")] == 0.937
    assert out[("a", "k")] == 0.0 and out[("k", "k")] == 0.0 and out[("a", "a")] == 1.0


def test_exact_median_and_quantiles_match_numpy(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (5.0,)], "v double")
    assert S.exact_quantiles(df, "v", [0.5], names=["m"]).first().m == 2.5
    rng = random.Random(3)
    vals = [round(rng.gauss(0, 1), 2) for _ in range(2000)]
    d2 = spark.createDataFrame([(v,) for v in vals], "v double")
    qs = [0.1, 0.25, 0.5, 0.9]
    got = S.exact_quantiles(d2, "v", qs, names=["a", "b", "c", "d"], buckets=7).first()
    want = np.percentile(vals, [q * 100 for q in qs])
    assert all(math.isclose(g, w, abs_tol=1e-9) for g, w in zip(got, want))


def test_ordered_cumsum_matches_sequential(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    out = S.ordered_cumsum(df, "k", ["a", "b"], descending=True, buckets=9).orderBy(F.desc("k")).collect()
    ca = cb = 0
    for (k, a, b), r in zip(sorted(rows, key=lambda t: -t[0]), out):
        ca, cb = ca + a, cb + b
        assert r.k == k and r.a_cum == ca and r.b_cum == cb


def test_modal_value_smallest_on_tie(spark):
    df = spark.createDataFrame([(1, 300), (1, 100), (1, 300), (1, 100), (2, 5)], "g long, v long")
    out = {r.g: r.mode for r in S.modal_value(df, ["g"], "v").collect()}
    assert out == {1: 100, 2: 5}


def test_correlation_matrix_narrow_wide_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, 0.3), (2.0, 1.0, 7.0, None), (3.0, None, 7.0, 0.1),
                                (None, 4.0, 7.0, 0.7), (5.0, 9.0, 7.0, 0.2)], "a double, b double, k double, d double")
    cols = ["a", "b", "k", "d"]
    got = {(r.feature_a, r.feature_b): r.r for r in S.correlation_long(df, cols).collect()}
    pdf = df.toPandas().corr().fillna(0.0)
    assert len(got) == 16 and all(abs(got[a, b] - pdf.loc[a, b]) < 6e-4 for a in "abd" for b in "abd")
    wide = df.select(*[F.col("a").alias(f"c{i}") for i in range(20)])
    assert {r.r for r in S.correlation_long(wide, wide.columns).collect()} == {1.0}
    assert {r.r for r in S.correlation_long(df.limit(0), cols).collect()} == {0.0}
