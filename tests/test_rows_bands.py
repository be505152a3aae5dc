import pytest
from pyspark.sql import functions as F

from panelspark.functions import bands as B
from panelspark.functions import rows as RW
from panelspark.functions.numeric import rnd


def test_grade_sweep_every_tenth(spark):
    df = spark.range(1001).select((F.col("id") / 10.0).alias("s"))
    out = df.select("s", B.grade_letter("s").alias("g"), B.grade_point("s").alias("p")).collect()
    assert len(out) == 1001 and all(r.g is not None and r.p is not None for r in out)
    by = {round(r.s, 1): (r.g, r.p) for r in out}
    assert by[70.0] == ("A", 5) and by[69.9] == ("B", 4) and by[39.9] == ("F", 0) and by[40.0] == ("E", 1)
    assert by[44.9] == ("E", 1) and by[45.0] == ("D", 2) and by[100.0] == ("A", 5) and by[0.0] == ("F", 0)


@pytest.mark.parametrize("bad", [-1.0, 100.1])
def test_grade_out_of_range_raises(spark, bad):
    with pytest.raises(Exception):
        spark.createDataFrame([(bad,)], "s double").select(B.grade_letter("s")).collect()


def test_grade_lenient_gives_null(spark):
    r = spark.createDataFrame([(101.0,)], "s double").select(B.grade_letter("s", strict=False).alias("g")).first()
    assert r.g is None


def test_risk_tiers_and_standing(spark):
    df = spark.createDataFrame([(0.8,), (0.75,), (0.5,), (0.3,), (0.1,), (-0.2,), (None,)], "p double")
    tiers = [r.t for r in df.select(B.risk_tier("p").alias("t")).collect()]
    assert tiers == ["critical", "critical", "high", "moderate", "low", "low", None]
    st = spark.createDataFrame([(1.9,), (2.0,), (2.49,), (2.5,)], "c double").select(B.standing_band("c").alias("s"))
    assert [r.s for r in st.collect()] == ["probation", "warning", "warning", "good"]


def test_classify_cgpa_half_open(spark):
    df = spark.createDataFrame([(4.5,), (4.49,), (3.5,), (2.4,), (1.5,), (1.49,), (5.0,)], "c double")
    got = [r.k for r in df.select(B.classify_cgpa("c").alias("k")).collect()]
    assert got == ["first_class", "second_upper", "second_upper", "second_lower", "third_class", "pass_fail",
                   "first_class"]


def test_period_key_from_string_session(spark):
    df = spark.createDataFrame([("2021/2022", "2"), ("2019/2020", "1")], "session string, semester string")
    assert [r.k for r in df.select(B.period_key("session", "semester").alias("k")).collect()] == [20212, 20191]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (9.0,), (2.0,)], "x double")
    assert [r.c for r in df.select(B.clip("x", 0.0, 5.0).alias("c")).collect()] == [None, 0.0, 5.0, 2.0]


def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert [r.r for r in df.select(RW.safe_ratio("a", "b").alias("r")).collect()] == [None, None, 0.25]


def test_projected_mean(spark):
    df = spark.createDataFrame([(4.0, 3, 2.0), (None, 3, 2.0), (4.0, 0, 2.0)], "m double, n int, x double")
    got = [r.p for r in df.select(RW.blend_running_mean("m", "n", "x").alias("p")).collect()]
    assert got == [3.5, 2.0, 2.0]


def test_prediction_interval_fallback_rmse(spark):
    df = spark.createDataFrame([(4.9, None)], "p double, r double")
    p, lo, hi = RW.prediction_interval("p", "r", 0.0, 5.0)
    row = df.select(p.alias("p"), lo.alias("lo"), hi.alias("hi")).first()
    assert row.p == 4.9 and abs(row.lo - 4.6) < 1e-9 and row.hi == 5.0


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("a%b", "x"), ("axb", "x"), ("A%B", "y")], "name string, seg string")
    got = RW.search_rows(df, {"seg": "x"}, "a%b", ["name"]).collect()
    assert [r.name for r in got] == ["a%b"]


def test_leakage_guard_names_lineage_and_unknown_task(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, exam_score double")
    for task in ("risk_classification", "gpa_regression", "course_score"):
        with pytest.raises(RW.LeakageError):
            RW.assert_no_leakage(df, task)
    renamed = df.select("a", F.col("exam_score").alias("x"))
    with pytest.raises(RW.LeakageError):
        RW.assert_no_leakage(renamed, "course_score")
    derived = df.select((F.col("exam_score") * 0 + F.col("a")).alias("y"))
    RW.assert_no_leakage(derived, "course_score")  # derived values are not renames
    with pytest.raises(ValueError):
        RW.assert_no_leakage(df.select("a"), "no_such_task")


def test_column_types_and_protected(spark):
    df = spark.createDataFrame([(1.0, "m", True, "x")], "a double, gender string, b boolean, c string")
    num, cat = RW.column_types(df)
    assert num == ["a", "b"] and cat == ["gender", "c"]
    assert "gender" not in RW.drop_protected(df).columns


def test_rounding_is_half_away_on_scaled_value(spark):
    df = spark.createDataFrame([(0.7125 * 12.525,), (-2.5,), (2.5,), (None,)], "x double")
    got = [r.r for r in df.select(rnd("x", 0).alias("r")).collect()]
    assert got[1:] == [-3.0, 3.0, None]
