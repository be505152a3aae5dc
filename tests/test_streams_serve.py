import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import serve as SV
from panelspark.plans import prep as P
from panelspark.session import scratch_path
from panelspark.streaming import streams as ST


def _events(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=5 * i), i % 3, "purchase" if i % 4 == 0 else "view", float(i))
            for i in range(60)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_stream_windows_and_latest_match_batch(spark):
    ev = _events(spark)
    src_dir = scratch_path(spark, "ev-src")
    ev.coalesce(2).write.parquet(src_dir)
    src = ST.file_stream(spark, src_dir, ev.schema, max_files=1)
    win = ST.run_to_table(ST.stream_windows(src, "ts", "user_id"), "update", "t-q3", spark)
    final = win.groupBy("window_start", "user_id").agg(F.max_by("logins", "batch").alias("logins"))
    assert final.agg(F.sum("logins")).first()[0] == 60
    src2 = ST.file_stream(spark, src_dir, ev.schema)
    latest = ST.run_to_table(ST.stream_latest(src2, "user_id", ["ts", "event_id"], ["event_id"]), "update", "t-q2", spark)
    got = {r.user_id: r.event_id for r in latest.groupBy("user_id").agg(F.max_by("event_id", "batch").alias("event_id")).collect()}
    assert got == {0: 57, 1: 58, 2: 59}


def test_scope_rows_roles(spark):
    grants = spark.createDataFrame([("adv-1", "adviser", 1), ("adv-1", "adviser", 2), ("stu-3", "student", 3)],
                                   "user_id string, role string, student_id long")
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "student_id long")
    assert SV.scope_rows(df, grants, None, "admin").count() == 4
    assert sorted(r.student_id for r in SV.scope_rows(df, grants, "adv-1", "adviser").collect()) == [1, 2]
    assert [r.student_id for r in SV.scope_rows(df, grants, "stu-3", "student").collect()] == [3]
    assert SV.scope_rows(df, grants, "x", "visitor").count() == 0


def test_smote_points_lie_between_minority_rows(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(str(i), Vectors.dense([float(i), float(2 * i)]), 1 if i < 20 else 0) for i in range(60)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("features", VectorUDT()),
                           T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    syn = P.smote(df, "features", "label", "id", k=3, ratio=1.0).collect()
    assert len(syn) == 20 and all(r.label == 1 for r in syn)
    for r in syn:
        x, y = r.features
        assert 0.0 <= x <= 19.0 and abs(y - 2 * x) < 1e-9  # on the segment between minority points


def test_register_report_text(spark):
    reg = spark.createDataFrame([(1, "Ada", 200, "critical", 0.8765), (2, None, None, "high", 0.5),
                                 (3, "Bo", 100, "low", 0.1)],
                                "student_id long, name string, level int, risk_tier string, probability double")
    out = {r.student_id: r for r in SV.register_report(reg).collect()}
    assert set(out) == {1, 2}
    assert (out[1].tier, out[1].risk, out[1].level) == ("Critical", f"{0.8765 * 100:.1f}%", "200")
    assert (out[2].name, out[2].level, out[2].risk) == ("-", "-", "50.0%")
