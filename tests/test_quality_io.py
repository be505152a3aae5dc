import os

import pytest
from pyspark.sql import functions as F

from panelspark.functions.constants import ENTRY_MODES, LEVELS
from panelspark.operators import quality as Q
from panelspark.session import scratch_path
from panelspark.sources import files as FS
from panelspark.sources.tables import normalise_nulls

HEADER = ("matric_no,first_name,last_name,gender,date_of_birth,department,programme,level,entry_mode,entry_score,"
          "state_of_origin,accommodation,has_scholarship,employment_status,enrolment_session")
GOOD1 = "M001,Ada,Obi,female,2001-02-03,CS,BSc,100,UTME,250,Lagos,on_campus,yes,none,2020/2021"
GOOD2 = "M002,Ben,Eze,male,2000-05-06,CS,BSc,200,Direct Entry,300,Enugu,off_campus,0,part_time,2020/2021"
BAD = "M003,,Uche,male,2000-01-01,CS,BSc,999,UTME,200,Imo,on_campus,n,none,2020/2021"

RULES = [Q.Rule(c, "not_blank") for c in ("matric_no", "first_name", "last_name", "department", "programme",
                                           "state_of_origin", "enrolment_session")] + [
    Q.Rule("level", "int_in", LEVELS), Q.Rule("entry_mode", "in_set", ENTRY_MODES),
    Q.Rule("entry_score", "float_range", (0.0, 400.0)), Q.Rule("date_of_birth", "date"),
    Q.Rule("gender", "in_set", ("male", "female")), Q.Rule("has_scholarship", "bool")]


def _write(spark, lines):
    path = scratch_path(spark, "import")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "students.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_import_golden_and_reimport(spark):
    path = _write(spark, [HEADER, GOOD1, GOOD2, BAD])
    df = FS.read_csv_strings(spark, path, HEADER.split(","))
    existing = spark.createDataFrame([], "matric_no string")
    ins, skipped, errors = Q.import_batch(df, RULES, ["matric_no"], existing)
    summ = Q.validation_summary(df, errors, ins, skipped, "matric_no").first()
    assert (summ.total_rows, summ.valid_rows, summ.invalid_rows, summ.inserted) == (3, 2, 1, 2)
    errs = sorted((r.row, r.field) for r in errors.collect())
    assert errs == [(4, "first_name"), (4, "level")]
    # re-import against what was inserted: nothing new, both good rows skipped
    ins2, skipped2, _ = Q.import_batch(df, RULES, ["matric_no"], ins.select("matric_no"))
    assert ins2.count() == 0 and skipped2.count() == 2


def test_missing_columns_fail_before_rows(spark):
    path = _write(spark, ["matric_no,first_name", "M1,A"])
    with pytest.raises(FS.MissingColumnsError) as e:
        FS.read_csv_strings(spark, path, HEADER.split(","))
    assert "last_name" in str(e.value)


def test_bool_coercion(spark):
    df = spark.createDataFrame([("Yes",), (" y ",), ("1",), ("nope",), (None,)], "b string")
    assert [r.v for r in df.select(Q.coerce_bool("b").alias("v")).collect()] == [True, True, True, False, None]


def test_line_numbers_follow_file_order_across_files(spark):
    path = scratch_path(spark, "lines")
    spark.range(0, 5000, numPartitions=3).selectExpr("cast(id as string) as value").write.text(path)
    out = FS.with_line_numbers(spark.read.text(path)).collect()
    assert sorted(r.line_no for r in out) == list(range(5000))
    assert all(int(r.value) == r.line_no for r in out)


def test_parse_id_list_rules(spark):
    lines = spark.createDataFrame([("Student_ID", 0), ("5,x", 1), ("-1", 2), ("abc", 3), ("5", 4), ("7", 5), ("", 6)],
                                  "value string, line_no long")
    ids, counts = Q.parse_id_list(lines)
    assert sorted(r.id for r in ids.collect()) == [5, 7]
    c = counts.first()
    assert (c.valid, c.invalid, c.duplicate) == (2, 2, 1)


def test_score_attendance_status_updates(spark):
    base = spark.createDataFrame([(1, 10.0, None, None, None, None, "ongoing", False),
                                  (2, 12.0, None, None, None, None, "ongoing", False)],
                                 "id long, ca_score double, exam_score double, total_score double, grade string, "
                                 "grade_point int, status string, is_carryover boolean")
    upd = spark.createDataFrame([(1, None, 20.0, 1), (1, 25.0, None, 2), (2, 5.0, None, 1)],
                                "id long, ca_score double, exam_score double, seq int")
    out = {r.id: r for r in Q.apply_score_updates(base, upd, ["id"]).collect()}
    assert out[1].total_score == 45.0 and out[1].grade == "D" and out[1].status == "completed"
    assert out[2].status == "ongoing" and out[2].ca_score == 5.0 and out[2].total_score is None
    att = spark.createDataFrame([(1, 10, 5, 0.5)], "id long, sessions_held int, sessions_attended int, attendance_rate double")
    up = spark.createDataFrame([(1, 0, 3, 1), (2, 4, 6, 1)], "id long, sessions_held int, sessions_attended int, seq int")
    rates = {r.id: r.attendance_rate for r in Q.apply_attendance_updates(att, up, ["id"]).collect()}
    assert rates == {1: None, 2: 1.5}
    iv = spark.createDataFrame([(1, "planned", None, None)], "id long, status string, note string, resolved_at timestamp")
    iu = spark.createDataFrame([(1, "completed", None, 1)], "id long, status string, note string, seq int")
    iu = iu.withColumn("updated_at", F.current_timestamp())
    got = Q.apply_status_updates(iv, iu, ["id"], "seq", ["status", "note"]).first()
    assert got.status == "completed" and got.resolved_at is not None


def test_update_limits_last_update_and_renewed_resolution(spark):
    kind = ("id long, ca_score double, exam_score double, total_score double, grade string, "
            "grade_point int, status string, is_carryover boolean")
    base = spark.createDataFrame([(1, 9.996, None, None, None, None, "ongoing", False)], kind)
    upd = lambda ca, ex: spark.createDataFrame([(1, ca, ex, 1)], "id long, ca_score double, exam_score double, seq int")
    got = Q.apply_score_updates(base, upd(None, 60.0), ["id"]).first()
    assert got.grade == "B" and got.total_score == 70.0   # graded before rounding
    for bad in ((-5.0, None), (None, 75.0)):
        with pytest.raises(Exception, match="must be between"):
            Q.apply_score_updates(base, upd(*bad), ["id"]).select("status").collect()
            Q.apply_score_updates(base, upd(*bad), ["id"]).collect()
    att = spark.createDataFrame([], "id long, sessions_held int, sessions_attended int, attendance_rate double")
    two = spark.createDataFrame([(1, 5, 4, 1), (1, 4, 2, 2)], "id long, sessions_held int, sessions_attended int, seq int")
    rows = Q.apply_attendance_updates(att, two, ["id"], seq="seq").collect()
    assert len(rows) == 1 and rows[0].attendance_rate == 0.5
    with pytest.raises(Exception, match="exceeds"):
        Q.apply_attendance_updates(att, two.withColumn("sessions_attended", F.lit(9)), ["id"], enforce_le=True).collect()
    iv = spark.sql("select 1L id, 'completed' status, cast(null as string) note, timestamp'2020-01-01' resolved_at")
    iu = spark.sql("select 1L id, 'cancelled' status, cast(null as string) note, 1 seq, timestamp'2021-01-01' updated_at "
                   "union all select 1L, null, 'later', 2, timestamp'2022-01-01'")
    got = Q.apply_status_updates(iv, iu, ["id"], "seq", ["status", "note"]).first()
    assert got.resolved_at.year == 2021 and got.note == "later" and got.status == "cancelled"


def test_null_out_rates_within_bounds(spark):
    df = spark.range(20000).select(F.col("id"), F.col("id").cast("double").alias("a"), F.col("id").cast("string").alias("b"))
    out = Q.null_out(df, ["a", "b"], ["id"], seed=7)
    shares = out.agg(F.avg(F.col("a").isNull().cast("double")).alias("a"),
                     F.avg(F.col("b").isNull().cast("double")).alias("b")).first()
    assert 0.02 <= shares.a <= 0.10 and 0.02 <= shares.b <= 0.10
    assert out.filter(F.col("a").isNull()).count() == Q.null_out(df.repartition(7), ["a", "b"], ["id"], seed=7) \
        .filter(F.col("a").isNull()).count()


def test_normalise_nulls_and_replace_by_key(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("nan"), 2.5)], "a double, b double")
    out = normalise_nulls(df, ["a"]).collect()
    assert out[0].a == 1 and out[0].b is None and out[1].a is None
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    once = FS.replace_by_key(base, new, "k")
    twice = FS.replace_by_key(once, new, "k")
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 3
