"""CSV records against Python's csv, and texts against Python's own formatting."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions.numeric import half_even
from panelspark.operators import explain as X
from panelspark.operators import serve as SV
from panelspark.session import scratch_path
from panelspark.sources import files as FS


def folder(spark, files):
    path = scratch_path(spark, "records")
    local = path.removeprefix("file:")
    os.makedirs(local)
    for name, text in files.items():
        with open(os.path.join(local, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return path, local


def python_rows(local):
    out = []
    for name in sorted(os.listdir(local)):
        with open(os.path.join(local, name), newline="", encoding="utf-8") as f:
            out += [tuple(r.values()) for r in csv.DictReader(f)]
    return [(*r, i) for i, r in enumerate(out)]


CASES = {
    "break": 'a,b\n1,"two\nlines"\n2,x\n',
    "doubled": 'a,b\n"say ""hi""",2\n3,""\n',
    "breaks and quotes": 'a,b\n"x\n""y""\n\n z", 1 \n,\n\n\n5,"6"\n',
    "windows": 'a,b\r\n1,"p\r\nq"\r\n2,"r"\r\n',
    "no last break": 'a,b\n1,2\n3,"4\n5"',
    "header only": 'a,b\n',
    "quoted header": '"a","b"\n"\n",é\n',
}


@pytest.mark.parametrize("name", CASES)
def test_records_equal_python_csv(spark, name):
    path, local = folder(spark, {"one.csv": CASES[name]})
    got = sorted((r.a, r.b, r.line_no) for r in FS.read_csv_strings(spark, path, ["a", "b"]).collect())
    assert sorted(got, key=lambda r: r[2]) == python_rows(local)


def test_records_over_files_and_splits(spark):
    rng = random.Random(6)
    cell = lambda: "".join(rng.choice(['x', 'y z', '\n', '"', ',', 'é', '']) for _ in range(rng.randrange(6)))
    files = {}
    for f in range(2):
        rows = [["a", "b"]] + [[f"{f}-{i}", cell()] for i in range(3000)]
        files[f"{f}.csv"] = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows) + "\n"
    path, local = folder(spark, files)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # many splits, some begin inside a quoted cell
    try:
        got = sorted(((r.a, r.b, r.line_no) for r in FS.read_csv_strings(spark, path, ["b"]).collect()), key=lambda r: r[2])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == python_rows(local)


def test_missing_cells_headers_and_open_quotes(spark, monkeypatch):
    path, _ = folder(spark, {"a.csv": "a,b\n1\n"})
    assert [(r.a, r.b) for r in FS.read_csv_strings(spark, path, ["a"]).collect()] == [("1", None)]
    path, _ = folder(spark, {"a.csv": "a,b\n1,2\n", "b.csv": "b,a\n1,2\n"})
    with pytest.raises(ValueError, match="same header"):
        FS.read_csv_strings(spark, path, ["a"])
    monkeypatch.setattr(FS, "MOST_LINES", 20)
    path, _ = folder(spark, {"a.csv": 'a,b\n1,"2\n' + "x\n" * 50})
    with pytest.raises(Exception, match="quote is not closed"):
        FS.read_csv_strings(spark, path, ["a"]).collect()


def test_half_even_equals_python(spark):
    rng = random.Random(1)
    v = [12.5, 13.5, 0.125, 4.025, 4.075, 1.005, 1.015, 2.675, -0.001, -12.5, 0.0, 1e20]
    v += [rng.randrange(-20000, 20000) / rng.choice([8, 16, 40, 200, 400]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for d in (0, 1, 2):
        for r in df.select("x", F.format_string(f"%+.{d}f", half_even("x", d)).alias("s"), F.format_string(f"%+.{d}f", half_even("x", F.lit(d))).alias("t")).collect():
            assert r.s == r.t == f"{r.x:+.{d}f}"
    assert df.limit(1).select(half_even(F.lit(None).cast("double"), 1).alias("x")).first().x is None


@pytest.mark.parametrize("unit,value,text,want", [
    ("percent", 0.412, None, "41%"), ("gpa", 3.456, None, "3.46"), ("boolean", 1.0, None, "yes"), ("boolean", 0.0, None, "no"),
    ("categorical", None, "UTME", "UTME"), ("percent", None, None, "unknown"), ("categorical", None, None, "unknown"),
    ("score_30", 12.5, None, "12"), ("signed_gpa", -0.001, None, "-0.00"), ("units_signed", 1.25, None, "+1.2"), ("hours", 7.0, None, "7.0 hrs/week"),
    ("zscore", 0.5, None, "+0.50 SD from average"), ("generic", 0.305, None, "0.30"), ("something", 1.0, None, "1.00")])
def test_values_as_text(spark, unit, value, text, want):
    df = spark.createDataFrame([(unit, value, text)], "u string, v double, t string")
    assert df.select(X.format_value(F.col("u"), F.col("v"), F.col("t")).alias("s")).first().s == want


def test_explanations_of_all_kinds_of_features(spark):
    rows = [(i, float(i % 5), ["UTME", "Transfer", None][i % 3], i % 2 == 0, None if i == 4 else i / 7) for i in range(12)]
    df = spark.createDataFrame(rows, "student_id long, ca_average double, entry_mode string, has_scholarship boolean, prior_cgpa double")
    feats = df.columns[1:]

    def score(z):
        f = F.col("ca_average") * 0.1 + F.when(F.col("entry_mode") == "UTME", 0.5).otherwise(0.0) + F.col("has_scholarship").cast("int") * F.coalesce("prior_cgpa", F.lit(0.0))
        return z.withColumn("_f", f)

    full = X.explain_rows(df.filter("student_id < 6"), ["student_id"], feats, df, score, n_permutations=3, n_background=12).cache()
    assert full.count() == 6 * 4
    fx = {r.student_id: r._f for r in score(df).collect()}
    mean = sum(fx.values()) / 12
    for r in full.groupBy("student_id").agg(F.sum("shap_value").alias("s")).collect():
        assert abs(r.s - (fx[r.student_id] - mean)) < 1e-9
    text = {(r.student_id, r.feature): r.sentence for r in X.narratives(full, "course_score").collect()}
    assert text[0, "entry_mode"].startswith("Entry mode of UTME is ") and text[2, "entry_mode"].startswith("Entry mode of unknown is ")
    assert text[0, "has_scholarship"].startswith("Scholarship status of yes is ")
    own = X.read_explanations(X.store_contributors(full, ["student_id"]), ["student_id"], "student").collect()
    assert {r.feature for r in own} == {"ca_average"} and {r["rank"] for r in own} == {1}
    staff = X.read_explanations(X.store_contributors(full, ["student_id"]), ["student_id"], "adviser")
    assert sorted(map(str, staff.select(*sorted(full.columns)).collect())) == sorted(map(str, full.select(*sorted(full.columns)).collect()))


def test_report_lines(spark):
    items = spark.createDataFrame([(1, 7, 2020, 1, 12.25, None, None, None, 0.125, "D1")],
                                  "student_id long, course_id long, session int, semester int, ca_score double, exam_score double, "
                                  "total_score double, grade string, attendance_rate double, department string")
    r = SV.report_enrolment_lines(items).first()
    assert (r.course, r.period, r.ca, r.exam, r.total, r.grade, r.attendance) == ("7", "2020 S1", "12.2", "-", "-", "-", "12%")
