"""Driver tables viewed as an institutional panel (role mapping of FIXTURES.md §3).

customer -> student, part -> course, lineitem x orders -> enrolment,
half-year of the order date -> (session, semester), orders from 2001-07-01
on -> the open (ongoing) period, events -> engagement, documents x labels
-> binary labels with groups.

Every view is a lazy DataFrame; Catalyst prunes the columns each query
needs down to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.bands import grade_letter, grade_point
from panelspark.operators import rollups
from panelspark.operators.history import running_weighted_mean

# FIXED VALUES: the role mapping's open-period cut-off.
OPEN_FROM = "2001-07-01 00:00:00"
ENTITY = "student_id"
PERIOD = ("session", "semester")
KEY = (ENTITY, *PERIOD)


def open_cutoff():
    return F.lit(OPEN_FROM).cast("timestamp_ntz")


def enrolments(t, *more: str) -> DataFrame:
    """One row per enrolment (lineitem) with course attributes and scores, and the lineitem columns ``more``.

    lineitem x orders is the only fact-fact join (shuffle on orderkey, AQE
    splits a hot order); part joins on partkey and is broadcast by AQE only
    when its measured size is under the threshold.
    """
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_quantity", "l_discount", *more)
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    p = t["part"].select("p_partkey", "p_size")
    done = F.col("o_orderdate") < open_cutoff()
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("student_id"),
                    F.col("l_partkey").alias("course_id"),
                    F.year("o_orderdate").cast("int").alias("session"),
                    F.when(F.month("o_orderdate") <= 6, F.lit(1)).otherwise(F.lit(2)).alias("semester"),
                    (F.col("p_size") % 3 + 2).alias("units"),
                    (F.floor((F.col("p_size") - 1) / 10).cast("int") * 100 + 100).alias("level"),
                    F.when(F.col("p_size") % 4 == 0, F.lit(0)).otherwise(F.lit(1)).alias("is_core"),
                    (F.col("l_quantity") * 0.6).alias("ca_score"),
                    F.when(done, F.col("l_quantity") * 2).alias("total_score"),
                    F.when(done, F.lit("completed")).otherwise(F.lit("ongoing")).alias("status"),
                    (1 - F.col("l_discount") * 5).alias("attendance_rate"), *more))


def graded(t) -> DataFrame:
    """Completed enrolments with grade letter and points (B1 applied)."""
    e = enrolments(t).filter(F.col("status") == "completed")
    return e.withColumns({"grade": grade_letter("total_score"), "grade_point": grade_point("total_score")})


def term(t) -> DataFrame:
    """Per (student, period) rollup of CA and attendance (D1 subset)."""
    return rollups.term_rollup(enrolments(t), KEY, with_level=False, with_difficulty=False,
                               with_attendance_std=False)


def history(t) -> DataFrame:
    """academic_history equivalent: credits, term GPA (D5) and running CGPA."""
    g = graded(t)
    per = rollups.term_points(g, KEY, points="grade_point", units="units", grade="grade")
    per = running_weighted_mean(per, ENTITY, PERIOD, "pts", "credits_registered", "cgpa")
    return per.select(*KEY, "credits_registered", "credits_earned",
                      (F.col("pts") / F.col("credits_registered").cast("double")).alias("gpa"), "cgpa")


def engagement(t) -> DataFrame:
    """Weekly engagement counters from the event stream."""
    ev = t["events"]
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    return (ev.groupBy(F.col("user_id").alias("student_id"), week.alias("week"))
            .agg(F.count(F.lit(1)).alias("logins"),
                 F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("submitted"),
                 F.avg("value").alias("study_hours")))


def students(t) -> DataFrame:
    """customer as student: segment = entry mode / group, acctbal = entry score."""
    return t["customer"].select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"),
                                F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("entry_score"),
                                F.col("c_mktsegment").alias("entry_mode"))


def courses(t) -> DataFrame:
    return t["part"].select(F.col("p_partkey").alias("course_id"), F.col("p_brand").alias("department"),
                            F.col("p_type").alias("course_type"), (F.col("p_size") % 3 + 2).alias("units"),
                            (F.floor((F.col("p_size") - 1) / 10).cast("int") * 100 + 100).alias("level"))


def interventions(t) -> DataFrame:
    """orders as interventions: open orders are planned, partly filled ones in progress, the rest completed."""
    o = t["orders"]
    status = (F.when(F.col("o_orderstatus") == "O", "planned").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed"))
    return o.select(F.col("o_orderkey").alias("intervention_id"), F.col("o_custkey").alias("student_id"), status.alias("status"),
                    F.col("o_orderdate").alias("created_at"))


def profile_items(t) -> DataFrame:
    """Enrolments as a profile shows them: the exam is what the total has beyond the assessment."""
    e = enrolments(t)
    return e.withColumns({"exam_score": F.when(F.col("status") == "completed", F.col("total_score") - F.col("ca_score")),
                          "grade": F.when(F.col("total_score").isNotNull(), grade_letter("total_score"))})
