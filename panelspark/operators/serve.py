"""Scoring and served datasets.

Everything is computed for all entities at once; serving a single entity
is a filter on the result (pushed into the scan when the result is stored).
Row scoping is a semi join against a (user, entity) grant table built once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.bands import risk_tier, standing_band
from panelspark.functions.numeric import half_even
from panelspark.operators.select import ranked_register


def score_with_model(features: DataFrame, model, prob_col: str = "probability") -> DataFrame:
    """Positive-class probability from a fitted classifier pipeline, then the tier."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(features)
    return (out.withColumn(prob_col, vector_to_array(F.col("probability")).getItem(1))
            .withColumn("risk_tier", risk_tier(prob_col)))


def at_risk_register(scored: DataFrame, entities: DataFrame, key: str = "student_id",
                     tier: str | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Scored rows + entity attributes, probability-descending; optional tier and scope."""
    s = scored if scope is None else scored.join(scope.select(key), key, "left_semi")
    return ranked_register(s, entities, key, tier=tier)


def build_grants(memberships: dict[str, DataFrame]) -> DataFrame:
    """(user_id, role, entity) grant table from per-role membership frames.

    Each frame must have ``user_id`` and ``student_id``; admins are not
    materialised (they see everything).
    """
    parts = [df.select("user_id", F.lit(role).alias("role"), "student_id") for role, df in memberships.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["user_id", "student_id"])


def scope_rows(df: DataFrame, grants: DataFrame, user_id: str | None, role: str, key: str = "student_id") -> DataFrame:
    """Admin sees all; adviser / lecturer / student see granted entities; unknown sees none."""
    if role == "admin":
        return df
    if role not in ("adviser", "lecturer", "student") or user_id is None:
        return df.limit(0)
    g = grants.filter(F.col("user_id") == user_id).select(F.col("student_id").alias(key))
    return df.join(g, key, "left_semi")


def scoped_rows_all_users(df: DataFrame, grants: DataFrame, key: str = "student_id") -> DataFrame:
    """P6 for every non-admin user at once: (user_id, role, rows of df in scope)."""
    return grants.withColumnRenamed("student_id", key).join(df, key)


def scoped_log(log: DataFrame, grants: DataFrame, at: str, tie: str, key: str = "student_id") -> DataFrame:
    """Every user's log rows in scope, newest first (equal times by ``tie``)."""
    return scoped_rows_all_users(log, grants, key).orderBy(F.desc(at), tie, "user_id")


def format_percent(p, digits: int = 1):
    """'12.3%' text of a probability."""
    # format_string renders null as (truncated) "null": guard it so callers can coalesce
    return F.when(p.isNotNull(), F.concat(F.format_string(f"%.{digits}f", half_even(p * 100, digits)), F.lit("%")))


def format_number(c, digits: int = 1):
    """'12.3' text, '-' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(c.isNotNull(), F.format_string(f"%.{digits}f", half_even(c, digits))), F.lit("-"))


def register_report(register: DataFrame, name: str = "name", level: str = "level",
                    tier: str = "risk_tier", prob: str = "probability") -> DataFrame:
    """Report rows for high and critical tiers: name, level, capitalised tier, 'p%'; missing -> '-'."""
    r = register.filter(F.col(tier).isin("high", "critical"))
    dash = F.lit("-")
    return r.select("student_id", F.coalesce(F.col(name), dash).alias("name"),
                    F.coalesce(F.col(level).cast("string"), dash).alias("level"),
                    F.coalesce(F.initcap(tier), dash).alias("tier"),
                    F.coalesce(format_percent(F.col(prob)), dash).alias("risk"))


def entity_profile(entities: DataFrame, history: DataFrame, enrolments: DataFrame, key: str = "student_id",
                   period: Sequence[str] = ("session", "semester")) -> DataFrame:
    """P5: entity + its history ordered by period (an array bounded by the number of periods)
    + enrolment counts (enrolment lists are not nested: one entity may own a third of them)."""
    h = (history.groupBy(key)
         .agg(F.sort_array(F.collect_list(F.struct(*period, "gpa", "cgpa"))).alias("history"),
              F.count(F.lit(1)).alias("n_history")))
    e = enrolments.groupBy(key).agg(F.count(F.lit(1)).alias("n_enrolments"),
                                    F.countDistinct("course_id").alias("n_courses"))
    return entities.join(h, key, "left").join(e, key, "left")


def profile_history(history: DataFrame, key: str = "student_id", period: Sequence[str] = ("session", "semester")) -> DataFrame:
    """P5 in rows: every period of every entity with its standing and line number (an entity has few periods)."""
    w = Window.partitionBy(key).orderBy(*period)
    return history.withColumns({"standing": standing_band("cgpa"), "line": F.row_number().over(w).cast("long")})


def profile_enrolments(items: DataFrame, courses: DataFrame) -> DataFrame:
    """P5 in rows: every enrolment with its course; rows, not lists, since one entity may own a third of them."""
    return items.join(courses.select("course_id", "department"), "course_id")


def report_history_lines(rows: DataFrame, key: str = "student_id") -> DataFrame:
    """History rows as report text."""
    return rows.select(key, F.col("session").cast("string").alias("session"), F.col("semester").cast("string").alias("semester"),
                       format_number("gpa", 2).alias("gpa"), format_number("cgpa", 2).alias("cgpa"), "standing")


def report_enrolment_lines(rows: DataFrame, key: str = "student_id") -> DataFrame:
    """Enrolment rows as report text; missing -> '-'."""
    dash = F.lit("-")
    return rows.select(key, F.col("course_id").cast("string").alias("course"),
                       F.format_string("%s S%s", F.col("session").cast("string"), F.col("semester").cast("string")).alias("period"),
                       format_number("ca_score").alias("ca"), format_number("exam_score").alias("exam"), format_number("total_score").alias("total"),
                       F.coalesce("grade", dash).alias("grade"), F.coalesce(format_percent(F.col("attendance_rate"), 0), dash).alias("attendance"))
