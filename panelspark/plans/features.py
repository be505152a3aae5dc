"""Feature tables (J1-J5) as one composition over generic column roles.

Physical shape of J1 (what ``explain`` shows):

1. enrolment facts -> per (course, period) offering means -> prior-offering
   difficulty (window by course over offerings: bounded by periods);
2. enrolments joined to difficulty, then ONE (entity, period) aggregate that
   yields the term rollup, the grade points for GPA, earned credits and
   fail counts together (partial aggregation before the shuffle);
3. ONE window pass by entity over that small grain (lags, trend,
   volatility, expanding ratio, carryovers, index);
4. peer means (groupBy + join), engagement and static attributes with
   population z-scores (one-row aggregates, broadcast);
5. interactions as projections.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.constants import CA_WEIGHT, LEVELS, PROBATION_THRESHOLD
from panelspark.functions.rows import assert_no_leakage, safe_ratio
from panelspark.operators import history as H
from panelspark.operators.rollups import mode_over_domain
from panelspark.session import cut_lineage

ENROLMENT_FACTS = ("units", "level", "is_core", "ca_score", "attendance_rate", "total_score", "status", "grade", "grade_point")
HISTORY_FEATURES = ("prior_cgpa", "prior_gpa", "gpa_trend", "gpa_volatility", "credits_earned_ratio",
                    "carryover_count", "semesters_completed")
TERM_FEATURES = ("ca_average", "ca_std_dev_across_courses", "lowest_ca_score", "courses_below_ca_threshold",
                 "mean_attendance_rate", "min_attendance_rate", "attendance_std_dev", "courses_below_75_percent",
                 "credit_load", "core_course_ratio", "mean_course_difficulty_index", "level", "ca_to_max_ratio",
                 "credit_load_vs_level_mean")
ENGAGEMENT_FEATURES = ("submission_rate", "punctuality_rate", "lms_logins_normalised", "study_hours_per_week",
                       "tutorial_attendance_rate", "library_visits_normalised")
STATIC_FEATURES = ("entry_mode", "employment_status", "accommodation", "has_scholarship", "entry_score_normalised")
INTERACTION_FEATURES = ("attendance_x_ca_average", "study_hours_per_credit_load", "gpa_trend_x_credit_load")
PANEL_FEATURES = HISTORY_FEATURES + TERM_FEATURES + ENGAGEMENT_FEATURES + STATIC_FEATURES + INTERACTION_FEATURES
ITEM_FEATURES = ("ca_score", "ca_to_max_ratio", "attendance_rate", "sessions_attended", "sessions_held",
                 "attendance_x_ca_score")


@dataclass
class FeatureSet:
    """Features, labels and row identity of one table, kept apart by name."""
    df: DataFrame
    feature_cols: tuple[str, ...]
    label_cols: tuple[str, ...]
    meta_cols: tuple[str, ...]

    def features(self) -> DataFrame:
        return self.df.select(*self.meta_cols, *self.feature_cols)

    def labels(self) -> DataFrame:
        return self.df.select(*self.meta_cols, *self.label_cols)


def term_panel(enr: DataFrame, entity: str = "student_id", course: str = "course_id",
               period: Sequence[str] = ("session", "semester"), level_domain: Sequence | None = LEVELS,
               materialize: bool = True) -> DataFrame:
    """Steps 1-2: one row per (entity, period) with rollup + GPA inputs + fail counts.

    ``enr`` columns: entity, course, period..., units, level, is_core, ca_score,
    attendance_rate, total_score, status, grade, grade_point.  Offerings and
    terms both read them; ``materialize`` writes these columns once, so that
    the joins behind them run once.
    """
    key = [entity, *period]
    if materialize:
        enr = cut_lineage(enr.select(*key, course, *ENROLMENT_FACTS), "panel-facts")
    done = (F.col("status") == "completed") & F.col("total_score").isNotNull()
    offers = enr.filter(done).groupBy(course, *period).agg(
        F.avg("total_score").alias("mean_score"), F.sum("total_score").alias("_sum"), F.count("total_score").alias("_n"))
    diff = H.prior_difficulty(offers, course, period, sum_col="_sum", count_col="_n")
    # rows come by course here, so groups before the shuffle would be as many as rows, and wider
    x = enr.join(diff, [course, *period], "left").repartition(*key)
    completed = F.col("status") == "completed"
    agg = x.groupBy(*key).agg(
        F.avg("ca_score").alias("ca_average"),
        F.stddev_samp("ca_score").alias("ca_std_dev_across_courses"),
        F.min("ca_score").alias("lowest_ca_score"),
        F.sum(F.when(F.col("ca_score") < CA_WEIGHT / 2, 1).otherwise(0)).cast("long").alias("courses_below_ca_threshold"),
        F.avg("attendance_rate").alias("mean_attendance_rate"),
        F.min("attendance_rate").alias("min_attendance_rate"),
        F.stddev_samp("attendance_rate").alias("attendance_std_dev"),
        F.sum(F.when(F.col("attendance_rate") < 0.75, 1).otherwise(0)).cast("long").alias("courses_below_75_percent"),
        F.sum("units").cast("long").alias("credit_load"),
        F.avg(F.col("is_core").cast("double")).alias("core_course_ratio"),
        F.avg("difficulty_index").alias("mean_course_difficulty_index"),
        (mode_over_domain("level", level_domain) if level_domain else F.mode("level", True)).alias("level"),
        F.sum(F.when(completed, F.col("grade_point") * F.col("units"))).cast("long").alias("_pts"),
        F.sum(F.when(completed, F.col("units"))).cast("long").alias("credits_registered"),
        F.sum(F.when(completed & (F.col("grade") != "F"), F.col("units")).when(completed, 0)).cast("long")
        .alias("credits_earned"),
        F.sum(F.when(completed & (F.col("grade") == "F"), 1).otherwise(0)).cast("long").alias("_fails"),
        F.max(F.when(F.col("status") == "ongoing", 1).otherwise(0)).alias("_open"),
    )
    return agg.withColumn("ca_to_max_ratio", F.col("ca_average") / CA_WEIGHT)


def panel_features(enr: DataFrame, engagement: DataFrame, static: DataFrame, entity: str = "student_id",
                   course: str = "course_id", period: Sequence[str] = ("session", "semester"),
                   include_current: bool = False, task: str = "risk_classification",
                   checkpoint: bool = True) -> FeatureSet:
    """J1 (``include_current=False``: completed periods) / J2 (open periods only).

    ``engagement``: entity (+ period when available) with submission_rate,
    punctuality_rate, lms_logins, study_hours_per_week, tutorial_attendance_rate,
    library_visits.  ``static``: entity, entry_mode, employment_status,
    accommodation, has_scholarship, entry_score.
    """
    key = [entity, *period]
    tp = term_panel(enr, entity, course, period, materialize=checkpoint)
    tp = tp.withColumn("gpa", F.when(F.col("credits_registered") > 0,
                                     F.col("_pts") / F.col("credits_registered").cast("double")))
    spine_cond = F.col("credits_registered") > 0
    if include_current:
        spine_cond = spine_cond | (F.col("_open") == 1)
    tp = tp.filter(spine_cond)
    # cumulative CGPA over completed rows; open rows carry nulls (they add nothing to the sums)
    tp = H.running_weighted_mean(tp, entity, period, "_pts", "credits_registered", "cgpa")
    tp = tp.withColumn("cgpa", F.when(F.col("gpa").isNotNull(), F.col("cgpa")))
    w_hist = H.history_features(tp, entity, period)
    w_hist = w_hist.withColumn("carryover_count", H.expanding_prior_sum_expr("_fails", entity, period))
    if checkpoint:
        # The (entity, period) grain feeds both the peer aggregate and the join back; writing it once
        # to the shared checkpoint folder keeps the fact scans and shuffles from running twice.
        assert_no_leakage(w_hist, task, [c for c in w_hist.columns if c in PANEL_FEATURES])
        w_hist = cut_lineage(w_hist, "panel-grain")
    w_hist = H.peer_deviation(w_hist, "credit_load", ["level", *period], "credit_load_vs_level_mean")
    # engagement: the per-entity aggregate feeds both the z-score statistics and the join; it is
    # bounded by the entity count, so write it once instead of aggregating the event stream twice
    if checkpoint:
        engagement = cut_lineage(engagement, "engagement")
    eng = H.zscore(engagement, {"lms_logins_normalised": "lms_logins",
                                "library_visits_normalised": "library_visits"})
    eng_keys = [c for c in key if c in engagement.columns]
    eng = eng.select(*eng_keys, *ENGAGEMENT_FEATURES)
    st = H.zscore(static, {"entry_score_normalised": "entry_score"}).select(
        entity, "entry_mode", "employment_status", "accommodation", "has_scholarship", "entry_score_normalised")
    x = w_hist.join(eng, eng_keys, "left").join(st, entity, "left")
    x = x.withColumns({
        "attendance_x_ca_average": F.col("mean_attendance_rate") * F.col("ca_average"),
        "study_hours_per_credit_load": safe_ratio("study_hours_per_week", "credit_load"),
        "gpa_trend_x_credit_load": F.col("gpa_trend") * F.col("credit_load"),
        "risk_label": F.coalesce((F.col("gpa") < PROBATION_THRESHOLD).cast("int"), F.lit(0)),
        "target_gpa": F.col("gpa"),
        "target_cgpa": F.col("cgpa"),
    })
    if include_current:
        x = x.filter(F.col("gpa").isNull())
    fs = FeatureSet(x.select(*key, *PANEL_FEATURES, "risk_label", "target_gpa", "target_cgpa"),
                    PANEL_FEATURES, ("risk_label", "target_gpa", "target_cgpa"), tuple(key))
    assert_no_leakage(fs.df, task, fs.feature_cols)
    return fs


def item_features(enr: DataFrame, entity: str = "student_id", course: str = "course_id",
                  period: Sequence[str] = ("session", "semester"), ongoing: bool = False) -> FeatureSet:
    """J3 (completed items with a score) / J4 (ongoing items): CA and attendance only."""
    if ongoing:
        x = enr.filter(F.col("status") == "ongoing")
    else:
        x = enr.filter((F.col("status") == "completed") & F.col("total_score").isNotNull())
    x = x.withColumns({
        "ca_to_max_ratio": F.col("ca_score") / CA_WEIGHT,
        "attendance_x_ca_score": F.col("attendance_rate") * F.col("ca_score"),
        "target_total_score": F.col("total_score"),
    })
    meta = (entity, course, *period)
    fs = FeatureSet(x.select(*meta, *ITEM_FEATURES, "target_total_score"), ITEM_FEATURES,
                    ("target_total_score",), meta)
    assert_no_leakage(fs.df, "course_score", fs.feature_cols)
    return fs
