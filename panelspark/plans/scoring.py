"""Open-period panel and a fixed linear reference scorer over the driver tables.

The served datasets (register, tiers, reports, explanations) need a score.
Trained models are exercised by the ``catalog_models`` queries; for
oracle-checkable serving queries we use a fixed logistic scorer whose
coefficients are declared below, so the same numbers can be written in SQL.
Its exact Shapley values are closed-form: w_j * (x_j - mean_j) in logit space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.bands import risk_tier
from panelspark.operators import history as H
from panelspark.operators import rollups as R
from panelspark.plans import views as V

# FIXED VALUES: reference scorer (feature, fill value for null, centre, weight).
SCORER = (
    ("prior_cgpa", 2.5, 2.5, -1.2),
    ("gpa_trend", 0.0, 0.0, -0.5),
    ("ca_average", 15.0, 15.0, -0.08),
    ("mean_attendance_rate", 0.75, 0.75, -3.0),
    ("credit_load", 12.0, 12.0, 0.05),
    ("courses_below_75_percent", 0.0, 0.0, 0.3),
)
SCORER_FEATURES = tuple(f for f, _, _, _ in SCORER)


def extended_lagged(t) -> DataFrame:
    """History plus open periods (G1), then the E1/E2 windows over both."""
    open_keys = R.distinct_periods(V.enrolments(t), V.KEY)
    ext = H.extend_with_open_period(V.history(t), open_keys, ["credits_registered", "credits_earned", "gpa", "cgpa"])
    return H.history_features(ext)


def open_panel(t) -> DataFrame:
    """Open-period rows with prior history and current-term rollups.

    Built from the single (entity, period) aggregate of the feature table
    (``features.term_panel``): completed periods supply the GPA history,
    the open period its CA/attendance rollup; one window pass by entity.
    """
    from panelspark.plans.catalog_features import panel_inputs
    from panelspark.plans.features import term_panel
    enr, _, _ = panel_inputs(t)
    tp = term_panel(enr)
    tp = tp.withColumn("gpa", F.when(F.col("credits_registered") > 0,
                                     F.col("_pts") / F.col("credits_registered").cast("double")))
    tp = tp.filter((F.col("credits_registered") > 0) | (F.col("_open") == 1))
    tp = H.running_weighted_mean(tp, "student_id", V.PERIOD, "_pts", "credits_registered", "cgpa")
    tp = tp.withColumn("cgpa", F.when(F.col("gpa").isNotNull(), F.col("cgpa")))
    h = H.history_features(tp)
    return h.filter(F.col("gpa").isNull()).select(
        *V.KEY, "prior_cgpa", "gpa_trend", "ca_average", "ca_std_dev_across_courses", "lowest_ca_score",
        "courses_below_ca_threshold", "mean_attendance_rate", "min_attendance_rate", "courses_below_75_percent",
        "credit_load", "core_course_ratio", "ca_to_max_ratio")


def logit_expr():
    z = F.lit(0.0)
    for f, fill, centre, w in SCORER:
        z = z + F.lit(w) * (F.coalesce(F.col(f).cast("double"), F.lit(fill)) - F.lit(centre))
    return z


def scored_open(t) -> DataFrame:
    """Open panel with probability and tier from the reference scorer."""
    p = open_panel(t)
    prob = 1 / (1 + F.exp(-logit_expr()))
    return p.withColumn("probability", prob).withColumn("risk_tier", risk_tier("probability"))


# Oracle-side SQL for the same datasets.
OPEN_SQL = """ext as (
  select student_id, session, semester, gpa, cgpa from hist
  union all
  select distinct student_id, session, semester, cast(null as double), cast(null as double) from enr where status = 'ongoing'),
lagged as (
  select *, lag(cgpa, 1) over w as prior_cgpa, lag(gpa, 1) over w - lag(gpa, 3) over w as gpa_trend
  from ext window w as (partition by student_id order by session, semester)),
openp as (
  select l.student_id, l.session, l.semester, l.prior_cgpa, l.gpa_trend, t.ca_average, t.mean_attendance_rate,
    t.credit_load, t.courses_below_75_percent
  from lagged l join term t on l.student_id = t.student_id and l.session = t.session and l.semester = t.semester
  where l.gpa is null),
scored as (
  select *, 1 / (1 + exp(-(
      -1.2 * (coalesce(prior_cgpa, 2.5) - 2.5) - 0.5 * (coalesce(gpa_trend, 0.0) - 0.0)
      - 0.08 * (coalesce(ca_average, 15.0) - 15.0) - 3.0 * (coalesce(mean_attendance_rate, 0.75) - 0.75)
      + 0.05 * (coalesce(cast(credit_load as double), 12.0) - 12.0)
      + 0.3 * (coalesce(cast(courses_below_75_percent as double), 0.0) - 0.0)))) as probability
  from openp),
tiered as (
  select *, case when probability >= 0.75 then 'critical' when probability >= 0.5 then 'high'
    when probability >= 0.25 then 'moderate' else 'low' end as risk_tier
  from scored)"""
