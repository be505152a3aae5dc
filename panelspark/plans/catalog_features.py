"""Registered queries: feature tables (J1-J5) over the driver tables."""

from pyspark.sql import functions as F

from panelspark.functions.numeric import r6, r6t
from panelspark.plans import features as FT
from panelspark.plans import views as V
from panelspark.plans.registry import query
from panelspark.plans.sql_views import ENR, with_views


def panel_inputs(t):
    """Enrolments with grades, per-user engagement from events, static attributes from customer."""
    from panelspark.functions.bands import grade_letter, grade_point
    e = V.enrolments(t)
    done = F.col("status") == "completed"
    e = e.withColumns({"grade": F.when(done, grade_letter("total_score")),
                       "grade_point": F.when(done, grade_point("total_score"))})
    ev = t["events"]
    eng = ev.groupBy(F.col("user_id").alias("student_id")).agg(
        F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("submission_rate"),
        F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("punctuality_rate"),
        F.count(F.lit(1)).alias("lms_logins"),
        F.avg("value").alias("study_hours_per_week"),
        F.avg(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)).alias("tutorial_attendance_rate"),
        F.countDistinct(F.dayofmonth("ts")).alias("library_visits"))
    c = t["customer"]
    static = c.select(F.col("c_custkey").alias("student_id"), F.col("c_mktsegment").alias("entry_mode"),
                      F.when(F.col("c_nationkey") % 3 == 0, "none").when(F.col("c_nationkey") % 3 == 1, "part_time")
                      .otherwise("full_time").alias("employment_status"),
                      F.when(F.col("c_acctbal") >= 0, "on_campus").otherwise("off_campus").alias("accommodation"),
                      (F.col("c_acctbal") > 8000).alias("has_scholarship"),
                      F.col("c_acctbal").alias("entry_score"))
    return e, eng, static


def panel_featureset(t, include_current=False):
    e, eng, static = panel_inputs(t)
    return FT.panel_features(e, eng, static, include_current=include_current)


INT_COLS = {"courses_below_ca_threshold", "courses_below_75_percent", "credit_load", "level",
            "carryover_count", "semesters_completed", "risk_label"}
NON_NUM = {"entry_mode", "employment_status", "accommodation", "has_scholarship"}


TIE_COLS = {"attendance_x_ca_average", "gpa_trend_x_credit_load", "attendance_x_ca_score",
            "mean_course_difficulty_index"}


def _present(df, cols):
    return [F.col(c) if (c in INT_COLS or c in NON_NUM) else (r6t(c) if c in TIE_COLS else r6(c)).alias(c)
            for c in cols]


def panel_sql(include_current: bool) -> str:
    spine = "credits_registered > 0 or is_open = 1" if include_current else "credits_registered > 0"
    final_filter = "where h.gpa is null" if include_current else ""
    return with_views(ENR) + f""",
gr as (select *,
    case when status = 'completed' then case when total_score >= 70 then 'A' when total_score >= 60 then 'B'
      when total_score >= 50 then 'C' when total_score >= 45 then 'D' when total_score >= 40 then 'E' else 'F' end end as grade,
    case when status = 'completed' then case when total_score >= 70 then 5 when total_score >= 60 then 4
      when total_score >= 50 then 3 when total_score >= 45 then 2 when total_score >= 40 then 1 else 0 end end as grade_point
  from enr),
off as (select course_id, session, semester, avg(total_score) as mean_score from enr
  where status = 'completed' and total_score is not null group by all),
fb as (select 1 - avg(total_score) / 100 as fallback from enr where status = 'completed' and total_score is not null),
diff as (select course_id, session, semester, coalesce(1 - avg(mean_score) over (partition by course_id
    order by session, semester rows between unbounded preceding and 1 preceding) / 100, fallback) as difficulty_index
  from off cross join fb),
x as (select g.*, d.difficulty_index from gr g left join diff d
  on g.course_id = d.course_id and g.session = d.session and g.semester = d.semester),
lvl as (select student_id, session, semester, level from (
    select student_id, session, semester, level,
      row_number() over (partition by student_id, session, semester order by n desc, level) as rk
    from (select student_id, session, semester, level, count(*) as n from enr group by all) c) r where rk = 1),
tp as (select student_id, session, semester, avg(ca_score) as ca_average,
    stddev_samp(ca_score) as ca_std_dev_across_courses, min(ca_score) as lowest_ca_score,
    cast(sum(case when ca_score < 15 then 1 else 0 end) as bigint) as courses_below_ca_threshold,
    avg(attendance_rate) as mean_attendance_rate, min(attendance_rate) as min_attendance_rate,
    stddev_samp(attendance_rate) as attendance_std_dev,
    cast(sum(case when attendance_rate < 0.75 then 1 else 0 end) as bigint) as courses_below_75_percent,
    cast(sum(units) as bigint) as credit_load, avg(cast(is_core as double)) as core_course_ratio,
    avg(difficulty_index) as mean_course_difficulty_index,
    cast(sum(case when status = 'completed' then grade_point * units end) as bigint) as pts,
    cast(sum(case when status = 'completed' then units end) as bigint) as credits_registered,
    cast(sum(case when status = 'completed' and grade <> 'F' then units when status = 'completed' then 0 end) as bigint)
      as credits_earned,
    cast(sum(case when status = 'completed' and grade = 'F' then 1 else 0 end) as bigint) as fails,
    max(case when status = 'ongoing' then 1 else 0 end) as is_open
  from x group by student_id, session, semester),
sp as (select tp.*, l.level, tp.ca_average / 30.0 as ca_to_max_ratio,
    case when tp.credits_registered > 0 then tp.pts / cast(tp.credits_registered as double) end as gpa
  from tp join lvl l on tp.student_id = l.student_id and tp.session = l.session and tp.semester = l.semester
  where {spine}),
cg as (select *, case when gpa is not null then sum(pts) over wc / cast(sum(credits_registered) over wc as double) end as cgpa
  from sp window wc as (partition by student_id order by session, semester rows between unbounded preceding and current row)),
h as (select *, lag(cgpa, 1) over w as prior_cgpa, lag(gpa, 1) over w as prior_gpa,
    lag(gpa, 1) over w - lag(gpa, 3) over w as gpa_trend,
    case when count(gpa) over w3 >= 2 then stddev_pop(gpa) over w3 end as gpa_volatility,
    case when sum(credits_registered) over wp <> 0
      then sum(credits_earned) over wp / cast(sum(credits_registered) over wp as double) end as credits_earned_ratio,
    cast(sum(fails) over wp as bigint) as carryover_count,
    cast(row_number() over w - 1 as bigint) as semesters_completed
  from cg window w as (partition by student_id order by session, semester),
    w3 as (partition by student_id order by session, semester rows between 3 preceding and 1 preceding),
    wp as (partition by student_id order by session, semester rows between unbounded preceding and 1 preceding)),
peer as (select level, session, semester, avg(credit_load) as pm from h where level is not null group by all),
ev as (select user_id as student_id, avg(case when event_type = 'purchase' then 1.0 else 0.0 end) as submission_rate,
    avg(case when event_type <> 'error' then 1.0 else 0.0 end) as punctuality_rate, count(*) as lms_logins,
    avg(value) as study_hours_per_week, avg(case when event_type = 'view' then 1.0 else 0.0 end) as tutorial_attendance_rate,
    count(distinct day(ts)) as library_visits
  from events group by user_id),
evs as (select avg(lms_logins) as m1, stddev_pop(lms_logins) as s1, avg(library_visits) as m2,
    stddev_pop(library_visits) as s2 from ev),
eng as (select student_id, submission_rate, punctuality_rate,
    case when s1 is null or s1 = 0 then 0.0 else (lms_logins - m1) / s1 end as lms_logins_normalised,
    study_hours_per_week, tutorial_attendance_rate,
    case when s2 is null or s2 = 0 then 0.0 else (library_visits - m2) / s2 end as library_visits_normalised
  from ev cross join evs),
stat as (select c_custkey as student_id, c_mktsegment as entry_mode,
    case c_nationkey % 3 when 0 then 'none' when 1 then 'part_time' else 'full_time' end as employment_status,
    case when c_acctbal >= 0 then 'on_campus' else 'off_campus' end as accommodation,
    c_acctbal > 8000 as has_scholarship, c_acctbal as entry_score from customer),
ss as (select avg(entry_score) as m, stddev_pop(entry_score) as s from stat),
st as (select student_id, entry_mode, employment_status, accommodation, has_scholarship,
    case when s is null or s = 0 then 0.0 else (entry_score - m) / s end as entry_score_normalised
  from stat cross join ss)
select h.student_id, h.session, h.semester,
  round(h.prior_cgpa, 6) as prior_cgpa, round(h.prior_gpa, 6) as prior_gpa, round(h.gpa_trend, 6) as gpa_trend,
  round(h.gpa_volatility, 6) as gpa_volatility, round(h.credits_earned_ratio, 6) as credits_earned_ratio,
  h.carryover_count, h.semesters_completed,
  round(h.ca_average, 6) as ca_average, round(h.ca_std_dev_across_courses, 6) as ca_std_dev_across_courses,
  round(h.lowest_ca_score, 6) as lowest_ca_score, h.courses_below_ca_threshold,
  round(h.mean_attendance_rate, 6) as mean_attendance_rate, round(h.min_attendance_rate, 6) as min_attendance_rate,
  round(h.attendance_std_dev, 6) as attendance_std_dev, h.courses_below_75_percent, h.credit_load,
  round(h.core_course_ratio, 6) as core_course_ratio,
  round(h.mean_course_difficulty_index + 1e-9, 6) as mean_course_difficulty_index, h.level,
  round(h.ca_to_max_ratio, 6) as ca_to_max_ratio, round(h.credit_load - p.pm, 6) as credit_load_vs_level_mean,
  round(e.submission_rate, 6) as submission_rate, round(e.punctuality_rate, 6) as punctuality_rate,
  round(e.lms_logins_normalised, 6) as lms_logins_normalised, round(e.study_hours_per_week, 6) as study_hours_per_week,
  round(e.tutorial_attendance_rate, 6) as tutorial_attendance_rate,
  round(e.library_visits_normalised, 6) as library_visits_normalised,
  st.entry_mode, st.employment_status, st.accommodation, st.has_scholarship,
  round(st.entry_score_normalised, 6) as entry_score_normalised,
  round(h.mean_attendance_rate * h.ca_average + 1e-9, 6) as attendance_x_ca_average,
  round(case when h.credit_load <> 0 then e.study_hours_per_week / h.credit_load end, 6) as study_hours_per_credit_load,
  round(h.gpa_trend * h.credit_load + 1e-9, 6) as gpa_trend_x_credit_load,
  case when h.gpa < 2.0 then 1 else 0 end as risk_label, round(h.gpa, 6) as target_gpa, round(h.cgpa, 6) as target_cgpa
from h left join peer p on h.level = p.level and h.session = p.session and h.semester = p.semester
left join eng e on h.student_id = e.student_id
left join st on h.student_id = st.student_id
{final_filter}"""


def _panel(t, include_current):
    fs = panel_featureset(t, include_current)
    return fs.df.select(*fs.meta_cols, *_present(fs.df, fs.feature_cols),
                        F.col("risk_label"), r6("target_gpa").alias("target_gpa"), r6("target_cgpa").alias("target_cgpa"))


@query("panel_features", headline=True, sql=panel_sql(False))
def panel_features(t):
    """J1 flagship: 35 leakage-guarded features + labels per completed (student, period)."""
    return _panel(t, False)


@query("open_period_features", sql=panel_sql(True))
def open_period_features(t):
    """The same columns for each student's open period (G1 before the lags)."""
    return _panel(t, True)


ITEM_SQL = with_views(ENR) + """
select student_id, course_id, session, semester, round(ca_score, 6) as ca_score,
  round(ca_score / 30.0, 6) as ca_to_max_ratio, round(attendance_rate, 6) as attendance_rate,
  cast(floor(attendance_rate * 20 + 0.5) as int) as sessions_attended, 20 as sessions_held,
  round(attendance_rate * ca_score + 1e-9, 6) as attendance_x_ca_score, round(total_score, 6) as target_total_score
from enr where """


def item_frame(t):
    e = V.enrolments(t).withColumns({
        "sessions_attended": F.floor(F.col("attendance_rate") * 20 + 0.5).cast("int"),
        "sessions_held": F.lit(20)})
    return e


def _items(t, ongoing):
    fs = FT.item_features(item_frame(t), ongoing=ongoing)
    d = fs.df
    return d.select(*fs.meta_cols, r6("ca_score").alias("ca_score"), r6("ca_to_max_ratio").alias("ca_to_max_ratio"),
                    r6("attendance_rate").alias("attendance_rate"), "sessions_attended", "sessions_held",
                    r6t("attendance_x_ca_score").alias("attendance_x_ca_score"),
                    r6("target_total_score").alias("target_total_score"))


@query("item_features", sql=ITEM_SQL + "status = 'completed' and total_score is not null")
def item_features(t):
    """Per completed enrolment, CA and attendance features with the score label."""
    return _items(t, False)


@query("open_item_features", sql=ITEM_SQL + "status = 'ongoing'")
def open_item_features(t):
    """The same features for ongoing enrolments."""
    return _items(t, True)


@query("panel_labels", sql="with pf as (" + panel_sql(False).replace("with enr as", "with enr as", 1) + """)
select student_id, session, semester, risk_label, target_gpa, target_cgpa from pf""")
def panel_labels(t):
    """Labels kept apart from features: risk_label = gpa < 2.0 (null -> 0), targets."""
    fs = panel_featureset(t)
    lab = fs.labels()
    return lab.select(*fs.meta_cols, "risk_label", r6("target_gpa").alias("target_gpa"),
                      r6("target_cgpa").alias("target_cgpa"))
