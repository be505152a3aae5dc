"""Registered queries: aggregations."""

from pyspark.sql import functions as F

from panelspark.operators import rollups as R
from panelspark.plans import views as V
from panelspark.functions.numeric import r6
from panelspark.plans.registry import query
from panelspark.plans.scoring import OPEN_SQL, scored_open
from panelspark.session import cut_lineage
from panelspark.plans.sql_views import ENR, GRADED, HIST, HIST_CTE, TERM, with_views




@query("session_trends", headline=True, sql=HIST_CTE + """
select session, round(avg(gpa), 3) as average_gpa, round(avg(cgpa), 3) as average_cgpa,
  count(distinct student_id) as n_students
from hist group by session
""")
def session_trends(t):
    """D5 term GPA -> E8 running CGPA -> D6 per-session trends."""
    return R.session_trends(V.history(t))


LEVEL_MODE_SQL = """lvl as (
  select student_id, session, semester, level from (
    select student_id, session, semester, level,
      row_number() over (partition by student_id, session, semester order by n desc, level) as rk
    from (select student_id, session, semester, level, count(*) as n from enr group by all) c) r
  where rk = 1)"""


@query("term_rollup", headline=True, sql=with_views(ENR, TERM, LEVEL_MODE_SQL) + """,
extra as (select student_id, session, semester, stddev_samp(attendance_rate) as attendance_std_dev
  from enr group by all)
select t.student_id, t.session, t.semester, round(ca_average, 6) as ca_average,
  round(ca_std_dev_across_courses, 6) as ca_std_dev_across_courses, round(lowest_ca_score, 6) as lowest_ca_score,
  courses_below_ca_threshold, round(mean_attendance_rate, 6) as mean_attendance_rate,
  round(min_attendance_rate, 6) as min_attendance_rate, round(attendance_std_dev, 6) as attendance_std_dev,
  courses_below_75_percent, credit_load, round(core_course_ratio, 6) as core_course_ratio,
  round(ca_to_max_ratio, 6) as ca_to_max_ratio, l.level
from term t join lvl l on t.student_id = l.student_id and t.session = l.session and t.semester = l.semester
join extra e on t.student_id = e.student_id and t.session = e.session and t.semester = e.semester""")
def term_rollup(t):
    """D1 (+D14 modal level): per (student, period) CA/attendance/load rollup in one aggregate."""
    x = R.term_rollup(V.enrolments(t), V.KEY, with_difficulty=False)
    num = ["ca_average", "ca_std_dev_across_courses", "lowest_ca_score", "mean_attendance_rate",
           "min_attendance_rate", "attendance_std_dev", "core_course_ratio", "ca_to_max_ratio"]
    return x.select(*V.KEY, *[r6(c).alias(c) for c in num], "courses_below_ca_threshold",
                    "courses_below_75_percent", "credit_load", "level")


@query("offering_means", sql=with_views(ENR) + """
select course_id, session, semester, round(avg(total_score), 6) as mean_score
from enr where status = 'completed' and total_score is not null group by course_id, session, semester""")
def offering_means(t):
    """Mean completed score per (course, period)."""
    x = R.offering_means(V.enrolments(t))
    return x.select("course_id", *V.PERIOD, r6("mean_score").alias("mean_score"))


@query("fail_counts", sql=with_views(ENR, GRADED) + """
select student_id, session, semester, cast(sum(case when grade = 'F' then 1 else 0 end) as bigint) as fails
from graded group by student_id, session, semester""")
def fail_counts(t):
    """D3: number of failed courses per (student, period)."""
    g = V.graded(t).withColumn("is_fail", F.col("grade") == "F")
    return R.flag_counts(g, V.KEY, "is_fail", "fails")


@query("credits_earned", sql=with_views(ENR, GRADED) + """,
reg as (select student_id, session, semester, cast(sum(units) as bigint) as credits_registered from enr group by all),
earned as (select student_id, session, semester, cast(sum(case when grade <> 'F' then units else 0 end) as bigint) as e
  from graded group by all)
select r.student_id, r.session, r.semester, r.credits_registered, coalesce(e.e, r.credits_registered) as credits_earned
from reg r left join earned e on r.student_id = e.student_id and r.session = e.session and r.semester = e.semester""")
def credits_earned(t):
    """Passing units per (student, period), default = registered where nothing is graded yet."""
    reg = V.enrolments(t).groupBy(*V.KEY).agg(F.sum("units").cast("long").alias("credits_registered"))
    return R.credits_earned(reg, V.graded(t), V.KEY)


@query("term_gpa", sql=with_views(ENR, GRADED) + """
select student_id, session, semester, round(sum(grade_point * units) / cast(sum(units) as double), 6) as gpa
from graded group by student_id, session, semester""")
def term_gpa(t):
    """Credit-weighted GPA per (student, period)."""
    x = R.term_gpa(V.graded(t), V.KEY)
    return x.select(*V.KEY, r6("gpa").alias("gpa"))


@query("course_difficulty", headline=True, sql=with_views(ENR, GRADED) + """
select g.course_id, count(*) as n_completed, round(avg(total_score), 2) as average_score,
  round(avg(case when grade = 'F' then 1.0 else 0.0 end), 3) as failure_rate, p.p_brand as department,
  p.p_type as course_type
from graded g join part p on g.course_id = p.p_partkey
where total_score is not null group by g.course_id, p.p_brand, p.p_type""")
def course_difficulty(t):
    """Completions, mean score, failure rate per course; inner join to course attributes."""
    c = V.courses(t).select("course_id", "department", "course_type")
    return R.course_difficulty(V.graded(t), c)


@query("overview_kpis", sql=with_views(ENR, GRADED, HIST, TERM)
       + "," + OPEN_SQL + """
select (select count(*) from customer) as total_students,
  (select count(*) from customer where c_acctbal > 0) as active_students,
  (select count(*) from tiered where risk_tier = 'low') as at_risk_low,
  (select count(*) from tiered where risk_tier = 'moderate') as at_risk_moderate,
  (select count(*) from tiered where risk_tier = 'high') as at_risk_high,
  (select count(*) from tiered where risk_tier = 'critical') as at_risk_critical,
  (select round(coalesce(avg(c), 0.0), 3) from (select arg_max(cgpa, session * 10 + semester) as c
     from hist group by student_id) x) as average_cgpa,
  (select count(*) from orders where o_orderstatus in ('O', 'P')) as total_interventions_open""")
def overview_kpis(t):
    """Headline numbers as independent one-row aggregates cross-joined; orders stand for interventions."""
    ent = t["customer"].select((F.col("c_acctbal") > 0).alias("is_active"))
    return R.overview_kpis(ent, scored_open(t), V.history(t), active="is_active", interventions=V.interventions(t))


EVENT_DOMAIN = ("click", "view", "purchase", "signup", "error", "refund")


@query("event_type_counts", sql="""
with dom(event_type) as (values ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('refund')),
c as (select event_type, count(*) as n from events group by event_type)
select d.event_type, coalesce(c.n, 0) as n, round(coalesce(c.n, 0) / cast((select count(*) from events) as double), 6) as share
from dom d left join c on d.event_type = c.event_type""")
def event_type_counts(t):
    """Counts zero-filled over a fixed domain (one value absent) with shares."""
    x = R.domain_counts(t["events"], "event_type", EVENT_DOMAIN)
    return x.select("event_type", "n", r6("share").alias("share"))


@query("class_distribution", sql=HIST_CTE + """,
latest as (select student_id, arg_max(cgpa, session * 10 + semester) as cgpa from hist group by student_id),
banded as (select case when cgpa >= 4.5 and cgpa < 5.01 then 'first_class' when cgpa >= 3.5 and cgpa < 4.5 then 'second_upper'
    when cgpa >= 2.4 and cgpa < 3.5 then 'second_lower' when cgpa >= 1.5 and cgpa < 2.4 then 'third_class'
    else 'pass_fail' end as degree_class from latest)
select degree_class, count(*) as n, round(count(*) / cast((select count(*) from banded) as double), 6) as share
from banded group by degree_class""")
def class_distribution(t):
    """Distribution of degree classes over each student's latest CGPA."""
    x = R.class_distribution(V.history(t))
    return x.select("degree_class", "n", r6("share").alias("share"))


CORR_COLS = ("ca_average", "ca_std_dev_across_courses", "lowest_ca_score", "courses_below_ca_threshold",
             "mean_attendance_rate", "min_attendance_rate", "courses_below_75_percent", "credit_load",
             "core_course_ratio", "ca_to_max_ratio")


def _corr_sql() -> str:
    cells = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            cells.append(f"select '{a}' as feature_a, '{b}' as feature_b, "
                         f"round(coalesce(case when isnan(corr({a}, {b})) then 0.0 else corr({a}, {b}) end, 0.0), 3) as r "
                         f"from term")
    return with_views(ENR, TERM) + "\nunion all\n".join(cells)


@query("correlation_matrix", headline=True, sql=_corr_sql())
def correlation_matrix(t):
    """Pairwise-complete Pearson matrix of the term features (long form, one aggregate pass)."""
    return R.correlation_matrix(V.term(t), CORR_COLS)


@query("calibration_correlations", sql=HIST_CTE + """,
lagged as (select gpa, lag(cgpa, 1) over (partition by student_id order by session, semester) as prior_cgpa from hist)
select 'attendance_vs_ca' as metric, round(corr(attendance_rate, ca_score), 6) as r from enr
union all select 'attendance_vs_total', round(corr(attendance_rate, total_score), 6) from enr
union all select 'prior_cgpa_vs_gpa', round(corr(prior_cgpa, gpa), 6) from lagged""")
def calibration_correlations(t):
    """Named correlations, each with its own null drops."""
    e = V.enrolments(t)
    from panelspark.operators import history as H
    lag = H.lag_features(V.history(t), "student_id", V.PERIOD, {"prior_cgpa": "cgpa"})
    x = R.calibration_correlations({"attendance_vs_ca": (e, "attendance_rate", "ca_score"),
                                    "attendance_vs_total": (e, "attendance_rate", "total_score"),
                                    "prior_cgpa_vs_gpa": (lag, "prior_cgpa", "gpa")})
    return x.select("metric", r6("r").alias("r"))


@query("missingness_profile", sql="""
with j as (select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id)
select 'doc_id' as "column", round(avg(case when doc_id is null then 1.0 else 0.0 end) * 100, 2) as missing_pct from j
union all select 'lang', round(avg(case when lang is null then 1.0 else 0.0 end) * 100, 2) from j
union all select 'n_chars', round(avg(case when n_chars is null then 1.0 else 0.0 end) * 100, 2) from j
union all select 'quality', round(avg(case when quality is null then 1.0 else 0.0 end) * 100, 2) from j
union all select 'toxic', round(avg(case when toxic is null then 1.0 else 0.0 end) * 100, 2) from j""")
def missingness_profile(t):
    """Null percentage per column of documents left-joined to labels."""
    d = t["documents"].select("doc_id", "lang", "n_chars")
    j = d.join(t["labels"], "doc_id", "left")
    return R.missingness_profile(j, ["doc_id", "lang", "n_chars", "quality", "toxic"])


@query("modal_brand", sql="""
with c as (select o.o_custkey as student_id, p.p_brand as brand, count(*) as n
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey group by all)
select student_id, brand as modal_brand from (
  select *, row_number() over (partition by student_id order by n desc, brand) as rk from c) r where rk = 1""")
def modal_brand(t):
    """Most frequent brand per customer, smallest on ties (counted map-side, no value lists)."""
    from panelspark.operators.stats import modal_value
    li = t["lineitem"].select("l_orderkey", "l_partkey")
    o = t["orders"].select("o_orderkey", F.col("o_custkey").alias("student_id"))
    p = t["part"].select("p_partkey", F.col("p_brand").alias("brand"))
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return modal_value(x, ["student_id"], "brand", "modal_brand")


@query("open_periods", sql=with_views(ENR) + """
select distinct student_id, session, semester from enr where status = 'ongoing'""")
def open_periods(t):
    """Distinct (student, period) with ongoing enrolments."""
    return R.distinct_periods(V.enrolments(t), V.KEY)


@query("tier_groups", sql=with_views(ENR, GRADED, HIST, TERM)
       + "," + OPEN_SQL + """
select risk_tier, cast(case risk_tier when 'critical' then 1 when 'high' then 2 when 'moderate' then 3 else 4 end as int)
    as tier_order, count(*) over (partition by risk_tier) as tier_size, student_id, round(probability, 6) as probability
from tiered""")
def tier_groups(t):
    """Register grouped by tier in urgency order (flattened form)."""
    s = scored_open(t).select("student_id", r6("probability").alias("probability"), "risk_tier")
    return R.tier_groups(cut_lineage(s, "scored-panel"))


NUMERIC = ("prior_cgpa", "prior_gpa", "gpa_trend", "gpa_volatility", "credits_earned_ratio", "carryover_count", "semesters_completed",
           "ca_average", "ca_std_dev_across_courses", "lowest_ca_score", "courses_below_ca_threshold", "mean_attendance_rate",
           "min_attendance_rate", "attendance_std_dev", "courses_below_75_percent", "credit_load", "core_course_ratio",
           "mean_course_difficulty_index", "level", "ca_to_max_ratio", "credit_load_vs_level_mean", "submission_rate", "punctuality_rate",
           "lms_logins_normalised", "study_hours_per_week", "tutorial_attendance_rate", "library_visits_normalised", "has_scholarship",
           "entry_score_normalised", "attendance_x_ca_average", "study_hours_per_credit_load", "gpa_trend_x_credit_load")


def _correlation_sql() -> str:
    from panelspark.plans.catalog_features import panel_sql
    cells = ", ".join(f"corr({a}, {b}) as r_{i}_{j}" for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC) if i <= j)
    pick = " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, r_{min(i, j)}_{max(i, j)} as r from c"
        for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC))
    pf = "with pf as (" + panel_sql(False) + "), n as (select " + ", ".join(f"cast({c} as double) as {c}" for c in NUMERIC) + " from pf)"
    return pf + f""", c as (select {cells} from n), l as ({pick})
select feature_a, feature_b, round(case when r is null or isnan(r) then 0.0 else r end, 3) as r from l"""


@query("feature_correlations", sql=_correlation_sql())
def feature_correlations(t):
    """D11 as served: Pearson over every numeric column of the J1 feature table (pairwise-complete,
    3 dp, undefined -> 0), long form; masked moments per task."""
    from panelspark.functions.rows import column_types
    from panelspark.plans.catalog_features import _present, panel_featureset
    fs = panel_featureset(t)
    numeric, _ = column_types(fs.df, fs.feature_cols)
    return R.correlation_matrix(fs.df.select(*_present(fs.df, fs.feature_cols)), numeric)
