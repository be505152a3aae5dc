"""Registered queries: served datasets (P2, P5-P8), sort/limit (F1-F3) and wish-list."""

from pyspark.sql import functions as F

from panelspark.functions.numeric import half_even, r6
from panelspark.functions.rows import confidence
from panelspark.operators import rollups as R
from panelspark.operators import select as SEL
from panelspark.operators import serve as SV
from panelspark.plans import scoring as S
from panelspark.plans import tasks as TK
from panelspark.plans import views as V
from panelspark.plans.catalog_features import panel_sql
from panelspark.plans.registry import query
from panelspark.plans.sql_views import ALL_CTE, ENR, HIST_CTE, with_views
from panelspark.session import cut_lineage, scratch_path

TIERED = ALL_CTE + "," + S.OPEN_SQL + "\n"


def _entities(t):
    c = t["customer"].select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"),
                             F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("department"))
    return c


@query("at_risk_register", headline=True, sql=TIERED + """
select t.student_id, round(t.probability, 6) as probability, t.risk_tier, c.c_name as name, c.c_mktsegment as department,
  c.c_nationkey as nation
from tiered t join customer c on t.student_id = c.c_custkey""")
def at_risk_register(t):
    """Open-period register with entity attributes, probability-descending."""
    s = S.scored_open(t).select("student_id", "probability", "risk_tier")
    r = SV.at_risk_register(s, _entities(t))
    return r.select("student_id", r6("probability").alias("probability"), "risk_tier", "name", "department", "nation")


@query("ranked_register_high", sql=TIERED + """
select t.student_id, round(t.probability, 6) as probability, c.c_name as name
from tiered t join customer c on t.student_id = c.c_custkey where t.risk_tier = 'high'""")
def ranked_register_high(t):
    """the register filtered to one tier (filter before the join)."""
    s = S.scored_open(t).select("student_id", "probability", "risk_tier")
    r = SEL.ranked_register(s, _entities(t), "student_id", tier="high")
    return r.select("student_id", r6("probability").alias("probability"), "name")


@query("paginate_customers", sql="""
select c_custkey, c_name from customer order by c_custkey limit 50 offset 100""")
def paginate_customers(t):
    """page 3 of 50 under a total order (offset/limit; keyset variant in ``page_after``)."""
    return SEL.paginate(t["customer"].select("c_custkey", "c_name"), ["c_custkey"], 3, 50)


@query("paginate_customers_after", sql="""
select c_custkey, c_name from customer where c_custkey > 100 order by c_custkey limit 50""")
def paginate_customers_after(t):
    """F2, keyset form: the page after a key; the filter reaches the scan, no rows are skipped over."""
    return SEL.page_after(t["customer"].select("c_custkey", "c_name"), "c_custkey", 100, 50)


@query("top_failing_per_department", sql=with_views(ENR) + """,
g as (select *, case when total_score < 40 then 'F' else 'P' end as grade from enr where status = 'completed'),
d as (select g.course_id, p.p_brand as department, round(avg(case when grade = 'F' then 1.0 else 0.0 end), 3) as failure_rate
  from g join part p on g.course_id = p.p_partkey group by g.course_id, p.p_brand),
r as (select *, row_number() over (partition by department order by failure_rate desc, course_id) as "rank" from d)
select department, course_id, failure_rate, "rank" from r where "rank" <= 3""")
def top_failing_per_department(t):
    """F3 per group: the three courses with the highest failure rate in every department."""
    d = R.course_difficulty(V.graded(t), V.courses(t).select("course_id", "department"))
    x = SEL.top_k_per_group(d.select("department", "course_id", "failure_rate"), 3, ["department"], [F.desc("failure_rate"), F.col("course_id")])
    return x.select("department", "course_id", "failure_rate", F.col("rank").cast("long").alias("rank"))


@query("top_failing_courses", sql=with_views(ENR) + """,
g as (select *, case when total_score < 40 then 'F' else 'P' end as grade from enr where status = 'completed')
select course_id, round(avg(case when grade = 'F' then 1.0 else 0.0 end), 3) as failure_rate, count(*) as n_completed
from g group by course_id order by failure_rate desc, course_id limit 15""")
def top_failing_courses(t):
    """the 15 courses with the highest failure rate (top-k without a full sort)."""
    d = R.course_difficulty(V.graded(t), V.courses(t).select("course_id"))
    return SEL.top_k(d.select("course_id", "failure_rate", "n_completed"), 15,
                     [F.desc("failure_rate"), F.col("course_id")])


@query("seeded_sample_orders")
def seeded_sample_orders(t):
    """exactly min(100, N) orders chosen by a seeded hash: same rows on any partitioning."""
    return SEL.seeded_sample_n(t["orders"].select("o_orderkey", "o_custkey"), 100, "o_orderkey", 42)


GRANTS_SQL = """grants as (
  select 'adviser-' || cast(c_nationkey as varchar) as user_id, 'adviser' as role, c_custkey as student_id from customer
  union
  select distinct 'lecturer-' || p.p_brand, 'lecturer', o.o_custkey from lineitem l
    join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
  union
  select 'student-' || cast(c_custkey as varchar), 'student', c_custkey from customer)"""


def grants(t):
    c = t["customer"]
    adv = c.select(F.concat(F.lit("adviser-"), F.col("c_nationkey").cast("string")).alias("user_id"),
                   F.col("c_custkey").alias("student_id"))
    li = t["lineitem"].select("l_orderkey", "l_partkey")
    o = t["orders"].select("o_orderkey", "o_custkey")
    p = t["part"].select("p_partkey", "p_brand")
    lec = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
           .select(F.concat(F.lit("lecturer-"), F.col("p_brand")).alias("user_id"), F.col("o_custkey").alias("student_id")))
    stu = c.select(F.concat(F.lit("student-"), F.col("c_custkey").cast("string")).alias("user_id"),
                   F.col("c_custkey").alias("student_id"))
    return SV.build_grants({"adviser": adv, "lecturer": lec, "student": stu})


@query("scope_counts", sql="with " + GRANTS_SQL + """
select user_id, role, count(distinct student_id) as n_students from grants group by user_id, role""")
def scope_counts(t):
    """Rows in scope per user for every adviser / lecturer / student user (grant semi-joins)."""
    g = grants(t)
    return g.groupBy("user_id", "role").agg(F.countDistinct("student_id").alias("n_students"))


@query("scoped_open_orders", sql="with " + GRANTS_SQL + """
select g.user_id, g.role, o.o_orderkey, cast(cast(o.o_orderdate as date) as varchar) as order_date
from grants g join orders o on g.student_id = o.o_custkey where o.o_orderstatus = 'O'""")
def scoped_open_orders(t):
    """The log rows in scope of every adviser, lecturer and student with a status filter, newest first."""
    log = V.interventions(t).filter(F.col("status") == "planned")
    x = SV.scoped_log(log, grants(t), "created_at", "intervention_id")
    return x.select("user_id", "role", F.col("intervention_id").alias("o_orderkey"), F.to_date("created_at").cast("string").alias("order_date"))


@query("scoped_register", sql="with base as (" + TIERED + """ select student_id, probability from tiered), """ + GRANTS_SQL + """,
who as (select role, min(user_id) as user_id from grants group by role)
select w.role, w.user_id, b.student_id, round(b.probability, 6) as probability
from who w join grants g on w.user_id = g.user_id and w.role = g.role join base b on g.student_id = b.student_id
union all select 'admin', 'admin', student_id, round(probability, 6) from base""")
def scoped_register(t):
    """P2 + P6: the register as the first user of every role sees it; the admin sees all of it."""
    g = cut_lineage(grants(t), "grants")
    first = {r["role"]: r["u"] for r in g.groupBy("role").agg(F.min("user_id").alias("u")).collect()}   # a row per role
    s = cut_lineage(S.scored_open(t).select("student_id", "probability"), "register")
    out = None
    for role, user in [*sorted(first.items()), ("admin", "admin")]:
        part = SV.scope_rows(s, g, user, role).select(F.lit(role).alias("role"), F.lit(user).alias("user_id"), "student_id",
                                                      r6("probability").alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


@query("profile_history", sql=HIST_CTE + """
select student_id, session, semester, credits_registered, credits_earned, round(gpa, 6) as gpa, round(cgpa, 6) as cgpa,
  case when cgpa < 2.0 then 'probation' when cgpa < 2.5 then 'warning' else 'good' end as standing,
  row_number() over (partition by student_id order by session, semester) as line
from hist""")
def profile_history(t):
    """P5: the history rows of every profile, numbered in period order, with the standing."""
    x = SV.profile_history(V.history(t))
    return x.select(*V.KEY, "credits_registered", "credits_earned", r6("gpa").alias("gpa"), r6("cgpa").alias("cgpa"), "standing", "line")


PROFILE_SQL = with_views(ENR) + """,
pe as (select student_id, course_id, p_brand as department, session, semester, ca_score, total_score,
    case when status = 'completed' then total_score - ca_score end as exam_score, status,
    case when total_score is null then null when total_score >= 70 then 'A' when total_score >= 60 then 'B' when total_score >= 50 then 'C'
      when total_score >= 45 then 'D' when total_score >= 40 then 'E' else 'F' end as grade, attendance_rate
  from enr join part on course_id = p_partkey)
"""


@query("profile_enrolments", sql=PROFILE_SQL + """
select student_id, course_id, department, session, semester, round(ca_score, 6) as ca_score, round(exam_score, 6) as exam_score,
  round(total_score, 6) as total_score, grade, round(attendance_rate, 6) as attendance_rate, status from pe""")
def profile_enrolments(t):
    """P5: the enrolment rows of every profile with their course, grade and attendance."""
    x = SV.profile_enrolments(V.profile_items(t), V.courses(t))
    return x.select("student_id", "course_id", "department", "session", "semester", *[r6(c).alias(c) for c in ("ca_score", "exam_score", "total_score")],
                    "grade", r6("attendance_rate").alias("attendance_rate"), "status")


def _one(c: str, digits: int = 1) -> str:
    return f"coalesce(printf('%.{digits}f', {c}), '-')"


@query("report_history_lines", sql=HIST_CTE + """
select student_id, cast(session as varchar) as session, cast(semester as varchar) as semester, printf('%.2f', gpa) as gpa,
  printf('%.2f', cgpa) as cgpa, case when cgpa < 2.0 then 'probation' when cgpa < 2.5 then 'warning' else 'good' end as standing
from hist""")
def report_history_lines(t):
    """The academic history table of every student report, as text."""
    return SV.report_history_lines(SV.profile_history(V.history(t)))


@query("report_enrolment_lines", sql=PROFILE_SQL + "select student_id, cast(course_id as varchar) as course, "
       "cast(session as varchar) || ' S' || cast(semester as varchar) as period, " + _one("ca_score") + " as ca, " + _one("exam_score")
       + " as exam, " + _one("total_score") + " as total, coalesce(grade, '-') as grade, "
       "coalesce(printf('%.0f', attendance_rate * 100) || '%', '-') as attendance from pe")
def report_enrolment_lines(t):
    """The enrolment table of every student report, as text; missing -> '-'."""
    return SV.report_enrolment_lines(SV.profile_enrolments(V.profile_items(t), V.courses(t)))


@query("register_report", sql=TIERED + """
select t.student_id, coalesce(c.c_name, '-') as name, coalesce(cast(l.level as varchar), '-') as level,
  upper(substr(t.risk_tier, 1, 1)) || substr(t.risk_tier, 2) as tier,
  printf('%.1f', t.probability * 100) || '%' as risk
from tiered t left join customer c on t.student_id = c.c_custkey
left join (select student_id, session, semester, level from (
    select student_id, session, semester, level,
      row_number() over (partition by student_id, session, semester order by n desc, level) as rk
    from (select student_id, session, semester, level, count(*) as n from enr group by all) c) r where rk = 1) l
  on t.student_id = l.student_id and t.session = l.session and t.semester = l.semester
where t.risk_tier in ('high', 'critical')""")
def register_report(t):
    """High + critical register as report text: name, level, capitalised tier, '12.3%'."""
    s = S.scored_open(t).select(*V.KEY, "probability", "risk_tier")
    lvl = R.term_rollup(V.enrolments(t), V.KEY, with_difficulty=False).select(*V.KEY, "level")
    x = s.join(V.students(t).select("student_id", "name"), "student_id", "left").join(lvl, list(V.KEY), "left")
    return SV.register_report(x)


@query("entity_profiles", sql=HIST_CTE + """
select c.c_custkey as student_id, c.c_name as name, h.n_history, h.first_session, round(h.last_cgpa, 6) as last_cgpa,
  e.n_enrolments, e.n_courses
from customer c
left join (select student_id, count(*) as n_history, min(session) as first_session,
    arg_max(cgpa, session * 10 + semester) as last_cgpa from hist group by student_id) h on c.c_custkey = h.student_id
left join (select student_id, count(*) as n_enrolments, count(distinct course_id) as n_courses from enr group by student_id) e
  on c.c_custkey = e.student_id""")
def entity_profiles(t):
    """P5: entity with its period-ordered history (nested) and enrolment counts; flattened here."""
    p = SV.entity_profile(V.students(t).select("student_id", "name"), V.history(t), V.enrolments(t))
    return p.select("student_id", "name", "n_history", F.col("history")[0]["session"].alias("first_session"),
                    r6(F.element_at("history", -1)["cgpa"]).alias("last_cgpa"), "n_enrolments", "n_courses")


@query("entity_forecast")
def entity_forecast(t):
    """Per open student, risk, GPA with interval and projected CGPA, and the score of every open course item (nested,
    bounded by the term's course load), all from the active models."""
    store = TK.trained_store(t)
    items = TK.score_open_items(t, store).groupBy(*V.KEY).agg(
        F.sort_array(F.collect_list(F.struct("course_id", r6("predicted_score").alias("predicted_score")))).alias("items"))
    x = TK.score_open(t, store).join(items, list(V.KEY), "left")
    numbers = ("probability", "predicted_gpa", "gpa_lower", "gpa_upper", "projected_cgpa")
    return x.select(*V.KEY, *[r6(c).alias(c) for c in numbers], "risk_tier", "risk_algorithm", "gpa_algorithm", "items")


@query("open_item_scores")
def open_item_scores(t):
    """The active model's score of every open course item."""
    return TK.score_open_items(t, TK.trained_store(t, "course_score")).withColumn("predicted_score", r6("predicted_score"))


@query("gpa_histogram", sql=HIST_CTE + """,
dom as (select range as bin from range(0, 10)),
b as (select least(cast(floor(gpa / 0.5) as int), 9) as bin from hist)
select d.bin, round(d.bin * 0.5, 6) as lower_edge, coalesce(c.n, 0) as n
from dom d left join (select bin, count(*) as n from b group by bin) c on d.bin = c.bin""")
def gpa_histogram(t):
    """Fixed-width GPA histogram (0.5 wide, top bin closed), zero-filled over the domain."""
    h = V.history(t).select(F.least(F.floor(F.col("gpa") / 0.5).cast("int"), F.lit(9)).alias("bin"))
    counts = h.groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    dom = t.spark.range(0, 10).select(F.col("id").cast("int").alias("bin"))
    return (dom.join(counts, "bin", "left")
            .select("bin", r6(F.col("bin") * 0.5).alias("lower_edge"), F.coalesce("_n", F.lit(0)).cast("long").alias("n")))


@query("scatter_fit", sql=with_views(ENR) + """
select round(regr_slope(total_score, attendance_rate), 6) as slope,
  round(regr_intercept(total_score, attendance_rate), 6) as intercept,
  round(regr_r2(total_score, attendance_rate), 6) as r2, count(total_score) as n
from enr where status = 'completed'""")
def scatter_fit(t):
    """Least-squares fit of score on attendance (the chart's points come from F4)."""
    e = V.enrolments(t).filter(F.col("status") == "completed")
    return e.agg(r6(F.regr_slope("total_score", "attendance_rate")).alias("slope"),
                 r6(F.regr_intercept("total_score", "attendance_rate")).alias("intercept"),
                 r6(F.regr_r2("total_score", "attendance_rate")).alias("r2"),
                 F.count("total_score").alias("n"))


@query("level_comparison", sql=with_views(ENR) + """,
g as (select *, case when total_score >= 70 then 5 when total_score >= 60 then 4 when total_score >= 50 then 3
    when total_score >= 45 then 2 when total_score >= 40 then 1 else 0 end as gp from enr where status = 'completed')
select level, round(avg(gp), 6) as mean_grade_point, count(*) as n, round(stddev_samp(gp), 6) as sd_grade_point
from g group by level""")
def level_comparison(t):
    """S3: grade points compared across course levels."""
    g = V.graded(t)
    return g.groupBy("level").agg(r6(F.avg("grade_point")).alias("mean_grade_point"), F.count(F.lit(1)).alias("n"),
                                  r6(F.stddev_samp("grade_point")).alias("sd_grade_point"))


@query("score_open_periods")
def score_open_periods(t):
    """Open-period features -> the registry's active classifier -> probability, tier and confidence."""
    x = TK.score_open(t, TK.trained_store(t, *TK.PERIOD_TASKS))
    return x.select(*V.KEY, r6("probability").alias("probability"), "risk_tier", r6(confidence("probability")).alias("confidence"),
                    F.col("risk_algorithm").alias("algorithm"))


@query("scored_open_keys", sql="with pf as (" + panel_sql(True) + ") select student_id, session, semester from pf")
def scored_open_keys(t):
    """The active model scores every open (student, period), each once."""
    return TK.score_open(t, TK.trained_store(t, *TK.PERIOD_TASKS)).select(*V.KEY)


@query("batch_predict")
def batch_predict(t):
    """Requested ids -> status (not found / no ongoing / ok) -> risk + predicted GPA of the active models for the ok
    ones (the GPA is filled, unlike the source) -> appended to a prediction log, read back."""
    from panelspark.operators.joins import lookup_with_status
    from panelspark.sources.files import append_log
    scored = TK.score_open(t, TK.trained_store(t, *TK.PERIOD_TASKS)).select("student_id", "probability", "risk_tier", "predicted_gpa")
    req = t["lineitem"].select(F.col("l_partkey").alias("student_id"))
    ent = t["customer"].select(F.col("c_custkey").alias("student_id"))
    status = cut_lineage(lookup_with_status(req, ent, scored, "student_id"), "batch-status")
    path = scratch_path(t.spark, "batch-predictions")
    append_log(status.filter(F.col("status") == "ok"), path, ["probability", "risk_tier", "predicted_gpa"])
    logged = t.spark.read.parquet(path).select("student_id", F.lit(True).alias("logged"))
    return (status.join(logged, "student_id", "left")
            .select("student_id", "status", r6("probability").alias("probability"), "risk_tier",
                    r6("predicted_gpa").alias("predicted_gpa"), F.coalesce("logged", F.lit(False)).alias("logged")))


@query("entity_report", sql=HIST_CTE + """,
lv as (select student_id, level from (select student_id, level, row_number() over (partition by student_id
  order by n desc, level) as rk from (select student_id, level, count(*) as n from enr where status = 'ongoing'
  group by all) c) r where rk = 1),
lc as (select student_id, arg_max(cgpa, session * 10 + semester) as cgpa from hist group by student_id)
select c.c_custkey as student_id, coalesce(c.c_name, '-') as name, coalesce(cast(lv.level as varchar), '-') as level,
  coalesce(printf('%.2f', lc.cgpa), '-') as latest_cgpa
from customer c left join lv on c.c_custkey = lv.student_id left join lc on c.c_custkey = lc.student_id""")
def entity_report(t):
    """P8 (entity report): name, open-period level and latest CGPA as text; missing -> '-'."""
    lvl = R.term_rollup(V.enrolments(t).filter(F.col("status") == "ongoing"), ["student_id"], with_difficulty=False) \
        .select("student_id", "level")
    lc = R.latest_value(V.history(t), "student_id", V.PERIOD, "cgpa")
    dash = F.lit("-")
    x = V.students(t).select("student_id", "name").join(lvl, "student_id", "left").join(lc, "student_id", "left")
    return x.select("student_id", F.coalesce("name", dash).alias("name"),
                    F.coalesce(F.col("level").cast("string"), dash).alias("level"),
                    F.coalesce(F.when(F.col("cgpa").isNotNull(), F.format_string("%.2f", half_even("cgpa", 2))),
                               dash).alias("latest_cgpa"))
