"""Registered queries: row expressions."""

from pyspark.sql import functions as F

from panelspark.functions import bands as B
from panelspark.functions import rows as RW
from panelspark.operators import history as H
from panelspark.operators import rollups as R
from panelspark.operators.joins import attach_scalars
from panelspark.plans import views as V
from panelspark.functions.numeric import r6, r6t
from panelspark.plans.registry import query
from panelspark.plans.sql_views import HIST_CTE, TERM_CTE




@query("grade_bands", sql="""
select l_orderkey, l_linenumber, l_quantity * 2 as score,
  case when l_quantity * 2 >= 70 then 'A' when l_quantity * 2 >= 60 then 'B' when l_quantity * 2 >= 50 then 'C'
    when l_quantity * 2 >= 45 then 'D' when l_quantity * 2 >= 40 then 'E' else 'F' end as grade,
  case when l_quantity * 2 >= 70 then 5 when l_quantity * 2 >= 60 then 4 when l_quantity * 2 >= 50 then 3
    when l_quantity * 2 >= 45 then 2 when l_quantity * 2 >= 40 then 1 else 0 end as grade_point
from lineitem""")
def grade_bands(t):
    """B1: strict grade letter and points of l_quantity*2 (range violation raises)."""
    li = t["lineitem"]
    s = F.col("l_quantity") * 2
    return li.select("l_orderkey", "l_linenumber", s.alias("score"), B.grade_letter(s).alias("grade"),
                     B.grade_point(s).alias("grade_point"))


@query("risk_tiers", sql="""
select l_orderkey, l_linenumber, round(l_quantity / 50, 6) as probability,
  case when l_quantity / 50 >= 0.75 then 'critical' when l_quantity / 50 >= 0.5 then 'high'
    when l_quantity / 50 >= 0.25 then 'moderate' else 'low' end as risk_tier
from lineitem""")
def risk_tiers(t):
    """B2: risk tier of l_quantity/50."""
    p = F.col("l_quantity") / 50
    return t["lineitem"].select("l_orderkey", "l_linenumber", r6(p).alias("probability"),
                                B.risk_tier(p).alias("risk_tier"))


@query("standing_bands", sql=HIST_CTE + """
select student_id, session, semester, round(cgpa, 6) as cgpa,
  case when cgpa < 2.0 then 'probation' when cgpa < 2.5 then 'warning' else 'good' end as standing
from hist""")
def standing_bands(t):
    """Academic standing of the running CGPA."""
    h = V.history(t)
    return h.select(*V.KEY, r6("cgpa").alias("cgpa"), B.standing_band("cgpa").alias("standing"))


@query("degree_classes", sql=HIST_CTE + """
select student_id, round(cgpa, 6) as cgpa,
  case when cgpa >= 4.5 and cgpa < 5.01 then 'first_class' when cgpa >= 3.5 and cgpa < 4.5 then 'second_upper'
    when cgpa >= 2.4 and cgpa < 3.5 then 'second_lower' when cgpa >= 1.5 and cgpa < 2.4 then 'third_class'
    else 'pass_fail' end as degree_class
from (select student_id, arg_max(cgpa, session * 10 + semester) as cgpa from hist group by student_id) x""")
def degree_classes(t):
    """B4 over E11: degree class of each student's latest CGPA."""
    latest = R.latest_value(V.history(t), "student_id", V.PERIOD, "cgpa")
    return latest.select("student_id", r6("cgpa").alias("cgpa"), B.classify_cgpa("cgpa").alias("degree_class"))


@query("period_keys", sql="""
select o_orderkey, cast(year(o_orderdate) as int) as session,
  case when month(o_orderdate) <= 6 then 1 else 2 end as semester,
  cast(substr(cast(year(o_orderdate) as varchar), 1, 4) as int) * 10
    + case when month(o_orderdate) <= 6 then 1 else 2 end as period_key
from orders""")
def period_keys(t):
    """Sortable period key from (session, semester) of the order date."""
    sess, sem = B.half_year_period("o_orderdate")
    return (t["orders"].select("o_orderkey", sess.alias("session"), sem.alias("semester"))
            .withColumn("period_key", B.period_key("session", "semester")))


@query("safe_ratio_tax_discount", sql="""
select l_orderkey, l_linenumber, round(case when l_discount <> 0 then l_tax / l_discount end, 6) as tax_per_discount
from lineitem""")
def safe_ratio_tax_discount(t):
    """Ratio that is null when the denominator is zero (zeros occur)."""
    return t["lineitem"].select("l_orderkey", "l_linenumber",
                                r6(RW.safe_ratio("l_tax", "l_discount")).alias("tax_per_discount"))


@query("interaction_features", sql=TERM_CTE + """
select student_id, session, semester, round(mean_attendance_rate * ca_average + 1e-9, 6) as attendance_x_ca_average,
  round(case when credit_load <> 0 then ca_average / credit_load end, 6) as ca_per_credit,
  round(mean_attendance_rate * credit_load + 1e-9, 6) as attendance_x_load
from term""")
def interaction_features(t):
    """Product and ratio interactions over the term rollup."""
    x = RW.interactions(V.term(t), {"attendance_x_ca_average": ("mul", "mean_attendance_rate", "ca_average"),
                                    "ca_per_credit": ("div", "ca_average", "credit_load"),
                                    "attendance_x_load": ("mul", "mean_attendance_rate", "credit_load")})
    return x.select(*V.KEY, r6t("attendance_x_ca_average").alias("attendance_x_ca_average"),
                    r6("ca_per_credit").alias("ca_per_credit"), r6t("attendance_x_load").alias("attendance_x_load"))


@query("clip_scores", sql="""
select c_custkey, round(least(greatest(c_acctbal / 2000, 0.0), 4.0), 6) as clipped
from customer""")
def clip_scores(t):
    """Clamp c_acctbal/2000 into [0, 4]."""
    return t["customer"].select("c_custkey", r6(B.clip(F.col("c_acctbal") / 2000, 0.0, 4.0)).alias("clipped"))


@query("search_customers", sql="""
select c_custkey, c_name, c_mktsegment from customer
where c_mktsegment = 'BUILDING' and (c_name ilike '%r#00000012%' or c_mktsegment ilike '%r#00000012%')""")
def search_customers(t):
    """Equality filter (pushed to the scan) AND case-insensitive contains over two columns."""
    c = t["customer"].select("c_custkey", "c_name", "c_mktsegment")
    return RW.search_rows(c, {"c_mktsegment": "BUILDING"}, "R#00000012", ["c_name", "c_mktsegment"])


@query("prediction_intervals", sql=HIST_CTE + """,
lagged as (select *, lag(gpa, 1) over (partition by student_id order by session, semester) as prior_gpa from hist),
pred as (select *, coalesce(prior_gpa, 2.5) as point from lagged),
err as (select sqrt(avg((gpa - point) * (gpa - point))) as rmse from pred)
select student_id, session, semester, round(least(greatest(point, 0.0), 5.0), 6) as predicted_gpa,
  round(least(greatest(point - rmse, 0.0), 5.0), 6) as lower_bound,
  round(least(greatest(point + rmse, 0.0), 5.0), 6) as upper_bound
from pred cross join err""")
def prediction_intervals(t):
    """Point +/- the model's RMSE (a one-row aggregate, broadcast), clipped to the scale."""
    h = H.lag_features(V.history(t), "student_id", V.PERIOD, {"prior_gpa": "gpa"})
    pred = h.withColumn("point", F.coalesce("prior_gpa", F.lit(2.5)))
    x = attach_scalars(pred, F.sqrt(F.avg((F.col("gpa") - F.col("point")) ** 2)).alias("rmse"))
    p, lo, hi = RW.prediction_interval("point", "rmse", 0.0, 5.0)
    return x.select(*V.KEY, r6(p).alias("predicted_gpa"), r6(lo).alias("lower_bound"), r6(hi).alias("upper_bound"))


@query("projected_cgpa", sql=HIST_CTE + """,
lagged as (select *, lag(cgpa, 1) over w as prior_cgpa, row_number() over w - 1 as n_prior
  from hist window w as (partition by student_id order by session, semester))
select student_id, session, semester,
  round(case when prior_cgpa is null or n_prior <= 0 then gpa else (prior_cgpa * n_prior + gpa) / (n_prior + 1) end, 6)
    as projected_cgpa
from lagged""")
def projected_cgpa(t):
    """Blend of prior CGPA over n prior terms with the new term value."""
    h = H.history_features(V.history(t))
    return h.select(*V.KEY, r6(RW.blend_running_mean("prior_cgpa", "semesters_completed", "gpa")).alias("projected_cgpa"))


@query("trend_labels", sql=HIST_CTE + """
select distinct session, semester, cast(session as varchar) || ' S' || cast(semester as varchar) as label from hist""")
def trend_labels(t):
    """Chart labels of the distinct periods."""
    h = V.history(t).select(*V.PERIOD).distinct()
    return h.withColumn("label", RW.trend_label("session", "semester"))
