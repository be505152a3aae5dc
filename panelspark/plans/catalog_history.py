"""Registered queries: history windows."""

from pyspark.sql import functions as F

from panelspark.operators import history as H
from panelspark.operators import rollups as R
from panelspark.plans import views as V
from panelspark.functions.numeric import r6
from panelspark.plans.catalog_rollups import LEVEL_MODE_SQL
from panelspark.plans.registry import query
from panelspark.plans.sql_views import ENR, HIST_CTE, with_views




@query("panel_core", headline=True, sql=HIST_CTE + """
select student_id, session, semester, round(gpa, 6) as gpa, round(cgpa, 6) as cgpa,
  round(lag(cgpa, 1) over w, 6) as prior_cgpa,
  round(lag(gpa, 1) over w, 6) as prior_gpa,
  round(lag(gpa, 1) over w - lag(gpa, 3) over w, 6) as gpa_trend,
  case when count(gpa) over w3 >= 2 then round(stddev_pop(gpa) over w3, 6) end as gpa_volatility,
  round(sum(credits_earned) over wp / cast(sum(credits_registered) over wp as double), 6) as credits_earned_ratio,
  cast(row_number() over w - 1 as bigint) as semesters_completed
from hist
window w as (partition by student_id order by session, semester),
  w3 as (partition by student_id order by session, semester rows between 3 preceding and 1 preceding),
  wp as (partition by student_id order by session, semester rows between unbounded preceding and 1 preceding)
""")
def panel_core(t):
    """E1-E5 + E8 over the history view: the flagship history core."""
    h = H.history_features(V.history(t))
    return h.select("student_id", "session", "semester", r6("gpa").alias("gpa"), r6("cgpa").alias("cgpa"),
                    r6("prior_cgpa").alias("prior_cgpa"), r6("prior_gpa").alias("prior_gpa"),
                    r6("gpa_trend").alias("gpa_trend"), r6("gpa_volatility").alias("gpa_volatility"),
                    r6("credits_earned_ratio").alias("credits_earned_ratio"), "semesters_completed")


@query("carryover_count", sql=with_views(ENR) + """,
per as (select student_id, session, semester,
  cast(sum(case when status = 'completed' and total_score < 40 then 1 else 0 end) as bigint) as fails
  from enr group by all)
select student_id, session, semester,
  sum(fails) over (partition by student_id order by session, semester rows between unbounded preceding and 1 preceding)
    as carryover_count
from per""")
def carryover_count(t):
    """Failed courses in all strictly earlier periods (null on the first)."""
    e = V.enrolments(t).withColumn("is_fail", (F.col("status") == "completed") & (F.col("total_score") < 40))
    per = R.flag_counts(e, V.KEY, "is_fail", "fails")
    return per.select(*V.KEY, H.expanding_prior_sum_expr("fails", "student_id", V.PERIOD).cast("long")
                      .alias("carryover_count"))


@query("prior_difficulty", headline=True, sql=with_views(ENR) + """,
off as (select course_id, session, semester, avg(total_score) as mean_score from enr
  where status = 'completed' and total_score is not null group by all),
fb as (select 1 - avg(total_score) / 100 as fallback from enr where status = 'completed' and total_score is not null)
select course_id, session, semester, round(coalesce(1 - avg(mean_score) over (partition by course_id
  order by session, semester rows between unbounded preceding and 1 preceding) / 100, fallback), 6) as difficulty_index
from off cross join fb""")
def prior_difficulty(t):
    """1 - mean of strictly prior offering means / 100, global fallback on a first offering."""
    e = V.enrolments(t)
    done = e.filter((F.col("status") == "completed") & F.col("total_score").isNotNull())
    off = done.groupBy("course_id", *V.PERIOD).agg(F.avg("total_score").alias("mean_score"),
                                                   F.sum("total_score").alias("_sum"), F.count("total_score").alias("_n"))
    x = H.prior_difficulty(off, sum_col="_sum", count_col="_n")
    return x.select("course_id", *V.PERIOD, r6("difficulty_index").alias("difficulty_index"))


@query("peer_deviation", sql=with_views(ENR, LEVEL_MODE_SQL) + """,
load as (select student_id, session, semester, cast(sum(units) as bigint) as credit_load from enr group by all),
j as (select a.*, l.level from load a join lvl l on a.student_id = l.student_id and a.session = l.session
  and a.semester = l.semester)
select student_id, session, semester, level, credit_load,
  round(credit_load - avg(credit_load) over (partition by level, session, semester), 6) as credit_load_vs_level_mean
from j""")
def peer_deviation(t):
    """Credit load minus the mean of peers at the same (level, period), via groupBy + join."""
    x = R.term_rollup(V.enrolments(t), V.KEY, with_difficulty=False).select(*V.KEY, "credit_load", "level")
    y = H.peer_deviation(x, "credit_load", ["level", *V.PERIOD], "credit_load_vs_level_mean")
    return y.select(*V.KEY, "level", "credit_load", r6("credit_load_vs_level_mean").alias("credit_load_vs_level_mean"))


@query("zscores", sql="""
with s as (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as sd, avg(c_nationkey * 0.0) as m0,
  stddev_pop(c_nationkey * 0.0) as sd0 from customer)
select c_custkey, round(case when sd is null or sd = 0 then 0.0 else (c_acctbal - m) / sd end, 6) as entry_score_normalised,
  round(case when sd0 is null or sd0 = 0 then 0.0 else (c_nationkey * 0.0 - m0) / sd0 end, 6) as constant_normalised
from customer cross join s""")
def zscores(t):
    """Population z-scores; a constant column gives 0.0 for every row."""
    c = t["customer"].select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 0.0).alias("const"))
    z = H.zscore(c, {"entry_score_normalised": "c_acctbal", "constant_normalised": "const"})
    return z.select("c_custkey", r6("entry_score_normalised").alias("entry_score_normalised"),
                    r6("constant_normalised").alias("constant_normalised"))


@query("latest_per_entity", sql=HIST_CTE + """
select student_id, arg_max(session, session * 10 + semester) as session, arg_max(semester, session * 10 + semester) as semester,
  round(arg_max(gpa, session * 10 + semester), 6) as gpa, round(arg_max(cgpa, session * 10 + semester), 6) as cgpa
from hist group by student_id""")
def latest_per_entity(t):
    """Each student's latest history row (max_by, no sort)."""
    x = H.latest_per_entity(V.history(t).select(*V.KEY, "gpa", "cgpa"), "student_id", V.PERIOD)
    return x.select("student_id", "session", "semester", r6("gpa").alias("gpa"), r6("cgpa").alias("cgpa"))


@query("keep_first_orders", sql="""
with f as (select o_custkey, min(o_orderkey) as first_key, count(*) as n from orders group by o_custkey)
select o_custkey, first_key as o_orderkey, n - 1 as duplicates from f""")
def keep_first_orders(t):
    """First order per customer in file order (order key as the line number); later ones counted."""
    o = t["orders"].select("o_custkey", "o_orderkey")
    kept, dups = H.keep_first(o, ["o_custkey"], "o_orderkey")
    nd = dups.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("duplicates"))
    return (kept.join(nd, "o_custkey", "left")
            .select("o_custkey", "o_orderkey", F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates")))


@query("extended_history", sql=HIST_CTE + """
select student_id, session, semester, round(gpa, 6) as gpa from hist
union all
select distinct student_id, session, semester, cast(null as double) from enr where status = 'ongoing'""")
def extended_history(t):
    """G1: history union distinct open periods with null measures."""
    open_keys = R.distinct_periods(V.enrolments(t), V.KEY)
    x = H.extend_with_open_period(V.history(t), open_keys, ["gpa"])
    return x.select(*V.KEY, r6("gpa").alias("gpa"))


@query("category_domain", sql="""
select c_mktsegment from (select c_mktsegment from customer where c_acctbal < 0
  union select c_mktsegment from customer where c_acctbal >= 0) u""")
def category_domain(t):
    """Sorted distinct union of category values over two frames (train / test split)."""
    from panelspark.operators.select import category_domain as cd
    c = t["customer"]
    return cd([c.filter(F.col("c_acctbal") < 0), c.filter(F.col("c_acctbal") >= 0)], "c_mktsegment")


@query("distinct_lines", sql="""
select doc_id, cast(len(list_distinct(string_split(text, chr(10)))) as int) as n_distinct_lines,
  cast(len(string_split(text, chr(10))) as int) as n_lines
from documents""")
def distinct_lines(t):
    """Union of two line lists with duplicates dropped (first-seen order), over whole texts."""
    from panelspark.operators.select import distinct_concat
    lines = F.split(F.col("text"), "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    a = F.slice(lines, 1, half)
    b = F.slice(lines, half + 1, F.size(lines))
    d = t["documents"]
    return d.select("doc_id", F.size(distinct_concat(a, b)).alias("n_distinct_lines"),
                    F.size(lines).alias("n_lines"))
