"""Oracle-side SQL for the panel views (same semantics as ``plans.views``).

These CTE snippets are prepended to oracle queries; they run unchanged in
DuckDB (and in Spark SQL).
"""

ENR = """enr as (
  select o.o_custkey as student_id, l.l_partkey as course_id, cast(year(o.o_orderdate) as int) as session,
    case when month(o.o_orderdate) <= 6 then 1 else 2 end as semester,
    p.p_size % 3 + 2 as units, cast(floor((p.p_size - 1) / 10) as int) * 100 + 100 as level,
    case when p.p_size % 4 = 0 then 0 else 1 end as is_core,
    l.l_quantity * 0.6 as ca_score,
    case when o.o_orderdate < timestamp '2001-07-01 00:00:00' then l.l_quantity * 2 end as total_score,
    case when o.o_orderdate < timestamp '2001-07-01 00:00:00' then 'completed' else 'ongoing' end as status,
    1 - l.l_discount * 5 as attendance_rate
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey)"""

GRADED = """graded as (
  select *, case when total_score >= 70 then 'A' when total_score >= 60 then 'B' when total_score >= 50 then 'C'
      when total_score >= 45 then 'D' when total_score >= 40 then 'E' else 'F' end as grade,
    case when total_score >= 70 then 5 when total_score >= 60 then 4 when total_score >= 50 then 3
      when total_score >= 45 then 2 when total_score >= 40 then 1 else 0 end as grade_point
  from enr where status = 'completed')"""

HIST = """hist as (
  select student_id, session, semester, un as credits_registered, earned as credits_earned,
    pts / cast(un as double) as gpa,
    sum(pts) over (partition by student_id order by session, semester rows between unbounded preceding and current row)
      / cast(sum(un) over (partition by student_id order by session, semester rows between unbounded preceding and current row) as double) as cgpa
  from (select student_id, session, semester, cast(sum(grade_point * units) as bigint) as pts,
          cast(sum(units) as bigint) as un,
          cast(sum(case when grade <> 'F' then units else 0 end) as bigint) as earned
        from graded group by student_id, session, semester) t)"""

TERM = """term as (
  select student_id, session, semester, avg(ca_score) as ca_average, stddev_samp(ca_score) as ca_std_dev_across_courses,
    min(ca_score) as lowest_ca_score,
    cast(sum(case when ca_score < 15 then 1 else 0 end) as bigint) as courses_below_ca_threshold,
    avg(attendance_rate) as mean_attendance_rate, min(attendance_rate) as min_attendance_rate,
    cast(sum(case when attendance_rate < 0.75 then 1 else 0 end) as bigint) as courses_below_75_percent,
    cast(sum(units) as bigint) as credit_load, avg(cast(is_core as double)) as core_course_ratio,
    avg(ca_score) / 30.0 as ca_to_max_ratio
  from enr group by student_id, session, semester)"""

ENG = """eng as (
  select user_id as student_id, cast(floor((day(ts) - 1) / 7) as int) as week, count(*) as logins,
    cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as submitted, avg(value) as study_hours
  from events group by user_id, cast(floor((day(ts) - 1) / 7) as int))"""


def with_views(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


HIST_CTE = with_views(ENR, GRADED, HIST)
TERM_CTE = with_views(ENR, TERM)
ALL_CTE = with_views(ENR, GRADED, HIST, TERM)
