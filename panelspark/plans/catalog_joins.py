"""Registered queries: joins."""

from pyspark.sql import functions as F

from panelspark.operators import joins as J
from panelspark.plans import views as V
from panelspark.functions.numeric import r6
from panelspark.plans.registry import query
from panelspark.plans.sql_views import ENR, GRADED, HIST, TERM, with_views




@query("enrolment_join", headline=True, sql=with_views(ENR) + """
select student_id, course_id, session, semester, units, level, is_core, round(ca_score, 6) as ca_score,
  round(total_score, 6) as total_score, status, round(attendance_rate, 6) as attendance_rate
from enr""")
def enrolment_join(t):
    """Lineitem x orders x part -> enrolment facts."""
    e = V.enrolments(t)
    return e.select("student_id", "course_id", "session", "semester", "units", "level", "is_core",
                    r6("ca_score").alias("ca_score"), r6("total_score").alias("total_score"), "status",
                    r6("attendance_rate").alias("attendance_rate"))


@query("documents_with_labels", sql="""
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from documents d left join labels l on d.doc_id = l.doc_id""")
def documents_with_labels(t):
    """Documents left-joined to their optional 1:1 labels (uniqueness checked first)."""
    d = t["documents"].select("doc_id", "lang", "source", "n_chars")
    return J.left_one_to_one(d, t["labels"], "doc_id", check=True)


@query("assembled_panel", sql=with_views(ENR, GRADED, HIST, TERM) + """
select h.student_id, h.session, h.semester, round(h.gpa, 6) as gpa, round(t.ca_average, 6) as ca_average,
  round(t.mean_attendance_rate, 6) as mean_attendance_rate, t.credit_load, c.c_acctbal as entry_score,
  c.c_mktsegment as entry_mode
from hist h
left join term t on h.student_id = t.student_id and h.session = t.session and h.semester = t.semester
left join customer c on h.student_id = c.c_custkey""")
def assembled_panel(t):
    """History spine left-joined to the term rollup (3-column key) and static attributes."""
    st = V.students(t).select("student_id", "entry_score", "entry_mode")
    x = J.assemble_panel(V.history(t), [V.term(t)], [st], V.KEY, "student_id")
    return x.select(*V.KEY, r6("gpa").alias("gpa"), r6("ca_average").alias("ca_average"),
                    r6("mean_attendance_rate").alias("mean_attendance_rate"), "credit_load", "entry_score",
                    "entry_mode")


@query("latest_event_per_user", sql="""
select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type,
  round(arg_max(value, (ts, event_id)), 6) as value
from events group by user_id""")
def latest_event_per_user(t):
    """C4: latest event per user by (ts, event_id) with max_by - no self-join."""
    x = J.latest_by(t["events"], "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])
    return x.select("user_id", "event_id", "event_type", r6("value").alias("value"))


@query("customers_of_brand", sql="""
select c_custkey, c_name from customer where c_custkey in (
  select o.o_custkey from orders o join lineitem l on l.l_orderkey = o.o_orderkey
  join part p on l.l_partkey = p.p_partkey where p.p_brand = 'Brand#13')""")
def customers_of_brand(t):
    """Customers in the scope of a subquery (semi join)."""
    p = t["part"].filter(F.col("p_brand") == "Brand#13").select("p_partkey")
    li = t["lineitem"].select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    buyers = t["orders"].select("o_orderkey", F.col("o_custkey").alias("c_custkey")) \
        .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("c_custkey")
    return J.semi_scope(t["customer"].select("c_custkey", "c_name"), buyers, "c_custkey")


@query("anti_existing_import", sql="""
with incoming as (select c_custkey, c_name from customer where c_mktsegment in ('BUILDING', 'MACHINERY')),
existing as (select c_custkey from customer where c_acctbal >= 5000)
select c_custkey, c_name, 'inserted' as action from incoming where c_custkey not in (select c_custkey from existing)
union all
select c_custkey, c_name, 'skipped' as action from incoming where c_custkey in (select c_custkey from existing)""")
def anti_existing_import(t):
    """Drop incoming rows already present (anti join) and report them (semi join)."""
    c = t["customer"]
    incoming = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")
    existing = c.filter(F.col("c_acctbal") >= 5000).select("c_custkey")
    ins, skip = J.anti_existing(incoming, existing, "c_custkey")
    return ins.withColumn("action", F.lit("inserted")).unionByName(skip.withColumn("action", F.lit("skipped")))


@query("lookup_status", sql="""
with req as (select distinct l_partkey as student_id from lineitem),
ongoing as (select distinct o_custkey as student_id from orders where o_orderdate >= timestamp '2001-07-01 00:00:00')
select r.student_id,
  case when c.c_custkey is null then 'not found' when g.student_id is null then 'no ongoing' else 'ok' end as status
from req r left join customer c on r.student_id = c.c_custkey left join ongoing g on r.student_id = g.student_id""")
def lookup_status(t):
    """Requested ids (every part key referenced by lineitem, read as a student id) checked
    against the entity table and the open-period orders."""
    req = t["lineitem"].select(F.col("l_partkey").alias("student_id"))
    ent = t["customer"].select(F.col("c_custkey").alias("student_id"))
    ongoing = (t["orders"].filter(F.col("o_orderdate") >= V.open_cutoff())
               .select(F.col("o_custkey").alias("student_id")).distinct())
    return J.lookup_with_status(req, ent, ongoing, "student_id")


@query("lookup_totals", sql="""
with req as (select distinct l_partkey as student_id from lineitem),
ongoing as (select distinct o_custkey as student_id from orders where o_orderdate >= timestamp '2001-07-01 00:00:00'),
st as (select r.student_id, c.c_custkey is not null and g.student_id is not null as ok
  from req r left join customer c on r.student_id = c.c_custkey left join ongoing g on r.student_id = g.student_id)
select count(*) as requested, cast(sum(case when ok then 1 else 0 end) as bigint) as succeeded from st""")
def lookup_totals(t):
    """C7 totals: requested / succeeded in one aggregate."""
    s = lookup_status(t)
    return s.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("status") == "ok").alias("succeeded"))


@query("filter_id_list", sql="""
select o_orderkey, o_custkey, o_totalprice from orders
where o_custkey in (select c_custkey from customer where c_mktsegment = 'AUTOMOBILE' and c_acctbal > 9000)""")
def filter_id_list(t):
    """Filter by an id list derived from the data (semi join, broadcast only if small)."""
    ids = t["customer"].filter((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_acctbal") > 9000)).select("c_custkey")
    return J.filter_in(t["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", ids)


@query("attach_population_stats", sql="""
select o_orderkey, round(o_totalprice - m, 6) as price_minus_mean, round(o_totalprice / m, 6) as price_to_mean
from orders cross join (select avg(o_totalprice) as m from orders) s""")
def attach_population_stats(t):
    """A one-row population aggregate attached to every row by broadcast."""
    o = t["orders"].select("o_orderkey", "o_totalprice")
    x = J.attach_scalars(o, F.avg("o_totalprice").alias("_m"))
    return x.select("o_orderkey", r6(F.col("o_totalprice") - F.col("_m")).alias("price_minus_mean"),
                    r6(F.col("o_totalprice") / F.col("_m")).alias("price_to_mean"))
