"""Registered queries: validation, import and batch updates."""

from pyspark.sql import functions as F

from panelspark.functions.numeric import r6, rnd
from panelspark.operators import quality as Q
from panelspark.plans import views as V
from panelspark.plans.registry import ORACLES, query
from panelspark.session import scratch_path
from panelspark.sources.files import read_csv_strings, with_line_numbers, write_csv

CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
# FIXED VALUES: the customer import contract used by the import queries.
CUSTOMER_RULES = (
    Q.Rule("c_custkey", "positive_int"),
    Q.Rule("c_name", "not_blank"),
    Q.Rule("c_nationkey", "int_in", tuple(range(25))),
    Q.Rule("c_acctbal", "float_range", (0.0, 10000.0)),
    Q.Rule("c_mktsegment", "in_set", ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")),
)
ENR_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def customer_csv(t):
    """customer written as CSV (key order) to the shared scratch area and read back as strings."""
    spark = t.spark
    path = scratch_path(spark, "customer-csv")
    write_csv(t["customer"].select(*CUSTOMER_COLUMNS), path, order=["c_custkey"])
    return read_csv_strings(spark, path, CUSTOMER_COLUMNS)


VALID_SQL = """c as (select *, row_number() over (order by c_custkey) - 1 as line_no from customer),
chk as (select *,
  c_custkey <= 0 as e1, c_name is null or trim(c_name) = '' as e2, c_nationkey not between 0 and 24 as e3,
  c_acctbal < 0 or c_acctbal > 10000 as e4, c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') as e5
  from c)"""


@query("validate_customer_csv", sql="with " + VALID_SQL + """
select line_no + 2 as "row", 'c_custkey' as field, 'must be a positive integer' as message from chk where e1
union all select line_no + 2, 'c_name', 'must not be blank' from chk where e2
union all select line_no + 2, 'c_nationkey', 'must be one of ' || (select string_agg(cast(i as varchar), ', ' order by i) from range(25) r(i)) from chk where e3
union all select line_no + 2, 'c_acctbal', 'must be between 0 and 10000' from chk where e4
union all select line_no + 2, 'c_mktsegment', 'must be one of AUTOMOBILE, BUILDING, FURNITURE, MACHINERY' from chk where e5""")
def validate_customer_csv(t):
    """A2 + I1: CSV round trip as strings with file-order line numbers, every field error reported."""
    _, errors = Q.validate_rows(customer_csv(t), CUSTOMER_RULES)
    return errors.select("row", "field", "message")


IMPORT_SQL = VALID_SQL + """,
valid as (select * from chk where not (e1 or e2 or e3 or e4 or e5)),
firsts as (select c_nationkey, c_mktsegment, min(line_no) as first_line from valid group by all),
existing as (select distinct s_nationkey as c_nationkey, 'AUTOMOBILE' as c_mktsegment from supplier),
outcome as (
  select v.line_no + 2 as "row",
    case when v.line_no <> f.first_line then 'duplicate_in_file'
         when e.c_nationkey is not null then 'exists' else 'inserted' end as outcome
  from valid v join firsts f on v.c_nationkey = f.c_nationkey and v.c_mktsegment = f.c_mktsegment
  left join existing e on v.c_nationkey = e.c_nationkey and v.c_mktsegment = e.c_mktsegment
  union all select line_no + 2, 'invalid' from chk where e1 or e2 or e3 or e4 or e5)"""


def _import(t):
    df = customer_csv(t)
    key = ["c_nationkey", "c_mktsegment"]
    existing = t["supplier"].select(F.col("s_nationkey").cast("string").alias("c_nationkey"),
                                    F.lit("AUTOMOBILE").alias("c_mktsegment"))
    ins, skipped, errors = Q.import_batch(df, CUSTOMER_RULES, key, existing)
    return df, ins, skipped, errors


@query("import_customers", sql="with " + IMPORT_SQL + "\nselect * from outcome")
def import_customers(t):
    """Validate -> keep first per key in file order -> skip keys already stored -> insert."""
    df, ins, skipped, errors = _import(t)
    return (ins.select((F.col("line_no") + 2).alias("row"), F.lit("inserted").alias("outcome"))
            .unionByName(skipped.select((F.col("line_no") + 2).alias("row"), F.col("reason").alias("outcome")))
            .unionByName(errors.select("row").distinct().withColumn("outcome", F.lit("invalid"))))


@query("import_summary", sql="with " + IMPORT_SQL + """
select (select count(*) from customer) as total_rows,
  (select count(*) from customer) - (select count(*) from outcome where outcome = 'invalid') as valid_rows,
  (select count(*) from outcome where outcome = 'invalid') as invalid_rows,
  (select count(*) from outcome where outcome = 'inserted') as inserted,
  (select count(*) from outcome where outcome in ('exists', 'duplicate_in_file')) as skipped""")
def import_summary(t):
    """Total / valid / invalid / inserted / skipped of the import."""
    df, ins, skipped, errors = _import(t)
    return Q.validation_summary(df, errors, ins, skipped, "c_nationkey")


@query("import_skipped", sql="with " + IMPORT_SQL + """
select o."row", o.outcome as reason, cast(chk.c_nationkey as varchar) as c_nationkey, chk.c_mktsegment
from outcome o join chk on o."row" = chk.line_no + 2 where o.outcome in ('exists', 'duplicate_in_file')""")
def import_skipped(t):
    """Every skipped row of the import with its key and reason."""
    _, _, skipped, _ = _import(t)
    return skipped.select((F.col("line_no") + 2).alias("row"), "reason", "c_nationkey", "c_mktsegment")


@query("parse_id_list", sql="""
with ids as (select l_partkey - 5 as id from lineitem)
select cast(count(distinct case when id > 0 then id end) as bigint) as valid,
  cast(sum(case when id <= 0 then 1 else 0 end) as bigint) as invalid,
  cast(sum(case when id > 0 then 1 else 0 end) - count(distinct case when id > 0 then id end) as bigint) as duplicate
from ids""")
def parse_id_list(t):
    """Id-list text file (header + first CSV cell per line) parsed with keep-first dedupe."""
    spark = t.spark
    path = scratch_path(spark, "id-list")
    li = t["lineitem"]
    body = li.select(F.concat_ws(",", (F.col("l_partkey") - 5).cast("string"), F.col("l_linenumber").cast("string"))
                     .alias("value"), *[F.col(k) for k in ENR_KEY])
    header = spark.createDataFrame([("STUDENT_ID", -1, 0, 0, 0)], ["value", *ENR_KEY])
    body.unionByName(header).orderBy(*ENR_KEY).select("value").write.mode("overwrite").text(path)
    lines = with_line_numbers(spark.read.text(path))
    _, counts = Q.parse_id_list(lines)
    return counts.select("valid", "invalid", "duplicate")


OPEN_LI = """li as (select l.* from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  where o.o_orderdate >= timestamp '2001-07-01 00:00:00')"""


def _open_lineitems(t):
    o = t["orders"].filter(F.col("o_orderdate") >= V.open_cutoff()).select("o_orderkey")
    return t["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")




@query("score_updates", sql="with " + OPEN_LI + """,
u as (select *, round(l_tax * 875, 2) as exam from li where l_linestatus = 'O'),
v as (select *, round(l_discount * 300, 2) as ca from li where l_returnflag = 'R'),
m as (select li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey,
    coalesce(v.ca, li.l_quantity * 0.6) as ca_score, u.exam as exam_score
  from li left join u on li.l_orderkey = u.l_orderkey and li.l_linenumber = u.l_linenumber
    and li.l_partkey = u.l_partkey and li.l_suppkey = u.l_suppkey
  left join v on li.l_orderkey = v.l_orderkey and li.l_linenumber = v.l_linenumber
    and li.l_partkey = v.l_partkey and li.l_suppkey = v.l_suppkey),
g as (select *, ca_score + exam_score as raw from m)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ca_score, 6) as ca_score, exam_score, round(raw, 2) as total_score,
  case when raw is null then null when raw >= 70 then 'A' when raw >= 60 then 'B'
    when raw >= 50 then 'C' when raw >= 45 then 'D' when raw >= 40 then 'E' else 'F' end as grade,
  case when raw is null then null when raw >= 70 then 5 when raw >= 60 then 4
    when raw >= 50 then 3 when raw >= 45 then 2 when raw >= 40 then 1 else 0 end as grade_point,
  case when raw is null then 'ongoing' else 'completed' end as status,
  case when raw is null then false else raw < 40 end as is_carryover
from g""")
def score_updates(t):
    """I4: CA/exam updates (last per key by sequence) grade an ongoing enrolment once both are present."""
    li = _open_lineitems(t)
    base = li.select(*ENR_KEY, (F.col("l_quantity") * 0.6).alias("ca_score"),
                     F.lit(None).cast("double").alias("exam_score"), F.lit(None).cast("double").alias("total_score"),
                     F.lit(None).cast("string").alias("grade"), F.lit(None).cast("int").alias("grade_point"),
                     F.lit("ongoing").alias("status"), F.lit(False).alias("is_carryover"))
    u1 = li.filter(F.col("l_linestatus") == "O").select(*ENR_KEY, F.lit(None).cast("double").alias("ca_score"),
                                                        rnd(F.col("l_tax") * 875, 2).alias("exam_score"), F.lit(1).alias("seq"))
    u2 = li.filter(F.col("l_returnflag") == "R").select(*ENR_KEY, rnd(F.col("l_discount") * 300, 2).alias("ca_score"),
                                                        F.lit(None).cast("double").alias("exam_score"), F.lit(2).alias("seq"))
    x = Q.apply_score_updates(base, u1.unionByName(u2), ENR_KEY)
    return x.select(*ENR_KEY, r6("ca_score").alias("ca_score"), "exam_score", "total_score", "grade", "grade_point",
                    "status", "is_carryover")


def attendance_inputs(t):
    """(attendance of the completed enrolments, updates of some and new ones)."""
    o = t["orders"].filter(F.col("o_orderdate") < V.open_cutoff()).select("o_orderkey")
    li = t["lineitem"]
    base = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
            .select(*ENR_KEY, (10 + F.col("l_linenumber")).alias("sessions_held"),
                    F.floor(F.col("l_quantity") / 5).cast("int").alias("sessions_attended")))
    base = base.withColumn("attendance_rate", F.try_divide(F.col("sessions_attended").cast("double"),
                                                           F.col("sessions_held").cast("double")))
    up = li.filter(F.col("l_returnflag") == "A").select(*ENR_KEY, (F.col("l_linenumber") - 1).alias("sessions_held"),
                                                        F.floor(F.col("l_quantity") / 4).cast("int").alias("sessions_attended"),
                                                        F.lit(1).alias("seq"))
    return base, up


@query("attendance_updates", sql="""
with base as (select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, 10 + l.l_linenumber as sessions_held,
    cast(floor(l.l_quantity / 5) as int) as sessions_attended
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderdate < timestamp '2001-07-01 00:00:00'),
up as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 1 as sessions_held,
    cast(floor(l_quantity / 4) as int) as sessions_attended from lineitem where l_returnflag = 'A'),
allr as (select * from base b where not exists (select 1 from up u where u.l_orderkey = b.l_orderkey
    and u.l_linenumber = b.l_linenumber and u.l_partkey = b.l_partkey and u.l_suppkey = b.l_suppkey)
  union all select * from up)
select *, round(case when sessions_held > 0 then sessions_attended / cast(sessions_held as double) end, 6) as attendance_rate
from allr""")
def attendance_updates(t):
    """Upsert attendance by enrolment; rate = attended / held, null when held is 0, may exceed 1."""
    base, up = attendance_inputs(t)
    x = Q.apply_attendance_updates(base, up, ENR_KEY)
    return x.select(*ENR_KEY, "sessions_held", "sessions_attended", r6("attendance_rate").alias("attendance_rate"))


@query("status_updates", sql="""
with base as (select o_orderkey as id, case o_orderstatus when 'F' then 'completed' when 'O' then 'in_progress'
    else 'planned' end as status, cast(null as varchar) as outcome_note from orders),
u as (select l_orderkey as id, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey as seq, l_shipdate as upd_at,
    case when l_returnflag = 'R' then 'cancelled' when l_linestatus = 'F' then 'completed' end as status,
    'flag ' || l_returnflag as outcome_note from lineitem),
lu as (select id, arg_max(status, case when status is not null then seq end) as s,
    arg_max(outcome_note, seq) as n, arg_max(upd_at, case when status in ('completed', 'cancelled') then seq end) as closed
  from u group by id)
select b.id, coalesce(l.s, b.status) as status, coalesce(l.n, b.outcome_note) as outcome_note,
  cast(cast(l.closed as date) as varchar) as resolved_on
from base b left join lu l on b.id = l.id""")
def status_updates(t):
    """Non-null fields override; resolved date set when the status becomes closing."""
    o = t["orders"]
    base = o.select(F.col("o_orderkey").alias("id"),
                    F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress")
                    .otherwise("planned").alias("status"),
                    F.lit(None).cast("string").alias("outcome_note"),
                    F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    li = t["lineitem"]
    seq = F.col("l_linenumber").cast("long") * 100000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    up = li.select(F.col("l_orderkey").alias("id"), seq.alias("seq"), F.col("l_shipdate").alias("updated_at"),
                   F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_linestatus") == "F", "completed")
                   .alias("status"),
                   F.concat(F.lit("flag "), F.col("l_returnflag")).alias("outcome_note"))
    x = Q.apply_status_updates(base, up, ["id"], "seq", ["status", "outcome_note"])
    return x.select("id", "status", "outcome_note", F.to_date("resolved_at").cast("string").alias("resolved_on"))


@query("insert_if_absent_courses", sql="""
with ex as (select distinct l.l_partkey from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  where o.o_orderdate < timestamp '2001-07-01 00:00:00')
select p_partkey, case when p_partkey in (select l_partkey from ex) then 'rejected' else 'inserted' end as action
from part""")
def insert_if_absent_courses(t):
    """A create is rejected when the unique key already exists."""
    o = t["orders"].filter(F.col("o_orderdate") < V.open_cutoff()).select("o_orderkey")
    ex = (t["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
          .select(F.col("l_partkey").alias("p_partkey")))
    ins, rej = Q.insert_if_absent(ex, t["part"].select("p_partkey"), ["p_partkey"])
    return ins.withColumn("action", F.lit("inserted")).unionByName(rej.withColumn("action", F.lit("rejected")))


@query("delete_patch_customers", sql="""
select c.c_custkey, c.c_name, case when c.c_nationkey = 0 then 'BUILDING' else c.c_mktsegment end as c_mktsegment,
  c.c_acctbal
from customer c where c.c_custkey in (select o_custkey from orders)""")
def delete_patch_customers(t):
    """I8: delete customers without orders; patch the segment of nation 0 (unset fields untouched)."""
    c = t["customer"].select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    no_orders = c.select("c_custkey").join(t["orders"].select(F.col("o_custkey").alias("c_custkey")), "c_custkey",
                                           "left_anti")
    kept = Q.delete_by_key(c, no_orders, ["c_custkey"])
    patch = (t["customer"].filter(F.col("c_nationkey") == 0)
             .select("c_custkey", F.lit("BUILDING").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal")))
    return Q.patch_by_key(kept, patch, ["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("null_out_orders")
def null_out_orders(t):
    """Seeded, partition-independent nulling of 4-8% per column (checked against D13 bounds in tests)."""
    o = t["orders"].select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return Q.null_out(o, ["o_totalprice", "o_orderpriority", "o_orderstatus"], ["o_orderkey"])
