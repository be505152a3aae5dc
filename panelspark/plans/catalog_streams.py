"""Registered queries: streaming re-aims (Q1-Q3), each driven to completion with availableNow."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import r6
from panelspark.operators import quality as Q
from panelspark.plans.registry import ORACLES, query
from panelspark.session import scratch_path
from panelspark.sources.versions import KeyedTable
from panelspark.streaming import streams as ST


def _score_update_inputs(t):
    from panelspark.functions.numeric import rnd
    from panelspark.plans.catalog_quality import ENR_KEY, _open_lineitems
    li = _open_lineitems(t)
    base = li.select(*ENR_KEY, (F.col("l_quantity") * 0.6).alias("ca_score"),
                     F.lit(None).cast("double").alias("exam_score"), F.lit(None).cast("double").alias("total_score"),
                     F.lit(None).cast("string").alias("grade"), F.lit(None).cast("int").alias("grade_point"),
                     F.lit("ongoing").alias("status"), F.lit(False).alias("is_carryover"))
    u1 = li.filter(F.col("l_linestatus") == "O").select(*ENR_KEY, F.lit(None).cast("double").alias("ca_score"),
                                                        rnd(F.col("l_tax") * 875, 2).alias("exam_score"), F.lit(1).alias("seq"))
    u2 = li.filter(F.col("l_returnflag") == "R").select(*ENR_KEY, rnd(F.col("l_discount") * 300, 2).alias("ca_score"),
                                                        F.lit(None).cast("double").alias("exam_score"), F.lit(2).alias("seq"))
    return base, u1, u2, ENR_KEY


def _arrive(spark, name, updates, table, schema, apply, split, rejects):
    """Every frame of ``updates`` arrives as new files of one folder, written by all tasks, and is one batch of the same stream."""
    folder, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    for u in updates:
        u.write.mode("append").parquet(folder)
        ST.stream_updates(ST.file_stream(spark, folder, u.schema), table, schema, apply, checkpoint, split, rejects).awaitTermination()


def _stream_scores(t):
    """(table, schema, rejects folder, key) after three folders full of updates, one per trigger; the third one is out of range."""
    spark = t.spark
    base, u1, u2, key = _score_update_inputs(t)
    bad = u1.filter(F.col("l_linenumber") == 1).withColumns({"exam_score": F.col("exam_score") + 71, "seq": F.lit(9)})
    table = KeyedTable(spark, scratch_path(spark, "enr-table"), key)
    table.create(base)
    rejects = scratch_path(spark, "score-rejects")
    _arrive(spark, "score-updates", (u1, u2, bad), table, base.schema, lambda cur, b: Q.apply_score_updates(cur, b, key),
            Q.split_score_updates, rejects)
    return table, base.schema, rejects, key


@query("stream_score_updates")
def stream_score_updates(t):
    """Q1: score updates arrive as a file stream, one set of files per trigger, and are upserted batch by batch;
    a batch rewrites the key buckets that it touches, updates out of range are rejected."""
    table, schema, _, key = _stream_scores(t)
    return table.read(schema).select(*key, r6("ca_score").alias("ca_score"), "exam_score", "total_score", "grade", "grade_point",
                                     "status", "is_carryover")


@query("stream_rejected_updates", sql="""
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, 'exam_score must be between 0 and 70' as reason
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
where o.o_orderdate >= timestamp '2001-07-01 00:00:00' and l.l_linestatus = 'O' and l.l_linenumber = 1""")
def stream_rejected_updates(t):
    """Q1: the updates that the stream set aside, with the reason."""
    _, _, rejects, key = _stream_scores(t)
    return t.spark.read.parquet(rejects).select(*key, "reason")


@query("stream_attendance_updates")
def stream_attendance_updates(t):
    """Q1: attendance counts arrive as a file stream and are upserted; negative counts are rejected."""
    from panelspark.plans.catalog_quality import ENR_KEY, attendance_inputs
    spark = t.spark
    base, up = attendance_inputs(t)
    bad = up.withColumns({"sessions_held": F.lit(-1), "seq": F.lit(2)})
    table = KeyedTable(spark, scratch_path(spark, "attendance-table"), ENR_KEY)
    table.create(base)
    _arrive(spark, "attendance-updates", (up, bad), table, base.schema, lambda cur, b: Q.apply_attendance_updates(cur, b, ENR_KEY),
            Q.split_attendance_updates, scratch_path(spark, "attendance-rejects"))
    return table.read(base.schema).select(*ENR_KEY, "sessions_held", "sessions_attended", r6("attendance_rate").alias("attendance_rate"))


@query("stream_latest_event")
def stream_latest_event(t):
    """Q2: latest event per user, upserted batch by batch; the stream keeps no state."""
    spark = t.spark
    ev = t["events"].select("user_id", "ts", "event_id", "event_type", "value")
    src = ST.file_stream(spark, t.base, t["events"].schema, glob="events.parquet")
    table = KeyedTable(spark, scratch_path(spark, "latest-events"), ["user_id"])
    ST.stream_latest_table(src, table, ev.schema, ["ts", "event_id"], scratch_path(spark, "q2-ckpt")).awaitTermination()
    return table.read(ev.schema).select("user_id", "event_id", "event_type", r6("value").alias("value"))


@query("stream_engagement_windows", sql="""
select strftime(to_timestamp(floor(epoch(ts) / 604800) * 604800), '%Y-%m-%d %H:%M:%S') as window_start, user_id,
  count(*) as logins, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as submitted,
  round(avg(value), 6) as study_hours
from events group by all""")
def stream_engagement_windows(t):
    """Q3: 7-day event-time windows per user with a 1-day watermark, update mode."""
    spark = t.spark
    ev = t["events"]
    src = ST.file_stream(spark, t.base, ev.schema, glob="events.parquet")
    win = ST.stream_windows(src, "ts", "user_id")
    out = ST.run_to_table(win, "update", "q3", spark)
    w = Window.partitionBy("window_start", "user_id").orderBy(F.desc("batch"))
    final = out.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return final.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "user_id",
                        "logins", F.col("submitted").cast("long").alias("submitted"), r6("study_hours").alias("study_hours"))


# Q1 / Q2 compute the same result as their batch counterparts.
ORACLES["stream_score_updates"] = ORACLES["score_updates"]
ORACLES["stream_attendance_updates"] = ORACLES["attendance_updates"]
ORACLES["stream_latest_event"] = ORACLES.get("latest_event_per_user", "")
