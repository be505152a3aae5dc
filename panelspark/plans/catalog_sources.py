"""Registered queries: sources and sinks.

Every write goes to a fresh folder under the shared checkpoint folder.
"""

from pyspark.sql import functions as F

from panelspark.functions.numeric import r6
from panelspark.plans.catalog_metrics import scored_docs
from panelspark.plans.registry import ORACLES, query
from panelspark.plans.scoring import OPEN_SQL, scored_open
from panelspark.plans.sql_views import ALL_CTE
from panelspark.session import scratch_path
from panelspark.sources import files as FS
from panelspark.sources.tables import DRIVER_TABLES, normalise_nulls


REPORT_SQL = ORACLES["fairness_report"].replace("select attribute, metric, round(gap, 6) as gap,", """, fl as (
select attribute, metric, round(gap, 6) as gap,""").rsplit("from gp", 1)[0] + """from gp)
select attribute, 'group' as part, value as name, n, round(accuracy, 6) as accuracy, round(positive_rate, 6) as positive_rate,
  round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(precision, 6) as precision, cast(null as double) as gap, cast(null as boolean) as flagged
from r
union all select attribute, 'gap', metric, null, null, null, null, null, null, gap, flagged from fl"""


@query("table_row_counts", sql="\nunion all\n".join(
    f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in DRIVER_TABLES))
def table_row_counts(t):
    """A1: every driver table loaded lazily into a name -> DataFrame map; row count of each."""
    parts = [t[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for n in t]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# a number in each table that survives a round trip through text
KEY_SUMS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
            "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
            "pages": "page_id", "labels": "doc_id", "conversations": "conv_id"}


def _counts_sql() -> str:
    return "\nunion all\n".join(
        f"select '{n}' as table_name, count(*) as n_rows, cast({f'sum({KEY_SUMS[n]})' if n in KEY_SUMS else '0'} as bigint) as key_sum from {n}"
        for n in DRIVER_TABLES)


def _counts(frames):
    out = None
    for n, df in frames.items():
        total = F.sum(F.col(KEY_SUMS[n]).cast("long")) if n in KEY_SUMS else F.lit(0).cast("long")
        one = df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), total.alias("key_sum"))
        out = one if out is None else out.unionByName(one)
    return out


def _flat(df):
    """Arrays as JSON text: CSV has no arrays."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
                       for f in df.schema.fields])


@query("csv_snapshot_roundtrip", sql=_counts_sql())
def csv_snapshot_roundtrip(t):
    """A3: one CSV folder per table, all 14, and metadata JSON; read back as records, quoted line breaks and all."""
    spark = t.spark
    base = FS.write_csv_snapshot(spark, {n: _flat(t[n]) for n in t}, seed=42)
    return _counts({n: FS.read_csv_strings(spark, f"{base}/{n}", t[n].columns, line_col=None) for n in t})


@query("replace_tables_idempotent", sql=_counts_sql())
def replace_tables_idempotent(t):
    """A4: full reload of all 14 tables, twice; contents unchanged."""
    base = scratch_path(t.spark, "reload")
    for _ in range(2):
        store = FS.replace_tables(t.spark, {n: t[n] for n in t}, base)
    return _counts({n: store.read(n) for n in t})


@query("normalise_nulls_orders", sql="""
select o_orderkey, case when o_orderstatus = 'O' then null else cast(o_custkey as int) end as o_custkey,
  case when o_orderstatus = 'P' then null else o_totalprice end as o_totalprice
from orders""")
def normalise_nulls_orders(t):
    """A5: NaN injected by status, then NaN -> NULL and the declared int column cast back."""
    nan = F.lit(float("nan"))
    o = t["orders"].select("o_orderkey",
                           F.when(F.col("o_orderstatus") == "O", nan).otherwise(F.col("o_custkey").cast("double")).alias("o_custkey"),
                           F.when(F.col("o_orderstatus") == "P", nan).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return normalise_nulls(o, ["o_custkey"])


@query("replace_by_key_customer", sql="""
select c_custkey, c_name, case when c_acctbal > 9000 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer""")
def replace_by_key_customer(t):
    """Rows of a changed batch replace theirs by key, others kept; applied twice (idempotent)."""
    spark = t.spark
    base_path = scratch_path(spark, "customers-base")
    t["customer"].select("c_custkey", "c_name", "c_acctbal").write.parquet(base_path)
    new = (t["customer"].filter(F.col("c_acctbal") > 9000)
           .select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal")))
    once = FS.write_replace_by_key(spark, base_path, new, "c_custkey")
    twice = FS.write_replace_by_key(spark, once, new, "c_custkey")
    return spark.read.parquet(twice).select("c_custkey", "c_name", r6("c_acctbal").alias("c_acctbal"))


@query("append_log_scores", sql=ALL_CTE + "," + OPEN_SQL + """
select student_id, risk_tier, round(probability, 6) as probability from tiered""")
def append_log_scores(t):
    """Scored open periods appended to a prediction log with a JSON payload, read back."""
    spark = t.spark
    path = scratch_path(spark, "prediction-log")
    s = scored_open(t).select("student_id", "probability", "risk_tier")
    FS.append_log(s, path, ["probability", "risk_tier"])
    log = spark.read.parquet(path)
    return log.select("student_id", F.get_json_object("payload", "$.risk_tier").alias("risk_tier"),
                      r6(F.get_json_object("payload", "$.probability").cast("double")).alias("probability"))


@query("write_report_fairness", sql=REPORT_SQL)
def write_report_fairness(t):
    """Nested fairness report (per attribute: groups with all rates, gaps with flags) written as JSON, read back and flattened."""
    from panelspark.operators import fairness as FA
    spark = t.spark
    path = scratch_path(spark, "fairness-report")
    rates, flags = FA.fairness_report(scored_docs(t), ["lang", "source"])
    groups = rates.groupBy("attribute").agg(F.sort_array(F.collect_list(F.struct("value", "n", *FA.RATE_METRICS))).alias("groups"))
    gaps = flags.groupBy("attribute").agg(F.sort_array(F.collect_list(F.struct("metric", "gap", "flagged"))).alias("gaps"),
                                          F.bool_or("flagged").alias("flagged"))
    FS.write_report(groups.join(gaps, "attribute"), path)
    kind = ("attribute string, flagged boolean, groups array<struct<value:string,n:long,accuracy:double,positive_rate:double,tpr:double,"
            "fpr:double,precision:double>>, gaps array<struct<metric:string,gap:double,flagged:boolean>>")
    rep = spark.read.schema(kind).json(path)
    one = rep.select("attribute", F.explode("groups").alias("g")).select("attribute", F.lit("group").alias("part"), F.col("g.value").alias("name"),
                                                                        F.col("g.n").alias("n"), *[r6(F.col(f"g.{m}")).alias(m) for m in FA.RATE_METRICS],
                                                                        F.lit(None).cast("double").alias("gap"), F.lit(None).cast("boolean").alias("flagged"))
    two = rep.select("attribute", F.explode("gaps").alias("g")).select("attribute", F.lit("gap").alias("part"), F.col("g.metric").alias("name"),
                                                                      F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("double").alias(m) for m in FA.RATE_METRICS],
                                                                      r6(F.col("g.gap")).alias("gap"), F.col("g.flagged").alias("flagged"))
    return one.unionByName(two)
