"""Registered queries: evaluation metrics (M1-M7) and fairness.

Scores are deterministic functions of the data so every metric has an
oracle: documents x labels with score = n_chars / (n_chars + 1000) and the
rule prediction n_chars >= 1000 (score >= 0.5); regression uses the naive
"previous GPA" predictor over the history view.
"""

from pyspark.sql import functions as F

from panelspark.functions.numeric import r6
from panelspark.operators import fairness as FA
from panelspark.operators import history as H
from panelspark.operators import metrics as M
from panelspark.plans import views as V
from panelspark.plans.registry import query
from panelspark.plans.sql_views import HIST_CTE

SCORED_SQL = """with s as (select d.doc_id, d.lang, d.source, l.quality as y_true,
    case when d.n_chars >= 1000 then 1 else 0 end as y_pred, d.n_chars / (d.n_chars + 1000.0) as y_score
  from documents d join labels l on d.doc_id = l.doc_id)
"""


def scored_docs(t):
    d = t["documents"].select("doc_id", "lang", "source", "n_chars")
    j = d.join(t["labels"].select("doc_id", "quality"), "doc_id")
    return j.select("doc_id", "lang", "source", F.col("quality").alias("y_true"),
                    (F.col("n_chars") >= 1000).cast("int").alias("y_pred"),
                    (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("y_score"))


REG_SQL = HIST_CTE + """,
lagged as (select student_id, session, semester, gpa as y_true,
  coalesce(lag(gpa, 1) over (partition by student_id order by session, semester), 2.5) as y_pred from hist)
"""


def scored_hist(t):
    h = H.lag_features(V.history(t), "student_id", V.PERIOD, {"prior_gpa": "gpa"})
    return h.select(*V.KEY, F.col("gpa").alias("y_true"), F.coalesce("prior_gpa", F.lit(2.5)).alias("y_pred"))


def _cells():
    return """c as (select cast(sum(case when y_true = 0 and y_pred = 0 then 1 else 0 end) as bigint) as tn,
  cast(sum(case when y_true = 0 and y_pred = 1 then 1 else 0 end) as bigint) as fp,
  cast(sum(case when y_true = 1 and y_pred = 0 then 1 else 0 end) as bigint) as fn,
  cast(sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end) as bigint) as tp from s),
r as (select *, case when tp + fp = 0 then 0.0 else tp / cast(tp + fp as double) end as p1,
  case when tp + fn = 0 then 0.0 else tp / cast(tp + fn as double) end as r1,
  case when tn + fn = 0 then 0.0 else tn / cast(tn + fn as double) end as p0,
  case when tn + fp = 0 then 0.0 else tn / cast(tn + fp as double) end as r0 from c),
f as (select *, case when p1 + r1 = 0 then 0.0 else 2 * p1 * r1 / (p1 + r1) end as f1,
  case when p0 + r0 = 0 then 0.0 else 2 * p0 * r0 / (p0 + r0) end as f0 from r)"""


@query("confusion_prf", sql=SCORED_SQL + "," + _cells() + """
select tn, fp, fn, tp, round((tp + tn) / cast(tn + fp + fn + tp as double), 6) as accuracy,
  round((p0 + p1) / 2, 6) as precision_macro, round((r0 + r1) / 2, 6) as recall_macro,
  round((f0 + f1) / 2, 6) as f1_macro, round((f0 * (tn + fp) + f1 * (tp + fn)) / cast(tn + fp + fn + tp as double), 6)
    as f1_weighted
from f""")
def confusion_prf(t):
    """M1: confusion matrix, accuracy, macro precision/recall/F1, weighted F1."""
    m = M.confusion_and_prf(scored_docs(t))
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in
                    ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")])


@query("per_class_report", sql=SCORED_SQL + "," + _cells() + """
select 0 as label, round(p0, 6) as precision, round(r0, 6) as recall, round(f0, 6) as f1, tn + fp as support from f
union all select 1, round(p1, 6), round(r1, 6), round(f1, 6), tp + fn from f""")
def per_class_report(t):
    """M1: per-class precision / recall / F1 / support."""
    m = M.per_class_report(scored_docs(t))
    return m.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                    "support")


CUM_SQL = """g as (select y_score as threshold, sum(y_true) as pos, sum(1 - y_true) as neg from s group by y_score),
cu as (select *, sum(pos) over (order by threshold desc rows between unbounded preceding and current row) as cp,
  sum(neg) over (order by threshold desc rows between unbounded preceding and current row) as cn from g),
tot as (select sum(pos) as P, sum(neg) as N from g)"""


@query("roc_curve", headline=True, sql=SCORED_SQL + "," + CUM_SQL + """
select round(threshold, 6) as threshold, round(cn / cast(N as double), 6) as fpr, round(cp / cast(P as double), 6) as tpr
from cu cross join tot
union all select cast(null as double), 0.0, 0.0""")
def roc_curve(t):
    """M2: ROC points at every distinct score, from bucketed prefix sums (no global window)."""
    c = M.roc_curve(scored_docs(t))
    return c.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("roc_curve_sample")
def roc_curve_sample(t):
    """M2: at most 300 seeded ROC points (chart payload)."""
    return M.roc_sample(M.roc_curve(scored_docs(t)))


@query("roc_auc", sql=SCORED_SQL + "," + CUM_SQL + """
select round(sum(neg * (cp + (cp - pos)) / 2.0) / (sum(pos) * sum(neg)), 6) as roc_auc from cu""")
def roc_auc(t):
    """M3: trapezoidal AUC over distinct thresholds (ties handled)."""
    return M.roc_auc(scored_docs(t)).select(r6("roc_auc").alias("roc_auc"))


@query("average_precision", sql=SCORED_SQL + "," + CUM_SQL + """
select round(sum(pos * (cp / cast(cp + cn as double))) / sum(pos), 6) as average_precision from cu""")
def average_precision(t):
    """M4: step-wise average precision."""
    return M.average_precision(scored_docs(t)).select(r6("average_precision").alias("average_precision"))


@query("calibration_curve", sql=SCORED_SQL + """,
q as (select """ + ", ".join(f"quantile_cont(y_score, {i / 10}) as e{i}" for i in range(1, 10)) + """ from s),
b as (select s.*, """ + " + ".join(f"cast(e{i} < y_score as int)" for i in range(1, 10)) + """ as bin from s cross join q)
select bin, round(avg(y_score), 6) as prob_pred, round(avg(cast(y_true as double)), 6) as prob_true, count(*) as n
from b group by bin""")
def calibration_curve(t):
    """M5: 10 quantile bins with exact interpolated edges; mean score vs positive rate."""
    c = M.calibration_curve(scored_docs(t))
    return c.select("bin", r6("prob_pred").alias("prob_pred"), r6("prob_true").alias("prob_true"), "n")


@query("regression_metrics", sql=REG_SQL + """
select round(avg(abs(y_true - y_pred)), 6) as mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) as rmse,
  round(1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(y_true)), 6) as r2,
  round(avg(case when y_true <> 0 then abs(y_true - y_pred) / abs(y_true) end), 6) as mape
from lagged""")
def regression_metrics(t):
    """M6: MAE, RMSE, R2, MAPE of the previous-GPA predictor."""
    m = M.regression_metrics(scored_hist(t))
    return m.select(*[r6(c).alias(c) for c in ("mae", "rmse", "r2", "mape")])


@query("residual_sample")
def residual_sample(t):
    """M7: at most 300 seeded (y, residual, prediction) points."""
    return M.residual_sample(scored_hist(t), list(V.KEY))


@query("group_rates", headline=True, sql=SCORED_SQL + """
select lang as grp, count(*) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 6) as accuracy,
  round(avg(cast(y_pred as double)), 6) as positive_rate,
  round(case when sum(y_true) > 0 then sum(y_true * y_pred) / cast(sum(y_true) as double) end, 6) as tpr,
  round(case when sum(1 - y_true) > 0 then sum((1 - y_true) * y_pred) / cast(sum(1 - y_true) as double) end, 6) as fpr,
  round(case when sum(y_pred) > 0 then sum(y_true * y_pred) / cast(sum(y_pred) as double) end, 6) as precision
from s where lang is not null group by lang""")
def group_rates(t):
    """Per-language n, accuracy, positive rate, TPR, FPR, precision."""
    r = FA.group_rates(scored_docs(t).withColumnRenamed("lang", "grp"), "grp")
    return r.select("grp", "n", *[r6(c).alias(c) for c in FA.RATE_METRICS])


@query("group_errors", sql=REG_SQL + """
select c.c_mktsegment as grp, count(*) as n, round(avg(abs(y_true - y_pred)), 6) as mae,
  round(avg(y_pred) / 5.0, 6) as mean_predicted, round(avg(y_true) / 5.0, 6) as mean_actual
from lagged l join customer c on l.student_id = c.c_custkey group by c.c_mktsegment""")
def group_errors(t):
    """Per entry-mode group MAE and scaled mean predicted / actual GPA."""
    s = scored_hist(t).join(V.students(t).select("student_id", F.col("entry_mode").alias("grp")), "student_id")
    e = FA.group_errors(s, "grp", scale=5.0)
    return e.select("grp", "n", r6("mae").alias("mae"), r6("mean_predicted").alias("mean_predicted"),
                    r6("mean_actual").alias("mean_actual"))


GAPS_SQL = SCORED_SQL + """,
r as (select lang, avg(case when y_true = y_pred then 1.0 else 0.0 end) as accuracy,
  avg(cast(y_pred as double)) as positive_rate,
  case when sum(y_true) > 0 then sum(y_true * y_pred) / cast(sum(y_true) as double) end as tpr,
  case when sum(1 - y_true) > 0 then sum((1 - y_true) * y_pred) / cast(sum(1 - y_true) as double) end as fpr,
  case when sum(y_pred) > 0 then sum(y_true * y_pred) / cast(sum(y_pred) as double) end as precision
  from s where lang is not null group by lang),
l as (select 'accuracy' as metric, accuracy as v from r union all select 'positive_rate', positive_rate from r
  union all select 'tpr', tpr from r union all select 'fpr', fpr from r union all select 'precision', precision from r),
gp as (select metric, case when count(v) >= 2 then max(v) - min(v) end as gap from l group by metric)"""


@query("parity_gaps", sql=GAPS_SQL + """
select metric, round(gap, 6) as gap from gp""")
def parity_gaps(t):
    """Max - min of each rate over language groups."""
    r = FA.group_rates(scored_docs(t), "lang")
    return FA.parity_gaps(r).select("metric", r6("gap").alias("gap"))


@query("disparity_flags", sql=GAPS_SQL + """
select metric, round(gap, 6) as gap, (metric in ('positive_rate', 'tpr', 'precision') and coalesce(gap > 0.1, false)) as flagged,
  (select bool_or((metric in ('positive_rate', 'tpr', 'precision') and coalesce(gap > 0.1, false))) from gp) as any_flag from gp""")
def disparity_flags(t):
    """Strict > 0.10 flag per metric and any flag."""
    r = FA.group_rates(scored_docs(t), "lang")
    f = FA.flag_disparity(FA.parity_gaps(r))
    return f.select("metric", r6("gap").alias("gap"), "flagged", "any_flag")


def fairness_report_frame(t):
    rates, flags = FA.fairness_report(scored_docs(t), ["lang", "source"])
    anyf = flags.groupBy("attribute").agg(F.bool_or("flagged").alias("any_flag"))
    return rates.join(anyf, "attribute")


@query("fairness_report", sql=SCORED_SQL + """,
u as (select y_true, y_pred, 'lang' as attribute, lang as value from s
  union all select y_true, y_pred, 'source', source from s),
r as (select attribute, value, count(*) as n, avg(case when y_true = y_pred then 1.0 else 0.0 end) as accuracy,
  avg(cast(y_pred as double)) as positive_rate,
  case when sum(y_true) > 0 then sum(y_true * y_pred) / cast(sum(y_true) as double) end as tpr,
  case when sum(1 - y_true) > 0 then sum((1 - y_true) * y_pred) / cast(sum(1 - y_true) as double) end as fpr,
  case when sum(y_pred) > 0 then sum(y_true * y_pred) / cast(sum(y_pred) as double) end as precision
  from u where value is not null group by attribute, value),
l as (select attribute, 'accuracy' as metric, accuracy as v from r union all select attribute, 'positive_rate', positive_rate from r
  union all select attribute, 'tpr', tpr from r union all select attribute, 'fpr', fpr from r
  union all select attribute, 'precision', precision from r),
gp as (select attribute, metric, case when count(v) >= 2 then max(v) - min(v) end as gap from l group by attribute, metric)
select attribute, metric, round(gap, 6) as gap, (metric in ('positive_rate', 'tpr', 'precision') and coalesce(gap > 0.1, false)) as flagged,
  bool_or((metric in ('positive_rate', 'tpr', 'precision') and coalesce(gap > 0.1, false))) over (partition by attribute) as any_flag
from gp""")
def fairness_report(t):
    """N1-N4 over two group attributes with one (attribute, value) aggregation."""
    _, flags = FA.fairness_report(scored_docs(t), ["lang", "source"])
    return flags.select("attribute", "metric", r6("gap").alias("gap"), "flagged", "any_flag")
