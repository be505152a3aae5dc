"""Registered queries: preparation (K1-K9) and training / selection."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from panelspark.functions.numeric import r6
from panelspark.operators import metrics as M
from panelspark.operators import fairness as FA
from panelspark.plans import prep as P
from panelspark.plans import tasks as TK
from panelspark.plans import train as TR
from panelspark.plans import views as V
from panelspark.plans.catalog_features import panel_sql
from panelspark.plans.registry import query
from panelspark.plans.sql_views import HIST_CTE, TERM_CTE

MED_COLS = ("ca_std_dev_across_courses", "ca_average", "min_attendance_rate")


@query("impute_medians", sql=TERM_CTE + "\nunion all\n".join(
    f"select '{c}' as \"column\", round(median({c}), 6) as median from term" for c in MED_COLS).replace(TERM_CTE, "", 0))
def impute_medians(t):
    """K1: exact (interpolated) median per numeric column, fitted on the training frame."""
    from panelspark.session import cut_lineage
    term = cut_lineage(V.term(t).select(*MED_COLS), "median-columns")   # read by every pass
    model = P.ExactMedianImputer(inputCols=list(MED_COLS)).fit(term)
    rows = list(zip(MED_COLS, model._stats()))
    return t.spark.createDataFrame(rows, "column string, median double").select("column", r6("median").alias("median"))


@query("impute_modes", sql="""
select 'c_mktsegment' as "column", (select c_mktsegment from customer group by c_mktsegment
  order by count(*) desc, c_mktsegment limit 1) as mode
union all
select 'c_nationkey', (select cast(c_nationkey as varchar) from customer group by c_nationkey
  order by count(*) desc, cast(c_nationkey as varchar) limit 1)""")
def impute_modes(t):
    """K2: most frequent value per categorical column (smallest on ties), one distributed job."""
    model = P.ModeImputer(inputCols=["c_mktsegment", "c_nationkey"]).fit(t["customer"])
    return t.spark.createDataFrame(list(zip(["c_mktsegment", "c_nationkey"], model._stats())), "column string, mode string")


@query("scaled_term_features", sql=TERM_CTE + """,
s as (select avg(ca_average) as m1, stddev_pop(ca_average) as s1, avg(credit_load) as m2, stddev_pop(credit_load) as s2
  from term)
select student_id, session, semester, round((ca_average - m1) / s1, 6) as ca_average,
  round((credit_load - m2) / s2, 6) as credit_load from term cross join s""")
def scaled_term_features(t):
    """K3: z-scaling with the population standard deviation."""
    term = V.term(t).select(*V.KEY, "ca_average", F.col("credit_load").cast("double").alias("credit_load"))
    model = P.PopulationScaler(inputCols=["ca_average", "credit_load"]).fit(term)
    out = model.transform(term)
    return out.select(*V.KEY, r6("ca_average").alias("ca_average"), r6("credit_load").alias("credit_load"))


@query("one_hot_unknown")
def one_hot_unknown(t):
    """K4/K5: prep stages fitted on part of the customers; an unseen category encodes to all zeros."""
    c = t["customer"].select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment"))
    fit_on = c.filter(F.col("segment") != "HOUSEHOLD")
    model = Pipeline(stages=P.prep_stages(["c_acctbal"], ["segment"])).fit(fit_on)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(c)
    return out.select("c_custkey", "segment", vector_to_array("features").alias("features"))


@query("temporal_split", sql=HIST_CTE + """
select student_id, session, semester,
  case when session >= (select max(session) from hist) then 'test' else 'train' end as split from hist""")
def temporal_split(t):
    """K6: the latest distinct session is the test side, earlier sessions train."""
    h = V.history(t).select(*V.KEY)
    train, test = P.temporal_split(h, "session", 1)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


# folds: entities ranked by rows (most first, ties by a hash of the key) and dealt there and back
FOLD_SQL = """, placed as (select *, row_number() over (partition by stratum order by size desc,
    md5(cast(student_id as varchar) || '-42'), student_id) - 1 as place from per),
dealt as (select student_id, cast(((case when (place // 5) % 2 = 0 then place % 5 else 4 - place % 5 end) + start) % 5 as int) as fold
  from placed)
"""


@query("group_folds", sql=HIST_CTE + """, per as (select student_id, count(*) as size, 0 as stratum, 0 as start from hist group by student_id)"""
       + FOLD_SQL + "select h.student_id, h.session, h.semester, d.fold from hist h join dealt d on h.student_id = d.student_id")
def group_folds(t):
    """K7: whole students dealt to 5 folds, largest first, there and back."""
    return P.group_folds(V.history(t).select(*V.KEY), "student_id", 5)


STRATIFIED_SQL = HIST_CTE + """,
cnt as (select student_id, count(*) as size, count(*) filter (where gpa < 2.0) as stratum from hist group by student_id),
st as (select stratum, coalesce(sum(count(*)) over (order by stratum desc rows between unbounded preceding and 1 preceding), 0) % 5 as start
  from cnt group by stratum),
per as (select cnt.*, st.start from cnt join st on cnt.stratum = st.stratum)""" + FOLD_SQL


@query("stratified_group_folds", sql=STRATIFIED_SQL + """
select h.student_id, h.session, h.semester, case when h.gpa < 2.0 then 1 else 0 end as risk_label, d.fold
from hist h join dealt d on h.student_id = d.student_id""")
def stratified_group_folds(t):
    """K8: students dealt to 5 folds inside each number of positive (gpa < 2) rows."""
    h = V.history(t).select(*V.KEY, (F.col("gpa") < 2.0).cast("int").alias("risk_label"))
    return P.stratified_group_folds(h, "student_id", "risk_label", 5)


@query("fold_balance", sql=STRATIFIED_SQL + """
select d.fold, count(*) as n_rows, count(distinct h.student_id) as n_students, cast(sum(case when h.gpa < 2.0 then 1 else 0 end) as bigint) as n_positive
from hist h join dealt d on h.student_id = d.student_id group by d.fold""")
def fold_balance(t):
    """K8: rows, students and positive rows per fold."""
    h = V.history(t).select(*V.KEY, (F.col("gpa") < 2.0).cast("int").alias("risk_label"))
    x = P.stratified_group_folds(h, "student_id", "risk_label", 5)
    return x.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("student_id").alias("n_students"),
                                 F.sum("risk_label").cast("long").alias("n_positive"))


def _prepared_panel(t):
    from panelspark.plans.catalog_features import panel_featureset
    from panelspark.functions.rows import column_types
    fs = panel_featureset(t)
    numeric, categorical = column_types(fs.df, fs.feature_cols)
    return fs, numeric, categorical


@query("smote_minority")
def smote_minority(t):
    """K9: synthetic at-risk rows between nearest at-risk rows, until both classes are equal (training rows only)."""
    from panelspark.session import cut_lineage, free_shuffles
    fs, numeric, categorical = _prepared_panel(t)
    df = cut_lineage(fs.df.withColumn("row_id", F.concat_ws("-", *[F.col(c).cast("string") for c in fs.meta_cols])))
    free_shuffles(t.spark)
    prep = Pipeline(stages=P.prep_stages(numeric, categorical)).fit(df)
    x = prep.transform(df).select("row_id", "features", "risk_label")
    return P.smote(x, "features", "risk_label", "row_id", k=5, ratio=1.0)


def _panel_with_folds(t, k=3):
    from panelspark.session import cut_lineage
    fs, numeric, categorical = _prepared_panel(t)
    df = cut_lineage(P.group_folds(fs.df, "student_id", k))
    return df, numeric, categorical


def _compared(t, task):
    return TR.results_frame(t.spark, TK.train_task(t, task, TK.SHORT_GRIDS[TK.TASKS[task].kind]))


@query("classifier_comparison")
def classifier_comparison(t):
    """L1 + L3-L7: six classifiers with and without synthetic rows, grids over stratified student folds: out-of-fold F1 macro,
    in-sample gap, later-period refit, leakage redaction (risk label = gpa < 2.0)."""
    return _compared(t, "risk_classification")


@query("regressor_comparison")
def regressor_comparison(t):
    """L2: six regressors and their grids over student folds (target = term GPA)."""
    return _compared(t, "gpa_regression")


@query("course_score_comparison")
def course_score_comparison(t):
    """L2 for T3: six regressors over the course items (target = item score)."""
    return _compared(t, "course_score")


@query("grid_search_logistic")
def grid_search_logistic(t):
    """L3: exhaustive grid (regParam) scored by F1 macro over entity folds; best model refit."""
    from pyspark.ml.classification import LogisticRegression
    df, numeric, categorical = _panel_with_folds(t)
    df = df.withColumn("label", F.col("risk_label").cast("double"))
    lr = LogisticRegression(maxIter=50)
    cvm = TR.grid_search(df, P.prep_stages(numeric, categorical), lr, {"regParam": [0.0, 0.1]}, "classification", k=3)
    grid = [str(pm[lr.regParam]) for pm in cvm.getEstimatorParamMaps()]
    return t.spark.createDataFrame(list(zip(grid, [float(m) for m in cvm.avgMetrics])), "reg_param string, f1_macro double")


PRED_SQL = """with s as (select l.quality as y_true, d.n_chars from documents d join labels l on d.doc_id = l.doc_id),
p as (select 'n_chars_rule' as algorithm, y_true, case when n_chars >= 1000 then 1 else 0 end as y_pred from s
  union all select 'label_copy', y_true, y_true from s
  union all select 'long_doc_rule', y_true, case when n_chars >= 5000 then 1 else 0 end from s),
c as (select algorithm, sum(case when y_true = 0 and y_pred = 0 then 1 else 0 end) as tn,
  sum(case when y_true = 0 and y_pred = 1 then 1 else 0 end) as fp, sum(case when y_true = 1 and y_pred = 0 then 1 else 0 end) as fn,
  sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end) as tp from p group by algorithm),
r as (select *, case when tp + fp = 0 then 0.0 else tp / cast(tp + fp as double) end as p1,
  case when tp + fn = 0 then 0.0 else tp / cast(tp + fn as double) end as r1,
  case when tn + fn = 0 then 0.0 else tn / cast(tn + fn as double) end as p0,
  case when tn + fp = 0 then 0.0 else tn / cast(tn + fp as double) end as r0 from c),
f as (select algorithm, (tp + tn) / cast(tn + fp + fn + tp as double) as acc,
  ((case when p0 + r0 = 0 then 0.0 else 2 * p0 * r0 / (p0 + r0) end)
   + (case when p1 + r1 = 0 then 0.0 else 2 * p1 * r1 / (p1 + r1) end)) / 2 as f1m from r),
red as (select 'risk_classification' as task, algorithm, acc > 0.96 as leakage_flag,
  case when acc > 0.96 then null else f1m end as cv_score, case when acc > 0.96 then null else acc end as cv_accuracy from f)
"""


def rule_metrics(t):
    d = t["documents"].select("doc_id", "n_chars").join(t["labels"].select("doc_id", F.col("quality").alias("y_true")), "doc_id")
    p = (d.select(F.lit("n_chars_rule").alias("algorithm"), "y_true", (F.col("n_chars") >= 1000).cast("int").alias("y_pred"))
         .unionByName(d.select(F.lit("label_copy").alias("algorithm"), "y_true", F.col("y_true").alias("y_pred")))
         .unionByName(d.select(F.lit("long_doc_rule").alias("algorithm"), "y_true",
                               (F.col("n_chars") >= 5000).cast("int").alias("y_pred"))))
    m = M.confusion_and_prf(p, by=["algorithm"])
    m = m.select(F.lit("risk_classification").alias("task"), "algorithm", F.col("f1_macro").alias("cv_score"),
                 F.col("accuracy").alias("cv_accuracy"))
    return TR.redact_suspicious(m, "classification")


@query("redact_metrics", sql=PRED_SQL + """
select task, algorithm, leakage_flag, round(cv_score, 6) as cv_score, round(cv_accuracy, 6) as cv_accuracy from red""")
def redact_metrics(t):
    """A perfect (label-copying) predictor trips the accuracy > .96 guard; its numbers are nulled."""
    m = rule_metrics(t)
    return m.select("task", "algorithm", "leakage_flag", r6("cv_score").alias("cv_score"),
                    r6("cv_accuracy").alias("cv_accuracy"))


@query("champion_selection", sql=PRED_SQL + """
select task, arg_max(algorithm, (case when cv_score is null or cv_score = 0 then -1e308 else cv_score end, algorithm))
  as algorithm, round(max(cv_score), 6) as cv_score
from red where not leakage_flag group by task""")
def champion_selection(t):
    """Best unflagged algorithm per task (0.0 / null rank last)."""
    c = TR.select_champion(rule_metrics(t), variant=None)
    return c.select("task", "algorithm", r6("cv_score").alias("cv_score"))


REGISTRY_SQL = PRED_SQL + """,
champ as (select task, arg_max(algorithm, (case when cv_score is null or cv_score = 0 then -1e308 else cv_score end,
  algorithm)) as algorithm from red where not leakage_flag group by task)
"""


def registry(t):
    m = rule_metrics(t)
    reg = m.select("task", "algorithm", F.concat_ws("__", "task", "algorithm").alias("version"),
                   F.to_json(F.struct(F.col("cv_score").alias("f1_macro"), "leakage_flag")).alias("metrics"),
                   F.lit(False).alias("is_active"))
    return reg


@query("activate_champion", sql=REGISTRY_SQL + """
select r.task || '__' || r.algorithm as version, r.algorithm = c.algorithm as is_active
from red r join champ c on r.task = c.task""")
def activate_champion(t):
    """One active version per task after activating the champion."""
    out = TR.activate_champions(registry(t), TR.select_champion(rule_metrics(t), variant=None))
    return out.select("version", "is_active")


@query("comparison_table", sql=REGISTRY_SQL + """
select r.task, r.algorithm, r.task || '__' || r.algorithm as version, 'f1_macro' as metric_name,
  round(r.cv_score, 6) as metric_value, r.leakage_flag, cast(null as double) as cv_std,
  cast(null as double) as train_test_gap, r.algorithm = c.algorithm as is_active
from red r join champ c on r.task = c.task""")
def comparison_table(t):
    """Registry rows as a comparison table (metric read back from the JSON metrics)."""
    ct = TR.comparison_table(TR.activate_champions(registry(t), TR.select_champion(rule_metrics(t), variant=None)))
    return ct.select("task", "algorithm", "version", "metric_name", r6("metric_value").alias("metric_value"),
                     "leakage_flag", "cv_std", "train_test_gap", "is_active")


@query("registry_record")
def registry_record(t):
    """The registry after training all three tasks: a row per version, one active version per task."""
    reg = TK.trained_store(t).registry()
    return reg.select("version", "task", "algorithm", "use_smote", "training_rows", "feature_list", "hyperparameters", "metrics", "is_active")


@query("registry_training_rows", sql="with pf as (" + panel_sql(False) + """),
items as (select count(*) as n from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
  where o.o_orderdate < timestamp '2001-07-01 00:00:00')
select 'risk_classification' as task, (select count(*) from pf) as training_rows, 35 as n_features
union all select 'gpa_regression', (select count(*) from pf), 35 union all select 'course_score', (select n from items), 6""")
def registry_training_rows(t):
    """Rows and features that each task's versions were trained on."""
    reg = TK.trained_store(t).registry()
    return reg.select("task", "training_rows", F.size("feature_list").alias("n_features")).distinct()


def _fairness(t, task):
    rates, flags, _ = TK.fairness_on_holdout(t, task, TK.trained_store(t, task))
    return rates, flags


@query("fairness_holdout_risk")
def fairness_holdout_risk(t):
    """The active risk model refitted on earlier periods, rates per group on the latest one, gaps and flag per attribute."""
    rates, flags = _fairness(t, "risk_classification")
    wide = flags.groupBy("attribute").pivot("metric", list(FA.RATE_METRICS)).agg(F.first("gap"))
    gaps = wide.select("attribute", *[F.col(m).alias(f"{m}_gap") for m in FA.RATE_METRICS]).join(
        flags.groupBy("attribute").agg(F.bool_or("flagged").alias("flagged")), "attribute")
    return rates.select("attribute", "value", "n", *[r6(m).alias(m) for m in FA.RATE_METRICS]).join(gaps, "attribute")


@query("fairness_holdout_gpa")
def fairness_holdout_gpa(t):
    """N5, regression form: errors and mean predictions per group on the latest period, gap and flag per attribute."""
    errors, flags = _fairness(t, "gpa_regression")
    gaps = flags.select("attribute", r6("gap").alias("mean_predicted_gap"), "flagged")
    return errors.select("attribute", "value", "n", *[r6(c).alias(c) for c in ("mae", "mean_predicted", "mean_actual")]).join(gaps, "attribute")


@query("fairness_holdout_groups", sql="with pf as (" + panel_sql(False) + """),
late as (select * from pf where session >= (select max(session) from pf)),
u as (select 'entry_mode' as attribute, entry_mode as value from late union all select 'employment_status', employment_status from late
  union all select 'accommodation', accommodation from late)
select attribute, value, count(*) as n from u where value is not null group by attribute, value""")
def fairness_holdout_groups(t):
    """The rows of the latest period that each group's rates rest on."""
    rates, _ = _fairness(t, "risk_classification")
    return rates.select("attribute", "value", "n")
