import random

from pyspark.sql import functions as F

from panelspark.operators import fairness as FA
from panelspark.operators import metrics as M


def test_group_rates_vector(spark):
    y, p, g = [1, 1, 0, 0, 1, 0], [1, 0, 0, 0, 1, 1], ["a", "a", "a", "b", "b", "b"]
    df = spark.createDataFrame(list(zip(y, p, g)), "y_true int, y_pred int, grp string")
    out = {r.grp: r for r in FA.group_rates(df, "grp").collect()}
    assert out["a"].n == 3 and out["a"].tpr == 0.5 and out["b"].fpr == 0.5


def test_group_rates_drop_null_group_and_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0, "a"), (1, 1, None)], "y_true int, y_pred int, grp string")
    out = FA.group_rates(df, "grp").collect()
    assert len(out) == 1 and out[0].tpr is None and out[0].precision is None


def test_group_errors_vector(spark):
    df = spark.createDataFrame([(4.0, 5.0, "x"), (2.0, 2.0, "y")], "y_true double, y_pred double, grp string")
    out = {r.grp: r for r in FA.group_errors(df, "grp", scale=5.0).collect()}
    assert out["x"].mae == 1.0 and out["x"].mean_predicted == 1.0 and out["y"].mae == 0.0


def test_gaps_and_strict_flags(spark):
    rates = spark.createDataFrame([("a", 0.8), ("b", None), ("c", 0.6)], "g string, accuracy double")
    gap = FA.parity_gaps(rates, ["accuracy"]).first().gap
    assert abs(gap - 0.2) < 1e-12
    one = spark.createDataFrame([("a", 0.8)], "g string, accuracy double")
    assert FA.parity_gaps(one, ["accuracy"]).first().gap is None
    gaps = spark.createDataFrame([("tpr", 0.11), ("precision", 0.10), ("positive_rate", None), ("accuracy", 0.5)], "metric string, gap double")
    fl = {r.metric: r.flagged for r in FA.flag_disparity(gaps).collect()}
    assert fl == {"tpr": True, "precision": False, "positive_rate": False, "accuracy": False}


def _brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, tp, fp = 0.0, 0, 0
    for th in order:
        dp = sum(1 for yi, si in zip(y, s) if si == th and yi == 1)
        dn = sum(1 for yi, si in zip(y, s) if si == th and yi == 0)
        tp, fp = tp + dp, fp + dn
        ap += (dp / P) * (tp / (tp + fp))
    return ap


def test_auc_and_ap_against_brute_force_with_ties(spark):
    rng = random.Random(11)
    y = [rng.randint(0, 1) for _ in range(400)]
    s = [round(rng.random(), 1) for _ in range(400)]  # many ties
    df = spark.createDataFrame(list(zip(y, s)), "y_true int, y_score double")
    auc = M.roc_auc(df).first().roc_auc
    ap = M.average_precision(df).first().average_precision
    assert abs(auc - _brute_auc(y, s)) < 1e-12 and abs(ap - _brute_ap(y, s)) < 1e-12
    curve = M.roc_curve(df).collect()
    assert len(curve) == len(set(s)) + 1 and max(r.tpr for r in curve) == 1.0


def test_confusion_macro_and_calibration(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.6), (0, 0, 0.2), (1, 0, 0.4)], "y_true int, y_pred int, y_score double")
    m = M.confusion_and_prf(df).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 1, 1) and m.accuracy == 0.5 and m.f1_macro == 0.5
    cal = M.calibration_curve(df, n_bins=2).orderBy("bin").collect()
    assert [r.n for r in cal] == [2, 2]


def test_regression_metrics_and_mape_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "y_true double, y_pred double")
    r = M.regression_metrics(df).first()
    assert r.mae == 1.0 and r.mape is None
    df2 = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "y_true double, y_pred double")
    assert M.regression_metrics(df2).first().r2 == 1.0


def test_fairness_report_one_aggregation(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (0, 1, "b", "x"), (1, 0, "a", "y")],
                               "y_true int, y_pred int, g1 string, g2 string")
    rates, flags = FA.fairness_report(df, ["g1", "g2"])
    assert rates.select("attribute").distinct().count() == 2
    assert flags.filter(F.col("metric") == "accuracy").count() == 2
