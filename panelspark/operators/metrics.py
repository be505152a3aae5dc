"""Evaluation metrics as aggregates over a (y_true, y_pred, y_score) DataFrame (M1-M7).

Nothing is collected: confusion cells are one aggregate; ROC / PR / AUC are
built from per-distinct-score counts and bucketed prefix sums
(``stats.ordered_cumsum``), never a single-partition window; calibration
bins use exact distributed quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.select import seeded_sample_n
from panelspark.operators.stats import exact_quantiles, ordered_cumsum


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0/0 -> 0 (sklearn zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion_cells(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    yt, yp = F.col(y).cast("int"), F.col(pred).cast("int")
    aggs = [F.count_if((yt == 0) & (yp == 0)).alias("tn"), F.count_if((yt == 0) & (yp == 1)).alias("fp"),
            F.count_if((yt == 1) & (yp == 0)).alias("fn"), F.count_if((yt == 1) & (yp == 1)).alias("tp")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion_and_prf(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by=()) -> DataFrame:
    """2x2 matrix, accuracy, macro P/R/F1 and weighted F1 in one row (per ``by`` group) (M1)."""
    c = confusion_cells(df, y, pred, by)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f1 = F.when((p1 + r1) == 0, 0.0).otherwise(2 * p1 * r1 / (p1 + r1))
    f0 = F.when((p0 + r0) == 0, 0.0).otherwise(2 * p0 * r0 / (p0 + r0))
    return c.select(*by, "tn", "fp", "fn", "tp",
                    _div0(tp + tn, n).alias("accuracy"),
                    ((p0 + p1) / 2).alias("precision_macro"),
                    ((r0 + r1) / 2).alias("recall_macro"),
                    ((f0 + f1) / 2).alias("f1_macro"),
                    _div0(f0 * (tn + fp) + f1 * (tp + fn), n).alias("f1_weighted"))


def per_class_report(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Per-class precision / recall / F1 / support (M1)."""
    c = confusion_cells(df, y, pred)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    rows = []
    for cls, (t, falsep, falsen) in ((0, (tn, fn, fp)), (1, (tp, fp, fn))):
        p, r = _div0(t, t + falsep), _div0(t, t + falsen)
        rows.append(c.select(F.lit(cls).alias("label"), p.alias("precision"), r.alias("recall"),
                             F.when((p + r) == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"),
                             (t + falsen).alias("support")))
    return rows[0].unionByName(rows[1])


def score_counts(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Positives / negatives per distinct score, cumulated from the highest score down."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    return ordered_cumsum(g, "threshold", ["pos", "neg"], descending=True)


def roc_curve(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score plus the (0, 0) origin (M2)."""
    c = score_counts(df, y, score)
    tot = c.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = c.crossJoin(F.broadcast(tot)).select(
        "threshold", _div0(F.col("neg_cum"), F.col("_N")).alias("fpr"), _div0(F.col("pos_cum"), F.col("_P")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def roc_sample(curve: DataFrame, max_points: int = 300, seed: int = 42) -> DataFrame:
    """At most ``max_points`` curve points, a seeded sample (chart payload)."""
    return seeded_sample_n(curve.withColumn("_k", F.coalesce(F.col("threshold"), F.lit(float("inf")))),
                           max_points, "_k", seed).drop("_k")


def roc_auc(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Area under ROC by trapezoids over distinct scores (tie-corrected Mann-Whitney) (M3)."""
    c = score_counts(df, y, score)
    prev_p, prev_n = F.col("pos_cum") - F.col("pos"), F.col("neg_cum") - F.col("neg")
    area = F.col("neg") * (F.col("pos_cum") + prev_p) / 2.0
    return c.agg(F.try_divide(F.sum(area), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Step-wise AP = sum over thresholds of (recall gain) x precision (M4)."""
    c = score_counts(df, y, score)
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    return c.agg(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos").cast("double")).alias("average_precision"))


def calibration_curve(df: DataFrame, y: str = "y_true", score: str = "y_score", n_bins: int = 10) -> DataFrame:
    """Quantile-binned reliability curve: bin, mean score, positive rate; empty bins dropped (M5).

    Inner bin edges are exact linear-interpolated quantiles; a score falls
    in bin = number of inner edges strictly below it.
    """
    qs = [i / n_bins for i in range(1, n_bins)]
    names = [f"e{i}" for i in range(1, n_bins)]
    edges = exact_quantiles(df, score, qs, names=names)
    x = df.crossJoin(F.broadcast(edges))
    b = sum((F.col(n) < F.col(score)).cast("int") for n in names)
    return (x.withColumn("bin", b).groupBy("bin")
            .agg(F.avg(score).alias("prob_pred"), F.avg(F.col(y).cast("double")).alias("prob_true"),
                 F.count(F.lit(1)).alias("n")))


def regression_metrics(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """MAE, RMSE, R2, MAPE over y != 0 (null if none) in one aggregate (M6)."""
    e = F.col(y) - F.col(pred)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                  (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
                  F.avg(F.when(F.col(y) != 0, F.abs(e) / F.abs(F.col(y)))).alias("mape"))


def residual_sample(df: DataFrame, key, y: str = "y_true", pred: str = "y_pred", n: int = 300,
                    seed: int = 42) -> DataFrame:
    """At most n seeded (y, residual, prediction) points (M7)."""
    s = seeded_sample_n(df, n, key, seed)
    return s.select(F.col(y).alias("y_true"), (F.col(y) - F.col(pred)).alias("residual"), F.col(pred).alias("y_pred"))
