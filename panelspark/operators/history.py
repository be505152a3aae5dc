"""Per-entity history windows (E1-E13) and the open-period extension (G1).

All ordered windows are ``partitionBy(entity).orderBy(period)`` over a
table already reduced to the (entity, period) grain, so a partition holds
one row per period of one entity: bounded by the calendar, not by the data
volume, even when one entity owns a third of the raw rows.  Several
features sharing the same partition/order spec are evaluated by a single
Window operator after a single shuffle + sort.

Population statistics (z-scores, peer means, global fallbacks) are never
windows without ``partitionBy``: they are one-row or per-group aggregates
joined back (a one-row side is broadcast; its size is proven by the plan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

U = Window.unboundedPreceding


def _w(entity: str | Sequence[str], period: Sequence[str]):
    ents = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*ents).orderBy(*period)


def lag_features(df: DataFrame, entity: str, period: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Value one period *row* back (E1): ``{out: source}``."""
    w = _w(entity, period)
    return df.withColumns({out: F.lag(src, 1).over(w) for out, src in cols.items()})


def trend_expr(col: str, entity: str, period: Sequence[str]) -> Column:
    """Last minus first of the three prior values; null until three priors exist."""
    w = _w(entity, period)
    return F.lag(col, 1).over(w) - F.lag(col, 3).over(w)


def volatility_expr(col: str, entity: str, period: Sequence[str], span: int = 3, min_count: int = 2) -> Column:
    """Population std of the last <= ``span`` prior values, needing ``min_count`` non-null."""
    w = _w(entity, period).rowsBetween(-span, -1)
    return F.when(F.count(col).over(w) >= min_count, F.stddev_pop(col).over(w))


def expanding_prior_sum_expr(col: str, entity: str, period: Sequence[str]) -> Column:
    """Sum of all strictly earlier values; null on the first period."""
    return F.sum(col).over(_w(entity, period).rowsBetween(U, -1))


def expanding_ratio_expr(num: str, den: str, entity: str, period: Sequence[str]) -> Column:
    """Sum of prior numerators / sum of prior denominators; null on first or zero."""
    w = _w(entity, period).rowsBetween(U, -1)
    d = F.sum(den).over(w).cast("double")
    return F.when(d != 0, F.try_divide(F.sum(num).over(w).cast("double"), d))


def period_index_expr(entity: str, period: Sequence[str]) -> Column:
    """0-based count of earlier rows (E5)."""
    return (F.row_number().over(_w(entity, period)) - 1).cast("long")


def running_weighted_mean(df: DataFrame, entity: str, period: Sequence[str], num: str, den: str,
                          out: str) -> DataFrame:
    """Cumulative sum(num) / cumulative sum(den), current row included."""
    w = _w(entity, period).rowsBetween(U, 0)
    return df.withColumn(out, F.try_divide(F.sum(num).over(w).cast("double"), F.sum(den).over(w).cast("double")))


def history_features(hist: DataFrame, entity: str = "student_id", period: Sequence[str] = ("session", "semester"),
                     gpa: str = "gpa", cgpa: str = "cgpa", earned: str = "credits_earned",
                     registered: str = "credits_registered") -> DataFrame:
    """E1-E5 in one Window pass: prior_cgpa, prior_gpa, gpa_trend, gpa_volatility,
    credits_earned_ratio, semesters_completed."""
    return hist.withColumns({
        "prior_cgpa": F.lag(cgpa, 1).over(_w(entity, period)),
        "prior_gpa": F.lag(gpa, 1).over(_w(entity, period)),
        "gpa_trend": trend_expr(gpa, entity, period),
        "gpa_volatility": volatility_expr(gpa, entity, period),
        "credits_earned_ratio": expanding_ratio_expr(earned, registered, entity, period),
        "semesters_completed": period_index_expr(entity, period),
    })


def prior_difficulty(offerings: DataFrame, course: str = "course_id", period: Sequence[str] = ("session", "semester"),
                     mean_col: str = "mean_score", fallback: Column | None = None,
                     completed: DataFrame | None = None, score: str = "total_score",
                     out: str = "difficulty_index", sum_col: str | None = None,
                     count_col: str | None = None, materialize: bool = True) -> DataFrame:
    """1 - (unweighted mean of strictly prior offering means)/100; first offering -> global fallback.

    ``offerings`` is D2's table (one row per course offering with a
    completed score).  The fallback is ``1 - mean(all completed scores)/100``,
    a one-row aggregate attached by broadcast.
    """
    if fallback is None and sum_col is not None and materialize:
        # offerings feed both the prior-offering window and the global fallback: write the
        # (courses x periods) table once so the fact scan behind it is not repeated
        from panelspark.session import cut_lineage
        offerings = cut_lineage(offerings, "offerings")
    w = Window.partitionBy(course).orderBy(*period).rowsBetween(U, -1)
    prior = F.avg(mean_col).over(w)
    x = offerings.withColumn("_prior", prior)
    if fallback is None and sum_col is not None:
        # global mean of all completed scores = sum of offering sums / sum of offering counts
        one = offerings.agg((1 - (F.sum(sum_col) / F.sum(count_col)) / 100).alias("_fallback"))
        x = x.crossJoin(F.broadcast(one))
        fb = F.col("_fallback")
    elif fallback is None:
        one = completed.agg((1 - F.avg(score) / 100).alias("_fallback"))
        x = x.crossJoin(F.broadcast(one))
        fb = F.col("_fallback")
    else:
        fb = fallback
    return x.select(course, *period, F.coalesce(1 - F.col("_prior") / 100, fb).alias(out))


def peer_deviation(df: DataFrame, value: str, peers: Sequence[str], out: str) -> DataFrame:
    """value - mean(value) over peers sharing ``peers`` keys; null peer keys excluded.

    groupBy + join instead of an unordered window: the peer mean is
    pre-aggregated map-side, so a peer group holding a third of the rows
    never lands in one task; the join back is AQE-managed (broadcast when
    the measured peer table is small, skew-split otherwise).
    """
    valid = F.lit(True)
    for p in peers:
        valid = valid & F.col(p).isNotNull()
    means = df.filter(valid).groupBy(*peers).agg(F.avg(value).alias("_peer_mean"))
    return (df.join(means, list(peers), "left")
            .withColumn(out, F.col(value) - F.col("_peer_mean")).drop("_peer_mean"))


def zscore(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Population z-score over the whole table (E10): ``{out: source}``.

    When the std is 0 or null every row gets 0.0 (nulls too); otherwise
    null stays null.  Mean/std come from one one-row aggregate, broadcast.
    """
    stats = df.agg(*[F.avg(src).alias(f"_m_{out}") for out, src in cols.items()],
                   *[F.stddev_pop(src).alias(f"_s_{out}") for out, src in cols.items()])
    x = df.crossJoin(F.broadcast(stats))
    outs = {}
    for out, src in cols.items():
        m, s = F.col(f"_m_{out}"), F.col(f"_s_{out}")
        outs[out] = F.when(s.isNull() | (s == 0), F.lit(0.0)).otherwise((F.col(src) - m) / s)
    x = x.withColumns(outs)
    return x.drop(*[f"_m_{o}" for o in cols], *[f"_s_{o}" for o in cols])


def latest_per_entity(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The last row per entity by ``order`` (E11) as a hash aggregate with ``max_by``."""
    others = [c for c in df.columns if c != entity]
    packed = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(entity).agg(packed).select(entity, "_row.*")


def keep_first(df: DataFrame, key: Sequence[str], line: str) -> tuple[DataFrame, DataFrame]:
    """First occurrence by file line wins (E12); returns (kept, duplicates).

    ``line`` must be an explicit line-number column captured at read time.
    The kept rows come from one aggregate (``min_by``, combined before the
    shuffle, so a key repeated on a third of the lines is no hot group); the
    duplicates are the rows of other lines.  Null keys are equal.
    """
    others = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(line)).alias("_first")).select(*key, "_first.*").select(*df.columns)
    firsts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(line).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    dups = df.join(firsts, same & (F.col(line) != F.col("_first"))).select(*df.columns)
    return kept, dups


def rank_by_abs(long_df: DataFrame, row_id: Sequence[str], feature: str = "feature", value: str = "shap_value",
                out: str = "rank") -> DataFrame:
    """Rank 1..n by |value| desc (feature name breaks ties) within each row id.

    A row id's partition holds its features only (bounded by the feature count).
    """
    w = Window.partitionBy(*row_id).orderBy(F.desc(F.abs(F.col(value))), F.col(feature))
    return long_df.withColumn(out, F.row_number().over(w))


def extend_with_open_period(hist: DataFrame, open_keys: DataFrame, measures: Sequence[str]) -> DataFrame:
    """History U distinct open (entity, period) rows with null measures (G1).

    Applied *before* the lag windows, so training and inference rows share
    one code path: an open row's lags resolve to its latest closed period.
    """
    key_cols = open_keys.columns
    types = dict(hist.dtypes)
    opened = open_keys.dropDuplicates().select(*key_cols, *[F.lit(None).cast(types[m]).alias(m) for m in measures])
    return hist.select(*key_cols, *measures).unionByName(opened)
