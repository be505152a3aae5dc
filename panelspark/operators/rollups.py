"""Aggregations (D1-D17).  All are single ``groupBy().agg()`` passes with
partial (map-side) aggregation, so a hot key is pre-combined before the
shuffle; joins back to facts use AQE (broadcast when measured small, skew
split otherwise)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import rnd

from panelspark.functions.bands import classify_cgpa
from panelspark.functions.constants import CA_WEIGHT, LEVELS, TIER_ORDER
from panelspark.operators.stats import correlation_long, safe_corr


def mode_over_domain(col: str, domain: Sequence) -> object:
    """Most frequent value of ``col`` among a fixed domain, smallest on ties, null if none.

    Plain conditional counts (declarative, codegen) instead of the object
    aggregate behind ``F.mode``; used when the value domain is a fixed rule
    (e.g. the institution's levels).
    """
    cands = [F.struct(F.sum(F.when(F.col(col) == v, 1).otherwise(0)).alias("n"), F.lit(-i).alias("o"),
                      F.lit(v).alias("v")) for i, v in enumerate(sorted(domain))]
    best = F.greatest(*cands)
    return F.when(best["n"] > 0, best["v"])


def term_rollup(enr: DataFrame, key: Sequence[str], ca: str = "ca_score", att: str = "attendance_rate",
                units: str = "units", core: str = "is_core", level: str = "level",
                difficulty: str = "difficulty_index", with_level: bool = True, with_difficulty: bool = True,
                with_attendance_std: bool = True, level_domain: Sequence | None = LEVELS) -> DataFrame:
    """Per (entity, period) CA / attendance / load rollup (D1); modal level smallest on ties."""
    aggs = [F.avg(ca).alias("ca_average"),
            F.stddev_samp(ca).alias("ca_std_dev_across_courses"),
            F.min(ca).alias("lowest_ca_score"),
            F.sum(F.when(F.col(ca) < CA_WEIGHT / 2, 1).otherwise(0)).cast("long").alias("courses_below_ca_threshold"),
            F.avg(att).alias("mean_attendance_rate"),
            F.min(att).alias("min_attendance_rate")]
    if with_attendance_std:
        aggs.append(F.stddev_samp(att).alias("attendance_std_dev"))
    aggs += [F.sum(F.when(F.col(att) < 0.75, 1).otherwise(0)).cast("long").alias("courses_below_75_percent"),
             F.sum(units).cast("long").alias("credit_load"),
             F.avg(F.col(core).cast("double")).alias("core_course_ratio")]
    if with_difficulty:
        aggs.append(F.avg(difficulty).alias("mean_course_difficulty_index"))
    if with_level:
        aggs.append((mode_over_domain(level, level_domain) if level_domain else F.mode(level, True)).alias("level"))
    out = enr.groupBy(*key).agg(*aggs)
    return out.withColumn("ca_to_max_ratio", F.col("ca_average") / CA_WEIGHT)


def term_points(graded: DataFrame, key: Sequence[str], points: str = "grade_point", units: str = "units",
                grade: str = "grade") -> DataFrame:
    """Per (entity, period): points*units, registered and earned units (D4/D5 inputs)."""
    return graded.groupBy(*key).agg(
        F.sum(F.col(points) * F.col(units)).cast("long").alias("pts"),
        F.sum(units).cast("long").alias("credits_registered"),
        F.sum(F.when(F.col(grade) != "F", F.col(units)).otherwise(0)).cast("long").alias("credits_earned"))


def term_gpa(graded: DataFrame, key: Sequence[str], points: str = "grade_point", units: str = "units",
             out: str = "gpa") -> DataFrame:
    """Credit-weighted mean of grade points per (entity, period)."""
    return graded.groupBy(*key).agg(
        F.try_divide(F.sum(F.col(points) * F.col(units)).cast("double"), F.sum(units).cast("double")).alias(out))


def credits_earned(registered: DataFrame, graded: DataFrame, key: Sequence[str], units: str = "units",
                   grade: str = "grade", registered_col: str = "credits_registered") -> DataFrame:
    """Units with a passing grade, left-joined back; default = registered."""
    earned = graded.groupBy(*key).agg(
        F.sum(F.when(F.col(grade) != "F", F.col(units)).otherwise(0)).cast("long").alias("_earned"))
    return (registered.join(earned, list(key), "left")
            .withColumn("credits_earned", F.coalesce("_earned", F.col(registered_col).cast("long")))
            .drop("_earned"))


def offering_means(enr: DataFrame, course: str = "course_id", period: Sequence[str] = ("session", "semester"),
                   score: str = "total_score", status: str = "status", out: str = "mean_score") -> DataFrame:
    """Mean score per (course, period) over completed rows with a score."""
    done = enr.filter((F.col(status) == "completed") & F.col(score).isNotNull())
    return done.groupBy(course, *period).agg(F.avg(score).alias(out))


def flag_counts(df: DataFrame, key: Sequence[str], flag: str, out: str) -> DataFrame:
    """Number of true flags per key (D3)."""
    return df.groupBy(*key).agg(F.sum(F.col(flag).cast("int")).cast("long").alias(out))


def session_trends(hist: DataFrame, session: str = "session", entity: str = "student_id",
                   gpa: str = "gpa", cgpa: str = "cgpa", digits: int = 3) -> DataFrame:
    """Per session: mean GPA, mean CGPA, distinct entities."""
    return (hist.groupBy(session)
            .agg(rnd(F.avg(gpa), digits).alias("average_gpa"),
                 rnd(F.avg(cgpa), digits).alias("average_cgpa"),
                 F.countDistinct(entity).alias("n_students"))
            .orderBy(session))


def course_difficulty(enr: DataFrame, courses: DataFrame, course: str = "course_id", score: str = "total_score",
                      grade: str = "grade", status: str = "status") -> DataFrame:
    """Per course: completions, mean score (2 dp), failure rate (3 dp); inner join to courses.

    A null grade counts as a pass (it is not 'F').
    """
    done = enr.filter((F.col(status) == "completed") & F.col(score).isNotNull())
    agg = done.groupBy(course).agg(
        F.count(F.lit(1)).alias("n_completed"),
        rnd(F.avg(score), 2).alias("average_score"),
        rnd(F.avg(F.when(F.col(grade) == "F", 1.0).otherwise(0.0)), 3).alias("failure_rate"))
    return agg.join(courses, course).orderBy(F.desc("failure_rate"), course)


def domain_counts(df: DataFrame, col: str, domain: Sequence[str], out: str = "n") -> DataFrame:
    """Value counts zero-filled over a fixed domain, with share of total."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(v,) for v in domain], [col])
    counts = df.filter(F.col(col).isin(list(domain))).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (dom.join(counts, col, "left").crossJoin(F.broadcast(total))
            .select(col, F.coalesce("_n", F.lit(0)).cast("long").alias(out),
                    F.try_divide(F.coalesce("_n", F.lit(0)).cast("double"), F.col("_total").cast("double")).alias("share")))


def latest_value(df: DataFrame, entity: str, order: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Value at the latest period per entity via ``max_by`` (hash aggregate, no sort)."""
    return df.groupBy(entity).agg(F.max_by(value, F.struct(*order)).alias(out or value))


def class_distribution(hist: DataFrame, entity: str = "student_id", order: Sequence[str] = ("session", "semester"),
                       cgpa: str = "cgpa") -> DataFrame:
    """Share of entities per degree class of their latest CGPA."""
    latest = latest_value(hist, entity, order, cgpa)
    banded = latest.select(classify_cgpa(cgpa).alias("degree_class"))
    total = banded.agg(F.count(F.lit(1)).alias("_total"))
    return (banded.groupBy("degree_class").agg(F.count(F.lit(1)).alias("n"))
            .crossJoin(F.broadcast(total))
            .select("degree_class", "n", (F.col("n") / F.col("_total")).alias("share")))


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Pearson over columns, pairwise-complete, rounded, undefined -> 0."""
    return correlation_long(df, columns, digits)


def calibration_correlations(pairs: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Named correlations, each with its own null drops (D12); those of one frame come from one pass over it."""
    frames: dict[int, tuple[DataFrame, list]] = {}
    for name, (frame, a, b) in pairs.items():
        frames.setdefault(id(frame), (frame, []))[1].append((name, a, b))
    out = None
    for frame, wanted in frames.values():
        one = frame.agg(*[safe_corr(a, b).alias(name) for name, a, b in wanted]).unpivot([], [n for n, _, _ in wanted], "metric", "r")
        out = one if out is None else out.unionByName(one)
    return out


def missingness_profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Null percentage per column in one pass, unpivoted to ``(column, missing_pct)``."""
    cols = list(columns) if columns else df.columns
    one = df.agg(*[rnd(F.avg(F.col(c).isNull().cast("double")) * 100, digits).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "missing_pct")


def distinct_periods(enr: DataFrame, key: Sequence[str], status: str = "status", value: str = "ongoing") -> DataFrame:
    """Distinct (entity, period) of rows with the given status."""
    return enr.filter(F.col(status) == value).select(*key).dropDuplicates()


def overview_kpis(entities: DataFrame, scored: DataFrame, hist: DataFrame, entity: str = "student_id",
                  order: Sequence[str] = ("session", "semester"), tier: str = "risk_tier",
                  active: str | None = None, interventions: DataFrame | None = None) -> DataFrame:
    """One row of headline numbers built from independent one-row aggregates."""
    ent = entities.agg(F.count(F.lit(1)).alias("total_students"),
                       (F.count_if(F.col(active)) if active else F.count(F.lit(1))).alias("active_students"))
    tiers = scored.agg(*[F.count_if(F.col(tier) == t).alias(f"at_risk_{t}") for t in reversed(TIER_ORDER)])
    latest = latest_value(hist, entity, order, "cgpa")
    cg = latest.agg(rnd(F.coalesce(F.avg("cgpa"), F.lit(0.0)), 3).alias("average_cgpa"))
    out = ent.crossJoin(tiers).crossJoin(cg)
    if interventions is not None:
        out = out.crossJoin(interventions.agg(
            F.count_if(F.col("status").isin("planned", "in_progress")).alias("total_interventions_open")))
    return out


def tier_groups(register: DataFrame, tier: str = "risk_tier", entity: str = "student_id",
                score: str = "probability") -> DataFrame:
    """Register grouped by tier in urgency order (D17), in flattened form.

    The nested per-tier list of the dashboard would put a whole tier (which
    may hold a third of all rows) into one value; instead every member row
    carries its tier's urgency order and size, and the result is globally
    sorted (range-partitioned sort) by tier, score desc, entity.  The tier
    sizes form a table bounded by the fixed tier domain, so broadcasting it
    is safe.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col(tier)).cast("int")
    sizes = register.groupBy(tier).agg(F.count(F.lit(1)).alias("tier_size"))
    return (register.join(F.broadcast(sizes), tier)
            .select(tier, order.alias("tier_order"), "tier_size", entity, score)
            .orderBy("tier_order", F.desc(score), entity))
