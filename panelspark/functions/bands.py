"""Banding and period expressions (B1-B5, B8): pure Column -> Column helpers.

Everything compiles to CASE WHEN chains inside whole-stage codegen; no UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.constants import (
    DEGREE_CLASSES, DEGREE_FALLTHROUGH, GRADE_BANDS, PROBATION_THRESHOLD, RISK_TIERS, WARNING_THRESHOLD,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band_floor(value, bands: Sequence[tuple], default=None) -> Column:
    """First band (from the top) whose inclusive lower bound ``value`` reaches.

    ``bands`` is ``[(label, lower_bound), ...]`` ordered from the highest
    bound down.  Null in -> null out.
    """
    v = _col(value)
    expr = None
    for label, lower in bands:
        expr = F.when(v >= F.lit(lower), F.lit(label)) if expr is None else expr.when(v >= F.lit(lower), F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def check_range(value, lo: float, hi: float, message: str) -> Column:
    """Raise a runtime error (strict mode) when a non-null value leaves [lo, hi]."""
    v = _col(value)
    return F.when(v.isNotNull() & ((v < lo) | (v > hi)), F.raise_error(F.lit(message))).otherwise(v)


def grade_letter(score, strict: bool = True) -> Column:
    """Grade letter of a 0-100 score (B1).  Out of range raises when strict, else null."""
    s = _col(score)
    if strict:
        s = check_range(s, 0.0, 100.0, "Assessment scores must be between 0 and 100.")
    else:
        s = F.when((s >= 0) & (s <= 100), s)
    return band_floor(s, [(g, lo) for g, lo, _ in GRADE_BANDS])


def grade_point(score, strict: bool = True) -> Column:
    """Grade point (5..0) of a 0-100 score (B1)."""
    s = _col(score)
    if strict:
        s = check_range(s, 0.0, 100.0, "Assessment scores must be between 0 and 100.")
    else:
        s = F.when((s >= 0) & (s <= 100), s)
    return band_floor(s, [(p, lo) for _, lo, p in GRADE_BANDS]).cast("int")


def risk_tier(probability) -> Column:
    """critical >= .75, high >= .5, moderate >= .25, otherwise low (B2).  Null stays null."""
    p = _col(probability)
    return F.when(p.isNotNull(), band_floor(p, RISK_TIERS, default="low"))


def standing_band(cgpa) -> Column:
    """probation < 2.0 <= warning < 2.5 <= good."""
    c = _col(cgpa)
    return (F.when(c < PROBATION_THRESHOLD, "probation")
            .when(c < WARNING_THRESHOLD, "warning")
            .when(c.isNotNull(), "good"))


def classify_cgpa(cgpa) -> Column:
    """Half-open [lo, hi) degree bands with a fall-through class."""
    c = _col(cgpa)
    expr = None
    for label, lo, hi in DEGREE_CLASSES:
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.when(c.isNotNull(), expr.otherwise(DEGREE_FALLTHROUGH))


def period_key(session, semester) -> Column:
    """Sortable integer period: first four characters of session * 10 + semester."""
    year = F.substring(_col(session).cast("string"), 1, 4).cast("int")
    return year * 10 + _col(semester).cast("int")


def half_year_period(ts) -> tuple[Column, Column]:
    """(session, semester) of a timestamp: calendar year and half (1 = Jan-Jun)."""
    t = _col(ts)
    return F.year(t).cast("int"), F.when(F.month(t) <= 6, F.lit(1)).otherwise(F.lit(2))


def clip(value, lo=None, hi=None) -> Column:
    """Clamp into [lo, hi] keeping nulls null.

    ``least``/``greatest`` skip nulls, so a bare clamp of null would return
    the bound; guard it explicitly.
    """
    v = _col(value)
    out = v
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(v.isNotNull(), out)
