"""Rounding used for every presented number.

``rnd(x, d)`` rounds half away from zero on the *scaled floating value*
(``x * 10^d``), i.e. the C ``round(x * 10^d) / 10^d`` convention.  Spark's
``round`` instead rounds the exact binary expansion, so a product such as
11.9521875 (stored as 11.95218749999...) rounds differently; using one
convention everywhere keeps results identical across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x, digits: int = 6) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** digits)
    scaled = c.cast("double") * F.lit(scale)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(F.isnan(scaled) | (F.abs(scaled) >= F.lit(4.5e15)), c.cast("double"))
        .otherwise(F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5)) / F.lit(scale)))


def r6(x) -> Column:
    return rnd(x, 6)


TIE_BREAK = 1e-9


def r6t(x) -> Column:
    """``rnd(x + 1e-9, 6)``: for products of short decimals that land exactly on a
    rounding tie, so an ulp of difference in the inputs cannot flip the last digit."""
    c = F.col(x) if isinstance(x, str) else x
    return rnd(c + F.lit(TIE_BREAK), 6)


def half_even(x, digits: int | Column = 0) -> Column:
    """``x`` rounded to ``digits``, ties to the even digit, decided on the exact binary value.

    The product with 10^digits is taken with its rounding error (the number
    is split into two halves whose products are exact), so 4.025, stored a
    little above, goes up although ``round`` and ``bround`` see a tie.  The
    sign of a value that rounds to zero is kept.
    """
    scale = F.lit(float(10 ** digits)) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)

    def step(s: Column) -> Column:
        a, k = s["a"], s["k"]
        high = a * F.lit(134217729.0) - (a * F.lit(134217729.0) - a)
        p = a * k
        error = (high * k - p) + (a - high) * k
        n = F.floor(p).cast("double")
        up = F.when(p - n != 0.5, p - n > 0.5).when(error != 0, error > 0).otherwise(n % 2 != 0)
        value = (n + up.cast("int")) / k * F.when(s["c"] < 0, -1.0).otherwise(1.0)
        return F.when(F.isnan(a) | (p >= 4.5e15), s["c"]).otherwise(value)

    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    # one element: the value is named once, however long the expression is that makes it
    one = F.array(F.struct(c.alias("c"), F.abs(c).alias("a"), scale.cast("double").alias("k")))
    return F.when(c.isNotNull(), F.get(F.transform(one, step), F.lit(0)))
