"""Upper tail of the chi-square distribution as a DataFrame expression.

With ``a = dof / 2`` and ``x`` half the statistic it is the regularised incomplete gamma function Q(a, x): one minus the power
series below ``a + 1``, and the continued fraction (modified Lentz) from there on. Both take a number of terms that follows
``sqrt(a)``, not the degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
#: Terms of either expansion: ``TERMS + TERMS_A * sqrt(a)``; the last ones are below 1e-16 of the sum.
TERMS, TERMS_A = 60, 12
#: Stirling's series is taken at ``z + SHIFT``.
SHIFT = 8


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0, to about 1e-14 of its size."""
    w = z + SHIFT
    r = F.lit(1.0) / (w * w)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / w
    rising = z
    for k in range(1, SHIFT):
        rising = rising * (z + k)
    return (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(rising)


def _terms(a: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(TERMS) + F.ceil(F.sqrt(a) * TERMS_A)).cast("int"))


def _series(a: Column, x: Column) -> Column:
    """Sum of ``x^n / ((a+1) ... (a+n))`` over n from 0."""
    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.aggregate(_terms(a), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda s: s["sum"])


def _fraction(a: Column, x: Column) -> Column:
    """The continued fraction ``1 / (x+1-a - 1(1-a) / (x+3-a - 2(2-a) / (x+5-a - ...)))``."""
    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        top, bottom = -n * (n - a), x + 2 * n + 1 - a
        return bound(
            F.struct((F.lit(1.0) / safe(top * s["d"] + bottom)).alias("d"), safe(bottom + top / s["c"]).alias("c")),
            lambda y: F.struct(y["c"].alias("c"), y["d"].alias("d"), (s["h"] * y["c"] * y["d"]).alias("h")),
        )

    first = F.lit(1.0) / (x + 1 - a)
    start = F.struct(F.lit(1 / TINY).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(_terms(a), start, step, lambda s: s["h"])


def upper_gamma(a: Column, x: Column) -> Column:
    """Q(a, x) for a > 0 and x > 0."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    q = F.when(x < a + 1, 1 - front / a * _series(a, x)).otherwise(front * _fraction(a, x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def chi2_p_value(statistic: Column, dof: Column) -> Column:
    """P(X > statistic); 1 for a statistic of 0 or without degrees of freedom, null for nulls."""
    half = F.struct((dof.cast("double") / 2).alias("a"), (statistic.cast("double") / 2).alias("x"))
    tail = bound(half, lambda v: F.when((v["a"] <= 0) | (v["x"] <= 0), F.lit(1.0)).otherwise(upper_gamma(v["a"], v["x"])))
    return F.when(statistic.isNotNull() & dof.isNotNull(), tail)
