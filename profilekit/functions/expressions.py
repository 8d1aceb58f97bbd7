"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: float | None) -> Column:
    """Double literal, null for None. NaN counts as missing before statistics are taken, so one that is not finite is an error."""
    if value is None:
        return F.lit(None).cast("double")
    if not math.isfinite(value):
        raise ValueError("a statistic is not finite: the column holds an infinity")
    return F.lit(float(value))


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Clip that keeps nulls; ``least``/``greatest`` alone would turn a null into a bound."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, literal(low)), literal(high)))


def hash_share(seed: object, *parts: Column) -> Column:
    """Uniform value in [0, 1) that depends only on the seed and the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *parts), 11) / F.lit(float(1 << 53))


def md5_number(text: Column, start: int) -> Column:
    """Unsigned 32-bit number read from eight hex digits of an md5 text, ``start`` counted from 1."""
    return F.conv(F.substring(text, start, 8), 16, 10).cast("long")


def gaussian(x: Column, mean: Column, std: Column) -> Column:
    z = F.try_divide(x - mean, std)
    return F.try_divide(F.exp(-0.5 * z * z), std * math.sqrt(2 * math.pi))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson transform (Yeo and Johnson, Biometrika 2000) for a literal or per-row lambda."""
    return yeo_johnson_of_log(x >= 0, F.log1p(F.abs(x)), lam)


def yeo_johnson_of_log(positive: Column, log_size: Column, lam: Column) -> Column:
    """The transform from the sign of x and ``ln(1 + |x|)``, so one exponential serves each lambda.

    Both branches are ``(e^(k g) - 1) / k``, with k = lambda above zero and
    k = 2 - lambda, mirrored, below; k = 0 is the logarithm itself.
    """
    k = F.when(positive, lam).otherwise(2.0 - lam)
    size = F.when(k == 0, log_size).otherwise(F.try_divide(F.expm1(k * log_size), k))
    return F.when(positive, size).otherwise(-size)
