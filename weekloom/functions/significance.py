"""p-values of correlation coefficients, as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 300
_SHIFT = 8


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of r under no correlation: a beta tail with n - 2 degrees of freedom."""
    r, n = r.cast("double"), n.cast("double")
    rest = F.greatest(1.0 - r * r, F.lit(0.0))
    tail = _beta_tail((n - 2.0) / 2.0, F.lit(0.5), rest)
    return (
        F.when(r.isNull() | (n < 3), F.lit(None).cast("double"))
        .when(rest == 0.0, 0.0)
        .otherwise(tail)
    )


def _beta_tail(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, from the side where its fraction converges fast."""
    direct = _beta_fraction(a, b, x)
    mirrored = 1.0 - _beta_fraction(b, a, 1.0 - x)
    return (
        F.when(x <= 0.0, 0.0).when(x >= 1.0, 1.0)
        .when(x <= (a + 1.0) / (a + b + 2.0), direct).otherwise(mirrored)
    )


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction evaluated from its far end, times the leading factor."""
    def term(below: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + m * 2.0 - 1.0) * (a + m * 2.0))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2.0) * (a + m * 2.0 + 1.0))
        return F.lit(1.0) + even / (F.lit(1.0) + odd / below)

    inner = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), term)
    first = F.lit(1.0) - (a + b) * x / (a + 1.0) / inner
    log_factor = (_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
                  + a * F.log(x) + b * F.log1p(-x))
    return F.exp(log_factor) / a / first


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted to arguments where it is exact to about 1e-13."""
    z = x + float(_SHIFT)
    series = 1.0 / (z * 12.0) - 1.0 / (z * z * z * 360.0) + 1.0 / (z * z * z * z * z * 1260.0)
    shifted = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2.0 * math.pi) + series
    for i in range(_SHIFT):
        shifted = shifted - F.log(x + float(i))
    return shifted

