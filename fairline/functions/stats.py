"""Closed-form statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairline.functions.exact import ratio

# 97.5 % normal quantile and the coefficients of the Chebyshev-fitted
# complementary error function (fractional error below 1.2e-7 everywhere).
Z975 = 1.959963984540054
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (neither engine has one built in)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def roi_z(roi: Column, n: Column) -> Column:
    """z of a mean profit with unit standard deviation."""
    return F.when(n > 0, roi * F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))


def win_rate_z(win_rate: Column, expected: Column, n: Column) -> Column:
    var = expected * (F.lit(1.0) - expected) / n
    return F.when(var > 0, (win_rate - expected) / F.sqrt(var))


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval in percent, null without observations."""
    z2 = Z975 * Z975
    nn = n.cast("double")
    p = ratio(wins, n)
    d = F.lit(1.0) + F.lit(z2) / nn
    centre = (p + F.lit(z2) / (F.lit(2.0) * nn)) / d
    half = F.lit(Z975) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(z2) / (F.lit(4.0) * nn)) / nn) / d
    ok = n > 0
    return F.when(ok, (centre - half) * 100.0), F.when(ok, (centre + half) * 100.0)


def shrunk_roi(profit: Column, n: Column, prior_strength: float = 200.0) -> Column:
    return profit / (n.cast("double") + F.lit(prior_strength))


def detectable_roi(sd: Column, n: Column, z: float = 1.96) -> Column:
    return F.when(n > 0, F.lit(z) * sd / F.sqrt(n.cast("double")))
