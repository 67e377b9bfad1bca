"""Order-independent sums and stable rounding.

A sum of doubles depends on the order in which tasks finish. Money, price and probability
totals are therefore summed as whole millionths (BIGINT): the result is the same after a
retry, a re-plan or on another cluster, and it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def micro(x: Column) -> Column:
    """Nearest millionth as BIGINT."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5))


def sum_micro(x: Column) -> Column:
    return F.sum(micro(x))


def avg_micro(x: Column) -> Column:
    """Mean of the non-null values, from exact sums."""
    return F.try_divide(F.sum(micro(x)).cast("double"), F.count(x).cast("double") * F.lit(1e6))


def from_micro(x: Column) -> Column:
    return x.cast("double") / F.lit(1e6)


def rnd(x: Column, digits: int) -> Column:
    """Round for display, half up; cheap (no BigDecimal) and equal in any IEEE engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null on a zero or null denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))
