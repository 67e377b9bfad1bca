"""Prices and margin removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported price ranges (decimal odds).
RESEARCH_RANGE = (1.50, 2.50)
TRADABLE_RANGE = (1.80, 2.20)


def number(c: Column) -> Column:
    """Finite double or null; accepts text."""
    x = F.expr("cast(null as double)") if c is None else c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def price(c: Column) -> Column:
    """Decimal price: finite and above 1, otherwise null."""
    x = number(c)
    return F.when(x > 1.0, x)


def score(c: Column) -> Column:
    """Goals: whole and not negative, otherwise null (expects an integral column)."""
    return F.when(c >= 0, c)


def first_number(*cols: Column) -> Column:
    return F.coalesce(*[number(c) for c in cols])


def first_complete(candidates: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]) -> Column:
    """First candidate whose prices are all valid, as struct(names..., source)."""
    options = []
    for label, cols in candidates:
        vals = [price(c) for c in cols]
        ok = vals[0].isNotNull()
        for v in vals[1:]:
            ok = ok & v.isNotNull()
        options.append(
            F.when(ok, F.struct(*[v.alias(n) for v, n in zip(vals, names)], F.lit(label).alias("source")))
        )
    return F.coalesce(*options)


def inverse(p: Column) -> Column:
    return F.lit(1.0) / p


def devig3(home: Column, draw: Column, away: Column) -> Column:
    """Proportional three-way margin removal: struct(home, draw, away, overround)."""
    ih, id_, ia = inverse(home), inverse(draw), inverse(away)
    total = ih + id_ + ia
    ok = (home > 1.0) & (draw > 1.0) & (away > 1.0)
    return F.when(
        ok,
        F.struct(
            (ih / total).alias("home"),
            (id_ / total).alias("draw"),
            (ia / total).alias("away"),
            (total - 1.0).alias("overround"),
        ),
    )


def devig2(a: Column, b: Column) -> Column:
    """Proportional two-way margin removal: struct(a, b, overround); null unless both exceed 1."""
    ia, ib = inverse(a), inverse(b)
    total = ia + ib
    return F.when(
        (a > 1.0) & (b > 1.0),
        F.struct((ia / total).alias("a"), (ib / total).alias("b"), (total - 1.0).alias("overround")),
    )


def favorite_by_probability(fair_home: Column, fair_away: Column) -> Column:
    """History paths: a tie belongs to the home side."""
    return F.when(fair_home >= fair_away, F.lit("H")).when(fair_home < fair_away, F.lit("A"))


def favorite_by_price(home: Column, away: Column) -> Column:
    """Screening path: a tie belongs to the away side."""
    return F.when(home < away, F.lit("H")).when(home >= away, F.lit("A"))


def side_view(side: Column, home: Column, away: Column) -> Column:
    return F.when(side == "H", home).when(side == "A", away)


def from_hong_kong(c: Column) -> Column:
    x = number(c)
    return F.when(x >= 0, F.round(x + 1.0, 6))


def from_american_or_decimal(c: Column) -> Column:
    x = number(c)
    return (
        F.when(x >= 10, F.lit(1.0) + x / 100.0)
        .when(x <= -10, F.lit(1.0) + F.lit(100.0) / F.abs(x))
        .when(x > 1, x)
    )


def within(c: Column, bounds: tuple[float, float]) -> Column:
    return c.between(F.lit(bounds[0]), F.lit(bounds[1]))


def research_price(c: Column) -> Column:
    return within(c, RESEARCH_RANGE)


def tradable_price(c: Column) -> Column:
    return within(c, TRADABLE_RANGE)


def in_band(x: Column, lo: Column, hi: Column) -> Column:
    """Half-open band; a missing band accepts everything."""
    return lo.isNull() | ((x >= lo) & (x < hi))
