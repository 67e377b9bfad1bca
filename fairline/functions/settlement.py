"""Split-stake settlement.

Both half stakes are decided by the sign of a whole number of quarters, so the class never
depends on a float comparison: with d the goal margin and q the line in quarters, the halves
sit at 4d + q -/+ (q odd).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairline.functions.lines import quarters

# Settlement classes, best to worst.
CLASSES = ("FULL_WIN", "HALF_WIN", "PUSH", "HALF_LOSS", "FULL_LOSS")


def half_signs(margin_quarters: Column, q: Column) -> Column:
    """Sum of the signs of the two halves: -2..2."""
    odd = F.abs(q % 2)
    at = margin_quarters + q
    return (F.signum(at - odd) + F.signum(at + odd)).cast("int")


def class_of(signs: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.lit(3) - signs)


def profit_of(signs: Column, odds: Column) -> Column:
    """Profit for one unit: each winning half earns (odds-1)/2, each losing half costs 1/2."""
    return F.when(signs > 0, (odds - 1.0) * signs / 2.0).otherwise(signs / 2.0)


def _settled(signs: Column, odds: Column, ok: Column) -> Column:
    p = profit_of(signs, odds)
    return F.when(
        ok & signs.isNotNull(),
        F.struct(
            class_of(signs).alias("settlement"),
            p.alias("profit_units"),
            (F.lit(1.0) + p).alias("return_units"),
        ),
    )


def handicap_signs(home_goals: Column, away_goals: Column, line: Column, side: Column) -> Column:
    d = F.when(side == "H", home_goals - away_goals).when(side == "A", away_goals - home_goals)
    return half_signs(d * 4, quarters(line))


def total_signs(home_goals: Column, away_goals: Column, line: Column, side: Column) -> Column:
    t = (home_goals + away_goals) * 4
    q = quarters(line)
    over = half_signs(t, -q)
    return F.when(side == "O", over).when(side == "U", -over)


def settle_handicap(home_goals: Column, away_goals: Column, line: Column, odds: Column, side: Column) -> Column:
    """struct(settlement, profit_units, return_units); null for an off-grid line, odds <= 1 or a bad side."""
    side = F.upper(side)
    return _settled(handicap_signs(home_goals, away_goals, line, side), odds, odds > 1.0)


def settle_total(home_goals: Column, away_goals: Column, line: Column, odds: Column, side: Column) -> Column:
    side = F.upper(side)
    return _settled(total_signs(home_goals, away_goals, line, side), odds, odds > 1.0)


def settle_entry(market: Column, home_goals: Column, away_goals: Column, line: Column, odds: Column, side: Column) -> Column:
    """Handicap or total by market name; null for any other market."""
    market, side = F.upper(market), F.upper(side)
    signs = F.when(market == "AH", handicap_signs(home_goals, away_goals, line, side)).when(
        market == "OU", total_signs(home_goals, away_goals, line, side)
    )
    return _settled(signs, odds, odds > 1.0)


def distribution(settlement: Column, prefix: str = "") -> list[Column]:
    """Five class counts as aggregates."""
    return [F.count_if(settlement == c).alias(prefix + c.lower()) for c in CLASSES]


def expected_return(counts: dict[str, Column], odds: Column) -> Column:
    """Mean profit of a class distribution at a price; null without observations or odds <= 1."""
    win = odds - 1.0
    weight = dict(zip(CLASSES, (win, win / 2.0, F.lit(0.0), F.lit(-0.5), F.lit(-1.0))))
    total = reduce(lambda a, b: a + b, [counts[c] * weight[c] for c in CLASSES])
    n = reduce(lambda a, b: a + b, [counts[c] for c in CLASSES])
    return F.when((odds > 1.0) & (n > 0), F.try_divide(total, n.cast("double")))


def minimum_phase_return(phases: list[dict[str, Column]], odds: Column) -> Column:
    """Worst phase; null as soon as one phase is missing."""
    values = [expected_return(p, odds) for p in phases]
    complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(complete, F.least(*values) if len(values) > 1 else values[0])
