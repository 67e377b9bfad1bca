"""Balanced representative line: a display choice, never a claim about the bookmaker's main line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.exact import rnd

# Both prices in this range, distance measured to 2.00.
RANGE, TARGET = (1.80, 2.20), 2.0


def balanced(quotes: DataFrame, key: str) -> DataFrame:
    """Per key: the line whose two prices are closest to 2.00 (squared distance, difference, line).

    Latest state per (key, line) by a max aggregate, then a min over the few lines of a key. Conflicting states at
    a line's latest instant disqualify the key.
    """
    pair = F.struct("home_price", "away_price")
    per_time = quotes.groupBy(key, "home_line", "observed_us").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    latest = per_time.groupBy(key, "home_line").agg(F.max(F.struct("observed_us", "lo", "hi")).alias("s"))
    h, a = F.col("s.lo.home_price"), F.col("s.lo.away_price")
    ok = h.between(*RANGE) & a.between(*RANGE)
    score = F.struct(
        rnd((h - TARGET) * (h - TARGET) + (a - TARGET) * (a - TARGET), 12).alias("d"), rnd(F.abs(h - a), 12).alias("diff"),
        F.col("home_line"), h.alias("home_price"), a.alias("away_price"),
    )
    g = latest.groupBy(key).agg(
        F.count("*").alias("evaluated_lines"), F.count_if(ok).alias("eligible_lines"),
        F.count_if(ok & (F.col("s.lo") != F.col("s.hi"))).alias("conflicts"), F.min(F.when(ok, score)).alias("b"),
    )
    reason = F.when(F.col("conflicts") > 0, "CONFLICTING_DUPLICATE_LINE").when(F.col("eligible_lines") == 0, "NO_ELIGIBLE_BALANCED_LINE")
    pick = lambda f: F.when(reason.isNull(), F.col(f"b.{f}")).alias(f)
    return g.select(key, "evaluated_lines", "eligible_lines", reason.alias("reason"), pick("home_line"), pick("home_price"), pick("away_price"))
