"""Market-state statistics of settled fixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions import bands, settlement, stats
from fairline.functions.exact import from_micro, micro, ratio, rnd
from fairline.functions.lines import line_text
from fairline.operators import filters
from fairline.operators.results import settled_results


def latest_valid(snaps: DataFrame) -> DataFrame:
    """Latest valid pre-match snapshot per fixture; ties by provider, then source id (one partial aggregate)."""
    keyed = snaps.withColumn("_k", filters.prematch_order()).filter(F.col("_k").isNotNull())
    cols = [c for c in snaps.columns if c != "fixture_id"]
    row = F.struct(*cols)
    first = F.struct(F.col("line").alias("first_line"), F.col("price").alias("first_price"))
    return (
        keyed.groupBy("fixture_id")
        .agg(F.count("*").alias("scan_count"), F.max_by(row, "_k").alias("r"), F.min_by(first, "_k").alias("f"))
        .select("fixture_id", "scan_count", "f.first_line", "f.first_price", "r.*")
    )


def outcomes(snaps: DataFrame, results: DataFrame) -> DataFrame:
    """One settled row per fixture with a unique verified score: handicap both sides, totals, labels."""
    last = latest_valid(snaps)
    j = last.join(settled_results(results), "fixture_id")
    hg, ag = F.col("ft_home_goals"), F.col("ft_away_goals")
    fav = F.col("favorite_side")
    dog = F.when(fav == "H", "A").otherwise("H")
    dog_price = F.when(fav == "H", F.col("away_price")).otherwise(F.col("home_price"))
    quote = filters.total_quote_status()
    has_ou = quote.isin("VERIFIED_MAINLINE", "PAIRED_QUOTE_MAINLINE_UNVERIFIED")
    j = (
        j.withColumn("fs", settlement.settle_handicap(hg, ag, F.col("line"), F.col("price"), fav))
        .withColumn("ds", settlement.settle_handicap(hg, ag, -F.col("line"), dog_price, dog))
        .withColumn("os", F.when(has_ou, settlement.settle_total(hg, ag, F.col("ou_line"), F.col("over_price"), F.lit("O"))))
        .withColumn("us", F.when(has_ou, settlement.settle_total(hg, ag, F.col("ou_line"), F.col("under_price"), F.lit("U"))))
    )
    exact = filters.exact_total_status()
    priced = exact == "VERIFIED_EXACT_2_5_PREMATCH"
    return j.select(
        "fixture_id", "league", "provider", "kickoff_us", "scan_count", "ft_home_goals", "ft_away_goals", "favorite_side",
        F.when(fav == "H", "HOME_FAVORITE").otherwise("AWAY_FAVORITE").alias("market_side"),
        line_text(F.col("line")).alias("ah_line"), F.col("price").alias("ah_price"),
        bands.price_label(F.col("price")).alias("ah_price_bucket"),
        F.col("price").between(*filters.CORE).alias("ah_core_price"),
        bands.probability_label(F.col("fair_probability")).alias("favorite_probability_bucket"),
        F.col("fs.settlement").alias("favorite_settlement"), F.col("fs.profit_units").alias("favorite_profit_units"),
        F.col("ds.settlement").alias("underdog_settlement"), F.col("ds.profit_units").alias("underdog_profit_units"),
        quote.alias("ou_status"), line_text(F.when(has_ou, F.col("ou_line"))).alias("ou_line"),
        F.when(has_ou, F.col("over_price")).alias("over_price"), F.when(has_ou, F.col("under_price")).alias("under_price"),
        F.col("os.settlement").alias("over_settlement"), F.col("os.profit_units").alias("over_profit_units"),
        F.col("us.settlement").alias("under_settlement"), F.col("us.profit_units").alias("under_profit_units"),
        F.when(has_ou, bands.price_label(F.col("over_price"))).alias("over_price_bucket"),
        F.coalesce(F.col("mainline_verified"), F.lit(False)).alias("mainline_verified"),
        exact.alias("ou25_status"),
        F.when(priced, F.col("over_price")).alias("ou25_over_price"), F.when(priced, F.col("under_price")).alias("ou25_under_price"),
        F.when(hg + ag > 2.5, "OVER").otherwise("UNDER").alias("ou25_result"), (hg + ag).alias("total_goals"),
    )


def _wins(c: str) -> Column:
    return F.count_if(F.col(c).isin("FULL_WIN", "HALF_WIN"))


def _losses(c: str) -> Column:
    return F.count_if(F.col(c).isin("FULL_LOSS", "HALF_LOSS"))


def state_statistics(out: DataFrame, keys: Sequence[str], core_only: bool = False) -> DataFrame:
    """Counts, win shares, returns of both sides, Wilson interval and labels for any key set."""
    rows = out.filter("ah_core_price") if core_only else out
    fav, dog = F.col("favorite_profit_units"), F.col("underdog_profit_units")
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *settlement.distribution(F.col("favorite_settlement")),
        F.sum(micro(fav)).alias("fp"), F.count(fav).alias("fn"), F.sum(micro(dog)).alias("dp"), F.count(dog).alias("dn"),
    )
    settled = F.col("full_win") + F.col("half_win") + F.col("push") + F.col("half_loss") + F.col("full_loss")
    wins, losses = F.col("full_win") + F.col("half_win"), F.col("half_loss") + F.col("full_loss")
    pct = lambda a, b: rnd(ratio(a * 100, b), 2)
    lo, hi = stats.wilson(wins, settled)
    return g.select(
        *keys, "n", settled.alias("settled_n"), "full_win", "half_win", "push", "half_loss", "full_loss",
        pct(wins, settled).alias("favorite_price_win_pct"), pct(losses, settled).alias("underdog_price_win_pct"),
        pct(F.col("push"), settled).alias("push_pct"),
        rnd(from_micro(F.col("fp")), 4).alias("favorite_profit_units"), rnd(from_micro(F.col("fp")) * 100.0 / F.col("fn"), 2).alias("favorite_roi_pct"),
        rnd(from_micro(F.col("dp")), 4).alias("underdog_profit_units"), rnd(from_micro(F.col("dp")) * 100.0 / F.col("dn"), 2).alias("underdog_roi_pct"),
        rnd(lo, 2).alias("wilson_low"), rnd(hi, 2).alias("wilson_high"), bands.sample_label(F.col("n")).alias("sample_label"),
    )


def goal_statistics(out: DataFrame, keys: Sequence[str], core_only: bool = False) -> DataFrame:
    rows = out.filter("ah_core_price") if core_only else out
    over = F.col("ou25_result") == "OVER"
    priced = F.col("ou25_over_price").isNotNull() & F.col("ou25_under_price").isNotNull()
    op = F.when(priced, F.when(over, F.col("ou25_over_price") - 1.0).otherwise(-1.0))
    up = F.when(priced, F.when(~over, F.col("ou25_under_price") - 1.0).otherwise(-1.0))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("total_goals").alias("total_goals"), F.count_if(F.col("total_goals") >= 4).alias("over_3_5_n"),
        F.count_if(over).alias("over_2_5_n"), F.count_if(~over).alias("under_2_5_n"), F.count_if(priced).alias("ou25_priced_n"),
        F.sum(micro(op)).alias("op"), F.sum(micro(up)).alias("up"),
    )
    pct = lambda a: rnd(ratio(F.col(a) * 100, F.col("n")), 2)
    return g.select(
        *keys, "n", "total_goals", rnd(ratio(F.col("total_goals"), F.col("n")), 2).alias("avg_total_goals"),
        "over_3_5_n", pct("over_3_5_n").alias("over_3_5_pct"), "over_2_5_n", "under_2_5_n", pct("over_2_5_n").alias("over_2_5_pct"),
        "ou25_priced_n", rnd(from_micro(F.col("op")), 4).alias("over_2_5_profit_units"),
        rnd(from_micro(F.col("up")), 4).alias("under_2_5_profit_units"), bands.sample_label(F.col("n")).alias("sample_label"),
    )


def versus_baseline(out: DataFrame) -> DataFrame:
    """Price-state win share minus the share of its (side, line): the baseline is a window sum over the states."""
    st = state_statistics(out, ["market_side", "ah_line", "ah_price_bucket"], core_only=True)
    line = Window.partitionBy("market_side", "ah_line")
    wins, n = F.sum(F.col("full_win") + F.col("half_win")).over(line), F.sum("settled_n").over(line)
    base = rnd(ratio(wins * 100, n), 2)
    return st.select(
        "market_side", "ah_line", "ah_price_bucket", "n", "favorite_price_win_pct", base.alias("baseline_favorite_price_win_pct"),
        rnd(F.col("favorite_price_win_pct") - base, 2).alias("difference_vs_line_baseline_pp"),
    )


def _pair_aggs() -> list[Column]:
    push = F.count_if(F.col("over_settlement") == "PUSH")
    return [
        F.count("*").alias("n"), _wins("over_settlement").alias("over_win_n"), _wins("under_settlement").alias("under_win_n"),
        push.alias("push_n"), F.count_if(F.col("under_settlement") == "PUSH").alias("under_push_n"),
        F.sum(micro(F.col("over_profit_units"))).alias("over_profit"), F.sum(micro(F.col("under_profit_units"))).alias("under_profit"),
        F.count_if("mainline_verified").alias("mainline_verified_n"),
        _wins("favorite_settlement").alias("ah_favorite_win_n"), _losses("favorite_settlement").alias("ah_underdog_win_n"),
        F.count_if(F.col("favorite_settlement") == "PUSH").alias("ah_push_n"),
    ]


# The four reporting levels of real totals.
TOTAL_LEVELS = {
    "PAIRED": ("market_side", "ah_line", "ah_price_bucket", "ou_line", "over_price_bucket"),
    "STANDALONE": ("ou_line", "over_price_bucket"),
    "JOINT_LINE": ("market_side", "ah_line", "ou_line"),
    "AH_BASELINE": ("market_side", "ah_line"),
}


def real_total_statistics(out: DataFrame) -> DataFrame:
    """All levels of the real-total statistics from one finest aggregate, expanded over the levels.

    `consistent` states the complement rule: pushes agree and over wins + under wins + pushes = n.
    """
    finest = out.filter(F.col("over_settlement").isNotNull() & F.col("under_settlement").isNotNull()).groupBy(
        *TOTAL_LEVELS["PAIRED"]
    ).agg(*_pair_aggs())
    all_keys = TOTAL_LEVELS["PAIRED"]
    levels = F.array(
        *[
            F.struct(F.lit(name).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(f"_{k}") for k in all_keys])
            for name, keys in TOTAL_LEVELS.items()
        ]
    )
    sums = ["n", "over_win_n", "under_win_n", "push_n", "under_push_n", "over_profit", "under_profit", "mainline_verified_n",
            "ah_favorite_win_n", "ah_underdog_win_n", "ah_push_n"]
    g = (
        finest.withColumn("l", F.explode(levels))
        .groupBy("l.level", *[F.col(f"l._{k}").alias(k) for k in all_keys])
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    pct = lambda a: rnd(ratio(F.col(a) * 100, F.col("n")), 2)
    ok = (F.col("push_n") == F.col("under_push_n")) & (F.col("over_win_n") + F.col("under_win_n") + F.col("push_n") == F.col("n"))
    return g.select(
        "level", *all_keys, "n", "over_win_n", "under_win_n", "push_n", pct("over_win_n").alias("over_win_pct"),
        pct("under_win_n").alias("under_win_pct"), pct("push_n").alias("push_pct"),
        rnd(from_micro(F.col("over_profit")) * 100.0 / F.col("n"), 2).alias("over_roi_pct"),
        rnd(from_micro(F.col("under_profit")) * 100.0 / F.col("n"), 2).alias("under_roi_pct"),
        "mainline_verified_n", "ah_favorite_win_n", "ah_underdog_win_n", "ah_push_n",
        pct("ah_favorite_win_n").alias("ah_favorite_win_pct"), bands.total_sample_label(F.col("n")).alias("sample_label"), ok.alias("consistent"),
    )


def walk_forward(rows: DataFrame, keys: Sequence[str], move: str, day: str, profit_micro: Column,
                 min_past: int = 20, min_base: int = 5, weight: int = 10) -> DataFrame:
    """Chronological forecasts from strictly earlier days.

    Sums per day first, then cumulative windows over days: one row per (key, day), not per fixture.
    """
    daily = rows.groupBy(*keys, move, day).agg(F.count("*").alias("n"), F.sum(profit_micro).alias("s"))
    past = lambda cols: Window.partitionBy(*cols).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    by_day = daily.groupBy(day).agg(F.sum("n").alias("dn"))
    by_day = by_day.withColumn("past_n", F.coalesce(F.sum("dn").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = daily.groupBy(*keys, day).agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    base = base.withColumn("base_n", F.sum("bn").over(past(keys))).withColumn("base_s", F.sum("bs").over(past(keys)))
    mv = daily.withColumn("move_n", F.coalesce(F.sum("n").over(past([*keys, move])), F.lit(0))).withColumn(
        "move_s", F.coalesce(F.sum("s").over(past([*keys, move])), F.lit(0)))
    j = mv.join(base.select(*keys, day, "base_n", "base_s"), [*keys, day]).join(by_day.select(day, "past_n"), day)
    mu = from_micro(F.col("base_s")) / F.col("base_n")
    ext = (from_micro(F.col("move_s")) + weight * mu) / (F.col("move_n") + weight)
    return j.filter((F.col("past_n") >= min_past) & (F.col("base_n") >= min_base)).select(
        *keys, move, day, "n", "base_n", "move_n", mu.alias("baseline_prediction"), ext.alias("movement_prediction"),
    )
