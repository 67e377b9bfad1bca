"""Forward evaluation: entries, closing-line value, settlement, metrics, readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import settlement
from fairline.functions.exact import avg_micro, from_micro, micro, ratio
from fairline.functions.lines import quarters
from fairline.functions.prices import in_band
from fairline.operators.asof import last_before_kickoff
from fairline.operators.results import insert_only
from fairline.operators.sequences import sequence_metrics

# Readiness thresholds.
READINESS = {
    "minimum_settled": 150, "minimum_leagues": 3, "minimum_positive_league_share": 0.60,
    "minimum_comparable_clv_share": 0.70, "maximum_concentration": 0.60,
}


def closing_line_value(entries: DataFrame, snaps: DataFrame) -> DataFrame:
    """Entry price over the last observed pre-match price of the same selection; only on an unchanged line."""
    quotes = snaps.filter(F.col("mainline_verified").eqNullSafe(F.lit(True)))
    j = last_before_kickoff(
        entries, quotes, ["home_line", "away_line", "home_price", "away_price", "ou_line", "over_price", "under_price"], "event_id"
    )
    q = lambda f: F.col(f"close.{f}")
    sel = F.concat_ws(":", "market", "selection")
    line = (
        F.when(sel == "AH:H", q("home_line")).when(sel == "AH:A", q("away_line")).when(F.col("market") == "OU", q("ou_line"))
    )
    price = (
        F.when(sel == "AH:H", q("home_price")).when(sel == "AH:A", q("away_price"))
        .when(sel == "OU:O", q("over_price")).when(sel == "OU:U", q("under_price"))
    )
    j = j.withColumn("close_line", line).withColumn("close_price", price)
    move = F.col("close_line") - F.col("entry_line")
    status = (
        F.when(F.col("fixture_id").isNull() | F.col("entry_us").isNull() | F.col("kickoff_us").isNull(), "ENTRY_INVALID")
        .when(F.col("close").isNull(), "NO_ADMISSIBLE_POST_ENTRY_SNAPSHOT")
        .when(F.col("close_line").isNull() | F.col("close_price").isNull() | F.col("entry_line").isNull() | F.col("entry_price").isNull(), "CLV_NOT_COMPARABLE")
        .when((F.col("entry_price") <= 1) | (F.col("close_price") <= 1), "CLV_NOT_COMPARABLE_INVALID_QUOTE")
        .when(F.abs(move) > 1e-9, "CLV_NOT_COMPARABLE_LINE_CHANGED")
        .otherwise("CLV_COMPARABLE")
    )
    return (
        j.withColumn("status", status)
        .withColumn("line_move", move)
        .withColumn("price_clv", F.when(F.col("status") == "CLV_COMPARABLE", F.col("entry_price") / F.col("close_price") - 1.0))
        .drop("close")
    )


def clv_summary(evaluated: DataFrame, key: str = "candidate_id") -> DataFrame:
    clv = F.col("price_clv")
    return evaluated.groupBy(key).agg(
        F.count("*").alias("entries"), F.count(clv).alias("comparable_clv"),
        ratio(F.count(clv), F.count("*")).alias("comparable_share"), avg_micro(clv).alias("mean_clv"), F.median(clv).alias("median_clv"),
        F.count_if(F.col("status") == "NO_ADMISSIBLE_POST_ENTRY_SNAPSHOT").alias("no_snapshot"),
        F.count_if(F.col("status") == "CLV_NOT_COMPARABLE_LINE_CHANGED").alias("line_changed"),
    )


def match_candidates(snaps: DataFrame, candidates: DataFrame, universe: bool = False) -> DataFrame:
    """Snapshot x candidate on side and whole quarter line, with band predicates as residuals.

    The equality part carries the join; the candidate table is the frozen catalog, left to Spark's own size
    check for broadcasting.
    """
    s = snaps.withColumn("ah_q", quarters(F.col("line"))).withColumn("ou_q", quarters(F.col("ou_line")))
    k = candidates.select(
        "pattern_id", F.col("favorite_side").alias("k_side"), F.col("ah_q").alias("k_ah_q"), F.col("market").alias("k_market"),
        F.col("ou_q").alias("k_ou_q"), F.col("ou_side").alias("k_ou_side"), "price_lo", "price_hi", "prob_lo", "prob_hi",
        *([F.col("universe").alias("k_universe")] if universe else []),
    )
    price = F.when(F.col("k_market") == "AH", F.col("price")).when(F.col("k_ou_side") == "O", F.col("over_price")).otherwise(F.col("under_price"))
    cond = (
        (s["favorite_side"] == k["k_side"]) & (s["ah_q"] == k["k_ah_q"])
        & in_band(F.col("fair_probability"), F.col("prob_lo"), F.col("prob_hi"))
        & in_band(price, F.col("price_lo"), F.col("price_hi"))
        & ((F.col("k_market") == "AH") | (F.col("ou_q") == F.col("k_ou_q")))
    )
    if universe:
        cond = cond & (F.col("universe") == F.col("k_universe"))
    return s.join(k, cond)


def forward_entries(
    snaps: DataFrame, candidates: DataFrame, existing: DataFrame, start_us: int, universe: bool = False,
) -> DataFrame:
    """First qualifying observation per (candidate, fixture); existing entries are never replaced."""
    ok = snaps.filter(
        (F.col("observed_us") >= start_us) & (F.col("observed_us") < F.col("kickoff_us")) & F.col("mainline_verified").eqNullSafe(F.lit(True))
    )
    m = match_candidates(ok, candidates, universe)
    is_ah = F.col("k_market") == "AH"
    rows = m.select(
        F.col("pattern_id").alias("candidate_id"), "fixture_id", "kickoff_us", F.col("observed_us").alias("entry_us"), "event_id", "league",
        F.col("k_market").alias("market"), F.when(is_ah, F.col("favorite_side")).otherwise(F.col("k_ou_side")).alias("selection"),
        F.when(is_ah, F.col("line")).otherwise(F.col("ou_line")).alias("entry_line"),
        F.when(is_ah, F.col("price")).when(F.col("k_ou_side") == "O", F.col("over_price")).otherwise(F.col("under_price")).alias("entry_price"),
    ).withColumn("_seq", F.struct("entry_us", "event_id"))
    return insert_only(existing.withColumn("_seq", F.struct("entry_us", "event_id")), rows, ["candidate_id", "fixture_id"], "_seq").drop("_seq")


def settle(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries with their result (from operators.results.result_index) and a reason when none can settle them."""
    j = entries.join(index, "fixture_id", "left")
    s = settlement.settle_entry(F.col("market"), F.col("ft_home_goals"), F.col("ft_away_goals"), F.col("entry_line"), F.col("entry_price"), F.col("selection"))
    j = j.withColumn("s", F.when(~F.coalesce("ambiguous", F.lit(True)), s))
    reason = (
        F.when(F.col("records").isNull(), "MISSING_RESULT").when(F.col("ambiguous"), "AMBIGUOUS_RESULT").when(F.col("s").isNull(), "ENTRY_INVALID")
    )
    return j.select(*entries.columns, reason.alias("reason"), "s.settlement", "s.profit_units", "s.return_units")


def candidate_metrics(settled: DataFrame, key: str = "candidate_id", order: Sequence[str] = ("kickoff_us", "fixture_id")) -> DataFrame:
    """Return, league spread, concentration, drawdown (negative) and losing streak per candidate."""
    ok = settled.filter(F.col("reason").isNull()).withColumn("_m", micro(F.col("profit_units")))
    league = ok.groupBy(key, "league").agg(F.count("*").alias("n"), F.sum("_m").alias("p"))
    g = league.groupBy(key).agg(
        F.sum("n").alias("settled_entries"), F.sum("p").alias("p"), F.count("*").alias("distinct_leagues"),
        F.count_if(F.col("p") > 0).alias("positive_leagues"), F.max(F.abs("p")).alias("big"), F.sum(F.abs("p")).alias("tot"),
    )
    seq = sequence_metrics(ok, [key], order, "_m").select(key, "max_drawdown", "longest_losing_streak")
    return g.join(seq, key).select(
        key, "settled_entries", from_micro(F.col("p")).alias("total_profit_units"), (from_micro(F.col("p")) / F.col("settled_entries")).alias("roi"),
        "distinct_leagues", "positive_leagues", ratio(F.col("positive_leagues"), F.col("distinct_leagues")).alias("positive_league_share"),
        ratio(F.col("big"), F.col("tot")).alias("max_single_league_share"), (-from_micro(F.col("max_drawdown")) + 0.0).alias("max_drawdown_units"),
        "longest_losing_streak",
    )


def readiness(metrics: DataFrame, clv: DataFrame, rules: Mapping[str, float] = READINESS, bootstrap_low: Column | None = None) -> DataFrame:
    """Gate status per candidate: everything is PENDING until the minimum sample is reached."""
    j = metrics.join(clv, "candidate_id", "left")
    enough = F.col("settled_entries") >= rules["minimum_settled"]
    low = F.lit(None).cast("double") if bootstrap_low is None else bootstrap_low
    gates = {
        "minimum_distinct_leagues": F.col("distinct_leagues") >= rules["minimum_leagues"],
        "minimum_positive_league_share": F.col("positive_league_share") >= rules["minimum_positive_league_share"],
        "positive_flat_stake_roi": F.col("roi") > 0,
        "positive_mean_comparable_clv": F.col("mean_clv") > 0,
        "positive_median_comparable_clv": F.col("median_clv") > 0,
        "bootstrap_roi_ci95_lower_above_zero": low > 0,
        "maximum_single_league_profit_concentration": F.col("max_single_league_share") <= rules["maximum_concentration"],
        "empirical_drawdown_report": F.col("max_drawdown_units").isNotNull(),
        "longest_losing_streak_report": F.col("longest_losing_streak").isNotNull(),
        "entry_to_close_line_move_report": F.col("entries") > 0,
        "minimum_comparable_clv_share": F.col("comparable_share") >= rules["minimum_comparable_clv_share"],
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(g)) for g, ok in gates.items()]))
    status = (
        F.when(~enough, "COLLECTING_FORWARD_EVIDENCE").when(F.size(failed) == 0, "FORWARD_PAPER_CONFIRMED").otherwise("FORWARD_NOT_CONFIRMED")
    )
    return j.select(
        "candidate_id", status.alias("status"), "settled_entries",
        F.greatest(F.lit(0), F.lit(int(rules["minimum_settled"])) - F.col("settled_entries")).alias("remaining"),
        F.array_join(F.when(enough, failed).otherwise(F.array().cast("array<string>")), ",").alias("failed_gates"),
    )
