"""Audits over pattern buckets: paired, three-way, multi-season validation, registry, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import bands, settlement, stats
from fairline.functions.exact import from_micro, micro, ratio, rnd
from fairline.functions.lines import quarters
from fairline.operators import patterns as P
from fairline.operators.multipletests import benjamini_hochberg
from fairline.operators.resampling import bootstrap_interval, sign_flip_p
from fairline.session import cut

# Statuses and gate thresholds.
ROBUST, WATCH, REJECT = "ROBUST_RESEARCH_CANDIDATE", "WATCHLIST", "REJECT"
GLOBAL_ROBUST, LEAGUE_SPECIFIC = "GLOBAL_ROBUST_RESEARCH_CANDIDATE", "LEAGUE_SPECIFIC_OR_UNSTABLE"
STRONG, CONSISTENT, NO_GO = "STRONG_RESEARCH_CANDIDATE", "CONSISTENT_POSITIVE_RESEARCH_CANDIDATE", "NO_GO"
FDR = 0.10
MIN_LEAGUES, MIN_LEAGUE_SHARE, MIN_LEAGUE_N = 3, 0.60, 20
CLASS_NAMES = [c.lower() for c in settlement.CLASSES]


def side_audit(report: DataFrame, min_train_n: int = 60, min_test_n: int = 20) -> DataFrame:
    """Train and test buckets of the side backtest, paired by one conditional aggregation."""
    key = ["side", "odds_low", "odds_high"]
    cols = ["n", "flat_stake_roi", "calibration_gap_pp", "avg_clv", "win_rate", "market_expected"]
    paired = report.groupBy(*key).agg(
        *[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "test") for c in cols]
    ).filter(F.col("train_n").isNotNull() & F.col("test_n").isNotNull())
    for s in ("train", "test"):
        paired = paired.withColumn(
            f"{s}_z", stats.win_rate_z(F.col(f"{s}_win_rate"), F.col(f"{s}_market_expected"), F.col(f"{s}_n"))
        )
    both = lambda c, f: f(F.col(f"train_{c}")) & f(F.col(f"test_{c}"))
    consistent = (
        (F.col("train_n") >= min_train_n) & (F.col("test_n") >= min_test_n)
        & both("flat_stake_roi", lambda x: x > 0) & both("calibration_gap_pp", lambda x: x > 0)
    )
    strong = both("avg_clv", lambda x: x >= 0) & both("z", lambda x: x >= 1.0)
    status = (
        F.when(consistent & F.coalesce(strong, F.lit(False)), STRONG).when(consistent, CONSISTENT).otherwise(NO_GO)
    )
    return paired.select(
        *key, "train_n", "test_n",
        F.col("train_flat_stake_roi").alias("train_roi"), F.col("test_flat_stake_roi").alias("test_roi"),
        F.col("train_calibration_gap_pp").alias("train_gap_pp"), F.col("test_calibration_gap_pp").alias("test_gap_pp"),
        F.col("train_avg_clv").alias("train_clv"), F.col("test_avg_clv").alias("test_clv"),
        "train_z", "test_z", status.alias("status"),
    )


def paired_audit(
    rows: DataFrame, test_seasons: Sequence[str], min_train_n: int = 60, min_test_n: int = 30, alpha: float = FDR,
    families: Sequence[str] | None = None, by: Sequence[str] = (), also: dict[str, str] | None = None,
) -> DataFrame:
    """Pattern x market tests: positive in both splits, stable over seasons, FDR-controlled.

    `by` adds grouping columns (a league, say) so that many scopes are audited in one pass; `also` names one
    more value of a grouping column that stands for all of its scopes together.
    """
    split = F.when(F.col("season").isin(*test_seasons), "test").otherwise("train")
    buckets = P.pattern_buckets(rows.withColumn("split", split), [*by, "split", "season"], also)
    if families is not None:
        buckets = buckets.filter(F.col("family").isin(*families))
    fine = P.stack_markets(buckets, [*by, *P.KEY, "split", "season"])
    aggs = []
    for s in ("train", "test"):
        mine = F.col("split") == s
        n, profit = F.when(mine, F.col("n")), F.when(mine, F.col("profit"))
        aggs += [F.sum(n).alias(f"{s}_n"), F.sum(profit).alias(f"{s}_profit"), *P.season_stability(n, profit, s)]
    paired = (
        fine.groupBy(*by, *P.KEY, "market")
        .agg(*aggs)
        .filter((F.col("train_n") >= min_train_n) & (F.col("test_n") >= min_test_n))
    )
    for s in ("train", "test"):
        paired = paired.withColumn(f"{s}_roi", P.roi(f"{s}_profit", f"{s}_n")).withColumn(
            f"z_{s}", stats.roi_z(F.col(f"{s}_roi"), F.col(f"{s}_n"))
        )
    paired = paired.withColumn(
        "p_conservative", rnd(F.greatest(stats.two_sided_p(F.col("z_train")), stats.two_sided_p(F.col("z_test"))), 6)
    )
    tested = benjamini_hochberg(paired, "p_conservative", "q_bh", by=by)
    positive = (F.col("train_roi") > 0) & (F.col("test_roi") > 0)
    passed = positive & P.stable("train") & P.stable("test") & (F.col("q_bh") <= alpha)
    return tested.select(
        *by, P.pattern_text().alias("pattern"), "family", "market", "train_n", "test_n", "train_roi", "test_roi",
        rnd(F.col("z_train"), 6).alias("z_train"), rnd(F.col("z_test"), 6).alias("z_test"), "p_conservative", "q_bh",
        "train_eligible_seasons", "train_positive_seasons", "test_eligible_seasons", "test_positive_seasons",
        F.when(passed, ROBUST).when(positive, WATCH).otherwise(REJECT).alias("status"),
    )


def phase_markets(rows: DataFrame, phases: Mapping[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Pattern x market x phase (x extra columns) sums from one expansion."""
    staged = rows.withColumn("phase", P.phase_label(phases)).filter(F.col("phase").isNotNull())
    return P.stack_markets(P.pattern_buckets(staged, [*by, "phase"]), [*by, *P.KEY, "phase"])


def league_consistency(fine: DataFrame, min_n: int = MIN_LEAGUE_N) -> DataFrame:
    """Holdout leagues of each (pattern, market): eligible, positive, share, stable.

    One aggregate over the league level; the rows are never read again per pattern or league.
    """
    ok = (F.col("phase") == "holdout") & (F.col("n") >= min_n)
    out = fine.groupBy(*P.KEY, "market").agg(
        F.count_if(ok).alias("eligible_leagues"),
        F.count_if(ok & (P.roi("profit") > 0)).alias("positive_leagues"),
    )
    share = F.coalesce(ratio(F.col("positive_leagues"), F.col("eligible_leagues")), F.lit(0.0))
    return out.withColumn("positive_share", rnd(share, 6)).withColumn(
        "cross_league_stable", (F.col("eligible_leagues") >= MIN_LEAGUES) & (share >= MIN_LEAGUE_SHARE)
    )


def three_way_audit(
    rows: DataFrame, phases: Mapping[str, Sequence[str]], league: str = "league",
    min_n: Mapping[str, int] | None = None, min_bucket: int = 20, alpha: float = FDR,
) -> DataFrame:
    """Train / validation / holdout audit with cross-league status, all from one league-level aggregate."""
    need = {"train": 150, "validation": 80, "holdout": 40, **(min_n or {})}
    fine = phase_markets(rows, phases, by=(league,))
    leagues_ok = (F.col("phase") == "holdout") & (F.col("n") >= MIN_LEAGUE_N)
    aggs = [
        F.count_if(leagues_ok).alias("eligible_leagues"),
        F.count_if(leagues_ok & (P.roi("profit") > 0)).alias("positive_leagues"),
    ]
    for ph in need:
        mine = F.col("phase") == ph
        aggs += [F.sum(F.when(mine, F.col("n"))).alias(f"{ph}_n"), F.sum(F.when(mine, F.col("profit"))).alias(f"{ph}_profit")]
        aggs += [F.sum(F.when(mine, F.col(c)).otherwise(0)).alias(f"{ph}_{c}") for c in CLASS_NAMES]
    tests = fine.groupBy(*P.KEY, "market").agg(*aggs)
    enough = reduce(lambda a, b: a & b, [F.col(f"{ph}_n") >= max(k, min_bucket) for ph, k in need.items()])
    tests = tests.filter(enough)
    for ph in need:
        tests = tests.withColumn(f"{ph}_roi", P.roi(f"{ph}_profit", f"{ph}_n"))
    z = stats.roi_z(F.col("validation_roi"), F.col("validation_n"))
    tests = tests.withColumn("z_validation", rnd(z, 6)).withColumn("p_validation", rnd(stats.two_sided_p(z), 6))
    tests = benjamini_hochberg(tests, "p_validation", "q_validation_bh")
    positive = (F.col("train_roi") > 0) & (F.col("validation_roi") > 0) & (F.col("holdout_roi") > 0)
    fdr = F.col("q_validation_bh") <= alpha
    share = F.coalesce(ratio(F.col("positive_leagues"), F.col("eligible_leagues")), F.lit(0.0))
    cross = (F.col("eligible_leagues") >= MIN_LEAGUES) & (share >= MIN_LEAGUE_SHARE)
    status = (
        F.when(positive & fdr & cross, GLOBAL_ROBUST)
        .when(positive & fdr, LEAGUE_SPECIFIC)
        .when(positive, WATCH)
        .otherwise(REJECT)
    )
    return tests.select(
        P.pattern_text().alias("pattern"), *P.KEY, "market",
        *[f"{ph}_{c}" for ph in need for c in ("n", "roi")],
        "z_validation", "p_validation", "q_validation_bh",
        "eligible_leagues", "positive_leagues", rnd(share, 6).alias("positive_share"),
        *[f"{ph}_{c}" for ph in need for c in CLASS_NAMES],
        status.alias("status"),
    )


def ranked(audit: DataFrame) -> DataFrame:
    """Status priority, then holdout return and size, best first."""
    order = {GLOBAL_ROBUST: 3, LEAGUE_SPECIFIC: 2, WATCH: 1, REJECT: 0}
    rank = reduce(lambda acc, kv: acc.when(F.col("status") == kv[0], kv[1]), list(order.items())[1:],
                  F.when(F.col("status") == GLOBAL_ROBUST, 3))
    return audit.withColumn("priority", rank).orderBy(
        F.desc("priority"), F.desc("holdout_roi"), F.desc("holdout_n"), "pattern", "market"
    )


def registry(audit: DataFrame, promotable: str = GLOBAL_ROBUST) -> DataFrame:
    """Promotable patterns with their phase distributions; small, feeds the screen."""
    return audit.filter(F.col("status") == promotable).withColumn(
        "pattern_id", F.concat_ws("::", "market", "pattern")
    )


def validation_rows(rows: DataFrame, market: str, price_width: float = 0.20, prob_width: float = 0.10) -> DataFrame:
    """Pattern key, profit and phase columns of the multi-season validation, for handicaps or totals."""
    base = rows.withColumn("p_band", bands.floor_band_no(F.col("favorite_fair_probability"), prob_width)).withColumn(
        "ah_q", quarters(F.col("favorite_ah_line"))
    )
    goals = (F.col("home_goals"), F.col("away_goals"))
    if market == "AH":
        price = F.col("favorite_ah_price")
        signs = settlement.handicap_signs(*goals, F.col("favorite_ah_line"), F.col("favorite_side"))
        base = base.withColumn("ou_side", F.lit("-")).withColumn("bet_price", price).withColumn("signs", signs)
    else:
        sides = F.array(
            F.struct(F.lit("O").alias("side"), F.col("over_price").alias("price")),
            F.struct(F.lit("U").alias("side"), F.col("under_price").alias("price")),
        )
        base = base.withColumn("b", F.explode(sides)).withColumn("ou_side", F.col("b.side")).withColumn(
            "bet_price", F.col("b.price")
        )
        base = base.withColumn("signs", settlement.total_signs(*goals, F.col("ou_line"), F.col("ou_side")))
    return base.filter(F.col("ah_q").isNotNull() & (F.col("bet_price") > 1)).select(
        "season", "league", "favorite_side", "ah_q", "ou_side", "p_band",
        bands.floor_band_no(F.col("bet_price"), price_width).alias("price_band"),
        micro(settlement.profit_of(F.col("signs"), F.col("bet_price"))).alias("profit"),
        "signs",
    )


VKEY = ("favorite_side", "ah_q", "ou_side", "price_band", "p_band")


def validation_key_text(price_width: float = 0.20, prob_width: float = 0.10) -> Column:
    return F.concat_ws(
        "|", "favorite_side", F.format_string("%+.2f", F.col("ah_q") / F.lit(4.0)), "ou_side",
        bands.band_text(F.col("price_band"), price_width), bands.band_text(F.col("p_band"), prob_width),
    )


def profit_histogram(bets: DataFrame, phases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Count of each profit per (key, phase, season, league): everything below derives from this aggregate."""
    return (
        bets.withColumn("phase", P.phase_label(phases))
        .filter(F.col("phase").isNotNull())
        .groupBy(*VKEY, "phase", "season", "league", "profit")
        .agg(F.count("*").alias("c"))
    )


def multi_season_gates(
    fine: DataFrame, phases: Mapping[str, Sequence[str]], min_n: Mapping[str, int],
) -> DataFrame:
    """Every gate input except the resampled p: sizes, returns, league and season counts (from profit_histogram)."""
    fine = fine.groupBy(*VKEY, "phase", "season", "league").agg(
        F.sum("c").alias("n"), F.sum(F.col("profit") * F.col("c")).alias("profit")
    )
    eval_phase = F.col("phase") != "train"

    def phase_sums(df: DataFrame, keys: Sequence[str]) -> list[Column]:
        out = []
        for ph in phases:
            mine = F.col("phase") == ph
            out.append(F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"{ph}_n"))
            out.append(F.sum(F.when(mine, F.col("profit")).otherwise(0)).alias(f"{ph}_profit"))
        return out

    by_league = fine.filter(eval_phase).groupBy(*VKEY, "league").agg(F.sum("profit").alias("profit"))
    leagues = by_league.groupBy(*VKEY).agg(
        F.count("*").alias("leagues"), F.count_if(F.col("profit") > 0).alias("positive_leagues")
    )
    by_season = fine.groupBy(*VKEY, "phase", "season").agg(F.sum("n").alias("n"), F.sum("profit").alias("profit"))
    totals = by_season.groupBy(*VKEY).agg(
        *phase_sums(by_season, VKEY),
        F.count_if((F.col("phase") == "validation") & (F.col("profit") > 0)).alias("validation_seasons_positive"),
        F.count_if((F.col("phase") == "holdout") & (F.col("profit") > 0)).alias("holdout_seasons_positive"),
    )
    tested = totals.filter((F.col("train_n") >= min_n["train"]) & (F.col("train_profit") > 0))
    out = tested.join(leagues, list(VKEY), "left").na.fill(0, ["leagues", "positive_leagues"])
    for ph in phases:
        out = out.withColumn(f"{ph}_roi", F.coalesce(P.roi(f"{ph}_profit", f"{ph}_n"), F.lit(0.0)))
    return out


def multi_season_status(
    gates: DataFrame, phases: Mapping[str, Sequence[str]], min_n: Mapping[str, int], q: str | None, alpha: float = FDR
) -> DataFrame:
    """Status from the gate inputs. q None leaves the FDR gate out (it needs the resampled p)."""
    checks = {
        "train_n": F.col("train_n") >= min_n["train"],
        "validation_n": F.col("validation_n") >= min_n["validation"],
        "holdout_n": F.col("holdout_n") >= min_n["holdout"],
        "train_roi_positive": F.col("train_profit") > 0,
        "validation_roi_positive": F.col("validation_profit") > 0,
        "holdout_roi_positive": F.col("holdout_profit") > 0,
        "cross_league_count": F.col("leagues") >= MIN_LEAGUES,
        "positive_league_share": ratio(F.col("positive_leagues"), F.col("leagues")) >= MIN_LEAGUE_SHARE,
        "validation_seasons_positive": F.col("validation_seasons_positive") == len(phases["validation"]),
        "holdout_season_positive": F.col("holdout_seasons_positive") == len(phases["holdout"]),
    }
    if q is not None:
        checks["validation_fdr"] = F.col(q) <= alpha
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])
    )
    return gates.withColumn("failed_gates", F.array_join(F.array_sort(failed), ",")).withColumn(
        "status", F.when(F.col("failed_gates") == "", GLOBAL_ROBUST).otherwise(REJECT)
    )


def multi_season_validation(
    bets: DataFrame, phases: Mapping[str, Sequence[str]], min_n: Mapping[str, int], draws: int = 5000,
    ci_draws: int = 4000, leagues: Sequence[str] | None = None,
) -> DataFrame:
    """The full validation: gates, one-sided sign-flip p on validation, BH q, bootstrap interval, status.

    Only patterns that pass the train gate are resampled (left semi on the small gate table).
    """
    if leagues is not None:
        bets = bets.filter(F.col("league").isin(*leagues))
    fine = cut(profit_histogram(bets, phases))
    gates = multi_season_gates(fine, phases, min_n).withColumn("pattern", validation_key_text())
    val = (
        fine.filter(F.col("phase") == "validation")
        .withColumn("pattern", validation_key_text())
        .join(gates.select("pattern"), "pattern", "left_semi")
    )
    hist = cut(val.groupBy("pattern", F.col("profit").alias("v")).agg(F.sum("c").alias("c")))
    flips = sign_flip_p(hist, ["pattern"], F.col("pattern"), draws, two_sided=False)
    ci = bootstrap_interval(hist, ["pattern"], F.col("pattern"), ci_draws, quantile="index")
    joined = gates.join(flips, "pattern", "left").join(ci, "pattern", "left")
    p = F.when(F.col("validation_n") >= min_n["validation"], F.coalesce("p", F.lit(1.0))).otherwise(F.lit(1.0))
    joined = joined.withColumn("p_validation", rnd(p, 6)).drop("p")
    tested = benjamini_hochberg(joined, "p_validation", "q_validation")
    return multi_season_status(tested, phases, min_n, "q_validation")


def diagnose(candidates: DataFrame, rules: Mapping[str, float]) -> DataFrame:
    """Diagnostic replay of validated patterns under pooled out-of-sample rules."""
    oos_n = F.col("validation_n") + F.col("holdout_n")
    oos_profit = from_micro(F.col("validation_profit") + F.col("holdout_profit"))
    pooled = F.coalesce(oos_profit / F.when(oos_n > 0, oos_n), F.lit(0.0))
    shrunk = F.when(oos_n > 0, stats.shrunk_roi(oos_profit, oos_n, rules["prior_strength"])).otherwise(0.0)
    share = F.coalesce(ratio(F.col("positive_leagues"), F.col("leagues")), F.lit(0.0))
    gates = {
        "train_n": F.col("train_n") >= rules["minimum_train_n"],
        "oos_n": oos_n >= rules["minimum_oos_n"],
        "train_roi_positive": F.col("train_roi") > 0,
        "pooled_oos_roi_positive": pooled > 0,
        "holdout_not_catastrophic": (F.col("holdout_n") == 0) | (F.col("holdout_roi") >= rules["maximum_single_holdout_loss_roi"]),
        "positive_league_share": share >= rules["minimum_positive_league_share"],
        "shrunk_oos_roi_positive": shrunk > 0,
    }
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in gates.items()]))
    return candidates.select(
        "pattern", "train_n", oos_n.alias("oos_n"), "holdout_n", "train_roi", rnd(pooled, 8).alias("pooled_oos_roi"),
        "holdout_roi", rnd(shrunk, 8).alias("shrunk_oos_roi"), rnd(share, 8).alias("positive_league_share"),
        F.array_join(failed, ",").alias("failed_gates"),
        F.when(F.size(failed) == 0, "RESEARCH_CANDIDATE").otherwise("RESEARCH_REJECT").alias("diagnostic_status"),
    )
