"""Price patterns: key expansion, bucket statistics, phase and league statistics.

One pass expands each quoted match into its pattern keys (all as small integers) and aggregates
by (split, key, season). Map-side combine makes the shuffle proportional to the number of
patterns, not of rows, so a pattern that holds a third of the rows is no hot spot. Coarser levels
are derived from the season level instead of reading the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import bands, prices, settlement
from fairline.functions.exact import avg_micro, from_micro, micro, ratio, rnd
from fairline.functions.lines import quarters

# Pattern families and the key columns each one fills.
FAMILIES = {
    "AH_LINE": (),
    "AH_MOVE": ("ah_move_q",),
    "AH_OU": ("ou_side", "ou_q"),
    "AH_OU_PRICE": ("ou_side", "ou_q", "ah_band", "ou_band"),
    "AH_OU_PRICE_1X2": ("ou_side", "ou_q", "ah_band", "ou_band", "p_band"),
    "OU_MOVE": ("ou_side", "ou_q", "ou_move_q"),
    "AH_OU_MOVE": ("ou_side", "ou_q", "ah_move_q", "ou_move_q"),
}
AH_ONLY = ("AH_LINE", "AH_MOVE")
# The families whose buckets add up to those of others, and which.
FINEST = {"AH_MOVE": ("AH_LINE",), "AH_OU_PRICE_1X2": ("AH_OU", "AH_OU_PRICE"), "AH_OU_MOVE": ("OU_MOVE",)}
KEY = (
    "family", "favorite_side", "ah_q", "ou_side", "ou_q", "ah_band", "ou_band", "p_band", "ah_move_q", "ou_move_q",
)
_TYPES = {
    "ou_side": "string", "ou_q": "int", "ah_band": "long", "ou_band": "long", "p_band": "long",
    "ah_move_q": "int", "ou_move_q": "int",
}
# Band widths of the key, minimum season size and share of the stability rule.
PRICE_WIDTH, PROBABILITY_WIDTH = 0.10, 0.05
MIN_SEASON_N, MIN_POSITIVE_SHARE = 10, 0.60


def side_backtest(rows: DataFrame, test_seasons: Sequence[str], min_n: int = 20) -> DataFrame:
    """Flat-stake 1X2 backtest by (split, side, 0.10 price bucket)."""
    sides = F.array(
        *[
            F.struct(
                F.lit(s.upper()).alias("side"),
                F.col(f"open_{s}").alias("odds"),
                F.col(f"fair_{s}").alias("fair"),
                F.col(f"close_{s}").alias("close"),
            )
            for s in ("h", "d", "a")
        ]
    )
    won = F.col("result") == F.col("q.side")
    odds = F.col("q.odds")
    grouped = (
        rows.filter(F.col("result").isin("H", "D", "A"))
        .withColumn("split", F.when(F.col("season").isin(*test_seasons), "test").otherwise("train"))
        .withColumn("q", F.explode(sides))
        .groupBy("split", F.col("q.side").alias("side"), bands.bucket_no(odds).alias("bucket"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(won).alias("wins"),
            avg_micro(F.col("q.fair")).alias("market_expected"),
            avg_micro(odds).alias("avg_odds"),
            F.sum(micro(F.when(won, odds - 1.0).otherwise(-1.0))).alias("profit"),
            avg_micro(odds / prices.price(F.col("q.close")) - 1.0).alias("avg_clv"),
        )
        .filter(F.col("n") >= min_n)
    )
    rate = ratio(F.col("wins"), F.col("n"))
    return grouped.select(
        "split", "side",
        bands.band_lo(F.col("bucket"), 0.10, 2).alias("odds_low"),
        bands.band_hi(F.col("bucket"), 0.10, 2).alias("odds_high"),
        "n", "wins",
        rate.alias("win_rate"),
        "market_expected",
        ((rate - F.col("market_expected")) * 100.0).alias("calibration_gap_pp"),
        "avg_odds",
        from_micro(F.col("profit")).alias("profit_units"),
        (from_micro(F.col("profit")) / F.col("n")).alias("flat_stake_roi"),
        "avg_clv",
    )


def observations(rows: DataFrame, keep: Sequence[str], finest: bool = False) -> DataFrame:
    """Rows x pattern keys. Handicap-only families appear once per match, the others once per total side.

    `finest` gives the families of FINEST only, rows without a movement included, for pattern_buckets.
    """
    line, price = F.col("favorite_ah_line"), F.col("favorite_ah_price")
    goals = (F.col("home_goals"), F.col("away_goals"))
    over = settlement.total_signs(*goals, F.col("ou_line"), F.lit("O"))
    base = rows.filter(prices.research_price(price)).select(
        *keep,
        "favorite_side",
        quarters(line).alias("ah_q"),
        quarters(F.col("ou_line")).alias("ou_q"),
        bands.band_no(price, PRICE_WIDTH).alias("ah_band"),
        bands.band_no(F.col("favorite_fair_probability"), PROBABILITY_WIDTH).alias("p_band"),
        quarters(F.col("ah_line_move")).alias("ah_move_q"),
        quarters(F.col("ou_line_move")).alias("ou_move_q"),
        "over_price", "under_price",
        settlement.handicap_signs(*goals, line, F.col("favorite_side")).alias("ah_signs"),
        price.alias("ah_price"),
        over.alias("over_signs"),
    ).filter(F.col("ah_q").isNotNull())
    base = base.withColumn("ah_profit", micro(settlement.profit_of(F.col("ah_signs"), F.col("ah_price"))))

    def bet(side: str, price_col: str, sign: int) -> Column:
        signs = F.col("over_signs") * F.lit(sign)
        ou_price = F.col(price_col)
        return F.when(
            prices.research_price(ou_price) & F.col("ou_q").isNotNull(),
            F.struct(
                F.lit(side).alias("ou_side"),
                bands.band_no(ou_price, PRICE_WIDTH).alias("ou_band"),
                signs.alias("ou_signs"),
                micro(settlement.profit_of(signs, ou_price)).alias("ou_profit"),
            ),
        )

    none = F.struct(
        F.lit(None).cast("string").alias("ou_side"), F.lit(None).cast("long").alias("ou_band"),
        F.lit(None).cast("int").alias("ou_signs"), F.lit(None).cast("long").alias("ou_profit"),
    )
    # Two small explodes instead of one wide one: the generated code stays small enough to be compiled.
    bets = (
        base.withColumn("b", F.explode(F.array(none, bet("O", "over_price", 1), bet("U", "under_price", -1))))
        .filter(F.col("b").isNotNull())
        .select(*keep, "favorite_side", "ah_q", "ou_q", "ah_band", "p_band", "ah_move_q", "ou_move_q",
                "ah_signs", "ah_profit", "b.*")
    )
    asked = FINEST if finest else FAMILIES
    names = {True: [f for f in asked if f in AH_ONLY], False: [f for f in asked if f not in AH_ONLY]}
    choice = F.when(F.col("ou_side").isNull(), F.array(*[F.lit(f) for f in names[True]])).otherwise(
        F.array(*[F.lit(f) for f in names[False]])
    )
    wanted = bets.withColumn("family", F.explode(choice))
    wanted = wanted if finest else _moved(wanted)
    return wanted.select(
        *keep, "favorite_side", "ah_q", "ah_signs", "ah_profit", "family", *[_filled(c) for c in _TYPES],
        "ou_signs", "ou_profit",
    )


def _moved(wanted: DataFrame) -> DataFrame:
    """Families of a movement have no rows without it."""
    for moving in ("ah_move_q", "ou_move_q"):
        needs = [f for f, filled in FAMILIES.items() if moving in filled]
        wanted = wanted.filter(~F.col("family").isin(*needs) | F.col(moving).isNotNull())
    return wanted


def _filled(c: str) -> Column:
    """A key column, null in the families that do not fill it."""
    fams = [f for f, filled in FAMILIES.items() if c in filled]
    return F.when(F.col("family").isin(*fams), F.col(c)).cast(_TYPES[c]).alias(c)


def pattern_text(family: str = "family") -> Column:
    """Readable label of a key."""
    q = lambda c: F.col(c) / F.lit(4.0)
    parts = [
        F.col(family),
        F.col("favorite_side"),
        F.format_string("AH=%+.2f", q("ah_q")),
        F.when(F.col("ou_side").isNotNull(), F.concat(F.col("ou_side"), F.format_string("%.2f", q("ou_q")))),
        F.when(F.col("ah_band").isNotNull(), F.concat(F.lit("AH@"), bands.band_text(F.col("ah_band"), PRICE_WIDTH))),
        F.when(F.col("ou_band").isNotNull(), F.concat(F.lit("OU@"), bands.band_text(F.col("ou_band"), PRICE_WIDTH))),
        F.when(
            F.col("p_band").isNotNull(),
            F.concat(F.lit("FAVP="), bands.band_text(F.col("p_band"), PROBABILITY_WIDTH)),
        ),
        F.when(F.col("ah_move_q").isNotNull(), F.format_string("AHMOVE=%+.2f", q("ah_move_q"))),
        F.when(F.col("ou_move_q").isNotNull(), F.format_string("OUMOVE=%+.2f", q("ou_move_q"))),
    ]
    return F.concat_ws("|", *parts)


def class_counts(signs: str, prefix: str) -> list[Column]:
    """Five class counts from the sign sum."""
    return [
        F.count_if(F.col(signs) == 2 - i).alias(f"{prefix}_{c.lower()}") for i, c in enumerate(settlement.CLASSES)
    ]


def counts_of(prefix: str) -> list[str]:
    return [f"{prefix}_{c.lower()}" for c in settlement.CLASSES]


def season_buckets(obs: DataFrame, extra: Sequence[str] = ("split", "season")) -> DataFrame:
    """The finest aggregate; every coarser statistic is a sum of these."""
    return obs.groupBy(*extra, *KEY).agg(
        F.count("*").alias("n"),
        F.sum("ah_profit").alias("ah_profit"),
        F.sum("ou_profit").alias("ou_profit"),
        *class_counts("ah_signs", "ah"),
        *class_counts("ou_signs", "ou"),
    )


def pattern_buckets(rows: DataFrame, extra: Sequence[str], also: dict[str, str] | None = None) -> DataFrame:
    """season_buckets of all families, from rows expanded to the finest families only: the others are sums of those.

    `also` names a value of an extra column under which all buckets are counted once more (a scope over all leagues, say).
    """
    fine = season_buckets(observations(rows, extra, finest=True), extra)
    for c, value in (also or {}).items():
        fine = fine.withColumn(c, F.explode(F.array(F.col(c), F.lit(value))))
    families = reduce(
        lambda acc, kv: acc.when(F.col("family") == kv[0], kv[1]),
        [(f, F.array(F.lit(f), *[F.lit(x) for x in coarser])) for f, coarser in FINEST.items()], F,
    )
    wanted = _moved(fine.withColumn("family", F.explode(families)))
    keys = [c for c in KEY if c not in _TYPES]
    sums = ["n", "ah_profit", "ou_profit", *counts_of("ah"), *counts_of("ou")]
    return roll_up(wanted.select(*extra, *keys, *[_filled(c) for c in _TYPES], *sums), [*extra, *KEY])


def roll_up(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum finer buckets to coarser keys."""
    sums = ["n", "ah_profit", "ou_profit", *counts_of("ah"), *counts_of("ou")]
    return buckets.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def roi(profit: str, n: str = "n") -> Column:
    return rnd(from_micro(F.col(profit)) / F.col(n), 6)


def hierarchical_report(rows: DataFrame, test_seasons: Sequence[str], min_n: int = 20) -> DataFrame:
    """Seven families in one pass, per split."""
    split = F.when(F.col("season").isin(*test_seasons), "test").otherwise("train")
    return (
        pattern_buckets(rows.withColumn("split", split), ["split"])
        .filter(F.col("n") >= min_n)
        .select(
            "split", "family", pattern_text().alias("pattern"), "n",
            roi("ah_profit").alias("ah_roi"), roi("ou_profit").alias("ou_roi"),
            *counts_of("ah"), *counts_of("ou"),
        )
    )


def joint_report(rows: DataFrame, test_seasons: Sequence[str], min_n: int = 20) -> DataFrame:
    """Handicap x total pattern (all bands) per split, with its seasons as one text column."""
    split = F.when(F.col("season").isin(*test_seasons), "test").otherwise("train")
    obs = observations(rows.withColumn("split", split), ["split", "season"]).filter(
        F.col("family") == "AH_OU_PRICE_1X2"
    )
    fine = season_buckets(obs)
    season = F.struct("season", "n", roi("ah_profit").alias("ah_roi"), roi("ou_profit").alias("ou_roi"))
    return (
        fine.withColumn("s", season)
        .groupBy("split", *KEY)
        .agg(
            F.sum("n").alias("n"),
            F.sum("ah_profit").alias("ah_profit"),
            F.sum("ou_profit").alias("ou_profit"),
            F.sort_array(F.collect_list("s")).alias("seasons"),
        )
        .filter(F.col("n") >= min_n)
        .select(
            "split", pattern_text().alias("pattern"), "n",
            roi("ah_profit").alias("ah_roi"), roi("ou_profit").alias("ou_roi"),
            F.array_join(
                F.transform("seasons", lambda s: F.concat_ws(":", s["season"], s["n"].cast("string"))), ","
            ).alias("seasons"),
        )
    )


def stack_markets(buckets: DataFrame, keys: Sequence[str], ou_families_only: bool = True) -> DataFrame:
    """One row per (pattern, market): handicap always, total where the family has one."""
    names = [c.lower() for c in settlement.CLASSES]

    def market(m: str) -> Column:
        return F.struct(
            F.lit(m.upper()).alias("market"),
            F.col(f"{m}_profit").alias("profit"),
            *[F.col(f"{m}_{c}").alias(c) for c in names],
        )

    both = F.array(market("ah"), F.when(~F.col("family").isin(*AH_ONLY), market("ou")))
    return (
        buckets.select(*keys, "n", F.explode(both).alias("m"))
        .filter(F.col("m").isNotNull())
        .select(*keys, "n", "m.*")
    )


def season_stability(n: Column, profit: Column, prefix: str) -> list[Column]:
    """Eligible and positive seasons over season buckets."""
    ok = n >= MIN_SEASON_N
    return [
        F.count_if(ok).alias(f"{prefix}_eligible_seasons"),
        F.count_if(ok & (profit > 0)).alias(f"{prefix}_positive_seasons"),
    ]


def stable(prefix: str) -> Column:
    share = ratio(F.col(f"{prefix}_positive_seasons"), F.col(f"{prefix}_eligible_seasons"))
    return F.coalesce(share >= MIN_POSITIVE_SHARE, F.lit(False))


def phase_label(phases: dict[str, tuple[str, ...]]) -> Column:
    return bands.phase_of(F.col("season"), phases)


def line_roi(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean opening profit by key of settled observations."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rnd(from_micro(F.sum(micro(F.col("profit_units")))) / F.count("*"), 6).alias("opening_flat_stake_roi"),
    )
