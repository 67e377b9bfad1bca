"""Screen of current quotes against validated patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions import prices, settlement
from fairline.functions.lines import quarters
from fairline.functions.reasons import first_reason

# Execution price range, minimum return per phase, window.
MIN_ODDS, MAX_ODDS, MIN_RETURN, FORWARD_DAYS, TOP = 1.80, 2.20, 0.01, 7, 5
MOST_BROADCAST = 200_000  # patterns that travel to the markets; beyond it both sides are shuffled
PHASES = ("train", "validation", "holdout")


def in_window(day: Column, today: Column, days: int = FORWARD_DAYS) -> Column:
    return F.coalesce(day.between(today, F.date_add(today, days)), F.lit(False))


def favorite_view(markets: DataFrame) -> DataFrame:
    """Favourite side, line, prices and fair probability, computed once per market before any pattern is met."""
    side = prices.favorite_by_price(F.col("open_h"), F.col("open_a"))
    home = F.col("m_side") == "H"
    fair = prices.devig3(F.col("open_h"), F.col("open_d"), F.col("open_a"))
    pick = lambda a, b: F.when(home, a).otherwise(b)
    return (
        markets.withColumn("m_side", side)
        .withColumn("m_ah_q", quarters(pick(F.col("home_line"), -F.col("home_line"))))
        .withColumn("m_ou_q", quarters(F.col("ou_line")))
        .withColumn("m_price", pick(F.col("ah_home"), F.col("ah_away")))
        .withColumn("m_other", pick(F.col("ah_away"), F.col("ah_home")))
        .withColumn("m_p", pick(fair["home"], fair["away"]))
    )


# Structure levels of a pattern beyond side and line: which key columns each level fixes.
LEVELS = {0: (), 1: ("ah_b",), 2: ("ou_q",), 3: ("ah_b", "ou_q"), 4: ("ah_b", "ou_q", "ou_side", "ou_b"), 5: ("ah_b", "ou_q", "ou_side", "ou_b", "p_b")}
_TYPES = {"ah_b": "long", "ou_q": "int", "ou_side": "string", "ou_b": "long", "p_b": "long"}
JOIN = ("m_side", "m_ah_q", "level", *_TYPES)


def _level_key(level: int, **values: Column) -> Column:
    """Key struct of one level; columns a level does not fix hold a sentinel so that keys join by equality."""
    none = {"string": F.lit("-")}
    cols = [
        F.coalesce(values[c].cast(t) if c in LEVELS[level] else F.lit(None).cast(t), none.get(t, F.lit(-9999)).cast(t)).alias(c)
        for c, t in _TYPES.items()
    ]
    return F.struct(F.lit(level).alias("level"), *cols)


def banded(markets: DataFrame) -> DataFrame:
    from fairline.functions.bands import edge_band_no
    from fairline.operators.patterns import PRICE_WIDTH, PROBABILITY_WIDTH

    cells = F.struct(
        edge_band_no(F.col("m_price"), PRICE_WIDTH).alias("ah_b"), edge_band_no(F.col("over_price"), PRICE_WIDTH).alias("over_b"),
        edge_band_no(F.col("under_price"), PRICE_WIDTH).alias("under_b"), edge_band_no(F.col("m_p"), PROBABILITY_WIDTH).alias("p_b"),
    )
    # The generator computes the bands once per market; as plain columns they would be merged into every key.
    return favorite_view(markets).withColumn("_b", F.explode(F.array(cells))).select("*", "_b.*").drop("_b")


def _market_keys(levels: Sequence[int]) -> Column:
    out = []
    for lv in levels:
        for s in ("O", "U") if "ou_side" in LEVELS[lv] else ("",):
            ou_b = F.col("over_b") if s == "O" else F.col("under_b")
            out.append(_level_key(lv, ah_b=F.col("ah_b"), ou_q=F.col("m_ou_q"), ou_side=F.lit(s), ou_b=ou_b, p_b=F.col("p_b")))
    return F.explode(F.array(*out))


def _pattern_keys(patterns: DataFrame) -> DataFrame:
    """Final level of every pattern and its ladder of levels with the reason a step rejects."""
    f = {"ah_b": F.col("ah_band"), "ou_q": F.col("ou_q"), "ou_side": F.col("ou_side"), "ou_b": F.col("ou_band"), "p_b": F.col("p_band")}
    has = lambda c: f[c].isNotNull()
    mid = F.when(has("ah_b"), _level_key(3, **f)).otherwise(_level_key(2, **f))
    step = lambda n, key, reason, cond: F.when(cond, F.struct(F.lit(n).alias("step"), F.lit(reason).alias("step_reason"), key.alias("key")))
    ladder = F.array(
        step(0, _level_key(0), "", F.lit(True)),
        step(1, _level_key(1, **f), "AH_PRICE_STRUCTURE_MISMATCH", has("ah_b")),
        step(2, mid, "OU_LINE_MISMATCH", has("ou_q")),
        step(3, _level_key(4, **f), "OU_PRICE_STRUCTURE_MISMATCH", has("ou_b")),
        step(4, _level_key(5, **f), "1X2_STRUCTURE_MISMATCH", has("p_b")),
    )
    return patterns.select(
        "pattern_id", F.col("favorite_side").alias("m_side"), F.col("ah_q").alias("m_ah_q"), F.explode(ladder).alias("_s")
    ).filter(F.col("_s").isNotNull()).select("pattern_id", "m_side", "m_ah_q", "_s.step", "_s.step_reason", *[F.col(f"_s.key.{c}").alias(c) for c in ("level", *_TYPES)])


def structural_rejections(markets: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, reason, n: markets on the pattern's side and line that fail a later structure step.

    The ladder is nested, so a step's rejections are the difference of two counts. Counts come from grid cells
    (one partial aggregate over the markets); no market meets a pattern it does not match.
    """
    cells = banded(markets).groupBy("m_side", "m_ah_q", "ah_b", "m_ou_q", "over_b", "under_b", "p_b").agg(F.count("*").alias("c"))
    counts = (
        cells.select("m_side", "m_ah_q", "c", _market_keys(list(LEVELS)).alias("k")).select("m_side", "m_ah_q", "c", "k.*")
        .groupBy(*JOIN).agg(F.sum("c").alias("n"))
    )
    steps = _pattern_keys(patterns).join(counts, list(JOIN), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("pattern_id").orderBy("step")
    return steps.withColumn("lost", F.lag("n").over(w) - F.col("n")).filter(F.col("lost") > 0).select(
        "pattern_id", F.col("step_reason").alias("reason"), F.col("lost").alias("n")
    )


def candidates(markets: DataFrame, patterns: DataFrame, min_return: float = MIN_RETURN) -> DataFrame:
    """Markets that have a pattern's structure, with the price and return reason (null reason: eligible).

    Each market carries its few structure keys and joins the patterns by equality on the full key, so the work grows
    with the matches and not with markets x patterns. The patterns are counted: up to MOST_BROADCAST of them go to the
    markets, which are then not shuffled. Structure rejections are counted by structural_rejections.
    """
    last = _pattern_keys(patterns).groupBy("pattern_id").agg(F.max_by(F.struct(*JOIN), "step").alias("j")).select("pattern_id", "j.*")
    k = patterns.select(*[F.col(c).alias(f"k_{c}") for c in patterns.columns]).join(
        last.select(F.col("pattern_id").alias("k_pattern_id"), *JOIN), "k_pattern_id"
    )
    keyed = banded(markets).withColumn("key", _market_keys([0, 2, 3, 4, 5]))
    keep = [c for c in keyed.columns if c not in ("key", *_TYPES)]
    keyed = keyed.select(*keep, *[F.col(f"key.{c}").alias(c) for c in ("level", *_TYPES)])
    few = patterns.count() <= MOST_BROADCAST
    j = keyed.join(F.broadcast(k) if few else k.hint("merge"), list(JOIN))
    is_ah, over = F.col("k_market") == "AH", F.col("k_ou_side") == "O"
    own = F.when(is_ah, F.col("m_price")).when(over, F.col("over_price")).otherwise(F.col("under_price"))
    other = F.when(is_ah, F.col("m_other")).when(over, F.col("under_price")).otherwise(F.col("over_price"))
    j = j.withColumn("target_odds", own).withColumn("opposite_odds", other)
    for ph in PHASES:
        dist = {c: F.col(f"k_{ph}_{c.lower()}") for c in settlement.CLASSES}
        j = j.withColumn(f"{ph}_ev", settlement.expected_return(dist, F.col("target_odds")))
    evs = [F.col(f"{ph}_ev") for ph in PHASES]
    missing = evs[0].isNull() | evs[1].isNull() | evs[2].isNull()
    reason = first_reason([
        (F.col("target_odds").isNull() | F.col("opposite_odds").isNull(), "MARKET_PRICE_INCOMPLETE"),
        (~F.col("target_odds").between(MIN_ODDS, MAX_ODDS), "PRICE_OUT_OF_RANGE"),
        (missing, "SETTLEMENT_DISTRIBUTION_MISSING"),
        (F.least(*evs) < min_return, "EDGE_ERODED"),
    ])
    fair = prices.devig2(F.col("target_odds"), F.col("opposite_odds"))
    return (
        j.withColumn("min_phase_ev", F.least(*evs))
        .withColumn("reason", reason)
        .withColumn("fair_probability", fair["a"])
        .withColumn("market_overround", fair["overround"])
    )


def screen_counts(markets: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, reason, n over all markets on a pattern's side and line; ELIGIBLE included."""
    matched = candidates(markets, patterns).groupBy(
        F.col("k_pattern_id").alias("pattern_id"), F.coalesce("reason", F.lit("ELIGIBLE")).alias("reason")
    ).agg(F.count("*").alias("n"))
    return matched.unionByName(structural_rejections(markets, patterns))


def screen_table(audit: DataFrame) -> DataFrame:
    """Audit rows as the pattern table of the screen."""
    names = [c.lower() for c in settlement.CLASSES]
    return audit.select(
        F.concat_ws("::", "market", "pattern").alias("pattern_id"), "market", "favorite_side", "ah_q", "ou_side", "ou_q",
        "ah_band", "ou_band", "p_band", "holdout_n", "q_validation_bh", *[f"{ph}_{c}" for ph in PHASES for c in names],
    )


def top(eligible: DataFrame, ids: Sequence[str], k: int = TOP) -> DataFrame:
    """Best candidates by worst-phase return, holdout size, q; a bounded top-k per partition, then merged."""
    return eligible.filter(F.col("reason").isNull()).orderBy(
        F.desc("min_phase_ev"), F.desc("k_holdout_n"), F.asc("k_q_validation_bh"), *ids
    ).limit(k)
