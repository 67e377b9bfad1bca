"""As-of joins without pair explosion.

Each form first reduces the many quotes to one state per small key with partial aggregation, and only then
meets the few probes. A fixture that holds a third of the quotes is reduced in many tasks before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.operators.sequences import _CHUNK, ordered_chunks
from fairline.session import cut


def last_before_kickoff(entries: DataFrame, quotes: DataFrame, payload: Sequence[str], tie: str) -> DataFrame:
    """Latest quote in [entry, kickoff) of the entry's fixture.

    The latest quote before kickoff does not depend on the entry; it qualifies iff it is not older than the
    entry. So: one max per fixture, then an ordinary equi-join.
    """
    value = F.struct("observed_us", tie, *[F.col(c) for c in payload])
    close = (
        quotes.filter(F.col("observed_us") < F.col("kickoff_us"))
        .groupBy("fixture_id", "kickoff_us")
        .agg(F.max(value).alias("close"))
    )
    joined = entries.join(close, ["fixture_id", "kickoff_us"], "left")
    return joined.withColumn("close", F.when(F.col("close.observed_us") >= F.col("entry_us"), F.col("close")))


def slot_states(
    ticks: DataFrame, slots: DataFrame, series: Sequence[str], fixture: str = "fixture_id",
    time: str = "created_us", state: Sequence[str] = ("price", "active"),
) -> DataFrame:
    """State of every series at every slot of its fixture: latest tick <= slot, with a tie check.

    slots: one row per fixture with `slots`, a sorted array of instants (a schedule, hence short).
    A tick belongs to the first slot at or after it; the maximum per (series, slot) is a partial aggregate,
    and a window over the few slots of a series carries the last state forward.
    Returns series, slot_us, at_us (null without history), state columns, ambiguous.
    """
    full = F.struct(*state)
    placed = (
        ticks.join(slots.select(fixture, "slots"), fixture)
        .withColumn("pos", F.size(F.filter("slots", lambda s: s < F.col(time))))
        .withColumn("slot_us", F.get("slots", F.col("pos")))
        .filter(F.col("slot_us").isNotNull())
    )
    per_time = placed.groupBy(*series, "slot_us", time).agg(F.min(full).alias("lo"), F.max(full).alias("hi"))
    latest = per_time.groupBy(*series, "slot_us").agg(
        F.max(F.struct(F.col(time).alias("at_us"), "lo", "hi")).alias("s")
    )
    grid = (
        ticks.select(*series).distinct().join(slots, fixture).select(*series, F.explode("slots").alias("slot_us"))
    )
    order = Window.partitionBy(*series).orderBy("slot_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        grid.join(latest, [*series, "slot_us"], "left")
        .withColumn("s", F.last("s", ignorenulls=True).over(order))
        .select(
            *series, "slot_us", F.col("s.at_us").alias("at_us"),
            *[F.col(f"s.lo.{c}").alias(c) for c in state],
            (F.col("s.lo") != F.col("s.hi")).alias("ambiguous"),
        )
    )


def slot_reason(max_age_seconds: int = 3600) -> Column:
    """Status of one side at one slot; the latest state wins, also when it is inactive or invalid."""
    from fairline.functions.reasons import first_reason, truly

    return first_reason(
        [
            (F.col("at_us").isNull(), "NO_HISTORICAL_DATA"),
            (truly(F.col("ambiguous")), "AMBIGUOUS_LATEST_STATE"),
            (~truly(F.col("active")), "INACTIVE_OR_UNKNOWN"),
            (~(F.col("price") > 1) | F.col("price").isNull(), "INVALID_PRICE"),
            (F.col("slot_us") - F.col("at_us") > max_age_seconds * 1_000_000, "STALE_QUOTE"),
        ],
        accepted="COMPLETE",
    )


def nearest_prior(
    probes: DataFrame, quotes: DataFrame, keys: Sequence[str], probe_us: str, quote_us: str,
    payload: Sequence[str], max_age_us: int, probe_id: str,
) -> DataFrame:
    """Nearest quote at or before each probe within max_age; differing quotes at that instant are ambiguous.

    Quotes (one state per instant) and probes are merged into one time order, cut into ordered chunks, and the
    last quote state is carried forward inside and across chunks. No pair is ever formed, so a hot key costs
    no more than its rows. The chunked order is checkpointed because two branches read its tags.
    """
    state = F.struct(*payload)
    q = quotes.groupBy(*keys, F.col(quote_us).alias("_t")).agg(F.min(state).alias("lo"), F.max(state).alias("hi"))
    q = q.select(*keys, "_t", F.lit(0).alias("_kind"), F.struct(F.col("_t").alias("at_us"), "lo", "hi").alias("_q"))
    p = probes.select(*keys, F.col(probe_us).alias("_t"), F.lit(1).alias("_kind"), probe_id)
    merged = q.unionByName(p, allowMissingColumns=True)
    chunks = cut(ordered_chunks(merged, keys, ["_t", "_kind"]))
    order = Window.partitionBy(*keys, _CHUNK).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = chunks.withColumn("_near", F.last("_q", ignorenulls=True).over(order)).filter(F.col("_kind") == 1)
    tails = chunks.groupBy(*keys, _CHUNK).agg(F.max("_q").alias("_tail"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*keys, _CHUNK, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    near = here.join(tails, [*keys, _CHUNK], "left").withColumn("m", F.coalesce("_near", "_carry"))
    near = near.withColumn("m", F.when(F.col("_t") - F.col("m.at_us") <= max_age_us, F.col("m"))).select(probe_id, "m")
    status = (
        F.when(F.col("m").isNull(), "NO_CANDIDATE").when(F.col("m.lo") != F.col("m.hi"), "AMBIGUOUS_NEAREST").otherwise("RECOVERED")
    )
    return probes.join(near, probe_id).select(
        *probes.columns, status.alias("status"), F.col("m.at_us").alias("at_us"),
        *[F.when(status == "RECOVERED", F.col(f"m.lo.{c}")).alias(f"recovered_{c}") for c in payload],
    )
