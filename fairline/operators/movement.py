"""Movement between observations of one comparable contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.exact import rnd
from fairline.operators.sequences import _CHUNK, ordered_chunks

CONTRACT = ("provider", "bookmaker", "source_semantics")
FLAT_PRICE = 0.005


def price_move(first: Column, last: Column) -> Column:
    return F.when(F.abs(last - first) < FLAT_PRICE, "PRICE_FLAT").when(last < first, "PRICE_DOWN").otherwise("PRICE_UP")


def line_move(first: Column, last: Column) -> Column:
    return (
        F.when(last == first, "AH_LINE_UNCHANGED").when(last < first, "AH_FAVORITE_LINE_STRONGER").otherwise("AH_FAVORITE_LINE_WEAKER")
    )


def movement_class(side1: Column, side2: Column, l1: Column, l2: Column, p1: Column, p2: Column) -> Column:
    """Class of two states."""
    return (
        F.when(~side1.eqNullSafe(side2), "FAVORITE_SWITCH")
        .when(l1.isNull() | l2.isNull(), "AH_LINE_UNKNOWN")
        .when(p1.isNull() | p2.isNull(), line_move(l1, l2))
        .otherwise(F.concat_ws("__", line_move(l1, l2), price_move(p1, p2)))
    )


def describe(snaps: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per fixture: first and last observation of the latest contract, and the movement class.

    Duplicates of (contract, instant) count once, the latest record wins. Only partial aggregates: per
    (fixture, contract, instant), per (fixture, contract), per fixture.
    """
    fields = ["favorite_side", "line", "price", *carry]
    pre = snaps.filter(F.col("observed_us") < F.col("kickoff_us"))
    instant = pre.groupBy("fixture_id", *CONTRACT, "observed_us", "kickoff_us").agg(
        F.max_by(F.struct("event_id", *fields), "event_id").alias("r")
    )
    state = F.struct("observed_us", F.col("r.event_id").alias("event_id"), "kickoff_us", *[F.col(f"r.{f}").alias(f) for f in fields])
    contract = instant.groupBy("fixture_id", *CONTRACT).agg(
        F.count("*").alias("m"), F.min(state).alias("a"), F.max(state).alias("b")
    )
    order = F.struct(F.col("b.observed_us").alias("t"), F.col("b.event_id").alias("e"))
    fixture = contract.groupBy("fixture_id").agg(
        F.sum("m").alias("total"), F.count("*").alias("contracts"),
        F.max_by(F.struct("m", "a", "b", *CONTRACT), order).alias("x"),
    )
    comparable = F.col("x.m") >= 2
    a, b = (lambda f: F.col(f"x.a.{f}")), (lambda f: F.col(f"x.b.{f}"))
    klass = movement_class(a("favorite_side"), b("favorite_side"), a("line"), b("line"), a("price"), b("price"))
    movement = (
        F.when(F.col("total") == 1, "SINGLE_OBSERVATION")
        .when(~comparable, "SOURCE_SWITCH__INSUFFICIENT_OBSERVATIONS")
        .when(klass != "FAVORITE_SWITCH", F.when(
            a("line").isNull() | b("line").isNull() | a("price").isNull() | b("price").isNull(), "INSUFFICIENT_MARKET_FIELDS"
        ).otherwise(klass))
        .otherwise(klass)
    )
    minutes = lambda later, earlier: rnd((later - earlier) / F.lit(6e7), 3)
    when = lambda c: F.when(comparable, c)
    switch = ~a("favorite_side").eqNullSafe(b("favorite_side"))
    out = fixture.select(
        "fixture_id", movement.alias("movement"),
        F.when(F.col("total") == 1, 0).otherwise(F.col("x.m")).alias("comparable_observations"),
        (F.col("contracts") > 1).alias("source_switch"),
        F.coalesce(when(a("line") != b("line")), F.lit(False)).alias("line_change"),
        F.coalesce(when(F.abs(b("price") - a("price")) >= FLAT_PRICE), F.lit(False)).alias("price_change"),
        F.coalesce(when(switch), F.lit(False)).alias("favorite_switch"),
        when(minutes(b("observed_us"), a("observed_us"))).alias("observation_gap_minutes"),
        when(minutes(a("kickoff_us"), a("observed_us"))).alias("first_minutes_before_kickoff"),
        when(minutes(b("kickoff_us"), b("observed_us"))).alias("last_minutes_before_kickoff"),
        *[a(f).alias(f"first_{f}") for f in fields if f != "favorite_side"],
        *[b(f).alias(f"last_{f}") for f in fields if f != "favorite_side"],
    )
    return out


def features(snaps: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Movement class plus first, last and delta of numeric fields (delta only for comparable, unswitched pairs)."""
    extra = [f for f in fields if f not in ("line", "price")]
    d = describe(snaps, carry=extra)
    ok = F.col("observation_gap_minutes").isNotNull() & ~F.col("favorite_switch")
    return d.select(
        "fixture_id", "movement", "comparable_observations",
        *[F.col(f"first_{f}") for f in fields], *[F.col(f"last_{f}") for f in fields],
        *[F.when(ok, rnd(F.col(f"last_{f}") - F.col(f"first_{f}"), 4)).alias(f"delta_{f}") for f in fields],
    )


def first_latest(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """First and latest record per key, keys with at least two observations."""
    state = F.struct(*order, *[F.col(f) for f in fields if f not in order])
    return (
        rows.groupBy(key)
        .agg(F.count("*").alias("observations"), F.min(state).alias("first"), F.max(state).alias("latest"))
        .filter(F.col("observations") >= 2)
    )


def set_changes(first: Column, latest: Column) -> dict[str, Column]:
    """Persisted, appeared and disappeared members, sorted."""
    return {
        "persisted": F.array_sort(F.array_intersect(first, latest)),
        "appeared": F.array_sort(F.array_except(latest, first)),
        "disappeared": F.array_sort(F.array_except(first, latest)),
    }


def transitions(snaps: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column) -> DataFrame:
    """Distinct consecutive state changes per key: keys, from_state, to_state.

    Ordered chunks as in `sequences`: inside a chunk by lag, across chunks by the head and tail of
    neighbouring chunks. The set of changes per chunk is bounded by the number of state pairs.
    """
    rows = ordered_chunks(snaps.select(*keys, *order, state.alias("_s")), keys, order)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    pair = F.struct(F.lag("_s").over(w).alias("from_state"), F.col("_s").alias("to_state"))
    rows = rows.withColumn("_pair", pair)
    seq = F.struct(*order)
    chunk = rows.groupBy(*keys, _CHUNK).agg(
        F.collect_set(F.when(F.col("_pair.from_state").isNotNull(), F.col("_pair"))).alias("inner"),
        F.min_by("_s", seq).alias("head"), F.max_by("_s", seq).alias("tail"),
    )
    prev = F.lag("tail").over(Window.partitionBy(*keys).orderBy(_CHUNK))
    edge = F.when(prev.isNotNull(), F.array(F.struct(prev.alias("from_state"), F.col("head").alias("to_state"))))
    empty = F.array().cast("array<struct<from_state:string,to_state:string>>")
    return (
        chunk.withColumn("all", F.concat("inner", F.coalesce(edge, empty)))
        .select(*keys, F.explode("all").alias("p"))
        .select(*keys, "p.from_state", "p.to_state")
        .filter(F.col("from_state") != F.col("to_state"))
        .distinct()
    )
