"""Result records: one verified score per fixture, or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("fixture_id").isNotNull() & (F.col("ft_home_goals") >= 0) & (F.col("ft_away_goals") >= 0))


def result_index(rows: DataFrame, order: Sequence[str] = ("result_source",)) -> DataFrame:
    """fixture_id, goals, result_source, ambiguous. Identical records are harmless, different scores are ambiguous.

    Partial aggregation only (min = max of the score), so a fixture with many records is no hot spot.
    """
    score = F.struct("ft_home_goals", "ft_away_goals")
    return (
        valid(rows)
        .groupBy("fixture_id")
        .agg(
            F.min(score).alias("lo"),
            F.max(score).alias("hi"),
            F.max_by("result_source", F.struct(*order)).alias("result_source"),
            F.count("*").alias("records"),
        )
        .select(
            "fixture_id", F.col("lo.ft_home_goals").alias("ft_home_goals"), F.col("lo.ft_away_goals").alias("ft_away_goals"),
            "result_source", "records", (F.col("lo") != F.col("hi")).alias("ambiguous"),
        )
    )


def settled_results(rows: DataFrame) -> DataFrame:
    return result_index(rows).filter(~F.col("ambiguous")).drop("ambiguous", "records")


def merge_results(existing: DataFrame, incoming: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, conflict ledger). An id that ever conflicted is never settled again; the first record wins."""
    tagged = valid(existing.withColumn("_prio", F.lit(0)).unionByName(incoming.withColumn("_prio", F.lit(1))))
    score = F.struct("ft_home_goals", "ft_away_goals")
    first = F.struct("_prio", "result_source", "ft_home_goals", "ft_away_goals")
    g = tagged.groupBy("fixture_id").agg(
        F.min(first).alias("f"), F.min(score).alias("lo"), F.max(score).alias("hi")
    )
    new = g.filter(F.col("lo") != F.col("hi")).select(
        "fixture_id", F.lit("CONFLICTING_EXACT_RESULT_SCORES").alias("reason")
    )
    ledger = conflicts.select("fixture_id", "reason").unionByName(new).distinct()
    kept = (
        g.filter(F.col("lo") == F.col("hi"))
        .select("fixture_id", "f.ft_home_goals", "f.ft_away_goals", "f.result_source")
        .join(conflicts.select("fixture_id").distinct(), "fixture_id", "left_anti")
    )
    return kept, ledger


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write wins per key: max_by of the whole row, so one hot key stays a map-side reduction."""
    payload = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Incoming rows replace existing rows of the same key; within one side the highest `seq` wins."""
    tagged = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return latest_by_key(tagged, keys, [F.col("_src"), F.col(seq)]).drop("_src")


def insert_only(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Existing rows are immutable; a new key takes its lowest `seq`."""
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    payload = F.struct(*[F.col(c) for c in fresh.columns if c not in keys])
    first = fresh.groupBy(*keys).agg(F.min_by(payload, F.col(seq)).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(first)


def exact_union(*parts: DataFrame) -> DataFrame:
    """Union with exact-record removal; records that differ anywhere all stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


def publish_plan(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Each incoming row as NEW, UNCHANGED or CONFLICT against the stored row of its key."""
    old = existing.select(*keys, F.struct(*value).alias("_old"))
    return (
        incoming.join(old, list(keys), "left")
        .withColumn(
            "action",
            F.when(F.col("_old").isNull(), "NEW").when(F.col("_old") == F.struct(*value), "UNCHANGED").otherwise("CONFLICT"),
        )
        .drop("_old")
    )


def maturity_reason(kickoff_us: Column, now_us: Column, hours: int = 3) -> Column:
    return F.when(now_us - kickoff_us < hours * 3_600_000_000, F.lit("NOT_MATURED"))
