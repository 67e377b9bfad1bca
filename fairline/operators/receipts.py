"""Selection of stored responses and receipts, field contracts, catalog gaps and changes of proofs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import names


def newest(rows: DataFrame, keys: Sequence[str], usable: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The newest usable row of each key: one map-side combined maximum, ties by the later columns of `order`."""
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return rows.filter(usable).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def required_fields(item: dict[str, Column]) -> Column:
    """First broken rule of an evidence item, VALID if none: fields there, whole scores, https source, final."""
    def blank(x: Column) -> Column:
        return x.isNull() | (x.cast("string") == "")

    fields = ("fixture_id", "home", "away", "kickoff", "ft_home_goals", "ft_away_goals", "source_url", "retrieved_at")
    missing = blank(item[fields[0]])
    for f in fields[1:]:
        missing = missing | blank(item[f])
    return (
        F.when(missing, "MISSING_REQUIRED_FIELD").when(F.least(item["ft_home_goals"], item["ft_away_goals"]) < 0, "INVALID_FT_SCORE")
        .when(~item["source_url"].startswith("https://"), "INVALID_SOURCE_URL").when(F.coalesce(F.upper(item["status"]), F.lit("")) != "FT", "RESULT_NOT_FINAL").otherwise("VALID")
    )


def gap_classes(observed: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """class, ids, observations: observed ids in the catalog, missing inside its range, or beyond it."""
    counts = observed.groupBy(key).agg(F.count("*").alias("n"))
    top = catalog.agg(F.max(key).alias("m")).first()["m"]  # one value
    j = counts.join(catalog.select(key, F.lit(True).alias("_in")).distinct(), key, "left")
    gap = F.when(F.col("_in"), "KNOWN").when(F.col(key) <= F.lit(top), "MISSING_IN_RANGE").otherwise("BEYOND_CATALOG")
    return j.groupBy(gap.alias("class")).agg(F.count("*").alias("ids"), F.sum("n").alias("observations"))


def same_team_in_league(left: Column, right: Column, league: Column) -> Column:
    """Overlapping aliases, or equal keys once the league's age group is put after one of them."""
    def same(x: Column) -> Column:
        a, b, age = x["a"], x["b"], x["age"]
        with_age = age.isNotNull() & ((a == F.concat(b, age)) | (b == F.concat(a, age)))
        return F.arrays_overlap(names.alias_options(a), names.alias_options(b)) | F.coalesce(with_age, F.lit(False))

    keys = F.struct(names.alnum_key(left).alias("a"), names.alnum_key(right).alias("b"), names.age_token(league).alias("age"))
    return F.get(F.transform(F.array(keys), same), F.lit(0))  # the keys are computed once


def proof_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, state for every id proven before: KEPT or LOST by the extra evidence; NEW if proven only now."""
    a = before.filter("proven").select(key, F.lit(True).alias("_a"))
    b = after.filter("proven").select(key, F.lit(True).alias("_b"))
    return a.join(b, key, "full").select(key, F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "LOST").otherwise("KEPT").alias("state"))
