"""Constraint suites over tables: each rule yields its violations, all rules share one report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def unique(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    return _report(df.groupBy(*keys).count().filter("count > 1"), rule, F.concat_ws("|", *keys))


def foreign_key(df: DataFrame, rule: str, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    ids = parent.select(F.col(parent_col).alias(col)).distinct()
    return _report(df.filter(F.col(col).isNotNull()).join(ids, col, "left_anti"), rule, F.col(col))


def matches(df: DataFrame, rule: str, key: str, ok: Column) -> DataFrame:
    return _report(df.filter(~F.coalesce(ok, F.lit(False))), rule, F.col(key))


def pattern(df: DataFrame, rule: str, col: str, regex: str) -> DataFrame:
    return matches(df, rule, col, F.col(col).rlike(regex))


def multiset_equal(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """Rows that occur more often on one side, counted once per distinct row (union + one aggregate)."""
    cols = a.columns
    u = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    return _report(u.groupBy(*cols).agg(F.sum("_d").alias("_d")).filter("_d <> 0"), rule, F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def count_equals(df: DataFrame, rule: str, group: str, expected: DataFrame, expected_col: str) -> DataFrame:
    """Group counts that differ from the declared counts, missing groups included."""
    got = df.groupBy(group).count()
    j = expected.select(group, expected_col).join(got, group, "full")
    return _report(j.filter(F.coalesce("count", F.lit(0)) != F.coalesce(F.col(expected_col), F.lit(0))), rule, F.col(group))


def run(*violations: DataFrame) -> DataFrame:
    """All violations of a suite: rule, key."""
    return reduce(lambda x, y: x.unionByName(y), violations)


def summary(violations: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Every rule with its violation count, PASS or FAIL; rules without violations stay visible."""
    n = violations.groupBy("rule").agg(F.count("*").alias("violations"))
    spark = violations.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
    return names.join(n, "rule", "left").select(
        "rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.when(F.col("violations") > 0, "FAIL").otherwise("PASS").alias("status")
    )


def full_compare(old: DataFrame, new: DataFrame, keys: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Publication guard: each key as UNCHANGED, CHANGED, REMOVED or ADDED."""
    a = old.select(*keys, F.struct(*value).alias("_a"))
    b = new.select(*keys, F.struct(*value).alias("_b"))
    state = (
        F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("_a") == F.col("_b"), "UNCHANGED").otherwise("CHANGED")
    )
    return a.join(b, list(keys), "full").select(*keys, state.alias("state"))


def publication_guard(old: DataFrame, new: DataFrame, keys: Sequence[str], value: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Per scope (some of the keys) what a load would do and why it may not be published; a null reason lets it through."""
    count = lambda s: F.count_if(F.col("state") == s.upper()).alias(s)
    n = full_compare(old, new, keys, value).groupBy(*scope).agg(*[count(s) for s in ("unchanged", "added", "removed", "changed")])
    return n.withColumn("reason", F.when(F.col("removed") > 0, "RETAINED_RESULT_REMOVED").when(F.col("changed") > 0, "RETAINED_RESULT_CHANGED"))


def roster_change(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = before.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, list(keys), "full").select(
        *keys, F.when(F.col("_a").isNull(), "JOINED").when(F.col("_b").isNull(), "LEFT").otherwise("STAYED").alias("change")
    )
