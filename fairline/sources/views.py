"""Derived market views over the star-schema test tables.

Whole-number arithmetic first, so that any SQL engine evaluates the same rows. Every view is a
projection or one equi-join; Spark prunes columns back to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions import prices, times
from fairline.session import prepare

# Chronological split of the derived fixtures.
PHASES = {
    "train": ("9495", "9596", "9697", "9798"),
    "validation": ("9899", "9900"),
    "holdout": ("0001", "0102"),
}
TEST_SEASONS = PHASES["validation"] + PHASES["holdout"]
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """One match per order."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    day = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey")
    kickoff_us = F.unix_micros(day) + (F.lit(10) + key % 14) * F.lit(HOUR_US)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("fixture_id"),
            F.col("n_name").alias("league"),
            F.col("n_regionkey").alias("region"),
            F.concat(F.lit("C"), F.col("o_custkey")).alias("home"),
            F.concat(F.lit("V"), (F.col("o_custkey") * 7 + 3) % 1000).alias("away"),
            F.to_date(day).alias("match_day"),
            kickoff_us.alias("kickoff_us"),
            times.season_code(day).alias("season"),
            F.col("o_orderstatus").alias("status"),
            F.substring("o_orderpriority", 1, 1).alias("priority"),
            (key % 5).cast("int").alias("home_goals"),
            (div(key, 5) % 4).cast("int").alias("away_goals"),
        )
    )


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Opening and closing quotes of three markets, one row per line item (no join)."""
    items = table(spark, sf, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    qty = F.col("l_quantity").cast("int")

    def cents(c: Column) -> Column:
        return c.cast("double") / F.lit(100.0)

    drift = qty % 5 - 2
    ah_q = F.col("l_linenumber") - 4
    ou_q = F.lit(8) + F.col("l_linenumber") % 6
    oh, od, oa = F.lit(130) + p % 250, F.lit(280) + s % 100, F.lit(130) + (p * 7) % 250
    ahh, aha = F.lit(150) + p % 101, F.lit(150) + (p * 3 + s) % 101
    over, under = F.lit(150) + (s * 7 + p) % 101, F.lit(150) + (s * 3 + p * 5) % 101
    return items.select(
        F.col("l_orderkey").alias("fixture_id"),
        F.col("l_linenumber").alias("line_no"),
        p.alias("part_id"),
        s.alias("supp_id"),
        qty.alias("qty"),
        F.col("l_returnflag").alias("returnflag"),
        cents(oh).alias("open_h"), cents(od).alias("open_d"), cents(oa).alias("open_a"),
        cents(oh + drift).alias("close_h"), cents(od - drift).alias("close_d"), cents(oa - drift).alias("close_a"),
        (ah_q / F.lit(4.0)).alias("home_line"),
        ((ah_q + qty % 3 - 1) / F.lit(4.0)).alias("close_home_line"),
        cents(ahh).alias("ah_home"), cents(aha).alias("ah_away"),
        cents(ahh + drift).alias("close_ah_home"), cents(aha - drift).alias("close_ah_away"),
        (ou_q / F.lit(4.0)).alias("ou_line"),
        ((ou_q + qty % 2) / F.lit(4.0)).alias("close_ou_line"),
        cents(over).alias("over_price"), cents(under).alias("under_price"),
        cents(over + drift).alias("close_over"), cents(under - drift).alias("close_under"),
    )


def market_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes joined to their fixture, with the favourite view.

    Both sides are large tables keyed by fixture: the join is a shuffle join on the key (bucketed tables
    would avoid the exchange), never a broadcast of either.
    """
    q = quotes(spark, sf)
    f = fixtures(spark, sf).hint("merge")
    fair = prices.devig3(F.col("open_h"), F.col("open_d"), F.col("open_a"))
    fav = F.col("favorite_side")

    def side(home: str, away: str) -> Column:
        return prices.side_view(fav, F.col(home), F.col(away))

    def line_view(home_line: str) -> Column:
        return F.when(fav == "H", F.col(home_line)).otherwise(-F.col(home_line))

    return (
        q.join(f, "fixture_id")
        .withColumn("fair", fair)
        .withColumn("favorite_side", prices.favorite_by_probability(F.col("fair.home"), F.col("fair.away")))
        .withColumn("fair_h", F.col("fair.home"))
        .withColumn("fair_d", F.col("fair.draw"))
        .withColumn("fair_a", F.col("fair.away"))
        .withColumn("overround", F.col("fair.overround"))
        .drop("fair")
        .withColumn("favorite_fair_probability", side("fair_h", "fair_a"))
        .withColumn("favorite_ah_line", line_view("home_line"))
        .withColumn("favorite_ah_price", side("ah_home", "ah_away"))
        .withColumn("favorite_ah_other_price", side("ah_away", "ah_home"))
        .withColumn("favorite_close_line", line_view("close_home_line"))
        .withColumn("favorite_close_price", side("close_ah_home", "close_ah_away"))
        .withColumn("ah_line_move", F.col("favorite_close_line") - F.col("favorite_ah_line"))
        .withColumn("ou_line_move", F.col("close_ou_line") - F.col("ou_line"))
        .withColumn(
            "result",
            F.when(F.col("home_goals") > F.col("away_goals"), "H")
            .when(F.col("home_goals") < F.col("away_goals"), "A")
            .otherwise("D"),
        )
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Quote observations, one per event; some fall after kickoff on purpose."""
    k = F.get_json_object("props", "$.k").cast("int")
    user, eid = F.col("user_id"), F.col("event_id")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    kickoff = (
        F.lit(1_704_067_200_000_000) + (F.lit(10) + user % 20) * F.lit(DAY_US) + F.lit(18 * HOUR_US)
    )
    home_q = k % 9 - 4
    side = F.when((user % 2 == 0) & (k <= 90), "H").otherwise("A")
    home_price = (F.lit(150) + eid % 101).cast("double") / 100.0
    away_price = (F.lit(150) + (eid * 3) % 101).cast("double") / 100.0
    return (
        table(spark, sf, "events")
        .select(
            eid.alias("event_id"),
            user.alias("fixture_id"),
            F.concat(F.lit("L"), (user % 12).cast("string")).alias("league"),
            F.concat(F.lit("T"), user.cast("string")).alias("home"),
            F.concat(F.lit("U"), (user * 3).cast("string")).alias("away"),
            F.col("event_type").alias("provider"),
            F.concat(F.lit("B"), (user % 3).cast("string")).alias("bookmaker"),
            F.when(k % 7 == 0, "UNVERIFIED").otherwise("MAINLINE").alias("source_semantics"),
            (k % 7 != 0).alias("mainline_verified"),
            ts.alias("observed_us"),
            kickoff.alias("kickoff_us"),
            side.alias("favorite_side"),
            (home_q / F.lit(4.0)).alias("home_line"),
            (-home_q / F.lit(4.0)).alias("away_line"),
            home_price.alias("home_price"),
            away_price.alias("away_price"),
            ((F.lit(8) + k % 5) / F.lit(4.0)).alias("ou_line"),
            ((F.lit(160) + k % 81).cast("double") / 100.0).alias("over_price"),
            ((F.lit(160) + (k * 3) % 81).cast("double") / 100.0).alias("under_price"),
            F.col("value"),
            k.alias("k"),
        )
        .withColumn("line", F.when(F.col("favorite_side") == "H", F.col("home_line")).otherwise(F.col("away_line")))
        .withColumn("price", prices.side_view(F.col("favorite_side"), F.col("home_price"), F.col("away_price")))
        .withColumn(
            "fair_probability",
            prices.devig2(F.col("price"), F.when(F.col("favorite_side") == "H", F.col("away_price")).otherwise(F.col("home_price"))).getField("a"),
        )
    )


def snapshot_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result records of the snapshot fixtures, two sources; some missing, some contradicting."""
    c = table(spark, sf, "customer")
    base = c.select(
        F.col("c_custkey").alias("fixture_id"),
        (F.col("c_custkey") % 5).cast("int").alias("ft_home_goals"),
        (div(F.col("c_custkey"), 5) % 4).cast("int").alias("ft_away_goals"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") < 0).alias("overdrawn"),
    )
    sources = F.array(F.lit("S1"), F.lit("S2"))
    return (
        base.filter(F.col("segment") != "HOUSEHOLD")
        .withColumn("result_source", F.explode(sources))
        .withColumn(
            "ft_home_goals",
            F.when(F.col("overdrawn") & (F.col("result_source") == "S2"), F.col("ft_home_goals") + 1).otherwise(
                F.col("ft_home_goals")
            ),
        )
        .drop("segment", "overdrawn")
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Result records of the order fixtures: open orders have none; urgent pending ones contradict themselves."""
    f = fixtures(spark, sf).filter(F.col("status") != "O")
    seq = F.when(F.col("status") == "P", F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    changed = (F.col("priority") == "1") & (F.col("seq") == 2)
    return f.withColumn("seq", F.explode(seq)).select(
        "fixture_id",
        "seq",
        F.concat(F.lit("S"), F.col("seq").cast("string")).alias("result_source"),
        F.when(changed, F.col("home_goals") + 1).otherwise(F.col("home_goals")).alias("ft_home_goals"),
        F.col("away_goals").alias("ft_away_goals"),
    )
