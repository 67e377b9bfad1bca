"""Are staged leagues ready: identities of leagues and clubs against a day's schedule and the price receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def club_owners(clubs: DataFrame) -> DataFrame:
    """provider_id, club_id, names of verified clubs; a provider id with two owners has none."""
    v = clubs.filter(F.col("verified") & F.col("provider_id").isNotNull()).groupBy("provider_id")
    return v.agg(F.count_distinct("club_id").alias("_n"), F.min("club_id").alias("club_id"), F.first("names").alias("names")).filter("_n = 1").drop("_n")


def fixture_failures(competitions: DataFrame, alternatives: DataFrame, clubs: DataFrame, members: DataFrame, schedule: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """competition_id, fixture_id, tournament_id, reasons (sorted, empty if the fixture maps) of the schedule's fixtures in the window.

    competitions: competition_id, provider_id, verified; alternatives: competition_id, provider_id, provider_name; members:
    competition_id, club_id; schedule: fixture_id, tournament_id, tournament_name, kickoff_us and id1, name1, id2, name2.
    Versions of a fixture that differ are a conflict; the smallest stands for it. No name is matched but exactly.
    """
    version = F.struct("kickoff_us", "tournament_id", "tournament_name", "id1", "name1", "id2", "name2")
    one = schedule.withColumn("_v", version).groupBy("fixture_id").agg(F.min("_v").alias("v"), (~F.min("_v").eqNullSafe(F.max("_v"))).alias("conflict"))
    # candidates first: the smallest version inside the window and under one of the league's ids
    names = alternatives.groupBy("competition_id", F.col("provider_id").alias("tournament_id")).agg(F.collect_set("provider_name").alias("expected"))
    inside = schedule.filter((F.col("kickoff_us") >= start_us) & (F.col("kickoff_us") < end_us)).join(names, "tournament_id")
    first = inside.withColumn("_v", version).groupBy("competition_id", "fixture_id").agg(F.min(F.struct("_v", "expected")).alias("f")).select("competition_id", "fixture_id", "f._v.*", "f.expected")
    j = first.join(one.select("fixture_id", "conflict"), "fixture_id", "left").join(competitions.select("competition_id", F.col("provider_id").alias("own"), "verified"), "competition_id")
    owner = club_owners(clubs)
    roster = members.select("competition_id", "club_id").distinct().withColumn("_in", F.lit(True))
    for side in ("1", "2"):
        j = j.join(owner.select(F.col("provider_id").alias(f"id{side}"), F.col("club_id").alias(f"club{side}"), F.col("names").alias(f"names{side}")), f"id{side}", "left")
        j = j.join(roster.withColumnsRenamed({"club_id": f"club{side}", "_in": f"in{side}"}), ["competition_id", f"club{side}"], "left")
    when = lambda cond, reason: F.when(F.coalesce(cond, F.lit(False)), F.lit(reason))

    def of_side(s: str) -> list[Column]:
        club, there = F.col(f"club{s}"), F.col(f"in{s}").isNotNull()
        renamed = club.isNotNull() & there & ~F.coalesce(F.array_contains(f"names{s}", F.col(f"name{s}")), F.lit(False))
        return [when(club.isNull(), f"UNVERIFIED_PARTICIPANT_{s}"), when(club.isNotNull() & ~there, f"PARTICIPANT_OUTSIDE_CURRENT_ROSTER_{s}"), when(renamed, f"PROVIDER_NAME_CHANGED_{s}")]

    twice = F.col("id1").eqNullSafe(F.col("id2")) | (F.col("club1") == F.col("club2"))
    reasons = F.array_sort(F.array_compact(F.array(
        when(F.col("conflict"), "CONFLICTING_FIXTURE_VERSIONS"), when(~(F.coalesce("verified", F.lit(False)) & F.col("own").eqNullSafe(F.col("tournament_id"))), "COMPETITION_ID_UNVERIFIED"),
        when(~F.coalesce(F.array_contains("expected", F.col("tournament_name")), F.lit(False)), "PROVIDER_COMPETITION_NAME_CHANGED"), *of_side("1"), *of_side("2"), when(twice, "DUPLICATE_SIDE_IDENTITY"),
    )))
    return j.select("competition_id", "fixture_id", "tournament_id", reasons.alias("reasons"))


def league_readiness(competitions: DataFrame, clubs: DataFrame, members: DataFrame, failures: DataFrame, requested: DataFrame, prices: DataFrame, received: bool, complete: bool) -> DataFrame:
    """One row a league: its roster's identities, fixtures returned and mapped, schedule status, price status.

    requested: tournament_id of odds requests in time; prices: fixture_id, tournament_id of valid observations.
    received, complete: whether a schedule response came and is known to be whole. No league is activated by this.
    """
    known = members.join(clubs.select("club_id", (F.col("verified") & F.col("provider_id").isNotNull()).alias("ok")), "club_id", "left")
    roster = known.groupBy("competition_id").agg(F.count_distinct("club_id").alias("clubs"), F.count_distinct(F.when(F.col("ok"), F.col("club_id"))).alias("mapped_clubs"))
    good = F.size("reasons") == 0
    fixtures = failures.groupBy("competition_id").agg(F.count("*").alias("returned"), F.count_if(good).alias("matched"))
    asked = requested.select("tournament_id").distinct().withColumn("asked", F.lit(True))
    own = competitions.withColumn("eligible", F.when(F.col("verified"), F.col("provider_id")))
    priced = failures.filter(good).select("competition_id", "fixture_id").join(own.select("competition_id", F.col("eligible").alias("tournament_id")), "competition_id").join(prices.select("fixture_id", "tournament_id").distinct(), ["fixture_id", "tournament_id"])
    priced = priced.groupBy("competition_id").agg(F.count_distinct("fixture_id").alias("priced"))
    j = own.join(roster, "competition_id", "left").join(fixtures, "competition_id", "left").join(priced, "competition_id", "left").join(asked.withColumnRenamed("tournament_id", "eligible"), "eligible", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    ok = F.coalesce(F.col("verified") & F.col("provider_id").isNotNull(), F.lit(False))
    status = (
        F.when(F.lit(not received), "WAITING_FIXTURE_RESPONSE").when(n("matched") < n("returned"), "FIXTURE_MAPPING_BLOCKED").when(F.lit(not complete), "PARTIAL_FIXTURE_RESPONSE")
        .when(n("returned") == 0, "NO_FIXTURES_RETURNED_NOT_PROOF_OF_NO_MATCHES").otherwise("RETURNED_FIXTURE_IDENTITIES_MATCHED")
    )
    price = F.when(n("priced") > 0, "VALID_ODDS_OBSERVED").when(F.col("asked"), "REQUESTED_NO_VALID_ODDS_OBSERVED").otherwise("NOT_REQUESTED_FOR_EXPANSION")
    return j.select(
        "competition_id", ok.alias("identity_verified"), n("clubs").alias("clubs"), n("mapped_clubs").alias("mapped_clubs"), (ok & (n("clubs") > 0) & (n("clubs") == n("mapped_clubs"))).alias("roster_verified"),
        n("returned").alias("returned"), n("matched").alias("matched"), n("priced").alias("priced"), status.alias("schedule_status"), price.alias("price_status"),
    )
