"""Readiness of staged leagues."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import readiness
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col
START, END = 880_000_000_000_000, 950_000_000_000_000  # the window of the schedule, in microseconds

# A league per nation, a club per customer, a schedule of the orders; every third league is quiet, the rest has each kind of damage somewhere.
_SCHED = """comp AS (SELECT n_nationkey AS competition_id, 't' || n_nationkey AS provider_id, n_nationkey % 6 <> 0 AS verified FROM nation),
alt AS (SELECT n_nationkey AS competition_id, 't' || n_nationkey AS provider_id, n_name AS provider_name FROM nation UNION ALL SELECT n_nationkey, 'alt' || n_nationkey, n_name FROM nation WHERE n_nationkey % 5 = 0),
club AS (SELECT c_custkey AS club_id, 'p' || c_custkey AS provider_id, c_custkey % 40 <> 0 OR c_nationkey % 2 = 0 AS verified, c_name AS nm, c_nationkey AS competition_id FROM customer),
ends AS (SELECT competition_id, MIN(club_id) AS lo, MAX(club_id) AS hi FROM club GROUP BY ALL),
raw AS (SELECT o_orderkey AS i, o_custkey AS h, c_name AS hn, c_nationkey AS nat, n_name, epoch_us(o_orderdate) AS kickoff_us, CASE WHEN o_custkey = e.lo THEN e.hi ELSE e.lo END AS a, x.lo AS foreign_club FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN ends e ON e.competition_id = c_nationkey LEFT JOIN ends x ON x.competition_id = (c_nationkey + 1) % 25 WHERE c_nationkey % 3 <> 0),
away AS (SELECT raw.*, CASE WHEN nat % 3 = 2 THEN i % 31 ELSE 99 END AS d FROM raw),
s0 AS (SELECT i AS fixture_id, CASE WHEN d = 1 THEN 'alt' || nat ELSE 't' || nat END AS tournament_id, CASE WHEN d = 2 THEN 'Renamed' ELSE n_name END AS tournament_name, kickoff_us, 'p' || h AS id1, CASE WHEN d = 3 THEN upper(hn) ELSE hn END AS name1,
  CASE d WHEN 4 THEN 'p?' WHEN 5 THEN 'p' || foreign_club WHEN 6 THEN 'p' || h ELSE 'p' || a END AS id2, CASE WHEN d = 6 THEN h WHEN d = 5 THEN foreign_club ELSE a END AS c2, d FROM away),
sched AS (SELECT s0.* EXCLUDE (c2), club.nm AS name2 FROM s0 JOIN club ON club.club_id = s0.c2), versions AS (SELECT * FROM sched UNION ALL SELECT * REPLACE (kickoff_us + 3600000000 AS kickoff_us) FROM sched WHERE d = 7)"""
_FAIL = f"""own AS (SELECT * FROM club WHERE verified), per AS (SELECT fixture_id, COUNT(DISTINCT kickoff_us) > 1 AS conflict FROM versions GROUP BY fixture_id),
f1 AS (SELECT alt.competition_id, alt.provider_name, v.* FROM versions v JOIN alt ON alt.provider_id = v.tournament_id WHERE kickoff_us >= {START} AND kickoff_us < {END} QUALIFY row_number() OVER (PARTITION BY alt.competition_id, fixture_id ORDER BY kickoff_us) = 1),
fail AS (SELECT f1.competition_id, fixture_id, tournament_id, array_to_string(list_sort(list_filter([CASE WHEN conflict THEN 'CONFLICTING_FIXTURE_VERSIONS' END, CASE WHEN NOT (comp.verified AND comp.provider_id = tournament_id) THEN 'COMPETITION_ID_UNVERIFIED' END,
  CASE WHEN tournament_name <> f1.provider_name THEN 'PROVIDER_COMPETITION_NAME_CHANGED' END, CASE WHEN o1.club_id IS NULL THEN 'UNVERIFIED_PARTICIPANT_1' WHEN o1.competition_id <> f1.competition_id THEN 'PARTICIPANT_OUTSIDE_CURRENT_ROSTER_1' WHEN o1.nm <> name1 THEN 'PROVIDER_NAME_CHANGED_1' END,
  CASE WHEN o2.club_id IS NULL THEN 'UNVERIFIED_PARTICIPANT_2' WHEN o2.competition_id <> f1.competition_id THEN 'PARTICIPANT_OUTSIDE_CURRENT_ROSTER_2' WHEN o2.nm <> name2 THEN 'PROVIDER_NAME_CHANGED_2' END, CASE WHEN id1 = id2 THEN 'DUPLICATE_SIDE_IDENTITY' END], lambda x: x IS NOT NULL)), ',') AS reasons
  FROM f1 JOIN per USING (fixture_id) JOIN comp ON comp.competition_id = f1.competition_id LEFT JOIN own o1 ON o1.provider_id = id1 LEFT JOIN own o2 ON o2.provider_id = id2)"""


def _staged(spark, sf):
    nation, customer = V.table(spark, sf, "nation"), V.table(spark, sf, "customer")
    say = lambda word, x: F.concat(F.lit(word), x.cast("string"))
    n = c("n_nationkey")
    competitions = nation.select(n.alias("competition_id"), say("t", n).alias("provider_id"), (n % 6 != 0).alias("verified"))
    alternatives = nation.select(n.alias("competition_id"), say("t", n).alias("provider_id"), c("n_name").alias("provider_name")).union(nation.filter(n % 5 == 0).select(n, say("alt", n), "n_name"))
    k = c("c_custkey")
    clubs = customer.select(k.alias("club_id"), say("p", k).alias("provider_id"), ((k % 40 != 0) | (c("c_nationkey") % 2 == 0)).alias("verified"), F.array("c_name").alias("names"))
    members = customer.select(c("c_nationkey").alias("competition_id"), k.alias("club_id"))
    ends = members.groupBy("competition_id").agg(F.min("club_id").alias("lo"), F.max("club_id").alias("hi"))
    nat = c("c_nationkey")
    raw = V.table(spark, sf, "orders").join(customer, c("o_custkey") == k).join(nation, n == nat).filter(nat % 3 != 0).join(ends, c("competition_id") == nat)
    raw = raw.join(ends.select(c("competition_id").alias("next"), c("lo").alias("foreign_club")), c("next") == (nat + 1) % 25, "left")
    d = F.when(nat % 3 == 2, c("o_orderkey") % 31).otherwise(99)
    other = F.when(d == 6, c("o_custkey")).when(d == 5, c("foreign_club")).when(c("o_custkey") == c("lo"), c("hi")).otherwise(c("lo"))
    s = raw.select(
        c("o_orderkey").alias("fixture_id"), F.when(d == 1, say("alt", nat)).otherwise(say("t", nat)).alias("tournament_id"), F.when(d == 2, "Renamed").otherwise(c("n_name")).alias("tournament_name"), F.unix_micros(c("o_orderdate").cast("timestamp")).alias("kickoff_us"),
        say("p", c("o_custkey")).alias("id1"), F.when(d == 3, F.upper("c_name")).otherwise(c("c_name")).alias("name1"), F.when(d == 4, "p?").otherwise(say("p", other)).alias("id2"), other.alias("c2"), d.alias("d"))
    s = s.join(customer.select(k.alias("c2"), c("c_name").alias("name2")), "c2").drop("c2")
    schedule = s.union(s.filter("d = 7").withColumn("kickoff_us", c("kickoff_us") + V.HOUR_US)).drop("d")
    return competitions, alternatives, clubs, members, schedule


@query("JON-27", sql=f"""WITH {_SCHED}, {_FAIL}, roster AS (SELECT competition_id, COUNT(*) AS clubs, COUNT(*) FILTER (verified) AS mapped FROM club GROUP BY ALL), fx AS (SELECT competition_id, COUNT(*) AS returned, COUNT(*) FILTER (reasons = '') AS matched FROM fail GROUP BY ALL),
price AS (SELECT fail.competition_id, COUNT(DISTINCT fixture_id) AS priced FROM fail JOIN comp USING (competition_id) JOIN lineitem ON l_orderkey = fixture_id WHERE reasons = '' AND verified AND l_returnflag = 'A' AND fail.competition_id % 4 <> 0 GROUP BY ALL)
SELECT competition_id, verified AS identity_verified, coalesce(clubs, 0) AS clubs, coalesce(mapped, 0) AS mapped_clubs, verified AND coalesce(clubs = mapped, false) AS roster_verified, coalesce(returned, 0) AS returned, coalesce(matched, 0) AS matched, coalesce(priced, 0) AS priced,
  CASE WHEN coalesce(matched, 0) < coalesce(returned, 0) THEN 'FIXTURE_MAPPING_BLOCKED' WHEN coalesce(returned, 0) = 0 THEN 'NO_FIXTURES_RETURNED_NOT_PROOF_OF_NO_MATCHES' ELSE 'RETURNED_FIXTURE_IDENTITIES_MATCHED' END AS schedule_status,
  CASE WHEN priced > 0 THEN 'VALID_ODDS_OBSERVED' WHEN verified AND competition_id % 7 <> 0 THEN 'REQUESTED_NO_VALID_ODDS_OBSERVED' ELSE 'NOT_REQUESTED_FOR_EXPANSION' END AS price_status
FROM comp LEFT JOIN roster USING (competition_id) LEFT JOIN fx USING (competition_id) LEFT JOIN price USING (competition_id)""")
def jon_27(spark, sf):
    """Every staged league: identities of its roster, its fixtures in the schedule and the prices seen for them."""
    competitions, alternatives, clubs, members, schedule = _staged(spark, sf)
    failures = readiness.fixture_failures(competitions, alternatives, clubs, members, schedule, START, END)
    requested = competitions.filter(c("competition_id") % 7 != 0).select(c("provider_id").alias("tournament_id"))
    seen = V.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(c("l_orderkey").alias("fixture_id"))
    prices = seen.join(schedule.select("fixture_id", "tournament_id").distinct(), "fixture_id").join(competitions.filter(c("competition_id") % 4 != 0).select(c("provider_id").alias("tournament_id")), "tournament_id")
    return readiness.league_readiness(competitions, clubs, members, failures, requested, prices, received=True, complete=True)
