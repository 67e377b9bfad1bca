"""The cascade from fixtures to a day's events, external ids of one run, official aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import identity
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col


def _k(x):
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"


def _ck(x):
    return f"(CASE WHEN regexp_matches(lower({x}), 'women|\\(w\\)') THEN {_k(x)} ELSE regexp_replace({_k(x)}, '^(fc|fk|cf|sc|sk|ac|cd|ca|bk)+', '') END)"


def _bk(x):
    return f"regexp_replace({_ck(x)}, '(women|w)$', '')"


# Fixtures without a result and the events of their days: each kind of spelling, damage and copy by the fixture's number.
_DAY = """miss AS (SELECT fixture_id, home, away, CASE WHEN m = 3 THEN league || ' Women' ELSE league END AS league, kickoff_us, m FROM (SELECT *, fixture_id % 10 AS m FROM fixtures)),
ev0 AS (SELECT fixture_id + 1000000000 AS event_id, CASE m WHEN 1 THEN 'FC ' || home WHEN 2 THEN 'Reviewed ' || home WHEN 3 THEN home || ' Women' ELSE upper(home) END AS home, CASE m WHEN 3 THEN away || ' (W)' WHEN 1 THEN 'Sk ' || away ELSE away END AS away,
  CASE WHEN m = 3 THEN 'Liga' ELSE league END AS league, kickoff_us + CASE WHEN m = 4 THEN 60000000 ELSE 0 END AS kickoff_us, m <> 6 AS finished, CASE WHEN m <> 7 THEN home_goals END AS hg, CASE WHEN m = 9 THEN -1 ELSE away_goals END AS ag, m FROM (SELECT *, fixture_id % 10 AS m FROM fixtures)),
ev AS (SELECT * FROM ev0 UNION ALL SELECT * FROM ev0 WHERE m = 8 UNION ALL SELECT * REPLACE (hg + 1 AS hg) FROM ev0 WHERE m = 5),
al AS (SELECT DISTINCT league, home AS name, 'Reviewed ' || home AS club FROM fixtures WHERE region <> 4)"""


@query("JON-13", views=("fixtures",), sql=f"""WITH {_DAY}, e AS (SELECT DISTINCT event_id, home, away, league, kickoff_us, finished, hg, ag FROM ev), f AS (SELECT miss.*, al.club FROM miss LEFT JOIN al ON al.league = miss.league AND al.name = miss.home),
lk AS (SELECT fixture_id, kickoff_us, 0 AS lv, {_k('home')} || '|' || {_k('away')} AS key FROM f UNION ALL SELECT fixture_id, kickoff_us, 1, {_ck('home')} || '|' || {_ck('away')} FROM f
  UNION ALL SELECT fixture_id, kickoff_us, 2, {_k('league')} || '|' || {_ck('coalesce(club, home)')} || '|' || {_ck('away')} FROM f UNION ALL SELECT fixture_id, kickoff_us, 3, 'women|' || {_bk('home')} || '|' || {_bk('away')} FROM f WHERE league LIKE '%Women'),
rk AS (SELECT *, 0 AS lv, {_k('home')} || '|' || {_k('away')} AS key FROM e UNION ALL SELECT *, 1, {_ck('home')} || '|' || {_ck('away')} FROM e UNION ALL SELECT *, 2, {_k('league')} || '|' || {_ck('home')} || '|' || {_ck('away')} FROM e
  UNION ALL SELECT *, 3, 'women|' || {_bk('home')} || '|' || {_bk('away')} FROM e WHERE regexp_matches(lower(home), 'women')),
r AS (SELECT kickoff_us, lv, key, COUNT(*) AS n, MIN(event_id) AS event_id, bool_and(finished) AS fin, MIN(hg) AS hg, MIN(ag) AS ag FROM rk GROUP BY ALL),
h AS (SELECT fixture_id, lv, n, event_id, fin, hg, ag FROM lk JOIN r USING (kickoff_us, lv, key) QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY lv) = 1),
x AS (SELECT f.fixture_id, h.*, CASE WHEN n IS NULL THEN CASE WHEN kickoff_us IN (SELECT kickoff_us FROM e) THEN 'KICKOFF_CANDIDATE_ONLY' ELSE 'NO_EXACT_IDENTITY' END WHEN n > 1 THEN 'AMBIGUOUS' WHEN coalesce(fin AND hg >= 0 AND ag >= 0, false) THEN 'MATCHED' ELSE 'EXACT_IDENTITY_UNFINISHED' END AS outcome FROM f LEFT JOIN h USING (fixture_id))
SELECT fixture_id, outcome, ['EXACT', 'CLUB', 'REVIEWED_ALIAS', 'CATEGORY'][lv + 1] AS level, CASE WHEN outcome = 'MATCHED' THEN event_id END AS event_id, CASE WHEN outcome = 'MATCHED' THEN hg END AS ft_home_goals, CASE WHEN outcome = 'MATCHED' THEN ag END AS ft_away_goals FROM x""")
def jon_13(spark, sf):
    """Fixtures without a result against the events of the day: four levels of names in one pass, unique and finished ones only."""
    f, m = V.fixtures(spark, sf), c("fixture_id") % 10
    missing = f.select("fixture_id", "home", "away", F.when(m == 3, F.concat("league", F.lit(" Women"))).otherwise(c("league")).alias("league"), "kickoff_us")
    say = lambda word, x: F.concat(F.lit(word), x)
    home = F.when(m == 1, say("FC ", c("home"))).when(m == 2, say("Reviewed ", c("home"))).when(m == 3, F.concat("home", F.lit(" Women"))).otherwise(F.upper("home"))
    away = F.when(m == 3, F.concat("away", F.lit(" (W)"))).when(m == 1, say("Sk ", c("away"))).otherwise(c("away"))
    events = f.select(
        (c("fixture_id") + 1_000_000_000).alias("event_id"), home.alias("home"), away.alias("away"), F.when(m == 3, "Liga").otherwise(c("league")).alias("league"), (c("kickoff_us") + F.when(m == 4, 60_000_000).otherwise(0)).alias("kickoff_us"),
        (m != 6).alias("finished"), F.when(m != 7, c("home_goals")).alias("hg"), F.when(m == 9, -1).otherwise(c("away_goals")).alias("ag"), m.alias("m"))
    events = events.union(events.filter("m = 8")).union(events.filter("m = 5").withColumn("hg", c("hg") + 1))
    aliases = f.filter("region <> 4").select("league", c("home").alias("name"), F.concat(F.lit("Reviewed "), "home").alias("club")).distinct()
    return identity.result_cascade(missing, events, aliases)


@query("NRM-47", views=("snapshots",), sql="""WITH run AS (SELECT provider, MAX(observed_us) AS at_us FROM snapshots GROUP BY provider), refs AS (SELECT c_custkey AS fixture_id, 'feed:' || c_nationkey AS x FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_nationkey = 3), one AS (SELECT fixture_id, MIN(x) AS x FROM refs GROUP BY fixture_id HAVING COUNT(*) = 1)
SELECT event_id, x AS external, CASE WHEN x IS NOT NULL THEN 'CURRENT_EXACT_EXTERNAL_IDS' END AS external_source FROM (SELECT s.event_id, CASE WHEN s.observed_us >= at_us - 86400000000 THEN one.x END AS x FROM snapshots s JOIN run USING (provider) LEFT JOIN one USING (fixture_id))""")
def nrm_47(spark, sf):
    """External ids by exact fixture id, only on the snapshots of a feed's last run (its last day); fixtures with two references get none."""
    s = V.snapshots(spark, sf).select("event_id", "fixture_id", "provider", "observed_us")
    last = s.groupBy("provider").agg(F.max("observed_us").alias("at_us"))
    cust = V.table(spark, sf, "customer")
    ref = lambda x: F.create_map(F.lit("feed"), x).alias("external")
    nothing = F.create_map().cast("map<string,string>")
    first = cust.select(c("c_custkey").alias("fixture_id"), F.when(c("c_mktsegment") == "BUILDING", nothing).otherwise(ref(F.concat(F.lit("feed:"), c("c_nationkey").cast("string")))).alias("external"))
    refs = first.union(cust.filter("c_nationkey = 3").select(c("c_custkey"), ref(F.lit("second"))))
    out = identity.attach_external(s.join(last, "provider"), refs, c("observed_us") >= c("at_us") - V.DAY_US)
    return out.select("event_id", c("external")["feed"].alias("external"), "external_source")


# Official records of clubs, sound but for one kind of damage.
_REC = """rec AS (SELECT c_custkey AS club, CASE m WHEN 1 THEN 'ELSEWHERE' ELSE n_name END AS competition, n_name AS member_of, c_name AS canonical_name, CASE m WHEN 2 THEN upper(c_name) ELSE c_name END AS canonical, 'id' || c_custkey AS official_id, CASE m WHEN 3 THEN 'id0' ELSE 'id' || c_custkey END AS entity2,
  CASE m WHEN 5 THEN 'en' ELSE 'ko' END AS lang2, c_name AS l1, 'Town ' || c_custkey || ' Football Club' AS l2, CASE m WHEN 6 THEN 'Other' ELSE 'Town ' || c_custkey || ' Football Club' END AS declared2, m FROM (SELECT *, c_custkey % 8 AS m FROM customer JOIN nation ON n_nationkey = c_nationkey))"""
_BASIC = "CASE WHEN m = 4 THEN 'CLUB_IN_SEVERAL_RECORDS' WHEN competition <> member_of THEN 'NOT_A_MEMBER' WHEN canonical <> canonical_name THEN 'CANONICAL_NAME_DIFFERS' WHEN entity2 <> official_id THEN 'OFFICIAL_ID_DIFFERS'"
_LABELS = "SELECT competition, club, unnest([l1, l2, 'Town ' || club]) AS alias, reason FROM j WHERE reason IS NULL UNION ALL SELECT competition, club, NULL, reason FROM j WHERE reason IS NOT NULL"


def _records(spark, sf):
    m = c("c_custkey") % 8
    t = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), c("n_nationkey") == c("c_nationkey"))
    own = F.concat(F.lit("id"), c("c_custkey").cast("string"))
    long = F.concat(F.lit("Town "), c("c_custkey").cast("string"), F.lit(" Football Club"))
    source = lambda lang, i: F.struct(lang.alias("language"), i.alias("entity_id"))
    r = t.select(
        c("c_custkey").alias("club"), F.when(m == 1, "ELSEWHERE").otherwise(c("n_name")).alias("competition"), F.when(m == 2, F.upper("c_name")).otherwise(c("c_name")).alias("canonical"), own.alias("official_id"), F.array(c("c_name"), long, F.lit("")).alias("labels"),
        F.array(source(F.lit("en"), own), source(F.when(m == 5, "en").otherwise("ko"), F.when(m == 3, "id0").otherwise(own))).alias("sources"), F.array(F.when(m == 6, "Other").otherwise(long), c("c_name")).alias("declared"), m.alias("m"))
    members = t.select(c("c_custkey").alias("club"), c("n_name").alias("competition"))
    return r.union(r.filter("m = 4")), members, t.select(c("c_custkey").alias("club"), c("c_name").alias("canonical_name"))


@query("JON-46", sql=f"WITH {_REC}, j AS (SELECT *, {_BASIC} END AS reason FROM rec UNION ALL SELECT *, 'CLUB_IN_SEVERAL_RECORDS' FROM rec WHERE m = 4) {_LABELS}")
def jon_46(spark, sf):
    """Aliases of official records, checked against membership, canonical name and the record's own id."""
    return identity.official_aliases(*_records(spark, sf))


@query("JON-47", sql=f"WITH {_REC}, j AS (SELECT *, {_BASIC} WHEN lang2 <> 'ko' THEN 'LANGUAGES_DIFFER' WHEN declared2 <> l2 THEN 'LABELS_DIFFER' END AS reason FROM rec UNION ALL SELECT *, 'CLUB_IN_SEVERAL_RECORDS' FROM rec WHERE m = 4) {_LABELS}")
def jon_47(spark, sf):
    """The same for records in two languages, whose sources must give exactly the declared labels."""
    return identity.official_aliases(*_records(spark, sf), declared="declared", languages=("en", "ko"))
