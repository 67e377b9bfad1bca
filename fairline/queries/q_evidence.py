"""Web evidence with its dates and methods, its expansion over equal matches, the bridge between two feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import filters, identity
from fairline.queries.q_feeds import iso
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col
_FIELDS = ("url", "tier", "method", "title", "status", "home", "away", "hg", "ag", "kickoff", "day")

# Evidence per fixture, flat: up to two sources, each sound but for one kind of damage, by the fixture's number.
EVIDENCE = """evidence AS (SELECT fixture_id, league, CASE WHEN m = 19 THEN '' ELSE home END AS home, away, CASE WHEN m = 18 THEN NULL ELSE kickoff_us END AS kickoff_us, home_goals AS hg, away_goals AS ag,
  CASE WHEN m = 15 THEN 'https://c.example/x' ELSE 'https://a.example/x' END AS primary_url, CASE WHEN m = 0 THEN 0 WHEN m IN (4, 17, 20, 22) THEN 2 ELSE 1 END AS n,
  CASE m WHEN 1 THEN 'http://a.example/x' WHEN 2 THEN 'https://a.example:8443/x' WHEN 3 THEN 'https://me@a.example/x' ELSE 'https://a.example/x' END AS url1, CASE WHEN m = 5 THEN 'C_BLOG' WHEN m IN (4, 17, 20, 23) THEN 'B_REPUTABLE' ELSE 'A_OFFICIAL' END AS tier1,
  CASE WHEN m = 6 THEN 'AUTOMATIC' ELSE 'MANUAL_WEB_REVIEW' END AS method1, CASE WHEN m = 7 THEN '  ' ELSE 'Report' END AS title1, CASE WHEN m = 8 THEN 'AET' ELSE 'FT' END AS status1, upper(home) AS home1, CASE WHEN m = 9 THEN home ELSE away END AS away1,
  home_goals + CASE WHEN m = 10 THEN 1 ELSE 0 END AS hg1, CASE WHEN m = 24 THEN NULL ELSE away_goals END AS ag1,
  CASE WHEN m IN (11, 13, 21) THEN NULL WHEN m = 12 THEN strftime(make_timestamp(kickoff_us + 60000000), '%Y-%m-%dT%H:%M:%SZ') WHEN m = 14 THEN strftime(make_timestamp(kickoff_us), '%Y-%m-%dT%H:%M:%S')
    WHEN m = 16 THEN strftime(make_timestamp(kickoff_us + 25200000000), '%Y-%m-%dT%H:%M:%S+07:00') ELSE strftime(make_timestamp(kickoff_us), '%Y-%m-%dT%H:%M:%SZ') END AS kickoff1,
  CASE WHEN m = 11 THEN '' WHEN m = 13 THEN strftime(make_timestamp(kickoff_us + 86400000000), '%Y-%m-%d') WHEN m = 21 THEN strftime(make_timestamp(kickoff_us), '%Y-%m-%d') END AS day1,
  CASE WHEN m = 4 THEN 'https://www.A.example/y' ELSE 'https://b.example/y' END AS url2, 'B_REPUTABLE' AS tier2, 'MANUAL_WEB_REVIEW' AS method2, 'Second' AS title2, 'FT' AS status2, home AS home2, away AS away2, home_goals AS hg2, away_goals + CASE WHEN m = 20 THEN 1 ELSE 0 END AS ag2,
  NULL::VARCHAR AS kickoff2, strftime(make_timestamp(kickoff_us), '%Y-%m-%d') AS day2 FROM (SELECT *, fixture_id % 25 AS m FROM fixtures))"""


def _key(x):
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"


def _host(i):
    return f"regexp_replace(lower(regexp_extract(url{i}, '^https://([^/?#@:]+)(?:[/?#]|$)', 1)), '^www\\.', '')"


def _defect(i, seen):
    return f"""CASE WHEN {_host(i)} = '' THEN 'INVALID_SOURCE_URL' WHEN {seen} THEN 'DUPLICATE_SOURCE_HOST' WHEN tier{i} NOT IN ('A_OFFICIAL', 'B_REPUTABLE') THEN 'INVALID_SOURCE_TIER' WHEN method{i} <> 'MANUAL_WEB_REVIEW' THEN 'INVALID_VERIFICATION_METHOD'
  WHEN trim(title{i}) = '' THEN 'MISSING_SOURCE_TITLE' WHEN status{i} <> 'FT' THEN 'SOURCE_RESULT_NOT_FINAL' WHEN {_key(f'home{i}')} <> {_key('home')} OR {_key(f'away{i}')} <> {_key('away')} THEN 'SOURCE_IDENTITY_MISMATCH'
  WHEN hg{i} IS NULL OR ag{i} IS NULL OR hg{i} <> hg OR ag{i} <> ag THEN 'SOURCE_SCORE_MISMATCH' WHEN coalesce(kickoff{i}, '') = '' AND coalesce(day{i}, '') = '' THEN 'MISSING_SOURCE_DATE'
  WHEN coalesce(kickoff{i}, '') <> '' AND coalesce(CASE WHEN regexp_matches(kickoff{i}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN epoch_us(CAST(kickoff{i} AS TIMESTAMPTZ)) END, -1) <> kickoff_us THEN 'SOURCE_KICKOFF_MISMATCH'
  WHEN coalesce(day{i}, '') <> '' AND day{i} <> strftime(make_timestamp(kickoff_us), '%Y-%m-%d') THEN 'SOURCE_DATE_MISMATCH' END"""


QUALITY = f"""quality AS (SELECT *, CASE WHEN n = 0 THEN 'MISSING_SOURCE_ASSERTIONS' WHEN kickoff_us IS NULL OR {_key('home')} = '' OR {_key('away')} = '' THEN 'INVALID_MATCH_IDENTITY' WHEN d1 IS NOT NULL THEN d1 WHEN n = 2 AND d2 IS NOT NULL THEN d2
  WHEN primary_url <> url1 AND (n = 1 OR primary_url <> url2) THEN 'PRIMARY_SOURCE_NOT_ASSERTED' WHEN tier1 = 'A_OFFICIAL' OR n = 2 AND tier2 = 'A_OFFICIAL' THEN 'TIER_A_OFFICIAL' WHEN n = 2 THEN 'TIER_B_TWO_INDEPENDENT_SOURCES' ELSE 'INSUFFICIENT_SOURCE_CORROBORATION' END AS quality
  FROM (SELECT *, {_defect(1, 'false')} AS d1, {_defect(2, f'{_host(1)} = {_host(2)}')} AS d2 FROM evidence))"""


def evidence(spark, sf):
    m = c("fixture_id") % 25
    at = lambda *n: m.isin(*n)
    pick = lambda default, **cases: _pick(m, default, cases)
    day = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")
    ko = c("kickoff_us")
    local = F.concat(F.date_format(F.timestamp_micros(ko + 7 * V.HOUR_US), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))
    one = {
        "url": pick("https://a.example/x", _1="http://a.example/x", _2="https://a.example:8443/x", _3="https://me@a.example/x"), "tier": F.when(m == 5, "C_BLOG").when(at(4, 17, 20, 23), "B_REPUTABLE").otherwise("A_OFFICIAL"),
        "verification_method": pick("MANUAL_WEB_REVIEW", _6="AUTOMATIC"), "source_title": pick("Report", _7="  "), "status": pick("FT", _8="AET"), "home": F.upper("home"), "away": F.when(m == 9, c("home")).otherwise(c("away")),
        "ft_home_goals": c("home_goals") + F.when(m == 10, 1).otherwise(0), "ft_away_goals": F.when(m != 24, c("away_goals")),
        "kickoff": F.when(at(11, 13, 21), None).when(m == 12, iso(ko + 60_000_000)).when(m == 14, F.regexp_replace(iso(ko), "Z$", "")).when(m == 16, local).otherwise(iso(ko)),
        "match_date": F.when(m == 11, "").when(m == 13, day(ko + V.DAY_US)).when(m == 21, day(ko)),
    }
    two = {
        "url": pick("https://b.example/y", _4="https://www.A.example/y"), "tier": F.lit("B_REPUTABLE"), "verification_method": F.lit("MANUAL_WEB_REVIEW"), "source_title": F.lit("Second"), "status": F.lit("FT"), "home": c("home"), "away": c("away"),
        "ft_home_goals": c("home_goals"), "ft_away_goals": c("away_goals") + F.when(m == 20, 1).otherwise(0), "kickoff": F.lit(None).cast("string"), "match_date": day(ko),
    }
    source = lambda s: F.struct(s["url"].alias("url"), s["tier"].alias("tier"), F.struct(*[v.alias(k) for k, v in s.items() if k not in ("url", "tier")]).alias("assertion"))
    sources = F.when(m == 0, F.slice(F.array(source(one)), 1, 0)).when(at(4, 17, 20, 22), F.array(source(one), source(two))).otherwise(F.array(source(one)))
    e = V.fixtures(spark, sf).select("fixture_id", "league", F.when(m == 19, "").otherwise(c("home")).alias("home"), "away", F.when(m != 18, ko).alias("kickoff_us"), "home_goals", "away_goals", pick("https://a.example/x", _15="https://c.example/x").alias("primary_url"), sources.alias("sources"))
    return e.withColumn("quality", filters.evidence_quality(c("sources"), c("home"), c("away"), c("kickoff_us"), (c("home_goals"), c("away_goals")), c("primary_url")))


def _pick(m, default, cases):
    out = F.lit(default)
    for k, v in cases.items():
        out = F.when(m == int(k[1:]), v).otherwise(out)
    return out


@query("FLT-14", views=("fixtures",), sql=f"WITH {EVIDENCE}, {QUALITY} SELECT fixture_id, quality FROM quality")
def flt_14(spark, sf):
    """Recorded web evidence per fixture: method, title, score, kickoff and date of every source, then their number and tier."""
    return evidence(spark, sf).select("fixture_id", "quality")


# Fixtures as a feed knows them: every third under a second id, some with two identities; results from elsewhere or from earlier evidence.
_WORLD = """seen AS (SELECT fixture_id, home, away, kickoff_us, league FROM fixtures UNION ALL SELECT -fixture_id, 'c-' || substr(home, 2), away, kickoff_us, CASE WHEN fixture_id % 9 = 0 THEN 'ELSEWHERE' ELSE league END FROM fixtures WHERE fixture_id % 3 = 0
  UNION ALL SELECT fixture_id, home, away, kickoff_us + 60000000, league FROM fixtures WHERE fixture_id % 7 = 0),
known AS (SELECT fixture_id, MIN(ft_home_goals) AS h, MIN(ft_away_goals) + CASE WHEN fixture_id % 12 = 1 THEN 1 ELSE 0 END AS a, CASE WHEN fixture_id % 2 = 0 THEN 'FEED' ELSE 'WEB_EVIDENCE_TIER_A_OFFICIAL' END AS src FROM results WHERE fixture_id % 4 < 2 GROUP BY fixture_id)"""


@query("JON-21", views=("fixtures", "results"), sql=f"""WITH {EVIDENCE}, {QUALITY}, {_WORLD}, ev AS (SELECT fixture_id AS evidence_id, home, away, kickoff_us, CASE WHEN fixture_id % 5 <> 0 THEN league END AS competition, hg, ag, quality FROM quality),
per AS (SELECT fixture_id, MIN({_key("home")}) AS home, MIN({_key("away")}) AS away, MIN(kickoff_us) AS kickoff_us, MIN({_key("league")}) AS league, COUNT(DISTINCT kickoff_us) AS ids FROM seen GROUP BY fixture_id),
ok AS (SELECT evidence_id, {_key("home")} AS home, {_key("away")} AS away, kickoff_us, CASE WHEN competition IS NOT NULL THEN {_key("competition")} END AS competition, hg, ag, quality FROM ev WHERE starts_with(quality, 'TIER_')),
same AS (SELECT evidence_id, per.fixture_id FROM ok JOIN per ON per.home = ok.home AND per.away = ok.away AND per.kickoff_us = ok.kickoff_us AND (competition IS NULL OR competition = per.league)),
w AS (SELECT evidence_id, evidence_id AS fixture_id FROM ok UNION SELECT evidence_id, -evidence_id FROM ok WHERE evidence_id % 2 = 0 UNION SELECT * FROM same)
SELECT evidence_id, NULL::BIGINT AS fixture_id, quality AS outcome FROM ev WHERE NOT starts_with(quality, 'TIER_') UNION ALL
SELECT w.evidence_id, w.fixture_id, CASE WHEN per.ids > 1 THEN 'CONFLICTING_SOURCE_FIXTURE_IDENTITY' WHEN per.fixture_id IS NULL OR per.home <> ok.home OR per.away <> ok.away OR per.kickoff_us <> ok.kickoff_us OR coalesce(competition <> per.league, false) THEN 'IDENTITY_MISMATCH_OR_UNKNOWN_FIXTURE'
  WHEN src = 'FEED' THEN 'SKIPPED_TRUSTED' WHEN src IS NOT NULL AND (h <> hg OR a <> ag) THEN 'CONFLICT_WITH_EXISTING_WEB_EVIDENCE' ELSE 'WEB_EVIDENCE_' || quality END FROM w JOIN ok USING (evidence_id) LEFT JOIN per ON per.fixture_id = w.fixture_id LEFT JOIN known ON known.fixture_id = w.fixture_id""")
def jon_21(spark, sf):
    """Evidence expanded to every id of the same match; ids with two identities, results from elsewhere and other scores stay out."""
    i = c("fixture_id")
    e = evidence(spark, sf).withColumn("fixture_ids", F.when(i % 2 == 0, F.array(i, -i)).otherwise(F.array(i)))
    e = e.withColumnsRenamed({"fixture_id": "evidence_id", "home_goals": "ft_home_goals", "away_goals": "ft_away_goals"}).withColumn("competition", F.when(c("evidence_id") % 5 != 0, c("league")))
    f = V.fixtures(spark, sf).select("fixture_id", "home", "away", "kickoff_us", "league")
    second = f.filter(i % 3 == 0).withColumns({"fixture_id": -i, "home": F.concat(F.lit("c-"), F.substring("home", 2, 99)), "league": F.when(i % 9 == 0, "ELSEWHERE").otherwise(c("league"))})
    seen = f.union(second).union(f.filter(i % 7 == 0).withColumn("kickoff_us", c("kickoff_us") + 60_000_000))
    known = V.results(spark, sf).filter(i % 4 < 2).groupBy("fixture_id").agg(F.min("ft_home_goals").alias("ft_home_goals"), F.min("ft_away_goals").alias("ft_away_goals"))
    known = known.withColumns({"ft_away_goals": c("ft_away_goals") + F.when(i % 12 == 1, 1).otherwise(0), "result_source": F.when(i % 2 == 0, "FEED").otherwise("WEB_EVIDENCE_TIER_A_OFFICIAL")})
    return identity.expand_evidence(e, seen, known)


# ---- bridge between two feeds -----------------------------------------------------------------
_BR = """br AS (SELECT * REPLACE (CASE WHEN provider = 'view' AND m IN (6, 9) AND k % 2 = 0 THEN 'view:' || CASE WHEN m = 6 THEN substr(sha1(home || '|' || away || '|' || kickoff_us), 1, 16) ELSE 'feed' END WHEN provider = 'click' AND m = 1 THEN 'x' || source_id WHEN provider = 'click' AND m = 5 AND k % 2 = 0 THEN source_id || 'b' ELSE source_id END AS source_id)
  FROM (SELECT provider || ':' || fixture_id AS source_id, provider, k, fixture_id % 11 AS m, CASE WHEN fixture_id % 11 = 4 AND k % 2 = 0 THEN home || '!' ELSE home END AS home, away, kickoff_us, observed_us, CASE fixture_id % 11 WHEN 7 THEN ' ' WHEN 8 THEN 'Nations ' || provider ELSE league END AS league,
    CASE WHEN fixture_id % 11 = 2 AND provider = 'view' THEN 'Other' ELSE 'Main' END AS bookmaker FROM snapshots WHERE provider IN ('view', 'click') AND mainline_verified AND (observed_us < kickoff_us OR fixture_id % 11 = 3) AND NOT (fixture_id % 11 IN (6, 9, 10) AND provider = 'click'))),
ids AS (SELECT source_id, MIN(provider) AS provider, MIN(home) AS home, MIN(away) AS away, MIN(kickoff_us) AS kickoff_us, MIN(league) AS league, COUNT(DISTINCT home) AS homes, bool_and(lower(bookmaker) = 'main' AND observed_us < kickoff_us) AS book FROM br GROUP BY source_id),
g AS (SELECT *, CASE WHEN homes > 1 THEN 'INCONSISTENT_IDENTITY' WHEN trim(league) = '' THEN 'INCOMPLETE_IDENTITY' WHEN NOT starts_with(source_id, provider || ':') THEN 'PROVIDER_NOT_BRIDGED' WHEN NOT book THEN 'BOOK_OR_TIME_NOT_TRUSTED' END AS gate,
  CASE WHEN league IN ('Nations view', 'Nations click') THEN 'NATIONS' ELSE league END AS comp, provider = 'view' AND regexp_matches(source_id, '^view:[0-9]+$') AS native, provider = 'view' AND source_id = 'view:' || substr(sha1(home || '|' || away || '|' || kickoff_us), 1, 16) AS hashed FROM ids),
m AS (SELECT home, away, kickoff_us, comp, COUNT(*) AS n, COUNT(*) FILTER (provider = 'view') AS n1, COUNT(*) FILTER (native) AS nn, COUNT(*) FILTER (hashed) AS nh, MIN(CASE WHEN provider = 'view' THEN source_id END) AS v, MIN(CASE WHEN native THEN source_id END) AS nv FROM g WHERE gate IS NULL GROUP BY ALL),
j AS (SELECT g.source_id, gate, n, gate IS NULL AND n = 2 AND n1 = 2 AND nn = 1 AND nh = 1 AS dup, gate IS NULL AND n = 2 AND n1 = 1 AS pair, v, nv FROM g LEFT JOIN m USING (home, away, kickoff_us, comp))"""


@query("JON-19", views=("snapshots",), sql=f"""WITH {_BR} SELECT source_id, CASE WHEN dup THEN nv WHEN pair THEN v END AS canonical_id, CASE WHEN dup THEN 'REPRODUCED_HASH_AND_NATIVE_ID' WHEN pair THEN 'EXACT_MATCH_UNIQUE_PER_PROVIDER' END AS policy,
  CASE WHEN gate IS NOT NULL THEN gate WHEN dup OR pair THEN NULL WHEN n >= 2 THEN 'AMBIGUOUS_PROVIDER_IDENTITY' ELSE 'NO_COUNTERPART' END AS reason FROM j""")
def jon_19(spark, sf):
    """Ids of two feeds that are one match, with every gate broken somewhere."""
    m, k, p = c("fixture_id") % 11, c("k"), c("provider")
    s = V.snapshots(spark, sf).filter(p.isin("view", "click") & c("mainline_verified") & ((c("observed_us") < c("kickoff_us")) | (m == 3)) & ~(m.isin(6, 9, 10) & (p == "click")))
    home = F.when((m == 4) & (k % 2 == 0), F.concat("home", F.lit("!"))).otherwise(c("home"))
    s = s.withColumns({"home": home, "league": F.when(m == 7, " ").when(m == 8, F.concat(F.lit("Nations "), p)).otherwise(c("league")), "bookmaker": F.when((m == 2) & (p == "view"), "Other").otherwise("Main"), "native": F.concat_ws(":", p, c("fixture_id").cast("string"))})
    hashed = F.substring(F.sha1(F.concat_ws("|", "home", "away", c("kickoff_us").cast("string"))), 1, 16)
    even = k % 2 == 0
    own = F.when((p == "view") & (m == 6) & even, F.concat(F.lit("view:"), hashed)).when((p == "view") & (m == 9) & even, "view:feed").when((p == "click") & (m == 1), F.concat(F.lit("x"), "native")).when((p == "click") & (m == 5) & even, F.concat("native", F.lit("b"))).otherwise(c("native"))
    s = s.withColumn("source_id", own).withColumn("provider_fixture_id", F.substring_index("source_id", ":", -1))
    return identity.feed_bridge(s, ("view", "click"), "main", {"Nations view": "NATIONS", "Nations click": "NATIONS"})
