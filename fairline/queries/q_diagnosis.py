"""Replay, text search for unresolved targets, proof deltas, causes, cohorts, persistence, line markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import asof, diagnosis, movement, publishing, replay, textsearch
from fairline.queries.q_feeds import catalog, iso, json, snaps
from fairline.queries.q_snapshots import _T, ticks
from fairline.queries.registry import query
from fairline.session import cut
from fairline.sources import views as V

c = F.col

# ---- replay of saved responses ----------------------------------------------------------------
SAVED_UNTIL = 1_704_067_200_000_000 + 27 * V.DAY_US  # the earlier run saw ticks up to here
_SLOT_DAYS = (5, 13, 21, 25, 28, 29)
_TICK = ("created_us", "price_c", "active", "event_id")
_SERIES = ("fixture_id", "side")


def _rebuilt(rows):
    """Slots of every series: how many are complete, stale, empty or otherwise not usable."""
    slots = F.array(*[F.lit(1_704_067_200_000_000 + d * V.DAY_US + 14 * V.HOUR_US) for d in _SLOT_DAYS])
    states = asof.slot_states(rows, rows.select("fixture_id").distinct().withColumn("slots", slots), list(_SERIES)).withColumn("status", asof.slot_reason(86400))
    n = lambda *s: F.count_if(c("status").isin(*s))
    return states.groupBy(*_SERIES).agg(n("COMPLETE").alias("complete"), n("STALE_QUOTE").alias("stale"), n("NO_HISTORICAL_DATA").alias("empty"), F.count_if(~c("status").isin("COMPLETE", "STALE_QUOTE", "NO_HISTORICAL_DATA")).alias("unusable"))


_WIN19 = f"""WITH t AS ({_T}), cand AS (SELECT DISTINCT fixture_id, side FROM t UNION ALL SELECT DISTINCT fixture_id, 'never answered' FROM t),
now AS (SELECT fixture_id, side, COUNT(*) AS n FROM t WHERE side <> 'click' GROUP BY ALL), before AS (SELECT fixture_id, side, COUNT(*) AS n FROM t WHERE side <> 'error' AND created_us < {SAVED_UNTIL} GROUP BY ALL),
st AS (SELECT cand.*, CASE WHEN now.n IS NULL AND before.n IS NULL THEN 'UNPROCESSED' WHEN now.n IS NULL THEN 'KEPT' WHEN before.n IS NULL THEN 'MISSING' WHEN now.n = before.n THEN 'REUSED' ELSE 'GROWN' END AS state FROM cand LEFT JOIN now USING (fixture_id, side) LEFT JOIN before USING (fixture_id, side)),
u AS (SELECT t.* FROM t JOIN st USING (fixture_id, side) WHERE state <> 'UNPROCESSED' AND (state <> 'KEPT' OR created_us < {SAVED_UNTIL})),
s AS (SELECT DISTINCT fixture_id, side, 1704067200000000 + d * 86400000000 + 14 * 3600000000 AS slot_us FROM u, (VALUES {", ".join(f"({d})" for d in _SLOT_DAYS)}) a(d)),
l AS (SELECT s.fixture_id, s.side, s.slot_us, MAX(created_us) AS at_us FROM s LEFT JOIN u ON s.fixture_id = u.fixture_id AND s.side = u.side AND u.created_us <= s.slot_us GROUP BY ALL),
x AS (SELECT l.fixture_id, l.side, slot_us, at_us, COUNT(DISTINCT price || '|' || active) AS states, bool_and(active) AS active FROM l LEFT JOIN u ON l.fixture_id = u.fixture_id AND l.side = u.side AND u.created_us = l.at_us GROUP BY ALL),
y AS (SELECT *, CASE WHEN at_us IS NULL THEN 'E' WHEN states > 1 OR NOT active THEN 'U' WHEN slot_us - at_us > 86400000000 THEN 'S' ELSE 'C' END AS k FROM x)
SELECT st.fixture_id, st.side, state, COUNT(*) FILTER (k = 'C') AS complete, COUNT(*) FILTER (k = 'S') AS stale, COUNT(*) FILTER (k = 'E') AS empty, COUNT(*) FILTER (k = 'U') AS unusable FROM st LEFT JOIN y USING (fixture_id, side) GROUP BY ALL"""


@query("WIN-19", sql=_WIN19)
def win_19(spark, sf):
    """All saved responses replayed over an earlier run: no response of `click` is at hand any more, none of `error` was processed then."""
    t = ticks(spark, sf).withColumn("price_c", F.round(c("price") * 100).cast("long"))
    series, request = t.select(*_SERIES).distinct(), list(_SERIES)
    asked = series.union(series.select("fixture_id", F.lit("never answered")).distinct())
    before = t.filter((c("created_us") < SAVED_UNTIL) & (c("side") != "error"))
    stored = cut(_rebuilt(before).join(replay.contents(before, request, _TICK), request))
    at_hand = t.filter(c("side") != "click")
    planned = cut(replay.plan(asked, replay.contents(at_hand, request, _TICK), stored, request))
    results = replay.replay(planned, at_hand, stored, request, _rebuilt)
    numbers = ["complete", "stale", "empty", "unusable"]
    return planned.select(*request, "state").join(results, request, "left").select(*request, "state", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers])


# ---- unresolved targets -----------------------------------------------------------------------
@query("FLT-29", sql="""WITH h AS (SELECT n_nationkey, n_name, unnest(list_distinct([lower(p_name), split_part(lower(p_name), ' ', 2) || ' ' || lower(p_brand), lower(p_brand), substr(lower(p_type), 1, 2), lower(n_name)])) AS hint
  FROM nation JOIN part ON p_partkey = n_nationkey WHERE n_regionkey > 1),
t AS (SELECT p_partkey, lower(p_type || ' ' || p_name || ' ' || p_brand) AS txt FROM part)
SELECT p_partkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS matched_for, COUNT(*) AS hints FROM t JOIN h ON contains(txt, hint) GROUP BY p_partkey""")
def flt_29(spark, sf):
    """Catalog rows that a search hint of an unresolved target occurs in, with all targets that they may belong to."""
    p = V.table(spark, sf, "part")
    low = textsearch.search_text
    own = p.join(V.table(spark, sf, "nation").filter("n_regionkey > 1"), c("p_partkey") == c("n_nationkey"))
    second = F.get(F.split(low(c("p_name")), " "), F.lit(1))
    hints = F.array_distinct(F.array(low(c("p_name")), F.concat_ws(" ", second, low(c("p_brand"))), low(c("p_brand")), F.substring(low(c("p_type")), 1, 2), low(F.replace(c("n_name"), F.lit("_"), F.lit("_")))))
    h = own.select("n_name", F.explode(hints).alias("hint")).withColumn("hint_id", F.xxhash64("n_name", "hint"))
    texts = p.select("p_partkey", low(c("p_type"), c("p_name"), c("p_brand")).alias("txt"))
    found = textsearch.contains_join(texts, h, "p_partkey", "txt", "hint_id", "hint").join(h.select("hint_id", "n_name"), "hint_id")
    return found.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("matched_for"), F.count("*").alias("hints"))


# ---- alias evidence with and without the extra aliases ------------------------------------------
def _world_sql(w, where):
    return f"""c{w} AS (SELECT league, home, away, COUNT(*) AS n FROM e WHERE {where} GROUP BY ALL), p{w} AS (SELECT league, home, COUNT(*) AS a, SUM(n) AS n, MAX(o) AS o FROM c{w} JOIN (SELECT league, away, COUNT(*) AS o FROM c{w} GROUP BY ALL) USING (league, away) GROUP BY ALL)"""


@query("JON-26", views=("fixtures",), sql=f"""WITH e AS (SELECT league, home, CASE WHEN priority = '1' AND region = 2 THEN away ELSE 'A' || home END AS away, priority, region FROM fixtures), {_world_sql(1, "priority = '5'")}, {_world_sql(2, "true")},
b AS (SELECT league, home, coalesce(p1.a = 1 AND p1.o = 1 AND p1.n >= 2, false) AS q1, coalesce(p2.a = 1 AND p2.o = 1 AND p2.n >= 2, false) AS q2, coalesce(p1.a > 1 OR p1.o > 1, false) AS d1, coalesce(p2.a > 1 OR p2.o > 1, false) AS d2 FROM p2 LEFT JOIN p1 USING (league, home))
SELECT league, COUNT(*) FILTER (q1) AS proven_before, COUNT(*) FILTER (q2) AS proven_after, COUNT(*) FILTER (q1 AND q2) AS kept, COUNT(*) FILTER (q2 AND NOT q1) AS gained, COUNT(*) FILTER (q1 AND NOT q2) AS lost,
  COUNT(*) FILTER (NOT q1 AND NOT q2 AND d2 AND NOT d1) AS newly_ambiguous FROM b GROUP BY league""")
def jon_26(spark, sf):
    """Proven teams per competition without and with the extra evidence (all but the least urgent rows; in one region the urgent ones contradict)."""
    f = V.fixtures(spark, sf)
    alias = F.when((c("priority") == "1") & (c("region") == 2), c("away")).otherwise(F.concat(F.lit("A"), c("home")))
    e = f.select("league", "home", alias.alias("alias"), F.when(c("priority") == "5", 3).otherwise(2).alias("worlds"))
    d = diagnosis.proof_delta(e, "league", "home", "alias", "worlds")
    n = lambda s: F.count_if(c("state") == s)
    return d.groupBy("league").agg(F.count_if("proven_before").alias("proven_before"), F.count_if("proven_after").alias("proven_after"), n("KEPT").alias("kept"), n("GAINED").alias("gained"), n("LOST").alias("lost"), n("NEWLY_AMBIGUOUS").alias("newly_ambiguous"))


# ---- causes per fixture -----------------------------------------------------------------------
NOW = 1_704_067_200_000_000 + 14 * V.DAY_US
_UNASKED, _BROKEN, _SILENT = ("L4", "L9"), ("L2", "L6"), ("L11",)


@query("JON-33", views=("snapshots",), sql=f"""WITH a AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'OK' WHEN k % 4 = 1 THEN 'TOURNAMENT_UNMAPPED' WHEN k % 4 = 2 THEN 'NO_MAIN_LINE' END AS reason FROM snapshots WHERE observed_us BETWEEN {NOW} - 172800000000 AND {NOW}),
s AS (SELECT DISTINCT league, fixture_id, kickoff_us FROM snapshots WHERE provider <> 'view'),
r AS (SELECT DISTINCT fixture_id FROM a WHERE provider = 'click'), v AS (SELECT DISTINCT fixture_id FROM a WHERE provider = 'view' AND mainline_verified AND price BETWEEN 1.8e0 AND 2.2e0),
d AS (SELECT fixture_id, reason FROM a WHERE provider = 'error' QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, event_id DESC) = 1)
SELECT s.league, s.fixture_id, CASE WHEN kickoff_us <= {NOW} THEN 'ALREADY_KICKOFF' WHEN v.fixture_id IS NOT NULL THEN 'VALID_ODDS' WHEN league IN {_UNASKED} THEN 'QUOTA_SKIPPED'
  WHEN d.fixture_id IS NULL THEN CASE WHEN league IN {_BROKEN} THEN 'PROVIDER_FAILURE' WHEN r.fixture_id IS NOT NULL THEN 'COLLECTOR_FAILURE' WHEN league <> '{_SILENT[0]}' THEN 'MARKET_UNAVAILABLE' ELSE 'INSUFFICIENT_EVIDENCE' END
  WHEN regexp_matches(coalesce(d.reason, ''), '{diagnosis.MAPPING_WORDS}') THEN 'MAPPING_FAILURE' WHEN d.reason = 'OK' THEN 'VALIDATION_REJECTED' ELSE 'MARKET_UNAVAILABLE' END AS cause, d.reason AS provider_reason
FROM s LEFT JOIN r USING (fixture_id) LEFT JOIN v USING (fixture_id) LEFT JOIN d USING (fixture_id)""")
def jon_33(spark, sf):
    """Cause of every scheduled fixture at one attempt, from the evidence of its last two days."""
    s = snaps(spark, sf)
    key = ["league", "fixture_id"]
    now = s.filter(c("observed_us").between(NOW - 2 * V.DAY_US, NOW))
    schedule = s.filter("provider <> 'view'").select(*key, (c("kickoff_us") <= NOW).alias("started"), (~c("league").isin(*_UNASKED)).alias("requested"), c("league").isin(*_BROKEN).alias("errors"), (~c("league").isin(*_SILENT)).alias("answered")).distinct()
    reason = F.when(c("k") % 4 == 0, "OK").when(c("k") % 4 == 1, "TOURNAMENT_UNMAPPED").when(c("k") % 4 == 2, "NO_MAIN_LINE")
    audits = now.filter("provider = 'error'").select(*key, F.struct("observed_us", "event_id").alias("at"), reason.alias("reason"))
    valid = now.filter((c("provider") == "view") & c("mainline_verified") & c("price").between(1.8, 2.2))
    return diagnosis.causes(schedule, now.filter("provider = 'click'"), audits, valid, key)


# ---- cohorts and the rounds of their windows --------------------------------------------------
_WINDOWS = """leagues AS (SELECT DISTINCT league, CAST(substr(league, 2) AS BIGINT) AS l FROM snapshots),
w AS (SELECT league, d, 1704067200000000 + d * 86400000000 + 43200000000 AS start_us, 1704067200000000 + d * 86400000000 + 43200000000 + (18 + 12 * (l % 3)) * 3600000000 AS end_us FROM leagues, range(0, 30) r(d)),
m AS (SELECT DISTINCT w.league, w.d, start_us, end_us, f.fixture_id, f.kickoff_us FROM w JOIN snapshots f ON f.league = w.league AND f.kickoff_us >= start_us AND f.kickoff_us < end_us),
o AS (SELECT m.league, m.d, m.fixture_id, MAX(CASE WHEN provider = 'error' THEN 1 ELSE 0 END) = 1 AS seen, MAX(CASE WHEN provider = 'view' THEN 1 ELSE 0 END) = 1 AS quoted,
  arg_max(price BETWEEN 1.8e0 AND 2.2e0, observed_us::HUGEINT * 1000000 + event_id) FILTER (provider = 'view') AS core, arg_max(CASE WHEN k % 2 = 0 THEN 'NO_MAIN_LINE' ELSE '' END, observed_us::HUGEINT * 1000000 + event_id) FILTER (provider = 'error') AS told
  FROM m JOIN snapshots e ON e.fixture_id = m.fixture_id AND e.observed_us >= start_us AND e.observed_us < end_us GROUP BY ALL)"""


@query("JON-32", views=("snapshots",), sql=f"""WITH {_WINDOWS}, x AS (SELECT m.league, CAST(m.d AS BIGINT) AS day, m.fixture_id, m.kickoff_us <= start_us + 21600000000 AS past, m.league NOT IN {_UNASKED} AS asked, m.league = '{_UNASKED[0]}' AS skipped, m.league IN {_BROKEN} AS broken,
  coalesce(seen, false) AS seen, coalesce(quoted, false) AS quoted, coalesce(core, false) AS core, told FROM m LEFT JOIN o USING (league, d, fixture_id))
SELECT league, day, fixture_id, CASE WHEN past AND NOT seen THEN 'KICKOFF_PASSED' WHEN NOT asked AND skipped THEN 'SKIPPED_QUOTA' WHEN NOT asked THEN 'UNQUERIED' WHEN NOT seen AND broken THEN 'API_FAILURE' WHEN NOT seen THEN 'NO_FIXTURE_IN_PROVIDER_RESPONSE'
  WHEN core THEN 'OBSERVED_CORE_ODDS' WHEN quoted THEN 'OBSERVED_OUTSIDE_CORE_PRICE' ELSE coalesce(nullif(told, ''), 'NO_VERIFIED_PREMATCH_ODDS') END AS reason FROM x""")
def jon_32(spark, sf):
    """Fixtures of every cohort (league and football day, windows of 18 to 42 hours) with what their rounds in the window saw."""
    s = snaps(spark, sf)
    days = s.select("league").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<bigint>")))
    start = F.lit(1_704_067_200_000_000 + 12 * V.HOUR_US) + c("day") * F.lit(V.DAY_US)
    hours = F.lit(18) + 12 * (F.substring("league", 2, 9).cast("long") % 3)
    windows = days.withColumn("start_us", start).withColumn("end_us", c("start_us") + hours * F.lit(V.HOUR_US))
    fixtures = s.select("league", "fixture_id", "kickoff_us").distinct()
    members = diagnosis.interval_join(windows, fixtures, ["league"], "start_us", "end_us", "kickoff_us", V.DAY_US)
    rounds = s.select("fixture_id", "observed_us", "event_id", "provider", "price", "k")
    seen = diagnosis.interval_join(members.select("league", "day", "fixture_id", "start_us", "end_us"), rounds, ["fixture_id"], "start_us", "end_us", "observed_us", V.DAY_US)
    at = F.struct("observed_us", "event_id")
    is_ = lambda p: c("provider") == p
    o = seen.groupBy("league", "day", "fixture_id").agg(
        F.max(is_("error")).alias("seen"), F.max(is_("view")).alias("quoted"), F.max_by(c("price").between(1.8, 2.2), F.when(is_("view"), at)).alias("core"),
        F.max_by(F.when(c("k") % 2 == 0, "NO_MAIN_LINE").otherwise(""), F.when(is_("error"), at)).alias("told"))
    j = members.join(o, ["league", "day", "fixture_id"], "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    league = c("league")
    reason = diagnosis.cohort_reason(c("kickoff_us") <= c("start_us") + 6 * V.HOUR_US, ~league.isin(*_UNASKED), league == _UNASKED[0], yes(c("seen")), league.isin(*_BROKEN), yes(c("quoted")), yes(c("core")) & yes(c("quoted")), F.when(yes(c("seen")), c("told")))
    return j.select("league", "day", "fixture_id", reason.alias("reason"))


# ---- persistence of candidates ----------------------------------------------------------------
_AGG21 = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, provider ORDER BY observed_us, event_id) AS r1, COUNT(*) OVER (PARTITION BY fixture_id, provider) AS m FROM snapshots),
p AS (SELECT a.fixture_id, a.league, b.line - a.line AS dl, b.ou_line - a.ou_line AS dt, a.favorite_side <> b.favorite_side AS sw, list_filter([1, 2, 3, 4, 5, 7], lambda x: a.k % x = 0) AS c1, list_filter([1, 2, 3, 4, 5, 7], lambda x: b.k % x = 0) AS c2
  FROM s a JOIN s b ON a.fixture_id = b.fixture_id AND a.provider = b.provider AND a.r1 = 1 AND b.r1 = b.m WHERE a.m >= 2 AND a.provider IN ('view', 'click')),
x AS (SELECT 'P' || unnest(list_distinct(list_concat(c1, c2))) AS candidate, * FROM p),
y AS (SELECT candidate, fixture_id, league, sw, list_contains(c1, CAST(substr(candidate, 2) AS INT)) AS f, list_contains(c2, CAST(substr(candidate, 2) AS INT)) AS l,
  CASE WHEN dl > 0 THEN 'UP' WHEN dl < 0 THEN 'DOWN' ELSE 'FLAT' END AS ah, CASE WHEN dt > 0 THEN 'UP' WHEN dt < 0 THEN 'DOWN' END AS ou FROM x),
h AS (SELECT candidate, kind, bucket, COUNT(*) AS n FROM (SELECT candidate, 'ah' AS kind, ah AS bucket FROM y UNION ALL SELECT candidate, 'ou', coalesce(ou, 'UNKNOWN') FROM y UNION ALL SELECT candidate, 'league', league FROM y) GROUP BY ALL),
g AS (SELECT candidate, string_agg(bucket || ':' || n, ',' ORDER BY bucket) FILTER (kind = 'ah') AS ah, string_agg(bucket || ':' || n, ',' ORDER BY bucket) FILTER (kind = 'ou') AS ou, string_agg(bucket || ':' || n, ',' ORDER BY bucket) FILTER (kind = 'league') AS league FROM h GROUP BY candidate)
SELECT candidate, COUNT(DISTINCT fixture_id) AS members, COUNT(*) FILTER (f) AS first_hits, COUNT(*) FILTER (l) AS latest_hits, COUNT(*) FILTER (f AND l) AS persisted, COUNT(*) FILTER (l AND NOT f) AS appeared, COUNT(*) FILTER (f AND NOT l) AS disappeared,
  COUNT(*) FILTER (sw) AS switched, g.ah, g.ou, g.league, CASE WHEN COUNT(*) FILTER (f) > 0 THEN round(COUNT(*) FILTER (f AND l) / COUNT(*) FILTER (f), 4) END AS persistence_rate FROM y JOIN g USING (candidate) GROUP BY candidate, g.ah, g.ou, g.league"""


@query("AGG-21", views=("snapshots",), sql=_AGG21)
def agg_21(spark, sf):
    """Candidates seen first and latest in two streams: hits, persistence, and where lines and leagues moved."""
    ids = F.filter(F.array(*[F.lit(i) for i in (1, 2, 3, 4, 5, 7)]), lambda x: c("k") % x == 0)
    names = F.transform(ids, lambda x: F.concat(F.lit("P"), x.cast("string")))
    s = snaps(spark, sf).withColumn("candidates", names)
    fields = ["line", "ou_line", "favorite_side", "candidates", "league"]
    one = lambda p: movement.first_latest(s.filter(c("provider") == p), "fixture_id", ["observed_us", "event_id"], fields)
    rows = one("view").union(one("click"))
    turn = lambda f, flat: F.when(c(f"latest.{f}") > c(f"first.{f}"), "UP").when(c(f"latest.{f}") < c(f"first.{f}"), "DOWN").otherwise(flat)
    rows = rows.select("fixture_id", c("first.candidates").alias("a"), c("latest.candidates").alias("b"), (c("first.favorite_side") != c("latest.favorite_side")).alias("sw"), turn("line", F.lit("FLAT")).alias("ah"), turn("ou_line", F.lit(None)).alias("ou"), c("first.league").alias("lg"))
    out = diagnosis.persistence(rows, "a", "b", "fixture_id", c("sw"), {"ah": c("ah"), "ou": c("ou"), "league": c("lg")})
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias(m)
    return out.select("candidate", "members", "first_hits", "latest_hits", "persisted", "appeared", "disappeared", "switched", text("ah"), text("ou"), text("league"), "persistence_rate")


# ---- line markers -----------------------------------------------------------------------------
def marker_docs(spark, sf):
    """Two handicap markets and a total per document: markers set, unset or absent, sides and markets switched off, a book that is absent."""
    k = c("k")
    player = lambda p, main, on: F.struct(F.create_map(F.lit("0"), F.struct(p.alias("price"), on.alias("active"), main.alias("mainLine"))).alias("players"))
    market = lambda on, a, b: F.struct(on.alias("marketActive"), F.create_map(F.lit("1"), a, F.lit("2"), b).alias("outcomes"))
    yes = F.lit(True)
    q = (c("home_line") * 4).cast("int")
    near = F.when(q == 4, 3).otherwise(q + 1)
    markets = F.create_map(
        F.concat(F.lit("A"), q + 4), market(k % 6 != 0, player(c("home_price"), F.when(k % 3 != 0, k % 3 == 1), k % 5 != 0), player(c("away_price"), F.when(k % 4 != 1, k % 4 != 2), yes)),
        F.concat(F.lit("A"), near + 4), market(yes, player(c("home_price"), F.lit(False), k % 7 != 0), player(c("away_price"), F.lit(False), yes)),
        F.concat(F.lit("T"), (c("ou_line") * 4).cast("int")), market(F.when(k % 8 != 0, k % 8 != 1), player(c("over_price"), yes, yes), player(c("under_price"), yes, yes)))
    book = F.struct((k % 10 != 0).alias("bookmakerIsActive"), (k % 9 == 0).alias("suspended"), markets.alias("markets"))
    books = F.when(k % 17 == 0, F.create_map(F.lit("elsewhere"), book)).otherwise(F.create_map(F.lit("bk"), book))
    return snaps(spark, sf).select("event_id", json(F.struct(c("event_id").cast("string").alias("fixtureId"), iso(c("kickoff_us")).alias("startTime"), books.alias("bookmakerOdds"))).alias("doc"))


def _marked(spark, sf):
    """The catalog is older than the documents: it lacks the market A7 and all totals over 2.5."""
    cat = catalog(spark, sf).filter((c("sport_id") == 10) & (c("period") == "FullTime") & (c("market_id") != "A7") & ~((c("kind") == "OU") & (c("handicap") > 2.5)))
    one = cat.groupBy("market_id").agg(F.max(c("kind") == "AH").alias("handicap_market"), F.max("handicap").alias("handicap"), F.max(F.when(F.lower("outcome_name").isin("home", "1", "over"), c("outcome_id"))).alias("home_id"), F.max(F.when(F.lower("outcome_name").isin("away", "2", "under"), c("outcome_id"))).alias("away_id"))
    return diagnosis.marker_bits(marker_docs(spark, sf), "doc", "event_id", "bk", one)


# One row per market of a document, as the documents hold them.
_MK = """mk AS (SELECT event_id, k, 'A' || (CAST(home_line * 4 AS INT) + 4) AS id, home_line AS hc, k % 6 <> 0 AS act, k % 5 <> 0 AS ha, CASE WHEN k % 3 <> 0 THEN k % 3 = 1 END AS hm, CASE WHEN k % 4 <> 1 THEN k % 4 <> 2 END AS am FROM snapshots
  UNION ALL SELECT event_id, k, 'A' || (CASE WHEN CAST(home_line * 4 AS INT) = 4 THEN 3 ELSE CAST(home_line * 4 AS INT) + 1 END + 4), (CASE WHEN CAST(home_line * 4 AS INT) = 4 THEN 3 ELSE CAST(home_line * 4 AS INT) + 1 END) / 4e0, true, k % 7 <> 0, false, false FROM snapshots
  UNION ALL SELECT event_id, k, 'T' || CAST(ou_line * 4 AS INT), ou_line, CASE WHEN k % 8 <> 0 THEN k % 8 <> 1 END, true, true, true FROM snapshots),
cat AS (SELECT DISTINCT 'A' || (CAST(home_line * 4 AS INT) + 4) AS id FROM snapshots UNION SELECT DISTINCT 'T' || CAST(ou_line * 4 AS INT) FROM snapshots WHERE ou_line <= 2.5),
x AS (SELECT mk.*, id <> 'A7' AND id IN (SELECT id FROM cat) AS known, id LIKE 'A%' AS ah, 'H_' || CASE WHEN hm THEN 'TRUE' WHEN NOT hm THEN 'FALSE' ELSE 'MISSING' END || '__A_' || CASE WHEN am THEN 'TRUE' WHEN NOT am THEN 'FALSE' ELSE 'MISSING' END AS sig FROM mk WHERE k % 17 <> 0)"""
_DOCS = "(SELECT event_id, k % 17 = 0 AS gone FROM snapshots) d"



def _sig_text(m="signatures"):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias(m)


@query("NRM-48", views=("snapshots",), sql=f"""WITH {_MK}, l AS (SELECT *, act AND known AND ah AND ha AS line FROM x),
g AS (SELECT event_id, COUNT(*) FILTER (act) AS am, COUNT(*) FILTER (act AND known) AS km, string_agg(id, ',' ORDER BY id) FILTER (act AND NOT known) AS un, COUNT(*) FILTER (line) AS ah, COUNT(*) FILTER (line AND hm AND am) AS main FROM l GROUP BY event_id),
t AS (SELECT event_id, string_agg(sig || ':' || n, ',' ORDER BY sig) AS sigs FROM (SELECT event_id, sig, COUNT(*) AS n FROM l WHERE line GROUP BY ALL) GROUP BY event_id)
SELECT d.event_id, coalesce(g.am, 0) AS active_markets, coalesce(km, 0) AS known_markets, coalesce(un, '') AS unknown_ids, coalesce(ah, 0) AS handicaps, coalesce(sigs, '') AS signatures,
  CASE WHEN gone THEN 'NO_BOOKMAKER' WHEN ah > 0 AND main > 0 THEN 'HAS_EXPLICIT_MAIN_AH' WHEN ah > 0 THEN 'AH_PRESENT_NO_EXPLICIT_MAIN' WHEN un IS NOT NULL THEN 'NO_RECOGNIZED_ACTIVE_AH_WITH_UNKNOWN_MARKETS' ELSE 'NO_RECOGNIZED_ACTIVE_AH_MARKET' END AS state
FROM {_DOCS} LEFT JOIN g USING (event_id) LEFT JOIN t USING (event_id)""")
def nrm_48(spark, sf):
    """Line marker diagnostic per document: markets, unknown ids, signatures of the markers, state."""
    d = diagnosis.marker_diagnostic(_marked(spark, sf), "event_id")
    return d.select("event_id", "active_markets", "known_markets", F.array_join("unknown_ids", ",").alias("unknown_ids"), "handicaps", _sig_text(), "state")


@query("NRM-18", views=("snapshots",), sql=f"""WITH {_MK}, l AS (SELECT * FROM x WHERE act AND known AND ah),
t AS (SELECT event_id, string_agg(sig || ':' || n, ',' ORDER BY sig) AS sigs FROM (SELECT event_id, sig, COUNT(*) AS n FROM l GROUP BY ALL) GROUP BY event_id),
g AS (SELECT event_id, COUNT(*) AS n, string_agg(CAST(hc AS VARCHAR), ',' ORDER BY hc) FILTER (hm AND am) AS marked FROM l GROUP BY event_id)
SELECT d.event_id, coalesce(n, 0) AS handicaps, coalesce(sigs, '') AS signatures, coalesce(marked, '') AS marked_lines FROM {_DOCS} LEFT JOIN g USING (event_id) LEFT JOIN t USING (event_id)""")
def nrm_18(spark, sf):
    """Handicap markets by the signature of their markers, and the lines marked on both sides."""
    d = diagnosis.marker_shape(_marked(spark, sf), "event_id")
    return d.select("event_id", "handicaps", _sig_text(), F.array_join(F.transform("marked_lines", lambda x: x.cast("string")), ",").alias("marked_lines"))


@query("NRM-19", views=("snapshots",), sql=f"""WITH {_MK}, s AS (SELECT sig, event_id, COUNT(*) AS n FROM x WHERE act AND known AND ah GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY event_id) AS rn FROM s)
SELECT sig AS signature, COUNT(*) AS documents, CAST(SUM(n) AS BIGINT) AS markets, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (rn <= 20) AS sample FROM r GROUP BY sig""")
def nrm_19(spark, sf):
    """Marker signatures over all documents, with the first documents of each."""
    d = diagnosis.marker_summary(cut(diagnosis.marker_shape(_marked(spark, sf), "event_id").select("event_id", "signatures")), "event_id")
    return d.select("signature", "documents", "markets", F.array_join(c("sample").cast("array<string>"), ",").alias("sample"))


@query("NRM-46", views=("snapshots",), sql=f"""WITH {_MK}, g AS (SELECT event_id, COUNT(*) AS n, COUNT(*) FILTER (act IS NULL OR act) AS am, COUNT(*) FILTER (known) AS km, string_agg(id || ':' || CASE WHEN known THEN 'known' ELSE 'unknown' END || ':' ||
  CASE WHEN known THEN CASE WHEN hm THEN 1 ELSE 0 END + CASE WHEN am THEN 1 ELSE 0 END ELSE 0 END, ',' ORDER BY id) AS sample FROM (SELECT * REPLACE (coalesce(act, true) AS act) FROM x) GROUP BY event_id)
SELECT event_id, k % 17 <> 0 AS has_book, CASE WHEN k % 17 <> 0 THEN k % 10 <> 0 END AS book_active, CASE WHEN k % 17 <> 0 THEN k % 9 = 0 END AS suspended, coalesce(g.n, 0) AS markets, coalesce(g.am, 0) AS active_markets, coalesce(km, 0) AS catalog_matches, coalesce(sample, '') AS sample
FROM snapshots LEFT JOIN g USING (event_id)""")
def nrm_46(spark, sf):
    """Shape of a document's odds without its prices: the book, its markets, what the catalog knows of them."""
    d = diagnosis.odds_shape(_marked(spark, sf), "event_id")
    return d.select("event_id", "has_book", "book_active", "suspended", "markets", "active_markets", "catalog_matches", F.array_join("sample", ",").alias("sample"))
