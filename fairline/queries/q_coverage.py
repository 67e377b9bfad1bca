"""Slots, coverage, inventories, audits, health and constraint suites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fairline.functions import names, times
from fairline.functions.exact import ratio
from fairline.functions.lines import is_quarter_line
from fairline.functions.reasons import first_reason
from fairline.operators import coverage as C
from fairline.operators import filters, quality, results
from fairline.queries import sqlviews as S
from fairline.queries.q_snapshots import CORE, OUTCOMES, SV, outcomes
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col
SHIFT_DAYS = 1000
SHIFT = SHIFT_DAYS * V.DAY_US
NOW = 1_792_500_000_000_000  # a clock inside the shifted observation period

# ---- slots ------------------------------------------------------------------------------------
_HOURS = """CASE WHEN d < DATE '2026-10-12' THEN CASE WHEN isodow(d) >= 6 THEN [12, 15, 18, 19, 20, 21, 22] ELSE [18, 21] END
  ELSE CASE WHEN isodow(d) >= 6 OR d >= DATE '2026-10-13' THEN [15, 18, 21, 0] ELSE [18, 21] END END"""
SLOTS = f"""obs AS (SELECT event_id, fixture_id, observed_us + {SHIFT} AS observed_us, kickoff_us + {SHIFT} AS kickoff_us, {CORE} AS ok FROM snapshots),
od AS (SELECT *, CAST(make_timestamp(observed_us) + INTERVAL 7 HOURS - INTERVAL 6 HOURS AS DATE) AS d FROM obs),
dd AS (SELECT DISTINCT d FROM od), sl AS (SELECT d, unnest({_HOURS}) AS hour FROM dd),
slots AS (SELECT d, hour, epoch_us(CAST(d AS TIMESTAMP)) + (hour + CASE WHEN hour < 6 THEN 24 ELSE 0 END - 7) * 3600000000 AS target_us FROM sl),
mt AS (SELECT od.event_id, od.fixture_id, od.observed_us, MAX(slots.target_us) AS target_us FROM od JOIN slots ON od.d = slots.d AND slots.target_us <= od.observed_us WHERE ok AND od.observed_us <= {NOW} GROUP BY ALL),
matched AS (SELECT * FROM mt WHERE observed_us - target_us <= 9000000000),
mg AS (SELECT target_us, COUNT(*) AS n, COUNT(DISTINCT fixture_id) AS fixtures, MAX(observed_us) AS last_us FROM matched GROUP BY target_us),
cv AS (SELECT strftime(d, '%Y-%m-%d') AS football_day, CAST(hour AS INTEGER) AS hour, slots.target_us, CASE WHEN n > 0 THEN 'OBSERVED' WHEN slots.target_us > {NOW} THEN 'UPCOMING' WHEN {NOW} > slots.target_us + 9000000000 THEN 'MISSED' ELSE 'MISSING' END AS state,
  coalesce(n, 0) AS valid_snapshot_count, coalesce(fixtures, 0) AS canonical_fixture_count, {S.r('(last_us - slots.target_us) / 6e7', 2)} AS lag_minutes, last_us FROM slots LEFT JOIN mg USING (target_us)),
cov AS (SELECT * EXCLUDE (last_us), CASE WHEN last_us - target_us <= 1800000000 THEN 'ON_TIME' WHEN last_us - target_us > 1800000000 THEN 'LATE' ELSE state END AS observation_timing FROM cv)"""


def _obs(spark, sf):
    s = V.snapshots(spark, sf).withColumn("_ok", filters.collectable())
    s = s.withColumn("observed_us", c("observed_us") + SHIFT).withColumn("kickoff_us", c("kickoff_us") + SHIFT)
    return s.withColumn("football_day", times.football_day(F.timestamp_micros("observed_us")))


def _cov(spark, sf):
    o = _obs(spark, sf)
    sl = C.slots(o.select("football_day").distinct())
    m = C.assign_slots(o.filter("_ok"), sl, now_us=F.lit(NOW))
    return sl, m, C.slot_coverage(sl, m, NOW).withColumn("football_day", c("football_day").cast("string"))


@query("STM-01", views=("snapshots",), sql=f"WITH {SLOTS} SELECT strftime(d, '%Y-%m-%d') AS football_day, CAST(hour AS INTEGER) AS hour, target_us FROM slots")
def stm_01(spark, sf):
    return _cov(spark, sf)[0].withColumn("football_day", c("football_day").cast("string"))


@query("STM-03", "FLT-35", views=("snapshots",), sql=f"WITH {SLOTS} SELECT event_id, target_us FROM matched")
def stm_03(spark, sf):
    return _cov(spark, sf)[1].select("event_id", "target_us")


@query("STM-05", "STM-04", views=("snapshots",), sql=f"WITH {SLOTS} SELECT * FROM cov")
def stm_05(spark, sf):
    return _cov(spark, sf)[2]


@query("STM-15", views=("snapshots",), sql=f"WITH {SLOTS} SELECT football_day, hour, target_us FROM cov WHERE state = 'MISSED'")
def stm_15(spark, sf):
    return C.expired_slots(_cov(spark, sf)[2])


@query("STM-07", "STM-06", views=("snapshots",), sql=f"""WITH {SLOTS} SELECT cov.target_us, CASE WHEN valid_snapshot_count > 0 AND lag_us <= 1800000000 THEN 'PASS' WHEN valid_snapshot_count > 0 THEN 'LATE_OBSERVED' WHEN {NOW} < cov.target_us THEN 'UPCOMING'
  WHEN {NOW} >= cov.target_us + 1800000000 THEN 'OVERDUE' ELSE 'RECOVERY_REQUIRED' END AS state FROM cov LEFT JOIN (SELECT target_us, last_us - target_us AS lag_us FROM mg) USING (target_us)""")
def stm_07(spark, sf):
    sl, m, cov = _cov(spark, sf)
    last = m.groupBy("target_us").agg(F.max("observed_us").alias("o"), F.count("*").alias("n"))
    st = C.deadline_state(c("target_us"), F.lit(NOW), c("o"), c("n"), F.lit(False), F.lit(None).cast("string"))
    return sl.join(last, "target_us", "left").select("target_us", st.alias("state"))


@query("GAT-15", views=("snapshots",), sql=f"""WITH {SLOTS}, g AS (SELECT football_day, COUNT(*) FILTER (WHERE state <> 'UPCOMING') AS expected_elapsed_slots, COUNT(*) FILTER (WHERE state = 'OBSERVED') AS observed_slots,
  COUNT(*) FILTER (WHERE state = 'OBSERVED' AND observation_timing = 'ON_TIME') AS on_time_slots, COUNT(*) FILTER (WHERE state = 'MISSED') AS missed_slots FROM cov GROUP BY football_day)
SELECT *, {S.r('CAST(observed_slots AS DOUBLE) / nullif(CAST(expected_elapsed_slots AS DOUBLE), 0)', 3)} AS coverage_fraction, CASE WHEN expected_elapsed_slots = 0 THEN 'NOT_DUE' WHEN on_time_slots = expected_elapsed_slots THEN 'COMPLETE'
  WHEN observed_slots = expected_elapsed_slots THEN 'DEGRADED_TIMING' ELSE 'DEGRADED' END AS collection_state FROM g""")
def gat_15(spark, sf):
    return C.day_coverage(_cov(spark, sf)[2])


@query("STM-12", "FLT-34", "DQC-06", views=("snapshots",), sql=f"""WITH x AS (SELECT event_id, observed_us, observed_us // 10800000000 * 10800000000 AS target, CASE k % 4 WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'ZERO_FIXTURES' WHEN 2 THEN 'FAILED' ELSE 'OBSERVED' END AS st, k FROM snapshots)
SELECT event_id, coalesce(observed_us <= target + 9000000000 AND CASE WHEN st = 'OBSERVED' THEN k % 3 > 0 WHEN st = 'ZERO_FIXTURES' THEN k % 3 = 0 AND k % 5 <> 0 ELSE false END, false) AS valid,
  CASE WHEN k % 6 = 0 THEN st = 'OBSERVED' AND k % 3 > 0 ELSE k % 6 > 1 OR (st = 'OBSERVED' AND k % 3 > 0) END AS attempted FROM x""")
def stm_12(spark, sf):
    """Completion receipts: observed with a count, or a verified empty day."""
    k = c("k")
    st = F.when(k % 4 == 1, "ZERO_FIXTURES").when(k % 4 == 2, "FAILED").otherwise("OBSERVED")
    x = V.snapshots(spark, sf).withColumn("target", V.div(c("observed_us"), 10_800_000_000) * 10_800_000_000).withColumn("st", st)
    valid = C.valid_completion(c("target"), c("observed_us"), c("observed_us"), c("st"), k % 3, F.lit(0), k % 5 != 0)
    att = C.attempt_receipt(F.when(k % 6 == 0, 0).otherwise(k % 6 - 1), F.lit("OK"), c("st"), k % 3)
    return x.select("event_id", valid.alias("valid"), att.alias("attempted"))


@query("STM-02", sql="""SELECT strftime(CAST(ts + INTERVAL 7 HOURS - INTERVAL 6 HOURS AS DATE), '%Y-%m-%d') AS football_day, event_type, COUNT(*) AS n FROM events WHERE hour(ts + INTERVAL 7 HOURS) >= 12 OR hour(ts + INTERVAL 7 HOURS) < 6 GROUP BY ALL""")
def stm_02(spark, sf):
    """Tumbling football day: 24-hour windows starting 05:00 UTC, rows from 12:00 to 06:00 local."""
    e = V.table(spark, sf, "events").withColumn("t", c("ts").cast("timestamp"))
    hour = F.hour(times.local(c("t")))
    w = F.window("t", "24 hours", "24 hours", "5 hours")
    g = e.filter((hour >= 12) | (hour < 6)).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.date_format(times.local(c("w.start")), "yyyy-MM-dd").alias("football_day"), "event_type", "n")


@query("STM-10", views=("snapshots",), sql="SELECT fixture_id, MIN(observed_us) AS first_us, MAX(observed_us) AS last_us, COUNT(*) AS n FROM snapshots GROUP BY fixture_id")
def stm_10(spark, sf):
    from fairline.streaming.stream import movement_state

    return movement_state(V.snapshots(spark, sf))


@query("STM-13", views=("fixtures", "results"), sql="""WITH a AS (SELECT fixture_id, MIN(ft_home_goals) AS h FROM results WHERE seq = 1 GROUP BY ALL), b AS (SELECT CASE WHEN fixture_id <= 100 THEN -fixture_id ELSE fixture_id END AS fixture_id, MAX(ft_home_goals) AS h FROM results GROUP BY ALL)
SELECT CASE WHEN a.h IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS state, COUNT(*) AS n FROM a FULL JOIN b USING (fixture_id) GROUP BY 1""")
def stm_13(spark, sf):
    """A new load may not remove or change retained results."""
    r = V.results(spark, sf)
    old = r.filter("seq = 1").groupBy("fixture_id").agg(F.min("ft_home_goals").alias("h"))
    moved = F.when(c("fixture_id") <= 100, -c("fixture_id")).otherwise(c("fixture_id"))
    new = r.withColumn("fixture_id", moved).groupBy("fixture_id").agg(F.max("ft_home_goals").alias("h"))
    return quality.full_compare(old, new, ["fixture_id"], ["h"]).groupBy("state").agg(F.count("*").alias("n"))


# ---- retirement -------------------------------------------------------------------------------
_RNOW = 1_707_000_000_000_000
_RET = """a0 AS (SELECT fixture_id, provider, observed_us AS recorded_us, CAST(k % 4 AS VARCHAR) AS fp FROM snapshots), a1 AS (SELECT fixture_id, provider, fp, MIN(recorded_us) AS r FROM a0 GROUP BY ALL),
a AS (SELECT fixture_id, COUNT(*) AS attempts, COUNT(DISTINCT provider) AS sources, MAX(r) - MIN(r) AS span FROM a1 GROUP BY fixture_id),
b AS (SELECT fixture_id FROM snapshot_results GROUP BY fixture_id HAVING COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) > 1),
f AS (SELECT DISTINCT fixture_id, kickoff_us FROM snapshots WHERE fixture_id NOT IN (SELECT fixture_id FROM snapshot_results) OR fixture_id IN (SELECT fixture_id FROM b))"""


@query("WIN-20", views=SV, sql=f"""WITH {_RET}, x AS (SELECT f.fixture_id, coalesce(attempts, 0) AS attempt_count, concat_ws(',', CASE WHEN f.fixture_id IN (SELECT fixture_id FROM b) THEN 'RESULT_CONFLICT' END, CASE WHEN coalesce(attempts, 0) < 4 THEN 'MINIMUM_DISTINCT_ROUNDS' END,
  CASE WHEN coalesce(sources, 0) < 2 THEN 'MINIMUM_SOURCES' END, CASE WHEN {_RNOW} - kickoff_us < 259200000000 THEN 'MINIMUM_AGE_72H' END, CASE WHEN coalesce(span, 0) < 86400000000 THEN 'MINIMUM_ATTEMPT_SPAN_24H' END, CASE WHEN f.fixture_id IN (SELECT fixture_id FROM snapshots WHERE k % 40 = 1) THEN 'INCONSISTENT_IDENTITY' END) AS unmet_gates FROM f LEFT JOIN a USING (fixture_id))
SELECT *, CASE WHEN unmet_gates = '' THEN 'RETIRED_UNRESOLVED' ELSE 'ACTIVE_UNRESOLVED' END AS status FROM x""")
def win_20(spark, sf):
    s, r = V.snapshots(spark, sf), results.result_index(V.snapshot_results(spark, sf))
    blocked = r.filter("ambiguous")
    fx = s.select("fixture_id", "kickoff_us").distinct().join(r.filter(~c("ambiguous")).select("fixture_id"), "fixture_id", "left_anti")
    att = s.select("fixture_id", "provider", c("observed_us").alias("recorded_us"), (c("k") % 4).cast("string").alias("fingerprint"))
    spelled = F.when(c("k") % 40 == 1, F.concat("home", F.lit(" II"))).otherwise(c("home"))  # some snapshots name another team
    return C.retirement(fx, att, blocked, _RNOW, identities=s.select("fixture_id", spelled.alias("home"), "away", "kickoff_us", "league"))


@query("WIN-21", "STR-16", views=("snapshots",), sql="""WITH f AS (SELECT DISTINCT fixture_id, kickoff_us, CAST(make_timestamp(kickoff_us) AS DATE) AS kd FROM snapshots), rd AS (SELECT provider AS round_id, provider, CAST(make_timestamp(observed_us) AS DATE) AS day, COUNT(*) AS proof FROM snapshots GROUP BY ALL)
SELECT fixture_id, round_id, string_agg(CAST(day AS VARCHAR) || '=' || proof, '|' ORDER BY CAST(day AS VARCHAR) || '=' || proof) AS fingerprint FROM f JOIN rd ON rd.day BETWEEN f.kd - 1 AND f.kd + 1 GROUP BY ALL HAVING COUNT(DISTINCT day) = 3""")
def win_21(spark, sf):
    """Rounds that cover the three days around kickoff."""
    s = V.snapshots(spark, sf)
    fx = s.select("fixture_id", "kickoff_us").distinct().withColumn("kickoff_day", F.to_date(F.timestamp_micros("kickoff_us")))
    rd = s.groupBy(c("provider").alias("round_id"), "provider", F.to_date(F.timestamp_micros("observed_us")).alias("day")).agg(F.count("*").cast("string").alias("proof"), F.max("observed_us").alias("m"))
    rd = rd.select("round_id", "provider", "day", "proof", F.lit(_RNOW).alias("recorded_us"))
    return C.covered_attempts(fx, rd).select("fixture_id", "round_id", "fingerprint")


@query("AGG-30", views=SV, sql=f"""WITH f AS (SELECT DISTINCT fixture_id, league, CASE WHEN fixture_id % 10 <> 3 THEN kickoff_us END AS ko FROM snapshots WHERE fixture_id NOT IN (SELECT fixture_id FROM snapshot_results))
SELECT league, COUNT(*) FILTER (WHERE 1705500000000000 - ko >= 10800000000) AS overdue, COUNT(*) FILTER (WHERE 1705500000000000 - ko < 10800000000) AS future_or_recent, COUNT(*) FILTER (WHERE ko IS NULL) AS unknown_kickoff FROM f GROUP BY league""")
def agg_30(spark, sf):
    f = V.snapshots(spark, sf).join(V.snapshot_results(spark, sf).select("fixture_id").distinct(), "fixture_id", "left_anti")
    f = f.select("fixture_id", "league", F.when(c("fixture_id") % 10 != 3, c("kickoff_us")).alias("kickoff_us")).distinct()
    return C.pending_age(f, 1_705_500_000_000_000, ["league"])


@query("AGG-29", "JON-28", views=SV, sql="""WITH f AS (SELECT league, home, away, kickoff_us, COUNT(DISTINCT fixture_id) AS ids, MIN(fixture_id) AS fixture_id FROM snapshots WHERE fixture_id NOT IN (SELECT fixture_id FROM snapshot_results) GROUP BY ALL)
SELECT league, CASE WHEN 1705500000000000 - kickoff_us >= 10800000000 THEN 'ACTIVE_OVERDUE' ELSE 'FUTURE_OR_RECENT' END AS lifecycle, COUNT(*) AS n FROM f GROUP BY ALL""")
def agg_29(spark, sf):
    """Missing-result queue, one row per match identity, counted by lifecycle and league."""
    f = V.snapshots(spark, sf).join(V.snapshot_results(spark, sf).select("fixture_id").distinct(), "fixture_id", "left_anti")
    q = f.groupBy("league", "home", "away", "kickoff_us").agg(F.count_distinct("fixture_id").alias("ids"))
    state = F.when(results.maturity_reason(c("kickoff_us"), F.lit(1_705_500_000_000_000)).isNull(), "ACTIVE_OVERDUE").otherwise("FUTURE_OR_RECENT")
    return q.groupBy("league", state.alias("lifecycle")).agg(F.count("*").alias("n"))


@query("AGG-31", views=("snapshots",), sql="""WITH p AS (SELECT event_id // 3 AS a, MAX(k) AS used, MIN(observed_us) AS mi FROM snapshots GROUP BY 1), d AS (SELECT CAST(make_timestamp(mi) AS DATE) AS d, SUM(used) AS u FROM p GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, CAST(u AS BIGINT) AS day_requests, CAST(SUM(u) OVER (PARTITION BY date_trunc('month', d)) AS BIGINT) AS month_requests FROM d""")
def agg_31(spark, sf):
    s = V.snapshots(spark, sf).select(V.div(c("event_id"), 3).alias("attempt_id"), c("k").alias("requests_used"), c("observed_us").alias("finalized_us"))
    return C.usage(s)


# ---- coverage inventories ---------------------------------------------------------------------
@query("AGG-19", "AGG-20", "JON-35", views=("snapshots",), sql="""WITH g AS (SELECT league, COUNT(*) AS o, COUNT(DISTINCT fixture_id) AS u FROM snapshots WHERE mainline_verified GROUP BY league), t AS (SELECT DISTINCT 'L' || n_nationkey AS league FROM nation)
SELECT league, coalesce(o, 0) AS observations, coalesce(u, 0) AS unique_fixtures, t.league IS NOT NULL AS expected, CASE WHEN o > 0 THEN 'OBSERVED' ELSE 'NO_STRICT_OBSERVATION_YET' END AS coverage_status FROM (SELECT coalesce(g.league, t2.league) AS league, o, u FROM g FULL JOIN t t2 ON g.league = t2.league) x LEFT JOIN t USING (league)""")
def agg_19(spark, sf):
    rows = V.snapshots(spark, sf).filter("mainline_verified")
    t = V.table(spark, sf, "nation").select(F.concat(F.lit("L"), c("n_nationkey")).alias("league"))
    return C.expected_coverage(rows, t, ["league"], "fixture_id")


@query("AGG-18", views=("fixtures", "results"), sql="""SELECT league, COUNT(*) AS fixtures, COUNT(*) FILTER (WHERE fixture_id IN (SELECT fixture_id FROM results)) AS with_result, COUNT(DISTINCT home) AS teams, string_agg(DISTINCT season, ',' ORDER BY season) AS seasons FROM fixtures GROUP BY league""")
def agg_18(spark, sf):
    """Archive inventory by league with observed entity counts."""
    f = V.fixtures(spark, sf).join(V.results(spark, sf).select("fixture_id", F.lit(True).alias("has")).distinct(), "fixture_id", "left")
    return f.groupBy("league").agg(F.count("*").alias("fixtures"), F.count("has").alias("with_result"), F.count_distinct("home").alias("teams"),
                                   F.array_join(F.array_sort(F.collect_set("season")), ",").alias("seasons"))


@query("AGG-16", "AGG-24", "AGG-25", views=("quotes",), sql="""SELECT returnflag, COUNT(*) AS rows, COUNT(*) FILTER (WHERE abs(CAST(round(home_line * 4) AS INTEGER) % 2) = 1) AS quarter_lines, COUNT(DISTINCT home_line) AS distinct_ah_lines, COUNT(DISTINCT ou_line) AS distinct_ou_lines,
  COUNT(*) FILTER (WHERE over_price > 1 AND under_price > 1 AND qty > 5) AS complete_totals, CAST(COUNT(*) FILTER (WHERE qty > 5) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS complete_share FROM quotes GROUP BY returnflag""")
def agg_16(spark, sf):
    """Market capability counters in one pass."""
    q = V.quotes(spark, sf)
    ok = c("qty") > 5
    return q.groupBy("returnflag").agg(
        F.count("*").alias("rows"), F.count_if(is_quarter_line(c("home_line"))).alias("quarter_lines"), F.count_distinct("home_line").alias("distinct_ah_lines"),
        F.count_distinct("ou_line").alias("distinct_ou_lines"), F.count_if((c("over_price") > 1) & (c("under_price") > 1) & ok).alias("complete_totals"), ratio(F.count_if(ok), F.count("*")).alias("complete_share"))


@query("AGG-40", "TOP-04", views=("quotes",), sql="""SELECT coalesce(printf('%.2f', CASE WHEN qty % 9 <> 0 THEN home_line END), 'NA') AS line, COUNT(*) AS n FROM quotes GROUP BY 1 ORDER BY n DESC, line""")
def agg_40(spark, sf):
    """Line histogram with NA, most frequent first."""
    x = F.coalesce(F.format_string("%.2f", F.when(c("qty") % 9 != 0, c("home_line"))), F.lit("NA"))
    x = F.when(c("qty") % 9 != 0, x).otherwise("NA")
    return V.quotes(spark, sf).groupBy(x.alias("line")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "line")


@query("AGG-33", sql="""SELECT 'o_orderstatus' AS column_name, COUNT(*) AS rows, COUNT(*) FILTER (WHERE o_orderstatus <> '') AS non_empty, COUNT(DISTINCT o_orderstatus) AS distinct_values FROM orders
  UNION ALL SELECT 'o_orderpriority', COUNT(*), COUNT(*) FILTER (WHERE o_orderpriority <> ''), COUNT(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', COUNT(*), COUNT(o_custkey), COUNT(DISTINCT o_custkey) FROM orders""")
def agg_33(spark, sf):
    """Schema probe: presence, non-empty and distinct values per column, in one aggregate."""
    cols = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    o = V.table(spark, sf, "orders").select(*cols)
    aggs = [F.count("*").alias("rows")]
    for k in cols:
        aggs += [F.count_if(c(k).cast("string") != "").alias(f"n_{k}"), F.count_distinct(k).alias(f"d_{k}")]
    rows = F.array(*[F.struct(F.lit(k).alias("column_name"), c("rows"), c(f"n_{k}").alias("non_empty"), c(f"d_{k}").alias("distinct_values")) for k in cols])
    return o.agg(*aggs).select(F.inline(rows))


@query("AGG-41", sql="""SELECT p_type AS kind, p_brand, COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS weighted FROM part GROUP BY ALL""")
def agg_41(spark, sf):
    """Gap classes with their counts and weighted counts, every class."""
    return _gaps(spark, sf)


@query("TOP-03", sql="""WITH a AS (SELECT p_type AS kind, p_brand, COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS weighted FROM part GROUP BY ALL) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, p_brand) <= 20""")
def top_03(spark, sf, sample_limit: int = 20):
    """The most frequent samples of each gap class: a report of sample_limit rows a class, ranked after the counts."""
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "p_brand")
    return _gaps(spark, sf).withColumn("rn", F.row_number().over(w)).filter(c("rn") <= sample_limit).drop("rn")


def _gaps(spark, sf):
    return V.table(spark, sf, "part").groupBy(c("p_type").alias("kind"), "p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("weighted"))


@query("AGG-43", "FLT-30", "FLT-31", "FLT-36", sql="""SELECT s_suppkey, concat_ws(',', CASE WHEN s_nationkey % 2 = 0 THEN 'ou_quarter_lines' END, CASE WHEN NOT (s_suppkey % 3 = 0) THEN 'movement_history' END, CASE WHEN s_acctbal < 1000 THEN 'current_odds' END) AS missing,
  s_suppkey % 4 = 1 AS multi_season FROM supplier""")
def agg_43(spark, sf):
    """Source qualification: missing capabilities and the history claim of a depth text, negative words win."""
    n = c("s_suppkey")
    caps = [("ou_quarter_lines", c("s_nationkey") % 2 != 0), ("movement_history", n % 3 == 0), ("current_odds", ~(c("s_acctbal") < 1000))]
    missing = F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(k)) for k, ok in caps])), ",")
    depth = F.when(n % 4 == 0, "no multi-season history").when(n % 4 == 1, "multiple seasons since 2015").when(n % 4 == 2, "current season only").otherwise("unknown")
    claim = F.lower(depth).rlike("multi|seasons|years|since") & ~F.lower(depth).rlike(r"\bno\b|only|unknown|limited")
    return V.table(spark, sf, "supplier").select("s_suppkey", missing.alias("missing"), claim.alias("multi_season"))


@query("AGG-27", views=("market_rows",), sql=f"""WITH x AS (SELECT 'AH' AS market, favorite_side AS selection, favorite_ah_line AS line, {S.profit(S.ah_signs('home_goals', 'away_goals', 'favorite_ah_line', 'favorite_side'), 'favorite_ah_price')} AS p FROM market_rows)
SELECT market, selection, line, COUNT(*) AS n, {S.r('CAST(SUM(CAST(floor(p * 1e6 + 0.5e0) AS BIGINT)) AS BIGINT) / 1e6 / COUNT(*)', 6)} AS opening_flat_stake_roi FROM x GROUP BY ALL""")
def agg_27(spark, sf):
    from fairline.functions.settlement import settle_handicap
    from fairline.operators.patterns import line_roi

    st = settle_handicap(c("home_goals"), c("away_goals"), c("favorite_ah_line"), c("favorite_ah_price"), c("favorite_side"))
    rows = V.market_rows(spark, sf).select(F.lit("AH").alias("market"), c("favorite_side").alias("selection"), c("favorite_ah_line").alias("line"), st["profit_units"].alias("profit_units"))
    return line_roi(rows, ["market", "selection", "line"])


@query("SET-09", views=("market_rows",), sql=f"""WITH a AS (SELECT fixture_id, line_no, part_id, supp_id, qty, 'OPENING' AS stage, home_line AS line, ah_home AS h, ah_away AS w, home_goals, away_goals FROM market_rows UNION ALL SELECT fixture_id, line_no, part_id, supp_id, qty, 'CLOSING_PREMATCH', close_home_line, close_ah_home, close_ah_away, home_goals, away_goals FROM market_rows),
b AS (SELECT *, 'H' AS selection, line AS sl, h AS price, w AS other FROM a UNION ALL SELECT *, 'A', -line, w, h FROM a)
SELECT stage, selection, {S.klass(S.ah_signs('home_goals', 'away_goals', 'sl', 'selection'))} AS settlement, COUNT(*) AS n, {S.sum_micro(S.profit(S.ah_signs('home_goals', 'away_goals', 'sl', 'selection'), 'price'))} AS profit_micro, {S.sum_micro('(1e0 / price) / (1e0 / price + 1e0 / other)')} AS share_micro FROM b GROUP BY ALL""")
def set_09(spark, sf):
    """Market x stage x side expansion of joined fixtures into settled rows, summarised."""
    from fairline.functions.exact import micro
    from fairline.functions.settlement import settle_handicap

    def row(stage, sel, line, price, other):
        return F.struct(F.lit(stage).alias("stage"), F.lit(sel).alias("selection"), line.alias("sl"), c(price).alias("price"), c(other).alias("other"))

    rows = F.array(row("OPENING", "H", c("home_line"), "ah_home", "ah_away"), row("OPENING", "A", -c("home_line"), "ah_away", "ah_home"),
                   row("CLOSING_PREMATCH", "H", c("close_home_line"), "close_ah_home", "close_ah_away"), row("CLOSING_PREMATCH", "A", -c("close_home_line"), "close_ah_away", "close_ah_home"))
    d = V.market_rows(spark, sf).select("home_goals", "away_goals", F.explode(rows).alias("r")).select("home_goals", "away_goals", "r.*")
    d = d.withColumn("s", settle_handicap(c("home_goals"), c("away_goals"), c("sl"), c("price"), c("selection")))
    share = (F.lit(1.0) / c("price")) / (F.lit(1.0) / c("price") + F.lit(1.0) / c("other"))
    return d.groupBy("stage", "selection", c("s.settlement").alias("settlement")).agg(F.count("*").alias("n"), F.sum(micro(c("s.profit_units"))).alias("profit_micro"), F.sum(micro(share)).alias("share_micro"))


# ---- schedule and cohort ----------------------------------------------------------------------
_SCH = """f AS (SELECT league, fixture_id, kickoff_us, CAST(date_trunc('week', match_day) AS DATE) AS week FROM fixtures), b AS (SELECT MIN(week) AS lo, MAX(week) AS hi FROM f),
t AS (SELECT n_name AS league, n_nationkey AS tid, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM nation, b),
g AS (SELECT league, week, COUNT(*) AS n, COUNT(*) FILTER (WHERE kickoff_us > epoch_us(week) + 259200000000) AS remaining, MIN(CASE WHEN kickoff_us > epoch_us(week) + 259200000000 THEN kickoff_us END) AS next_kickoff FROM f GROUP BY league, week),
s AS (SELECT t.league, tid, strftime(week, '%Y-%m-%d') AS week, coalesce(n, 0) AS scheduled_fixtures, coalesce(remaining, 0) AS remaining_fixtures, coalesce(next_kickoff, 0) AS next_kickoff_us FROM t LEFT JOIN g USING (league, week))"""
_SR = "CASE WHEN remaining_fixtures > 0 THEN 'AWAITING_ODDS' WHEN scheduled_fixtures > 0 THEN 'KICKOFF_PASSED_OR_NOT_PREMATCH' ELSE 'NO_MATCHES' END"


def _schedule(spark, sf, days: int = 7, seen_after: int = 3):
    """Every target in every window of the calendar; a window is looked at some days after it began."""
    f = V.fixtures(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "match_day")))
    fut = c("kickoff_us") > F.unix_micros(c("week").cast("timestamp")) + F.lit(seen_after * V.DAY_US)
    g = f.groupBy("league", "week").agg(F.count("*").alias("n"), F.count_if(fut).alias("r"), F.min(F.when(fut, c("kickoff_us"))).alias("k"))
    b = f.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).first()  # one row
    weeks = F.explode(F.sequence(F.lit(b["lo"]).cast("date"), F.lit(b["hi"]).cast("date"), F.expr(f"INTERVAL {days} DAYS")))
    z = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    t = V.table(spark, sf, "nation").select(c("n_name").alias("league"), c("n_nationkey").alias("tid"), weeks.alias("week"))
    return t.join(g, ["league", "week"], "left").select("league", "tid", c("week").cast("string").alias("week"), z("n").alias("scheduled_fixtures"), z("r").alias("remaining_fixtures"), z("k").alias("next_kickoff_us"))


@query("JON-29", views=("fixtures",), sql=f"WITH {_SCH} SELECT *, {_SR} AS reason FROM s")
def jon_29(spark, sf):
    """Schedule coverage of every target and window with its next kickoff."""
    return _schedule(spark, sf).withColumn("reason", C.schedule_reason(c("scheduled_fixtures"), c("remaining_fixtures"), F.lit(True)))


@query("JON-30", views=("fixtures",), sql=f"WITH {_SCH} SELECT league, week, CASE WHEN {_SR} <> 'AWAITING_ODDS' THEN {_SR} WHEN tid % 3 = 0 THEN 'QUOTA_SKIPPED' WHEN tid % 3 = 1 AND tid % 2 = 0 THEN 'OBSERVED' WHEN tid % 3 = 1 THEN 'NO_MARKET' ELSE 'NO_MARKET_RESPONSE' END AS reason FROM s")
def jon_30(spark, sf):
    """Request evidence joined back to the coverage rows."""
    cov = _schedule(spark, sf).withColumn("reason", C.schedule_reason(c("scheduled_fixtures"), c("remaining_fixtures"), F.lit(True)))
    ev = V.table(spark, sf, "nation").filter("n_nationkey % 3 = 1").select(c("n_name").alias("league"), F.lit(1).alias("rows"), (1 - c("n_nationkey") % 2).alias("strict"))
    j = cov.join(ev, "league", "left")
    out = F.when(c("reason") != "AWAITING_ODDS", c("reason")).when(c("tid") % 3 == 0, "QUOTA_SKIPPED").when(c("strict") > 0, "OBSERVED").when(c("rows") > 0, "NO_MARKET").otherwise("NO_MARKET_RESPONSE")
    return j.select("league", "week", out.alias("reason"))


@query("WIN-23", views=("fixtures",), sql=f"WITH {_SCH} SELECT league, week, CAST(row_number() OVER (PARTITION BY week ORDER BY remaining_fixtures DESC, tid % 5, next_kickoff_us, tid) AS INTEGER) AS rank FROM s WHERE remaining_fixtures > 0")
def win_23(spark, sf):
    """Priority within a window: most uncaptured first, then least recently queried. One row per target, hence small rankings."""
    s = _schedule(spark, sf).filter("remaining_fixtures > 0")
    return s.select("league", "week", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("remaining_fixtures"), c("tid") % 5, "next_kickoff_us", "tid")).alias("rank"))


@query("JON-31", views=("snapshots",), sql=f"""WITH x AS (SELECT CAST(make_timestamp(observed_us) AS DATE) AS d, fixture_id, observed_us, kickoff_us FROM snapshots), r AS (SELECT d, MIN(observed_us) AS first_us FROM x WHERE observed_us % 86400000000 >= 28800000000 GROUP BY d)
SELECT strftime(x.d, '%Y-%m-%d') AS day, COUNT(DISTINCT fixture_id) AS cohort FROM x JOIN r USING (d) WHERE x.observed_us <= first_us AND kickoff_us > first_us GROUP BY x.d""")
def jon_31(spark, sf):
    """Fixed cohort: fixtures seen by the day's first receipt after 08:00 UTC whose kickoff is still ahead."""
    x = V.snapshots(spark, sf).withColumn("d", F.to_date(F.timestamp_micros("observed_us")))
    r = x.filter(c("observed_us") % V.DAY_US >= 8 * V.HOUR_US).groupBy("d").agg(F.min("observed_us").alias("first_us"))
    j = x.join(r, "d").filter((c("observed_us") <= c("first_us")) & (c("kickoff_us") > c("first_us")))
    return j.groupBy(c("d").cast("string").alias("day")).agg(F.count_distinct("fixture_id").alias("cohort"))


@query("JON-34", views=("snapshots",), sql="""WITH g AS (SELECT fixture_id, bookmaker, COUNT(*) AS evidence_rows, COUNT(DISTINCT home || away || kickoff_us) AS identities, MIN(kickoff_us) AS ko FROM snapshots GROUP BY ALL)
SELECT fixture_id, bookmaker, evidence_rows, identities > 1 AS identity_conflict, h AS hours_before, ko - h * 3600000000 AS slot_us FROM g, (VALUES (1), (6), (24)) v(h)""")
def jon_34(spark, sf):
    """Reconstruction candidates: evidence merged per (fixture, bookmaker), times the requested slots."""
    ident = F.struct("home", "away", "kickoff_us")
    g = V.snapshots(spark, sf).groupBy("fixture_id", "bookmaker").agg(F.count("*").alias("evidence_rows"), F.min(ident).alias("a"), F.max(ident).alias("b"))
    h = F.explode(F.array(*[F.lit(i) for i in (1, 6, 24)]))
    return g.select("fixture_id", "bookmaker", "evidence_rows", (c("a") != c("b")).alias("identity_conflict"), c("a.kickoff_us").alias("ko"), h.alias("hours_before")).select(
        "fixture_id", "bookmaker", "evidence_rows", "identity_conflict", "hours_before", (c("ko") - c("hours_before").cast("long") * V.HOUR_US).alias("slot_us"))


@query("JON-36", views=("fixtures",), sql="""SELECT season, COUNT(*) FILTER (WHERE league IN ('NATION_3', 'NATION_7')) AS excluded_competition, COUNT(*) FILTER (WHERE league NOT IN ('NATION_3', 'NATION_7') AND region = 4) AS outside_allow_list,
  COUNT(*) FILTER (WHERE league NOT IN ('NATION_3', 'NATION_7') AND region <> 4) AS in_scope FROM fixtures GROUP BY season""")
def jon_36(spark, sf):
    """Scope replay: excluded competitions first, then the allow-list; pivoted by reason."""
    reason = first_reason([(c("league").isin("NATION_3", "NATION_7"), "EXCLUDED"), (c("region") == 4, "UNMAPPED")], accepted="IN_SCOPE")
    f = V.fixtures(spark, sf).withColumn("r", reason)
    return f.groupBy("season").agg(F.count_if(c("r") == "EXCLUDED").alias("excluded_competition"), F.count_if(c("r") == "UNMAPPED").alias("outside_allow_list"), F.count_if(c("r") == "IN_SCOPE").alias("in_scope"))


@query("JON-38", "JON-39", views=("fixtures",), sql="""WITH o AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN 'C' ELSE 'Club ' END || c_custkey AS home FROM customer) SELECT strftime(match_day, '%Y-%m-%d') AS day, COUNT(*) AS fixtures, COUNT(o.home) AS named FROM fixtures LEFT JOIN o USING (home) GROUP BY match_day""")
def jon_38(spark, sf):
    """Name coverage of another source by day."""
    o = V.table(spark, sf, "customer").select(F.concat(F.when(c("c_mktsegment") == "BUILDING", "C").otherwise("Club "), c("c_custkey")).alias("home"), F.lit(1).alias("hit"))
    return V.fixtures(spark, sf).join(o, "home", "left").groupBy(c("match_day").cast("string").alias("day")).agg(F.count("*").alias("fixtures"), F.count("hit").alias("named"))


@query("JON-24", "JON-25", views=("fixtures",), sql="""WITH e AS (SELECT home AS team, away AS provider_name FROM fixtures), g AS (SELECT team, COUNT(DISTINCT provider_name) AS names, MIN(provider_name) AS nm, COUNT(*) AS fixtures FROM e GROUP BY team),
o AS (SELECT provider_name, COUNT(DISTINCT team) AS owners FROM e GROUP BY provider_name) SELECT team, fixtures, names = 1 AND owners = 1 AND fixtures >= 2 AS proven FROM g LEFT JOIN o ON g.nm = o.provider_name""")
def jon_24(spark, sf):
    """Identity proof: one spelling per club, one owner per spelling, at least two fixtures."""
    e = V.fixtures(spark, sf).select(c("home").alias("team"), c("away").alias("provider_name"))
    g = e.groupBy("team").agg(F.count("*").alias("fixtures"), F.min("provider_name").alias("lo"), F.max("provider_name").alias("hi"))
    o = e.groupBy(c("provider_name").alias("lo")).agg(F.min("team").alias("t1"), F.max("team").alias("t2"))
    return g.join(o, "lo").select("team", "fixtures", ((c("lo") == c("hi")) & (c("t1") == c("t2")) & (c("fixtures") >= 2)).alias("proven"))


@query("FLT-24", "FLT-37", "FLT-38", sql="""WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name || ' League' WHEN 1 THEN p_name || ' Cup' WHEN 2 THEN 'UEFA ' || p_name || ' League' WHEN 3 THEN p_name || ' League Women' WHEN 4 THEN p_name || ' Division 2' ELSE p_name END AS n FROM part)
SELECT id, CASE WHEN id % 6 = 3 THEN 'EXCLUDED' WHEN id % 6 = 2 THEN 'EUROPEAN_CUP' WHEN id % 6 = 1 THEN 'DOMESTIC_CUP' WHEN id % 6 IN (0, 4) THEN 'LEAGUE' ELSE 'OTHER' END AS class, CASE WHEN id % 6 = 4 THEN 2 WHEN id % 6 = 0 THEN 1 ELSE 0 END AS tier FROM x""")
def flt_24(spark, sf):
    """Competition classes by name; excluded words first, then European cups, cups, leagues; tier from a digit."""
    m, n = c("p_partkey") % 6, c("p_name")
    name = (F.when(m == 0, F.concat(n, F.lit(" League"))).when(m == 1, F.concat(n, F.lit(" Cup"))).when(m == 2, F.concat(F.lit("UEFA "), n, F.lit(" League")))
            .when(m == 3, F.concat(n, F.lit(" League Women"))).when(m == 4, F.concat(n, F.lit(" Division 2"))).otherwise(n))
    d = V.table(spark, sf, "part").select(c("p_partkey").alias("id"), name.alias("n"))
    low = F.lower("n")
    klass = (F.when(c("n").rlike(names.WOMEN_SCOPE) | c("n").rlike(names.YOUTH_SCOPE) | low.rlike(r"\b(reserves?|friendl)"), "EXCLUDED").when(low.rlike(r"\b(uefa|champions league|europa)\b"), "EUROPEAN_CUP")
             .when(low.rlike(r"\b(cup|pokal|copa|coupe)\b"), "DOMESTIC_CUP").when(low.rlike(r"\b(league|division|liga|serie)\b"), "LEAGUE").otherwise("OTHER"))
    d = d.withColumn("class", klass)
    digit = F.regexp_extract("n", r"\b([1-4])\b", 1).try_cast("int")
    return d.select("id", "class", F.when(c("class") == "LEAGUE", F.coalesce(digit, F.lit(1))).otherwise(0).alias("tier"))


@query("FLT-23", views=("quotes",), sql="""SELECT fixture_id, line_no, part_id, supp_id, qty, CASE qty % 3 WHEN 0 THEN returnflag <> 'A' WHEN 1 THEN returnflag <> 'N' ELSE true END AS two_sided FROM quotes""")
def flt_23(spark, sf):
    """Two-sided test per market type: 1X2 needs three prices, handicap and total need both sides."""
    m = c("qty") % 3
    home, away = F.when(~((m == 0) & (c("returnflag") == "A")), c("open_h")), F.when(~((m == 1) & (c("returnflag") == "N")), c("open_a"))
    ok = F.when(m == 0, home.isNotNull() & (c("open_d") > 1) & (c("open_a") > 1)).otherwise((c("open_h") > 1) & F.coalesce(away > 1, F.lit(False)))
    return V.quotes(spark, sf).select("fixture_id", "line_no", "part_id", "supp_id", "qty", F.coalesce(ok, F.lit(False)).alias("two_sided"))


@query("FLT-16", views=("snapshots",), sql="""WITH r AS (SELECT fixture_id, CASE WHEN fixture_id % 3 = 0 THEN 'POSTPONED' WHEN fixture_id % 3 = 1 AND k > 50 THEN 'CANCELLED' WHEN fixture_id % 3 = 1 THEN 'ABANDONED' ELSE 'FT' END AS status, CASE WHEN k % 11 = 0 THEN 'elsewhere' ELSE league END AS league FROM snapshots),
i AS (SELECT fixture_id, MIN(league) AS league FROM snapshots GROUP BY fixture_id), g AS (SELECT r.fixture_id, COUNT(DISTINCT status) AS n, MIN(status) AS status FROM r JOIN i USING (fixture_id, league) WHERE status <> 'FT' GROUP BY r.fixture_id)
SELECT fixture_id, status FROM g WHERE n = 1""")
def flt_16(spark, sf):
    """Lifecycle receipts: identity must agree with all snapshots; conflicting statuses drop out."""
    s = V.snapshots(spark, sf)
    m = c("fixture_id") % 3
    status = F.when(m == 0, "POSTPONED").when((m == 1) & (c("k") > 50), "CANCELLED").when(m == 1, "ABANDONED").otherwise("FT")
    r = s.select("fixture_id", status.alias("status"), F.when(c("k") % 11 == 0, "elsewhere").otherwise(c("league")).alias("league"))
    ident = s.groupBy("fixture_id").agg(F.min("league").alias("league"), F.max("league").alias("l2")).filter("league = l2")
    j = r.filter(c("status").isin("POSTPONED", "CANCELLED", "ABANDONED")).join(ident, ["fixture_id", "league"])
    return j.groupBy("fixture_id").agg(F.min("status").alias("status"), F.max("status").alias("s2")).filter("status = s2").drop("s2")


# ---- audits -----------------------------------------------------------------------------------
_AUD = f"""{OUTCOMES}, st AS (SELECT league, COUNT(*) AS n FROM (SELECT DISTINCT league, fixture_id FROM snapshots WHERE observed_us < kickoff_us AND provider <> 'error') x GROUP BY league),
rc AS (SELECT league, COUNT(DISTINCT fixture_id) AS n FROM snapshots WHERE observed_us < kickoff_us GROUP BY league),
so AS (SELECT league, COUNT(DISTINCT fixture_id) AS n FROM snapshots WHERE fixture_id IN (SELECT fixture_id FROM outcomes) GROUP BY league), sr AS (SELECT league, COUNT(DISTINCT s.fixture_id) AS n FROM snapshots s JOIN snapshot_results r ON s.fixture_id = r.fixture_id GROUP BY league),
c0 AS (SELECT 'prematch_population' AS check_name, league, st.n AS stored, rc.n AS recomputed FROM st FULL JOIN rc USING (league) UNION ALL SELECT 'settled_population', league, so.n, sr.n FROM so FULL JOIN sr USING (league)),
ck AS (SELECT check_name, league, coalesce(stored, 0) AS stored, coalesce(recomputed, 0) AS recomputed, coalesce(stored, 0) = coalesce(recomputed, 0) AS agrees FROM c0)"""


def _audit(spark, sf):
    """Counts of a stored report (made without one provider) against counts from the observations, per league."""
    s = V.snapshots(spark, sf)
    pre = s.filter(filters.is_prematch())
    count = lambda df, name: df.select("league", "fixture_id").distinct().groupBy("league").agg(F.count("*").alias(name))
    known = outcomes(spark, sf).select("fixture_id").distinct()
    reported = V.snapshot_results(spark, sf).select("fixture_id").distinct()

    def check(name, stored, recomputed):
        z = lambda x: F.coalesce(x, F.lit(0)).cast("long")
        j = stored.join(recomputed, "league", "full")
        return j.select(F.lit(name).alias("check_name"), "league", z("stored").alias("stored"), z("recomputed").alias("recomputed")).withColumn("agrees", c("stored") == c("recomputed"))

    a = check("prematch_population", count(pre.filter("provider <> 'error'"), "stored"), count(pre, "recomputed"))
    return a.unionByName(check("settled_population", count(s.join(known, "fixture_id", "left_semi"), "stored"), count(s.join(reported, "fixture_id", "left_semi"), "recomputed")))


@query("GAT-12", views=SV, sql=f"WITH {_AUD} SELECT * FROM ck")
def gat_12(spark, sf):
    """Stored report counts against recomputed ones; a row that disagrees is a failure of that check and league."""
    return _audit(spark, sf)


@query("GAT-09", views=SV, sql=f"""WITH {_AUD} SELECT league, CASE WHEN COUNT(*) FILTER (WHERE NOT agrees) = 0 THEN 'VERIFIED' WHEN COUNT(*) FILTER (WHERE agrees) = 0 THEN 'BLOCKED' ELSE 'PARTIAL' END AS status,
  coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (WHERE NOT agrees), '') AS blockers FROM ck GROUP BY league""")
def gat_09(spark, sf):
    """Collection status per league with the names of the checks that block it."""
    bad = F.array_sort(F.collect_list(F.when(~c("agrees"), c("check_name"))))  # at most one name per check
    g = _audit(spark, sf).groupBy("league").agg(F.count_if(~c("agrees")).alias("bad"), F.count_if("agrees").alias("good"), F.array_join(bad, ",").alias("blockers"))
    return g.select("league", F.when(c("bad") == 0, "VERIFIED").when(c("good") == 0, "BLOCKED").otherwise("PARTIAL").alias("status"), "blockers")


@query("GAT-16", views=("snapshots",), sql=f"""WITH g AS (SELECT provider, league, MAX(CASE WHEN observed_us <= {_RNOW} THEN observed_us END) AS last_us FROM snapshots GROUP BY ALL)
SELECT provider, league, coalesce(last_us, 0) AS last_us, CASE WHEN last_us IS NULL THEN 'MISSING' WHEN {_RNOW} - last_us <= 64800000000 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM g""")
def gat_16(spark, sf, now_us: int = _RNOW, most_hours: int = 18):
    """Freshness of each source: its newest report up to now is at most most_hours old; later stamps do not count."""
    g = V.snapshots(spark, sf).groupBy("provider", "league").agg(F.max(F.when(c("observed_us") <= now_us, c("observed_us"))).alias("last_us"))
    age = F.when(c("last_us").isNull(), "MISSING").when(F.lit(now_us) - c("last_us") <= most_hours * V.HOUR_US, "FRESH").otherwise("STALE")
    return g.select("provider", "league", F.coalesce("last_us", F.lit(0)).cast("long").alias("last_us"), age.alias("freshness"))


@query("GAT-14", views=("snapshots",), sql="""WITH x AS (SELECT event_id, CASE k % 4 WHEN 0 THEN 'RESEARCH_V2_OBSERVED' WHEN 1 THEN 'SKIPPED_QUOTA' WHEN 2 THEN 'FAILED_HTTP' ELSE 'ZERO_USABLE_FIXTURES' END AS st, k FROM snapshots),
i AS (SELECT event_id, st, concat_ws(',', CASE WHEN (k % 5 = 0 AND st <> 'SKIPPED_QUOTA') OR st LIKE '%FAILED%' THEN 'API_OR_CONFIGURATION_FAILURE' END, CASE WHEN st = 'SKIPPED_QUOTA' THEN 'SKIPPED_QUOTA' END, CASE WHEN k % 3 = 0 THEN 'COVERAGE_INCOMPLETE' END,
  CASE WHEN k % 7 > 4 THEN 'QUOTA_OR_UNQUERIED_FIXTURES' END, CASE WHEN k % 6 = 0 THEN 'SCAN_LATE' END, CASE WHEN k % 10 = 9 THEN 'FIXTURE_COUNT_UNKNOWN' END, CASE WHEN st NOT IN ('RESEARCH_V2_OBSERVED', 'ZERO_USABLE_FIXTURES') THEN 'COLLECTION_NOT_CONFIRMED' END,
  CASE WHEN k % 10 < 9 AND k % 10 > 3 THEN 'FIXTURES_WITHOUT_VALID_CORE_ODDS' END) AS issues, k FROM x)
SELECT event_id, issues, CASE WHEN issues LIKE 'API_OR%' THEN 'FAIL' WHEN issues <> '' THEN 'WARNING' ELSE 'PASS' END AS health FROM i""")
def gat_14(spark, sf):
    k = c("k")
    st = F.when(k % 4 == 0, "RESEARCH_V2_OBSERVED").when(k % 4 == 1, "SKIPPED_QUOTA").when(k % 4 == 2, "FAILED_HTTP").otherwise("ZERO_USABLE_FIXTURES")
    r = V.snapshots(spark, sf).select("event_id", st.alias("scan_status"), F.when(k % 5 == 0, 1).otherwise(0).alias("errors"), (k % 3 != 0).alias("coverage_complete"), F.when(k % 7 > 4, 2).otherwise(0).alias("unqueried"),
                                      F.when(k % 6 == 0, "LATE").otherwise("ON_TIME").alias("timing"), F.when(k % 10 != 9, k % 10).alias("found"), F.lit(3).alias("valid"))
    return C.health(r).select("event_id", "issues", "health")


# ---- constraint suites ------------------------------------------------------------------------
@query("DQC-01", sql="""WITH v AS (SELECT 'unique_name' AS rule FROM (SELECT p_name FROM part GROUP BY p_name HAVING COUNT(*) > 1) UNION ALL SELECT 'brand_format' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$') UNION ALL SELECT 'size_range' FROM part WHERE NOT (p_size BETWEEN 1 AND 40)),
r AS (SELECT unnest(['unique_key', 'unique_name', 'brand_format', 'size_range', 'order_customer']) AS rule) SELECT rule, COUNT(v.rule) AS violations, CASE WHEN COUNT(v.rule) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM r LEFT JOIN v USING (rule) GROUP BY rule""")
def dqc_01(spark, sf):
    """Master table rules: keys, names, formats, ranges, references."""
    p, o, cu = (V.table(spark, sf, t) for t in ("part", "orders", "customer"))
    v = quality.run(quality.unique(p, "unique_key", ["p_partkey"]), quality.unique(p, "unique_name", ["p_name"]), quality.pattern(p, "brand_format", "p_brand", "^Brand#[0-9]$"),
                    quality.matches(p, "size_range", "p_partkey", c("p_size").between(1, 40)), quality.foreign_key(o, "order_customer", "o_custkey", cu, "c_custkey"))
    return quality.summary(v, ["unique_key", "unique_name", "brand_format", "size_range", "order_customer"])


@query("DQC-02", sql="""SELECT 'line_order' AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unique_line', l_orderkey || '|' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def dqc_02(spark, sf):
    """Staging rules: reference and line uniqueness, each violation listed."""
    li = V.table(spark, sf, "lineitem")
    return quality.run(quality.foreign_key(li, "line_order", "l_orderkey", V.table(spark, sf, "orders"), "o_orderkey"), quality.unique(li, "unique_line", ["l_orderkey", "l_linenumber"]))


@query("DQC-03", sql="""WITH a AS (SELECT c_nationkey AS nk, COUNT(*) AS n FROM customer GROUP BY 1), e AS (SELECT n_nationkey AS nk, (SELECT COUNT(*) FROM customer) // (SELECT COUNT(*) FROM nation) AS expected FROM nation) SELECT 'customers_per_nation' AS rule, CAST(coalesce(a.nk, e.nk) AS VARCHAR) AS key FROM a FULL JOIN e ON a.nk = e.nk WHERE coalesce(n, 0) <> coalesce(expected, 0)""")
def dqc_03(spark, sf):
    """Declared counts per group against counted ones."""
    even = V.table(spark, sf, "customer").agg(F.count("*").alias("n")).first()["n"] // max(V.table(spark, sf, "nation").count(), 1)
    e = V.table(spark, sf, "nation").select("n_nationkey", F.lit(even).alias("expected"))
    return quality.count_equals(V.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "customers_per_nation", "n_nationkey", e, "expected")


@query("DQC-04", "DQC-05", views=("fixtures",), sql="""WITH m AS (SELECT DISTINCT season, league, t AS team FROM (SELECT season, league, home AS t FROM fixtures UNION ALL SELECT season, league, away FROM fixtures)) SELECT season, league, COUNT(*) AS teams FROM m GROUP BY ALL""")
def dqc_04(spark, sf):
    """Membership projection: teams per season and competition from exploded rosters."""
    m = V.fixtures(spark, sf).select("season", "league", F.explode(F.array("home", "away")).alias("team")).distinct()
    return m.groupBy("season", "league").agg(F.count("*").alias("teams"))


@query("STO-06", views=("fixtures",), sql="""WITH a AS (SELECT DISTINCT league, home FROM fixtures WHERE season = '9798'), b AS (SELECT DISTINCT league, home FROM fixtures WHERE season = '9899')
SELECT league, CASE WHEN a.home IS NULL THEN 'JOINED' WHEN b.home IS NULL THEN 'LEFT' ELSE 'STAYED' END AS change, COUNT(*) AS n FROM (SELECT coalesce(a.league, b.league) AS league, a, b FROM a FULL JOIN b ON a.league = b.league AND a.home = b.home) x GROUP BY ALL""")
def sto_06(spark, sf):
    """Roster change between two seasons."""
    f = V.fixtures(spark, sf)
    ch = quality.roster_change(f.filter(c("season") == "9798"), f.filter(c("season") == "9899"), ["league", "home"])
    return ch.groupBy("league", "change").agg(F.count("*").alias("n"))


# ---- report forms of their own ------------------------------------------------------------------
@query("AGG-32", views=("fixtures",), sql="""WITH e AS (SELECT home AS team, league FROM fixtures UNION ALL SELECT away, league FROM fixtures) SELECT team, COUNT(*) AS observations, COUNT(DISTINCT league) AS countries, string_agg(DISTINCT league, ',' ORDER BY league) AS country_set FROM e GROUP BY team""")
def agg_32(spark, sf):
    """Entity candidates with observation counts and the countries they were seen in (as many as there are countries)."""
    e = V.fixtures(spark, sf).select(F.explode(F.array("home", "away")).alias("team"), "league")
    g = e.groupBy("team").agg(F.count("*").alias("observations"), F.array_sort(F.collect_set("league")).alias("s"))
    return g.select("team", "observations", F.size("s").cast("long").alias("countries"), F.array_join("s", ",").alias("country_set"))


@query("AGG-23", views=("snapshots",), sql="""SELECT league, bookmaker, COUNT(*) AS observations, COUNT(*) FILTER (WHERE mainline_verified) AS mainline_rows, COUNT(DISTINCT CASE WHEN mainline_verified THEN fixture_id END) AS mainline_fixtures, COUNT(DISTINCT fixture_id) AS fixtures FROM snapshots GROUP BY ALL""")
def agg_23(spark, sf):
    """Main-line coverage of each bookmaker by league: counted per fixture first, then summed."""
    f = V.snapshots(spark, sf).groupBy("league", "bookmaker", "fixture_id").agg(F.count("*").alias("n"), F.count_if("mainline_verified").alias("m"))
    return f.groupBy("league", "bookmaker").agg(F.sum("n").alias("observations"), F.sum("m").alias("mainline_rows"), F.count_if(c("m") > 0).alias("mainline_fixtures"), F.count("*").alias("fixtures"))


@query("AGG-26", views=("fixtures", "results"), sql="""WITH r AS (SELECT DISTINCT fixture_id FROM results) SELECT season, COUNT(*) AS fixtures, COUNT(DISTINCT league) AS leagues, COUNT(DISTINCT home) AS home_teams, COUNT(r.fixture_id) AS with_result, COUNT(*) - COUNT(r.fixture_id) AS without_result FROM fixtures LEFT JOIN r USING (fixture_id) GROUP BY season""")
def agg_26(spark, sf):
    """Catalog counters by season."""
    r = V.results(spark, sf).select("fixture_id", F.lit(1).alias("r")).distinct()
    f = V.fixtures(spark, sf).join(r, "fixture_id", "left")
    return f.groupBy("season").agg(F.count("*").alias("fixtures"), F.count_distinct("league").alias("leagues"), F.count_distinct("home").alias("home_teams"), F.count("r").alias("with_result"), F.count_if(c("r").isNull()).alias("without_result"))


@query("FLT-06", sql="""WITH u AS (SELECT n_name AS competition, 'LEAGUE' AS kind FROM nation WHERE n_regionkey <> 4 UNION SELECT p_type, 'CUP' FROM part WHERE p_type NOT LIKE 'SMALL%' UNION SELECT n_name, 'CUP' FROM nation WHERE n_nationkey % 5 = 0)
SELECT competition, string_agg(kind, ',' ORDER BY kind) AS kinds FROM u GROUP BY competition""")
def flt_06(spark, sf):
    """Approved competitions: the verified leagues and the verified cups, each once, with the lists that hold it."""
    n, p = V.table(spark, sf, "nation"), V.table(spark, sf, "part")
    leagues = n.filter("n_regionkey <> 4").select(c("n_name").alias("competition"), F.lit("LEAGUE").alias("kind"))
    cups = p.filter("p_type not like 'SMALL%'").select("p_type", F.lit("CUP")).union(n.filter("n_nationkey % 5 = 0").select("n_name", F.lit("CUP")))
    return leagues.union(cups).groupBy("competition").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("NRM-25", views=("snapshots",), sql="""WITH x AS (SELECT event_id, home_line, CASE WHEN k % 11 = 0 THEN away_line + 0.25e0 WHEN k % 13 = 0 THEN NULL ELSE away_line END AS away_points, home_price, away_price FROM snapshots)
SELECT event_id, CASE WHEN away_points IS NULL THEN 'MISSING_SIDE' WHEN abs(home_line + away_points) > 1e-9 THEN 'POINTS_NOT_OPPOSITE' WHEN NOT (home_price BETWEEN 1.8e0 AND 2.2e0 AND away_price BETWEEN 1.8e0 AND 2.2e0) THEN 'PRICE_OUT_OF_RANGE' ELSE 'MAIN_SPREAD' END AS verdict FROM x""")
def nrm_25(spark, sf):
    """Main spread: both sides there, opposite points, both prices within [1.80, 2.20]; the first rule that fails is named."""
    away = F.when(c("k") % 11 == 0, c("away_line") + 0.25).when(c("k") % 13 == 0, None).otherwise(c("away_line"))
    fair = c("home_price").between(1.8, 2.2) & c("away_price").between(1.8, 2.2)
    x = V.snapshots(spark, sf).withColumn("away_points", away)
    verdict = F.when(c("away_points").isNull(), "MISSING_SIDE").when(F.abs(c("home_line") + c("away_points")) > 1e-9, "POINTS_NOT_OPPOSITE").when(~fair, "PRICE_OUT_OF_RANGE").otherwise("MAIN_SPREAD")
    return x.select("event_id", verdict.alias("verdict"))


@query("JON-40", views=("fixtures", "results"), sql="""WITH g AS (SELECT fixture_id, COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) AS scores FROM results GROUP BY fixture_id)
SELECT fixture_id, CASE WHEN status IS NULL THEN 'FIXTURE_UNKNOWN' WHEN status = 'P' THEN 'SOURCE_NOT_FINISHED' WHEN scores > 1 THEN 'SCORE_CONFLICT' END AS quarantine_reason FROM g LEFT JOIN fixtures USING (fixture_id)""")
def jon_40(spark, sf):
    """Stored results that the source contradicts go to quarantine: unknown fixture, not finished there, several scores."""
    score = c("ft_home_goals") * 100 + c("ft_away_goals")
    g = V.results(spark, sf).groupBy("fixture_id").agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    f = V.fixtures(spark, sf).select("fixture_id", "status")
    why = F.when(c("status").isNull(), "FIXTURE_UNKNOWN").when(c("status") == "P", "SOURCE_NOT_FINISHED").when(c("lo") < c("hi"), "SCORE_CONFLICT")
    return g.join(f, "fixture_id", "left").select("fixture_id", why.alias("quarantine_reason"))


@query("WIN-24", views=("snapshots",), sql="""WITH x AS (SELECT provider, event_id, observed_us, CASE WHEN k % 4 = 2 THEN 'FAIL' WHEN k % 3 = 0 THEN 'WARNING' ELSE 'PASS' END AS health FROM snapshots),
r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY observed_us DESC, event_id DESC) AS rn FROM x)
SELECT provider, MAX(CASE WHEN rn = 1 THEN health END) AS latest, COUNT(*) AS checks, COUNT(*) FILTER (WHERE health = 'FAIL') AS failed, COUNT(*) FILTER (WHERE health = 'WARNING') AS warned FROM r WHERE rn <= 30 GROUP BY provider""")
def win_24(spark, sf, last: int = 30):
    """Newest health receipt of each source and the counts of its last checks; the rank limit goes below the shuffle."""
    k = c("k")
    x = V.snapshots(spark, sf).select("provider", "event_id", "observed_us", F.when(k % 4 == 2, "FAIL").when(k % 3 == 0, "WARNING").otherwise("PASS").alias("health"))
    r = x.withColumn("rn", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("observed_us"), F.desc("event_id")))).filter(c("rn") <= last)
    return r.groupBy("provider").agg(F.max(F.when(c("rn") == 1, c("health"))).alias("latest"), F.count("*").alias("checks"), F.count_if(c("health") == "FAIL").alias("failed"), F.count_if(c("health") == "WARNING").alias("warned"))
