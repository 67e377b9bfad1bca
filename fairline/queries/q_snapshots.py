"""Snapshot statistics, movement, as-of joins, sequences and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import settlement, stats
from fairline.functions.exact import from_micro, micro, rnd
from fairline.operators import asof, filters, movement, resampling, results, sequences, statistics
from fairline.queries import sqlviews as S
from fairline.queries.q_patterns import OBS
from fairline.queries.q_scalars import label_sql
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col
VALID = """observed_us < kickoff_us AND home_price > 1e0 AND away_price > 1e0"""
CORE = f"{VALID} AND price BETWEEN 1.8e0 AND 2.2e0"


# ---- filters ----------------------------------------------------------------------------------
@query("FLT-02", views=("snapshots",), sql=f"""SELECT event_id, NOT (provider = 'view') OR (bookmaker = 'B1' AND mainline_verified AND {CORE}) AS trusted FROM snapshots""")
def flt_02(spark, sf):
    return V.snapshots(spark, sf).select("event_id", filters.trusted(c("provider") == "view", "b1", "MAINLINE").alias("trusted"))


@query("FLT-07", "FLT-08", views=("snapshots",), sql=f"""SELECT event_id, {CORE} AS collectable, CASE WHEN {VALID} THEN observed_us END AS order_us FROM snapshots""")
def flt_07(spark, sf):
    return V.snapshots(spark, sf).select("event_id", filters.collectable().alias("collectable"), filters.prematch_order()["observed_us"].alias("order_us"))


@query("FLT-10", "FLT-11", views=("snapshots",), sql="""SELECT event_id, CASE WHEN observed_us >= kickoff_us THEN 'NOT_PREMATCH' WHEN mainline_verified THEN 'VERIFIED_MAINLINE' ELSE 'PAIRED_QUOTE_MAINLINE_UNVERIFIED' END AS total_status,
  CASE WHEN ou_line <> 2.5e0 THEN 'NOT_EXACT_2_5' WHEN observed_us >= kickoff_us THEN 'UNVERIFIED_PROVENANCE_OR_TIMESTAMP' ELSE 'VERIFIED_EXACT_2_5_PREMATCH' END AS exact_status FROM snapshots""")
def flt_10(spark, sf):
    return V.snapshots(spark, sf).select("event_id", filters.total_quote_status().alias("total_status"), filters.exact_total_status().alias("exact_status"))


@query("FLT-12", "FLT-32", views=("snapshots",), sql="""SELECT event_id, CASE WHEN bookmaker <> 'B1' THEN 'NOT_REFERENCE_BOOKMAKER' WHEN NOT mainline_verified THEN 'MAINLINE_SEMANTICS_NOT_VERIFIED'
  WHEN observed_us >= kickoff_us THEN 'TIMESTAMP_NOT_VERIFIED_PREMATCH' WHEN (home_line < 0 AND favorite_side <> 'H') OR (home_line > 0 AND favorite_side <> 'A') THEN 'FAVORITE_SIDE_CONFLICT'
  WHEN price NOT BETWEEN 1.8e0 AND 2.2e0 THEN 'OUTSIDE_RESEARCH_CORE_PRICE' END AS reason, provider = 'click' AND NOT mainline_verified AS legacy FROM snapshots""")
def flt_12(spark, sf):
    return V.snapshots(spark, sf).select("event_id", filters.historical_quote_reason("b1", ["MAINLINE"]).alias("reason"), filters.is_legacy("click", ["MAINLINE"]).alias("legacy"))


@query("FLT-01", "STM-11", views=("snapshots",), sql="""WITH x AS (SELECT event_id, k, k % 2 = 0 AS cur, (1705500000000000 - (observed_us // 1000000) * 1000000) / 1e6 AS age, event_id % 4 AS m FROM snapshots)
SELECT event_id, CASE WHEN k % 11 = 0 THEN 'EXECUTION_STATUS_INVALID_OR_MISSING' WHEN k % 13 = 0 THEN 'STALE_OR_UNVERIFIED_QUOTE' WHEN k % 17 = 0 THEN 'MARKET_NOT_VERIFIED_TRADABLE'
  WHEN m = 1 THEN CASE WHEN cur THEN 'OBSERVATION' ELSE 'QUOTE' END || '_TIMESTAMP_MISSING' WHEN m = 2 THEN CASE WHEN cur THEN 'OBSERVATION' ELSE 'QUOTE' END || '_TIMESTAMP_NOT_UTC_AWARE'
  WHEN age < -300 THEN 'QUOTE_TIMESTAMP_IN_FUTURE' WHEN age > 86400 THEN 'QUOTE_TOO_OLD' END AS reason FROM x""")
def flt_01(spark, sf):
    """Execution safety at a fixed clock, quotes at most a day old."""
    k, m = c("k"), c("event_id") % 4
    iso = F.date_format(F.timestamp_micros("observed_us"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(m == 1, F.lit(None).cast("string")).when(m == 2, iso).otherwise(F.concat(iso, F.lit("Z")))
    reason = filters.execution_reason(
        F.lit(1_705_500_000_000_000), status=F.when(k % 11 != 0, "Scheduled"), stale=F.when(k % 13 == 0, F.lit(None).cast("boolean")).otherwise(False),
        tradable=(k % 17 != 0), current_feed=(k % 2 == 0), observed_at=text, as_of=text, freshness_basis=F.lit("endpoint"), max_age_minutes=1440)
    return V.snapshots(spark, sf).select("event_id", reason.alias("reason"))


# ---- results ----------------------------------------------------------------------------------
@query("AGG-10", "AGG-42", views=("results",), sql="""SELECT fixture_id, MIN(ft_home_goals) AS ft_home_goals, MIN(ft_away_goals) AS ft_away_goals, MAX(result_source) AS result_source, COUNT(*) AS records,
  COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) > 1 AS ambiguous FROM results GROUP BY fixture_id""")
def agg_10(spark, sf):
    return results.result_index(V.results(spark, sf))


@query("AGG-11", "AGG-12", "SRC-33", views=("results",), sql="""WITH k AS (SELECT fixture_id FROM results GROUP BY fixture_id HAVING COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) = 1)
SELECT fixture_id, ft_home_goals, ft_away_goals, 'S1' AS result_source, 'SETTLED' AS state FROM results SEMI JOIN k USING (fixture_id) WHERE seq = 1
UNION ALL SELECT DISTINCT fixture_id, NULL, NULL, NULL, 'CONFLICTING_EXACT_RESULT_SCORES' FROM results ANTI JOIN k USING (fixture_id)""")
def agg_11(spark, sf):
    """First source merged with the second; the ledger lists ids that must never settle."""
    r = V.results(spark, sf).drop("seq")
    none = spark.createDataFrame([], "fixture_id long, reason string")
    kept, ledger = results.merge_results(r.filter("result_source = 'S1'"), r.filter("result_source = 'S2'"), none)
    return kept.withColumn("state", F.lit("SETTLED")).unionByName(
        ledger.withColumnRenamed("reason", "state"), allowMissingColumns=True)


@query("JON-01", views=("fixtures", "results"), sql="""WITH i AS (SELECT fixture_id, MIN(ft_home_goals) AS h, MIN(ft_away_goals) AS a FROM results GROUP BY fixture_id HAVING COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) = 1)
SELECT league, COUNT(*) AS fixtures, COUNT(h) AS joined, floor(CAST(COUNT(h) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 1e6 + 0.5e0) / 1e6 AS join_rate FROM fixtures LEFT JOIN i USING (fixture_id) GROUP BY league""")
def jon_01(spark, sf):
    j = V.fixtures(spark, sf).join(results.settled_results(V.results(spark, sf)), "fixture_id", "left")
    return j.groupBy("league").agg(F.count("*").alias("fixtures"), F.count("ft_home_goals").alias("joined")).withColumn(
        "join_rate", rnd(c("joined").cast("double") / c("fixtures").cast("double"), 6))


# ---- snapshot statistics ----------------------------------------------------------------------
_FS = S.ah_signs("ft_home_goals", "ft_away_goals", "line", "favorite_side")
_DS = S.ah_signs("ft_home_goals", "ft_away_goals", "(-line)", "(CASE WHEN favorite_side = 'H' THEN 'A' ELSE 'H' END)")
_OS = S.over_signs("ft_home_goals", "ft_away_goals", "ou_line")
_LQ = "CAST(round(line * 4) AS INTEGER)"
_OQ = "CAST(round(ou_line * 4) AS INTEGER)"
OUTCOMES = f"""
v AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, provider DESC, event_id DESC) AS rn,
  COUNT(*) OVER (PARTITION BY fixture_id) AS scan_count FROM snapshots WHERE {VALID}),
ri AS (SELECT fixture_id, MIN(ft_home_goals) AS ft_home_goals, MIN(ft_away_goals) AS ft_away_goals FROM snapshot_results GROUP BY fixture_id
  HAVING COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) = 1),
o AS (SELECT v.*, ri.ft_home_goals, ri.ft_away_goals FROM v JOIN ri USING (fixture_id) WHERE rn = 1),
outcomes AS (SELECT fixture_id, league, provider, kickoff_us, scan_count, ft_home_goals, ft_away_goals, favorite_side,
  CASE WHEN favorite_side = 'H' THEN 'HOME_FAVORITE' ELSE 'AWAY_FAVORITE' END AS market_side,
  CASE WHEN {_LQ} % 4 = 0 THEN CAST({_LQ} // 4 AS VARCHAR) ELSE CAST(line AS VARCHAR) END AS ah_line, price AS ah_price, {label_sql('price')} AS ah_price_bucket,
  price BETWEEN 1.8e0 AND 2.2e0 AS ah_core_price, {S.klass(_FS)} AS favorite_settlement, {S.profit(_FS, 'price')} AS favorite_profit_units,
  {S.klass(_DS)} AS underdog_settlement, {S.profit(_DS, 'other')} AS underdog_profit_units,
  CASE WHEN {_OQ} % 4 = 0 THEN CAST({_OQ} // 4 AS VARCHAR) ELSE CAST(ou_line AS VARCHAR) END AS ou_line, over_price, under_price,
  {S.klass(_OS)} AS over_settlement, {S.profit(_OS, 'over_price')} AS over_profit_units, {S.klass(f'(-{_OS})')} AS under_settlement, {S.profit(f'(-{_OS})', 'under_price')} AS under_profit_units,
  {label_sql('over_price')} AS over_price_bucket, mainline_verified, CASE WHEN ou_line = 2.5e0 THEN over_price END AS ou25_over_price, CASE WHEN ou_line = 2.5e0 THEN under_price END AS ou25_under_price,
  CASE WHEN ft_home_goals + ft_away_goals > 2.5e0 THEN 'OVER' ELSE 'UNDER' END AS ou25_result, ft_home_goals + ft_away_goals AS total_goals FROM o)
"""
SV = ("snapshots", "snapshot_results")


def outcomes(spark, sf):
    return statistics.outcomes(V.snapshots(spark, sf), V.snapshot_results(spark, sf))


@query("WIN-12", views=("snapshots",), sql=f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, provider DESC, event_id DESC) AS rn, COUNT(*) OVER (PARTITION BY fixture_id) AS scan_count,
  first_value(line) OVER (PARTITION BY fixture_id ORDER BY observed_us, provider, event_id) AS first_line FROM snapshots WHERE {VALID})
SELECT fixture_id, scan_count, first_line, event_id, line, price FROM v WHERE rn = 1""")
def win_12(spark, sf):
    return statistics.latest_valid(V.snapshots(spark, sf)).select("fixture_id", "scan_count", "first_line", "event_id", "line", "price")


@query("SET-10", "NRM-49", views=SV, sql=f"WITH {OUTCOMES} SELECT fixture_id, ou_line, over_price, under_price, over_settlement, under_settlement, over_profit_units, under_profit_units, over_price_bucket FROM outcomes")
def set_10(spark, sf):
    return outcomes(spark, sf).select("fixture_id", "ou_line", "over_price", "under_price", "over_settlement", "under_settlement", "over_profit_units", "under_profit_units", "over_price_bucket")


def _pct(a, b):
    return S.r(f"CAST({a} * 100 AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)", 2)


_Z2, _P, _NN = "(1.959963984540054e0 * 1.959963984540054e0)", "(CAST(w AS DOUBLE) / CAST(n AS DOUBLE))", "CAST(n AS DOUBLE)"
_CEN = f"(({_P} + {_Z2} / (2e0 * {_NN})) / (1e0 + {_Z2} / {_NN}))"
_HALF = f"(1.959963984540054e0 * sqrt(({_P} * (1e0 - {_P}) + {_Z2} / (4e0 * {_NN})) / {_NN}) / (1e0 + {_Z2} / {_NN}))"


def state_sql(keys, where=""):
    return f"""WITH {OUTCOMES},
g AS (SELECT {keys}, COUNT(*) AS n, {', '.join(f"COUNT(*) FILTER (WHERE favorite_settlement = '{k}') AS {k.lower()}" for k in settlement.CLASSES)},
  COUNT(*) FILTER (WHERE favorite_settlement IN ('FULL_WIN', 'HALF_WIN')) AS w, COUNT(*) FILTER (WHERE favorite_settlement IN ('FULL_LOSS', 'HALF_LOSS')) AS l,
  {S.sum_micro('favorite_profit_units')} AS fp, {S.sum_micro('underdog_profit_units')} AS dp FROM outcomes {where} GROUP BY {keys}),
st AS (SELECT {keys}, n, n AS settled_n, full_win, half_win, push, half_loss, full_loss, {_pct('w', 'n')} AS favorite_price_win_pct, {_pct('l', 'n')} AS underdog_price_win_pct, {_pct('push', 'n')} AS push_pct,
  {S.r('fp / 1e6', 4)} AS favorite_profit_units, {S.r('fp / 1e6 * 1e2 / n', 2)} AS favorite_roi_pct, {S.r('dp / 1e6', 4)} AS underdog_profit_units, {S.r('dp / 1e6 * 1e2 / n', 2)} AS underdog_roi_pct,
  {S.r(f'({_CEN} - {_HALF}) * 1e2', 2)} AS wilson_low, {S.r(f'({_CEN} + {_HALF}) * 1e2', 2)} AS wilson_high,
  CASE WHEN n < 30 THEN 'VERY_LOW' WHEN n < 100 THEN 'DEVELOPING' WHEN n < 300 THEN 'MODERATE' ELSE 'STRONG_300_PLUS' END AS sample_label, w, l FROM g)"""


_K3 = "market_side, ah_line, ah_price_bucket"


@query("AGG-06", views=SV, sql=state_sql(_K3) + " SELECT * EXCLUDE (w, l) FROM st")
def agg_06(spark, sf):
    return statistics.state_statistics(outcomes(spark, sf), ["market_side", "ah_line", "ah_price_bucket"])


@query("AGG-07", views=SV, sql=f"""WITH {OUTCOMES},
g AS (SELECT market_side, ah_line, COUNT(*) AS n, CAST(SUM(total_goals) AS BIGINT) AS total_goals, COUNT(*) FILTER (WHERE total_goals >= 4) AS over_3_5_n,
  COUNT(*) FILTER (WHERE ou25_result = 'OVER') AS over_2_5_n, COUNT(*) FILTER (WHERE ou25_result = 'UNDER') AS under_2_5_n, COUNT(ou25_over_price) AS ou25_priced_n,
  {S.sum_micro("CASE WHEN ou25_over_price IS NOT NULL THEN CASE WHEN ou25_result = 'OVER' THEN ou25_over_price - 1e0 ELSE -1e0 END END")} AS op,
  {S.sum_micro("CASE WHEN ou25_over_price IS NOT NULL THEN CASE WHEN ou25_result = 'UNDER' THEN ou25_under_price - 1e0 ELSE -1e0 END END")} AS up FROM outcomes GROUP BY ALL)
SELECT market_side, ah_line, n, total_goals, {S.r('CAST(total_goals AS DOUBLE) / CAST(n AS DOUBLE)', 2)} AS avg_total_goals, over_3_5_n, {_pct('over_3_5_n', 'n')} AS over_3_5_pct, over_2_5_n, under_2_5_n, {_pct('over_2_5_n', 'n')} AS over_2_5_pct,
  ou25_priced_n, {S.r('op / 1e6', 4)} AS over_2_5_profit_units, {S.r('up / 1e6', 4)} AS under_2_5_profit_units,
  CASE WHEN n < 30 THEN 'VERY_LOW' WHEN n < 100 THEN 'DEVELOPING' WHEN n < 300 THEN 'MODERATE' ELSE 'STRONG_300_PLUS' END AS sample_label FROM g""")
def agg_07(spark, sf):
    return statistics.goal_statistics(outcomes(spark, sf), ["market_side", "ah_line"])


@query("AGG-08", views=SV, sql=state_sql(_K3, "WHERE ah_core_price") + f""", b AS (SELECT market_side, ah_line, {_pct('SUM(w)', 'SUM(n)')} AS base FROM st GROUP BY ALL)
SELECT market_side, ah_line, ah_price_bucket, n, favorite_price_win_pct, base AS baseline_favorite_price_win_pct, {S.r('favorite_price_win_pct - base', 2)} AS difference_vs_line_baseline_pp FROM st JOIN b USING (market_side, ah_line)""")
def agg_08(spark, sf):
    return statistics.versus_baseline(outcomes(spark, sf))


_ALLK = ["market_side", "ah_line", "ah_price_bucket", "ou_line", "over_price_bucket"]


def _level(name, keys):
    cols = ", ".join(k if k in keys else f"NULL AS {k}" for k in _ALLK)
    return f"""SELECT '{name}' AS level, {cols}, COUNT(*) AS n, COUNT(*) FILTER (WHERE over_settlement IN ('FULL_WIN', 'HALF_WIN')) AS over_win_n, COUNT(*) FILTER (WHERE under_settlement IN ('FULL_WIN', 'HALF_WIN')) AS under_win_n,
  COUNT(*) FILTER (WHERE over_settlement = 'PUSH') AS push_n, {S.sum_micro('over_profit_units')} AS op, {S.sum_micro('under_profit_units')} AS up, COUNT(*) FILTER (WHERE mainline_verified) AS mainline_verified_n,
  COUNT(*) FILTER (WHERE favorite_settlement IN ('FULL_WIN', 'HALF_WIN')) AS ah_favorite_win_n, COUNT(*) FILTER (WHERE favorite_settlement IN ('FULL_LOSS', 'HALF_LOSS')) AS ah_underdog_win_n,
  COUNT(*) FILTER (WHERE favorite_settlement = 'PUSH') AS ah_push_n FROM outcomes GROUP BY {', '.join(keys)}"""


@query("AGG-09", views=SV, sql=f"WITH {OUTCOMES}, u AS (" + " UNION ALL ".join(_level(n, k) for n, k in statistics.TOTAL_LEVELS.items()) + f""")
SELECT level, {', '.join(_ALLK)}, n, over_win_n, under_win_n, push_n, {_pct('over_win_n', 'n')} AS over_win_pct, {_pct('under_win_n', 'n')} AS under_win_pct, {_pct('push_n', 'n')} AS push_pct,
  {S.r('op / 1e6 * 1e2 / n', 2)} AS over_roi_pct, {S.r('up / 1e6 * 1e2 / n', 2)} AS under_roi_pct, mainline_verified_n, ah_favorite_win_n, ah_underdog_win_n, ah_push_n, {_pct('ah_favorite_win_n', 'n')} AS ah_favorite_win_pct,
  CASE WHEN n < 20 THEN 'TINY' WHEN n < 40 THEN 'EARLY' WHEN n < 60 THEN 'DEVELOPING' WHEN n < 100 THEN 'MODERATE' ELSE 'LARGE' END AS sample_label, over_win_n + under_win_n + push_n = n AS consistent FROM u""")
def agg_09(spark, sf):
    return statistics.real_total_statistics(outcomes(spark, sf))


# ---- movement ---------------------------------------------------------------------------------
_PM = "CASE WHEN abs(p2 - p1) < 5e-3 THEN 'PRICE_FLAT' WHEN p2 < p1 THEN 'PRICE_DOWN' ELSE 'PRICE_UP' END"
_LM = "CASE WHEN l2 = l1 THEN 'AH_LINE_UNCHANGED' WHEN l2 < l1 THEN 'AH_FAVORITE_LINE_STRONGER' ELSE 'AH_FAVORITE_LINE_WEAKER' END"
DESCRIBE = f"""
pre AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, provider, bookmaker, source_semantics, observed_us ORDER BY event_id DESC) AS dup FROM snapshots WHERE observed_us < kickoff_us),
u AS (SELECT * FROM pre WHERE dup = 1),
lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, event_id DESC) AS rn FROM u) WHERE rn = 1),
cnt AS (SELECT fixture_id, COUNT(*) AS total, COUNT(DISTINCT provider || bookmaker || source_semantics) AS contracts FROM u GROUP BY fixture_id),
same AS (SELECT u.*, row_number() OVER (PARTITION BY u.fixture_id ORDER BY u.observed_us, u.event_id) AS r1, COUNT(*) OVER (PARTITION BY u.fixture_id) AS m
  FROM u JOIN lastc l ON u.fixture_id = l.fixture_id AND u.provider = l.provider AND u.bookmaker = l.bookmaker AND u.source_semantics = l.source_semantics),
ab AS (SELECT a.fixture_id, a.m, a.observed_us AS t1, b.observed_us AS t2, a.kickoff_us AS ko, a.favorite_side AS s1, b.favorite_side AS s2, a.line AS l1, b.line AS l2, a.price AS p1, b.price AS p2,
  a.over_price AS o1, b.over_price AS o2, total, contracts FROM same a JOIN same b ON a.fixture_id = b.fixture_id AND a.r1 = 1 AND b.r1 = b.m JOIN cnt ON a.fixture_id = cnt.fixture_id),
d AS (SELECT *, CASE WHEN total = 1 THEN 'SINGLE_OBSERVATION' WHEN m < 2 THEN 'SOURCE_SWITCH__INSUFFICIENT_OBSERVATIONS' WHEN s1 <> s2 THEN 'FAVORITE_SWITCH' ELSE {_LM} || '__' || {_PM} END AS movement FROM ab)
"""


@query("WIN-06", "WIN-10", views=("snapshots",), sql=f"""WITH {DESCRIBE} SELECT fixture_id, movement, CASE WHEN total = 1 THEN 0 ELSE m END AS comparable_observations, contracts > 1 AS source_switch,
  m >= 2 AND l1 <> l2 AS line_change, m >= 2 AND abs(p2 - p1) >= 5e-3 AS price_change, m >= 2 AND s1 <> s2 AS favorite_switch,
  CASE WHEN m >= 2 THEN {S.r('(t2 - t1) / 6e7', 3)} END AS observation_gap_minutes, CASE WHEN m >= 2 THEN {S.r('(ko - t1) / 6e7', 3)} END AS first_minutes_before_kickoff,
  CASE WHEN m >= 2 THEN {S.r('(ko - t2) / 6e7', 3)} END AS last_minutes_before_kickoff, l1 AS first_line, p1 AS first_price, l2 AS last_line, p2 AS last_price FROM d""")
def win_06(spark, sf):
    return movement.describe(V.snapshots(spark, sf))


@query("WIN-07", views=("snapshots",), sql=f"""WITH {DESCRIBE} SELECT fixture_id, movement, CASE WHEN total = 1 THEN 0 ELSE m END AS comparable_observations, l1 AS first_line, p1 AS first_price, o1 AS first_over_price,
  l2 AS last_line, p2 AS last_price, o2 AS last_over_price, CASE WHEN m >= 2 AND s1 = s2 THEN {S.r('l2 - l1', 4)} END AS delta_line, CASE WHEN m >= 2 AND s1 = s2 THEN {S.r('p2 - p1', 4)} END AS delta_price,
  CASE WHEN m >= 2 AND s1 = s2 THEN {S.r('o2 - o1', 4)} END AS delta_over_price FROM d""")
def win_07(spark, sf):
    return movement.features(V.snapshots(spark, sf), ["line", "price", "over_price"])


@query("AGG-15", "AGG-22", views=("snapshots",), sql=f"""WITH {DESCRIBE} SELECT movement, COUNT(*) AS n, {S.sum_micro('p2 - p1')} AS price_change_micro FROM d GROUP BY movement""")
def agg_15(spark, sf):
    d = movement.describe(V.snapshots(spark, sf))
    return d.groupBy("movement").agg(F.count("*").alias("n"), F.sum(micro(c("last_price") - c("first_price"))).alias("price_change_micro"))


_PB = label_sql("price")


@query("WIN-11", views=("snapshots",), sql=f"""WITH s AS (SELECT fixture_id, provider, bookmaker, source_semantics, observed_us, event_id, {_PB} AS st FROM snapshots WHERE observed_us < kickoff_us),
t AS (SELECT *, lag(st) OVER (PARTITION BY fixture_id, provider, bookmaker, source_semantics ORDER BY observed_us, event_id) AS pv FROM s)
SELECT from_state, to_state, COUNT(*) AS fixtures FROM (SELECT DISTINCT fixture_id, provider, bookmaker, source_semantics, pv AS from_state, st AS to_state FROM t WHERE pv IS NOT NULL AND pv <> st) GROUP BY ALL""")
def win_11(spark, sf):
    from fairline.functions.bands import price_label

    snaps = V.snapshots(spark, sf).filter(c("observed_us") < c("kickoff_us"))
    t = movement.transitions(snaps, ["fixture_id", *movement.CONTRACT], ["observed_us", "event_id"], price_label(c("price")))
    return t.groupBy("from_state", "to_state").agg(F.count("*").alias("fixtures"))


@query("WIN-08", "WIN-09", "STO-05", views=("snapshots",), sql=f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us, event_id) AS r1, COUNT(*) OVER (PARTITION BY fixture_id) AS m FROM snapshots),
p AS (SELECT a.fixture_id, a.m AS observations, a.line AS l1, b.line AS l2, a.price AS p1, b.price AS p2, a.k AS k1, b.k AS k2, a.favorite_side <> b.favorite_side AS favorite_side_changed FROM s a JOIN s b ON a.fixture_id = b.fixture_id AND a.r1 = 1 AND b.r1 = b.m WHERE a.m >= 2),
q AS (SELECT *, l2 - l1 AS dl, list_filter([1, 2, 3, 4, 5, 7], lambda x: k1 % x = 0) AS c1, list_filter([1, 2, 3, 4, 5, 7], lambda x: k2 % x = 0) AS c2 FROM p)
SELECT fixture_id, observations, favorite_side_changed, dl AS line_delta, CASE WHEN dl = 0 THEN 'FLAT' ELSE CASE WHEN dl > 0 THEN 'UP_' ELSE 'DOWN_' END || CASE WHEN abs(dl) >= 0.5e0 THEN '.50_PLUS' ELSE '.25' END END AS line_bucket,
  {S.r('p2 - p1', 4)} AS price_delta, array_to_string(list_filter(c1, lambda x: list_contains(c2, x)), ',') AS persisted, array_to_string(list_filter(c2, lambda x: NOT list_contains(c1, x)), ',') AS appeared,
  array_to_string(list_filter(c1, lambda x: NOT list_contains(c2, x)), ',') AS disappeared FROM q""")
def win_08(spark, sf):
    """First versus latest observation, with the change of the candidate set."""
    from fairline.functions.lines import quarter_delta

    ids = F.filter(F.array(*[F.lit(i) for i in (1, 2, 3, 4, 5, 7)]), lambda x: c("k") % x == 0)
    s = V.snapshots(spark, sf).withColumn("candidates", ids)
    d = movement.first_latest(s, "fixture_id", ["observed_us", "event_id"], ["line", "price", "favorite_side", "candidates"])
    delta = c("latest.line") - c("first.line")
    sets = movement.set_changes(c("first.candidates"), c("latest.candidates"))
    return d.select("fixture_id", "observations", (c("first.favorite_side") != c("latest.favorite_side")).alias("favorite_side_changed"), delta.alias("line_delta"),
                    quarter_delta(delta).alias("line_bucket"), rnd(c("latest.price") - c("first.price"), 4).alias("price_delta"),
                    *[F.array_join(v.cast("array<string>"), ",").alias(k) for k, v in sets.items()])


# ---- as-of ------------------------------------------------------------------------------------
@query("JON-08", "SET-12", views=("snapshots",), sql=f"""WITH e AS (SELECT event_id, fixture_id, kickoff_us, observed_us AS entry_us, line AS l1, price AS p1, favorite_side AS side FROM snapshots WHERE provider = 'purchase'),
q AS (SELECT * FROM snapshots WHERE mainline_verified AND observed_us < kickoff_us),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, event_id DESC) AS rn FROM q) WHERE rn = 1),
j AS (SELECT e.*, l.observed_us AS t2, CASE WHEN e.side = 'H' THEN l.home_line ELSE l.away_line END AS l2, CASE WHEN e.side = 'H' THEN l.home_price ELSE l.away_price END AS p2 FROM e LEFT JOIN l ON e.fixture_id = l.fixture_id AND l.observed_us >= e.entry_us)
SELECT event_id, CASE WHEN t2 IS NULL THEN 'NO_ADMISSIBLE_POST_ENTRY_SNAPSHOT' WHEN abs(l2 - l1) > 1e-9 THEN 'CLV_NOT_COMPARABLE_LINE_CHANGED' ELSE 'CLV_COMPARABLE' END AS status,
  l2 - l1 AS line_move, CASE WHEN abs(l2 - l1) <= 1e-9 THEN p1 / p2 - 1e0 END AS price_clv FROM j""")
def jon_08(spark, sf):
    """Closing-line value of every entry."""
    from fairline.plans.forward import closing_line_value

    s = V.snapshots(spark, sf)
    entries = s.filter(c("provider") == "purchase").select("event_id", "fixture_id", "kickoff_us", c("observed_us").alias("entry_us"), F.lit("AH").alias("market"),
                                                            c("favorite_side").alias("selection"), c("line").alias("entry_line"), c("price").alias("entry_price"))
    return closing_line_value(entries, s).select("event_id", "status", "line_move", "price_clv")


@query("AGG-13", views=("snapshots",), sql=f"""WITH e AS (SELECT event_id, league, fixture_id, observed_us AS entry_us, line AS l1, price AS p1, favorite_side AS side FROM snapshots WHERE provider = 'purchase'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, event_id DESC) AS rn FROM snapshots WHERE mainline_verified AND observed_us < kickoff_us) WHERE rn = 1),
j AS (SELECT e.*, l.observed_us AS t2, CASE WHEN e.side = 'H' THEN l.home_line ELSE l.away_line END AS l2, CASE WHEN e.side = 'H' THEN l.home_price ELSE l.away_price END AS p2 FROM e LEFT JOIN l ON e.fixture_id = l.fixture_id AND l.observed_us >= e.entry_us),
v AS (SELECT league, CASE WHEN abs(l2 - l1) <= 1e-9 THEN p1 / p2 - 1e0 END AS clv, t2 FROM j)
SELECT league AS candidate_id, COUNT(*) AS entries, COUNT(clv) AS comparable_clv, CAST(COUNT(clv) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS comparable_share, {S.avg_micro('clv')} AS mean_clv, median(clv) AS median_clv,
  COUNT(*) FILTER (WHERE t2 IS NULL) AS no_snapshot, COUNT(*) FILTER (WHERE t2 IS NOT NULL AND clv IS NULL) AS line_changed FROM v GROUP BY league""")
def agg_13(spark, sf):
    from fairline.plans.forward import clv_summary, closing_line_value

    s = V.snapshots(spark, sf)
    entries = s.filter(c("provider") == "purchase").select("event_id", c("league").alias("candidate_id"), "fixture_id", "kickoff_us", c("observed_us").alias("entry_us"), F.lit("AH").alias("market"),
                                                            c("favorite_side").alias("selection"), c("line").alias("entry_line"), c("price").alias("entry_price"))
    return clv_summary(closing_line_value(entries, s))


_T = "SELECT user_id AS fixture_id, event_type AS side, epoch_us(ts) // 1000000 * 1000000 AS created_us, 1.5e0 + (event_id % 101) / 100e0 AS price, value > 5 AS active, event_id FROM events"


def ticks(spark, sf):
    """Tick series: fixture x side, whole seconds."""
    return V.table(spark, sf, "events").select(
        c("user_id").alias("fixture_id"), c("event_type").alias("side"), (F.floor(F.unix_micros(c("ts").cast("timestamp")) / F.lit(1_000_000)) * 1_000_000).alias("created_us"),
        (F.lit(1.5) + (c("event_id") % 101) / F.lit(100.0)).alias("price"), (c("value") > 5).alias("active"), "event_id")


_SLOTS_SQL = f"""WITH t AS ({_T}), f AS (SELECT DISTINCT fixture_id, side FROM t),
s AS (SELECT fixture_id, side, 1704067200000000 + d * 86400000000 + h * 3600000000 AS slot_us FROM f, (VALUES (5), (9), (13), (17), (21), (25)) a(d), (VALUES (8), (14)) b(h)),
l AS (SELECT s.fixture_id, s.side, s.slot_us, MAX(created_us) AS at_us FROM s LEFT JOIN t ON s.fixture_id = t.fixture_id AND s.side = t.side AND t.created_us <= s.slot_us GROUP BY ALL),
x AS (SELECT l.fixture_id, l.side, slot_us, at_us, COUNT(DISTINCT price || '|' || active) AS states, MIN(price) AS price, bool_and(active) AS active FROM l LEFT JOIN t ON l.fixture_id = t.fixture_id AND l.side = t.side AND t.created_us = l.at_us GROUP BY ALL)
SELECT fixture_id, side, slot_us, CASE WHEN at_us IS NULL THEN 'NO_HISTORICAL_DATA' WHEN states > 1 THEN 'AMBIGUOUS_LATEST_STATE' WHEN NOT active THEN 'INACTIVE_OR_UNKNOWN' WHEN slot_us - at_us > 86400000000 THEN 'STALE_QUOTE' ELSE 'COMPLETE' END AS status,
  CASE WHEN at_us IS NOT NULL AND states = 1 AND active AND slot_us - at_us <= 86400000000 THEN price END AS price FROM x"""


@query("JON-09", sql=_SLOTS_SQL)
def jon_09(spark, sf):
    """Latest tick at or before twelve slots, one day maximum age."""
    t = ticks(spark, sf)
    slots = F.array(*[F.lit(1_704_067_200_000_000 + d * V.DAY_US + h * V.HOUR_US) for d in (5, 9, 13, 17, 21, 25) for h in (8, 14)])
    sched = t.select("fixture_id").distinct().withColumn("slots", slots)
    st = asof.slot_states(t, sched, ["fixture_id", "side"]).withColumn("status", asof.slot_reason(86400))
    return st.select("fixture_id", "side", "slot_us", "status", F.when(c("status") == "COMPLETE", c("price")).alias("price"))


@query("WIN-18", views=("snapshots",), sql=f"""WITH sl AS ({_SLOTS_SQL}), p AS (SELECT event_id, fixture_id, observed_us, price FROM snapshots WHERE provider = 'error' AND observed_us < kickoff_us),
q AS (SELECT fixture_id, observed_us // 60000000 * 60000000 AS t, COUNT(DISTINCT price || '|' || line) AS states, MIN(price) AS price FROM snapshots WHERE provider = 'view' GROUP BY ALL),
m AS (SELECT p.event_id, MAX(q.t) AS at_us FROM p LEFT JOIN q ON p.fixture_id = q.fixture_id AND q.t <= p.observed_us AND p.observed_us - q.t <= 86400000000 GROUP BY p.event_id),
x AS (SELECT p.fixture_id, CASE WHEN at_us IS NULL THEN 'UNCOVERED' WHEN states > 1 THEN 'AMBIGUOUS' WHEN q.price = p.price THEN 'EQUAL' ELSE 'DIFFERENT' END AS verdict FROM p JOIN m USING (event_id) LEFT JOIN q ON q.fixture_id = p.fixture_id AND q.t = m.at_us),
a AS (SELECT fixture_id, COUNT(*) AS slots, COUNT(*) FILTER (status = 'COMPLETE') AS complete FROM sl GROUP BY fixture_id),
b AS (SELECT fixture_id, COUNT(*) FILTER (verdict = 'EQUAL') AS equal, COUNT(*) FILTER (verdict = 'DIFFERENT') AS different, COUNT(*) FILTER (verdict = 'AMBIGUOUS') AS ambiguous, COUNT(*) FILTER (verdict = 'UNCOVERED') AS uncovered FROM x GROUP BY fixture_id)
SELECT fixture_id, slots, complete, coalesce(equal, 0) AS equal, coalesce(different, 0) AS different, coalesce(ambiguous, 0) AS ambiguous, coalesce(uncovered, 0) AS uncovered FROM a LEFT JOIN b USING (fixture_id)""")
def win_18(spark, sf):
    """All slots of a fixture reconstructed, and its original observations held against the history at their own instants.

    Another price at that instant is told, not called an error; observations after kickoff are not compared.
    """
    n = lambda col, what: F.count_if(c(col) == what)
    slots = jon_09(spark, sf).groupBy("fixture_id").agg(F.count("*").alias("slots"), n("status", "COMPLETE").alias("complete"))
    s = V.snapshots(spark, sf)
    original = s.filter((c("provider") == "error") & (c("observed_us") < c("kickoff_us"))).select("event_id", "fixture_id", "observed_us", c("price").alias("original"))
    history = s.filter(c("provider") == "view").withColumn("t", F.floor(c("observed_us") / F.lit(60_000_000)) * 60_000_000)
    near = asof.nearest_prior(original.select("event_id", "fixture_id", "observed_us"), history, ["fixture_id"], "observed_us", "t", ["price", "line"], V.DAY_US, "event_id")
    told = near.select("event_id", "status", "recovered_price").join(original, "event_id")
    verdict = F.when(c("status") == "NO_CANDIDATE", "UNCOVERED").when(c("status") != "RECOVERED", "AMBIGUOUS").when(c("recovered_price") == c("original"), "EQUAL").otherwise("DIFFERENT")
    seen = told.withColumn("verdict", verdict).groupBy("fixture_id").agg(*[n("verdict", x.upper()).alias(x) for x in ("equal", "different", "ambiguous", "uncovered")])
    j = slots.join(seen, "fixture_id", "left")
    return j.select("fixture_id", "slots", "complete", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("equal", "different", "ambiguous", "uncovered")])


@query("JON-10", "JON-41", views=("snapshots",), sql="""WITH p AS (SELECT event_id, fixture_id, observed_us FROM snapshots WHERE provider = 'error'),
q AS (SELECT fixture_id, observed_us // 60000000 * 60000000 AS t, MIN(event_id) AS lo, MAX(event_id) AS hi, MIN(price) AS pmin FROM snapshots WHERE provider = 'view' GROUP BY ALL),
m AS (SELECT p.event_id, MAX(q.t) AS at_us FROM p LEFT JOIN q ON p.fixture_id = q.fixture_id AND q.t <= p.observed_us AND p.observed_us - q.t <= 21600000000 GROUP BY p.event_id),
s AS (SELECT fixture_id, observed_us // 60000000 * 60000000 AS t, COUNT(DISTINCT price || '|' || line) AS states, MIN(price) AS price FROM snapshots WHERE provider = 'view' GROUP BY ALL)
SELECT p.event_id, CASE WHEN at_us IS NULL THEN 'NO_CANDIDATE' WHEN states > 1 THEN 'AMBIGUOUS_NEAREST' ELSE 'RECOVERED' END AS status, m.at_us, CASE WHEN states = 1 THEN s.price END AS recovered_price
FROM p JOIN m USING (event_id) LEFT JOIN s ON s.fixture_id = p.fixture_id AND s.t = m.at_us""")
def jon_10(spark, sf):
    """Nearest prior quote within six hours; conflicting states at that minute stay ambiguous."""
    s = V.snapshots(spark, sf)
    probes = s.filter(c("provider") == "error").select("event_id", "fixture_id", "observed_us")
    quotes = s.filter(c("provider") == "view").withColumn("t", F.floor(c("observed_us") / F.lit(60_000_000)) * 60_000_000)
    out = asof.nearest_prior(probes, quotes, ["fixture_id"], "observed_us", "t", ["price", "line"], 21_600_000_000, "event_id")
    return out.select("event_id", "status", "at_us", "recovered_price")


@query("WIN-04", "WIN-05", "FLT-09", sql="""WITH t AS (SELECT user_id AS fixture_id, event_type AS side, epoch_us(ts) AS created_us, event_id, 1.5e0 + (event_id % 101) / 100e0 AS price, 1704067200000000 + (10 + user_id % 20) * 86400000000 + 64800000000 AS ko FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, side ORDER BY created_us, event_id) AS r1, row_number() OVER (PARTITION BY fixture_id, side ORDER BY created_us DESC, event_id DESC) AS r2, COUNT(*) OVER (PARTITION BY fixture_id, side) AS n FROM t WHERE created_us < ko)
SELECT a.fixture_id, a.side, a.price AS opening_price, a.created_us AS opening_us, b.price AS closing_price, b.created_us AS closing_us, a.n AS prematch_tick_count FROM p a JOIN p b ON a.fixture_id = b.fixture_id AND a.side = b.side AND a.r1 = 1 AND b.r2 = 1""")
def win_04(spark, sf):
    """Opening and closing pre-match tick per series."""
    t = V.table(spark, sf, "events").select(c("user_id").alias("fixture_id"), c("event_type").alias("side"), F.unix_micros(c("ts").cast("timestamp")).alias("created_us"), "event_id",
                                            (F.lit(1.5) + (c("event_id") % 101) / F.lit(100.0)).alias("price"),
                                            (F.lit(1_704_067_200_000_000) + (F.lit(10) + c("user_id") % 20) * F.lit(V.DAY_US) + F.lit(18 * V.HOUR_US)).alias("ko"))
    state = F.struct("created_us", "event_id", "price")
    return t.filter((c("created_us") < c("ko")) & (c("price") > 1)).groupBy("fixture_id", "side").agg(F.min(state).alias("a"), F.max(state).alias("b"), F.count("*").alias("prematch_tick_count")).select(
        "fixture_id", "side", c("a.price").alias("opening_price"), c("a.created_us").alias("opening_us"), c("b.price").alias("closing_price"), c("b.created_us").alias("closing_us"), "prematch_tick_count")


# ---- sequences --------------------------------------------------------------------------------
_ORD = "match_day, fixture_id, line_no, part_id, supp_id, qty"
SEQ = f"""WITH {OBS}, s AS (SELECT favorite_side, ah_q, ah_profit AS p, {_ORD}, row_number() OVER (PARTITION BY favorite_side, ah_q ORDER BY {_ORD}) AS rn,
  SUM(ah_profit) OVER (PARTITION BY favorite_side, ah_q ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS cum FROM obs WHERE family = 'AH_LINE'),
d AS (SELECT *, greatest(0, MAX(cum) OVER (PARTITION BY favorite_side, ah_q ORDER BY rn ROWS UNBOUNDED PRECEDING)) - cum AS dd,
  rn - coalesce(MAX(CASE WHEN p >= 0 THEN rn END) OVER (PARTITION BY favorite_side, ah_q ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS run FROM s)
SELECT favorite_side, ah_q, COUNT(*) AS n, CAST(SUM(p) AS BIGINT) AS total_micro, CAST(MAX(dd) AS BIGINT) AS max_drawdown_micro, MAX(run) AS longest_losing_streak FROM d GROUP BY ALL"""


def ah_line_obs(spark, sf, keep):
    from fairline.operators.patterns import observations

    return observations(V.market_rows(spark, sf), keep).filter(c("family") == "AH_LINE")


@query("WIN-01", "WIN-02", views=("market_rows",), sql=SEQ)
def win_01(spark, sf):
    """Drawdown and losing streak of every handicap line, in chronological order."""
    order = ["match_day", "fixture_id", "line_no", "part_id", "supp_id", "qty"]
    m = sequences.sequence_metrics(ah_line_obs(spark, sf, order), ["favorite_side", "ah_q"], order, "ah_profit")
    return m.withColumnRenamed("total", "total_micro").withColumnRenamed("max_drawdown", "max_drawdown_micro")


@query("WIN-03", views=("market_rows",), sql=f"""WITH q AS ({SEQ}), {OBS}, z AS (SELECT favorite_side, ah_q, CAST(SUM(CAST(ah_profit AS HUGEINT) * ah_profit) AS DOUBLE) / 1e12 AS sq FROM obs WHERE family = 'AH_LINE' GROUP BY ALL)
SELECT q.*, {S.r('total_micro / 1e6 / n', 6)} AS roi, {S.r('total_micro / 1e6 / (n + 200e0)', 6)} AS shrunk_roi, {S.r('1.96e0 * sqrt(greatest(sq / n - (total_micro / 1e6 / n) * (total_micro / 1e6 / n), 0e0)) / sqrt(CAST(n AS DOUBLE))', 6)} AS detectable_roi FROM q JOIN z USING (favorite_side, ah_q)""")
def win_03(spark, sf):
    """Forward metrics of every handicap line: drawdown and streak, and how far its return is shrunk and could be told from zero."""
    g = ah_line_obs(spark, sf, ["season"]).groupBy("favorite_side", "ah_q").agg((F.sum(c("ah_profit").cast("decimal(20,0)") * c("ah_profit").cast("decimal(18,0)")).cast("double") / 1e12).alias("sq"))
    j = win_01(spark, sf).join(g, ["favorite_side", "ah_q"])
    profit, n = from_micro(c("total_micro")), c("n")
    sd = F.sqrt(F.greatest(c("sq") / n - (profit / n) * (profit / n), F.lit(0.0)))
    return j.withColumns({"roi": rnd(profit / n, 6), "shrunk_roi": rnd(stats.shrunk_roi(profit, n), 6), "detectable_roi": rnd(stats.detectable_roi(sd, n), 6)}).drop("sq")


@query("STA-06", views=("market_rows",), sql=f"""WITH {OBS}, s AS (SELECT favorite_side, ah_q, season, COUNT(*) AS n, SUM(ah_profit) AS p, SUM(CAST(ah_profit AS HUGEINT) * ah_profit) AS sq FROM obs WHERE family = 'AH_LINE' GROUP BY ALL),
g AS (SELECT favorite_side, ah_q, CAST(SUM(n) AS BIGINT) AS n, SUM(p) AS p, CAST(SUM(sq) AS DOUBLE) AS sq, MAX(abs(p)) AS big, SUM(abs(p)) AS tot, MIN(p / 1e6 / n) AS worst FROM s GROUP BY favorite_side, ah_q)
SELECT favorite_side, ah_q, n, {S.r('p / 1e6 / n', 6)} AS mean_roi, {S.r('sqrt((sq - CAST(p AS DOUBLE) * CAST(p AS DOUBLE) / CAST(n AS DOUBLE)) / (CAST(n AS DOUBLE) - 1e0)) / 1e6', 6)} AS sample_sd,
  {S.r('worst', 6)} AS worst_season_roi, {S.r('CAST(big AS DOUBLE) / CAST(tot AS DOUBLE)', 6)} AS season_abs_concentration FROM g""")
def sta_06(spark, sf):
    s = ah_line_obs(spark, sf, ["season"]).groupBy("favorite_side", "ah_q", "season").agg(
        F.count("*").alias("n"), F.sum("ah_profit").alias("p"), F.sum(c("ah_profit").cast("decimal(20,0)") * c("ah_profit").cast("decimal(18,0)")).alias("sq"))
    g = s.groupBy("favorite_side", "ah_q").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("sq").cast("double").alias("sq"), F.max(F.abs("p")).alias("big"), F.sum(F.abs("p")).alias("tot"),
        F.min(from_micro(c("p")) / c("n")).alias("worst"))
    n, p = c("n").cast("double"), c("p").cast("double")
    return g.select("favorite_side", "ah_q", "n", rnd(from_micro(c("p")) / c("n"), 6).alias("mean_roi"), rnd(F.sqrt((c("sq") - p * p / n) / (n - 1.0)) / 1e6, 6).alias("sample_sd"),
                    rnd(c("worst"), 6).alias("worst_season_roi"), rnd(c("big").cast("double") / c("tot").cast("double"), 6).alias("season_abs_concentration"))


# Random bounds are held against theory: SQL knows the counts, the total and what the normal law says; a bound may stray from
# it by as much as its own spread over the draws and the skew of the profits explain, and must then be called `near`.
_HIST = f"WITH {OBS}, g AS (SELECT favorite_side || '|' || CAST(ah_q AS VARCHAR) AS pattern, COUNT(*) AS n, CAST(SUM(ah_profit) AS BIGINT) AS total_micro, SUM(CAST(ah_profit AS HUGEINT) * ah_profit) AS sq FROM obs WHERE family = 'AH_LINE' GROUP BY ALL)"
_CI_SQL = _HIST + " SELECT pattern, n, total_micro, true AS low_near, true AS high_near FROM g"


def _patterns(spark, sf):
    obs = ah_line_obs(spark, sf, ["season"]).withColumn("pattern", F.concat_ws("|", "favorite_side", c("ah_q").cast("string")))
    hist = resampling.histogram(obs, ["pattern"], c("ah_profit"))
    sq = (c("v").cast("decimal(20,0)") * c("v").cast("decimal(18,0)")).cast("double") * c("c") / 1e12
    return hist, hist.groupBy("pattern").agg(F.sum("c").alias("n"), F.sum(c("v") * c("c")).alias("total_micro"), F.sum(sq).alias("sq"))


def _interval_check(spark, sf, n_draws, **kw):
    """Bootstrap bounds of every handicap line, and whether they lie where the normal law puts them (within a third of a bound's distance)."""
    hist, g = _patterns(spark, sf)
    ci = resampling.bootstrap_interval(hist, ["pattern"], c("pattern"), n_draws=n_draws, **kw)
    mean = c("total_micro") / 1e6 / c("n")
    spread = 1.959964 * F.sqrt((c("sq") / c("n") - mean * mean) / c("n"))
    near = lambda bound, expected: F.abs(c(bound) - expected) <= spread / 3 + 1e-9
    return g.join(ci, "pattern").select("pattern", "n", "total_micro", near("ci_low", mean - spread).alias("low_near"), near("ci_high", mean + spread).alias("high_near"))


@query("RES-01", views=("market_rows",), sql=_CI_SQL)
def res_01(spark, sf):
    return _interval_check(spark, sf, 500)


@query("RES-02", views=("market_rows",), sql=_CI_SQL)
def res_02(spark, sf):
    return _interval_check(spark, sf, 4000, quantile="index")


@query("RES-03", views=("market_rows",), sql=_CI_SQL)
def res_03(spark, sf):
    return _interval_check(spark, sf, 10000, quantile="index")


@query("RES-04", views=("market_rows",), sql=_CI_SQL)
def res_04(spark, sf):
    return _interval_check(spark, sf, 2000, quantile="index", indexes=(50, 1949))


def _flip_check(spark, sf, n_draws, two_sided):
    """Sign-flip p of every handicap line against the normal law of the flipped total; a total that is not positive has a one-sided p of 1."""
    hist, g = _patterns(spark, sf)
    p = resampling.sign_flip_p(hist, ["pattern"], c("pattern"), n_draws=n_draws, two_sided=two_sided)
    z = c("total_micro") / 1e6 / F.sqrt("sq")
    normal = stats.two_sided_p(z) if two_sided else F.when(z <= 0, 1.0).otherwise(stats.two_sided_p(z) / 2)
    near = F.abs(c("p") - normal) <= 0.03 + 5 * F.sqrt(normal * (1 - normal) / n_draws)
    return g.join(p, "pattern").select("pattern", "n", "total_micro", (c("p") == 1).alias("is_one") if not two_sided else F.lit(False).alias("is_one"), near.alias("p_near"))


@query("RES-05", views=("market_rows",), sql=_HIST + " SELECT pattern, n, total_micro, false AS is_one, true AS p_near FROM g")
def res_05(spark, sf):
    return _flip_check(spark, sf, 1000, True)


@query("RES-06", views=("market_rows",), sql=_HIST + " SELECT pattern, n, total_micro, total_micro <= 0 AS is_one, true AS p_near FROM g")
def res_06(spark, sf):
    return _flip_check(spark, sf, 5000, False)


# ---- walk-forward -----------------------------------------------------------------------------
@query("WIN-13", views=("market_rows",), sql=f"""WITH x AS (SELECT favorite_side, CAST(round(favorite_ah_line * 4) AS INTEGER) AS ah_q, CASE WHEN ah_line_move < 0 THEN 'S' WHEN ah_line_move > 0 THEN 'W' ELSE 'F' END AS move, CAST(match_day AS VARCHAR) AS day,
  {S.micro(S.profit(S.ah_signs('home_goals', 'away_goals', 'favorite_ah_line', 'favorite_side'), 'favorite_ah_price'))} AS p FROM market_rows),
d AS (SELECT favorite_side, ah_q, move, day, COUNT(*) AS n, SUM(p) AS s FROM x GROUP BY ALL),
b AS (SELECT favorite_side, ah_q, day, SUM(n) AS n, SUM(s) AS s FROM d GROUP BY ALL),
bw AS (SELECT *, SUM(n) OVER (PARTITION BY favorite_side, ah_q ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bn, SUM(s) OVER (PARTITION BY favorite_side, ah_q ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bs FROM b),
pd AS (SELECT day, SUM(SUM(n)) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn FROM d GROUP BY day),
mw AS (SELECT *, coalesce(SUM(n) OVER (PARTITION BY favorite_side, ah_q, move ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mn, coalesce(SUM(s) OVER (PARTITION BY favorite_side, ah_q, move ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ms FROM d)
SELECT favorite_side, ah_q, move, day, mw.n, CAST(bn AS BIGINT) AS base_n, CAST(mn AS BIGINT) AS move_n, bs / 1e6 / bn AS baseline_prediction, (ms / 1e6 + 10 * (bs / 1e6 / bn)) / (mn + 10) AS movement_prediction
FROM mw JOIN bw USING (favorite_side, ah_q, day) JOIN pd USING (day) WHERE pn >= 20 AND bn >= 5""")
def win_13(spark, sf):
    """Return forecasts per (line, movement, day) from strictly earlier days."""
    df = V.market_rows(spark, sf)
    st = settlement.settle_handicap(c("home_goals"), c("away_goals"), c("favorite_ah_line"), c("favorite_ah_price"), c("favorite_side"))
    rows = df.select("favorite_side", F.rint(c("favorite_ah_line") * 4).cast("int").alias("ah_q"), F.when(c("ah_line_move") < 0, "S").when(c("ah_line_move") > 0, "W").otherwise("F").alias("move"),
                     c("match_day").cast("string").alias("day"), micro(st["profit_units"]).alias("p"))
    return statistics.walk_forward(rows, ["favorite_side", "ah_q"], "move", "day", c("p"))
