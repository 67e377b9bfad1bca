"""Pattern backtests and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import settlement
from fairline.operators import patterns as P
from fairline.plans import audits as A
from fairline.queries import sqlviews as S
from fairline.queries.registry import query
from fairline.sources import views as V

TEST = ", ".join(f"'{s}'" for s in V.TEST_SEASONS)
PH = {k: ", ".join(f"'{s}'" for s in v) for k, v in V.PHASES.items()}
PHASE_SQL = " ".join(["CASE"] + [f"WHEN season IN ({v}) THEN '{k}'" for k, v in PH.items()] + ["END"])
SPLIT_SQL = f"CASE WHEN season IN ({TEST}) THEN 'test' ELSE 'train' END"
CLASSES = [c.lower() for c in settlement.CLASSES]

# ---- shared SQL: pattern expansion -----------------------------------------------------------
AHS = S.ah_signs("home_goals", "away_goals", "favorite_ah_line", "favorite_side")
OVS = S.over_signs("home_goals", "away_goals", "ou_line")


def _q(c):
    return f"CAST(round({c} * 4) AS INTEGER)"


OBS = f"""
o0 AS (SELECT *, {AHS} AS ah_signs, {OVS} AS over_signs FROM market_rows WHERE favorite_ah_price BETWEEN 1.5e0 AND 2.5e0),
o1 AS (SELECT *, {S.micro(S.profit('ah_signs', 'favorite_ah_price'))} AS ah_profit FROM o0),
sides AS (
  SELECT o1.*, 'O' AS ou_side, over_price AS ou_price, over_signs AS ou_signs FROM o1 WHERE over_price BETWEEN 1.5e0 AND 2.5e0
  UNION ALL SELECT o1.*, 'U', under_price, -over_signs FROM o1 WHERE under_price BETWEEN 1.5e0 AND 2.5e0),
obs AS (
  SELECT season, league, match_day, fixture_id, line_no, part_id, supp_id, qty, favorite_side, {_q('favorite_ah_line')} AS ah_q, f.family,
    ou_side, {_q('ou_line')} AS ou_q,
    CASE WHEN f.family LIKE 'AH_OU_PRICE%' THEN CAST(trunc(favorite_ah_price / 1e-1) AS BIGINT) END AS ah_band,
    CASE WHEN f.family LIKE 'AH_OU_PRICE%' THEN CAST(trunc(ou_price / 1e-1) AS BIGINT) END AS ou_band,
    CASE WHEN f.family = 'AH_OU_PRICE_1X2' THEN CAST(trunc(favorite_fair_probability / 5e-2) AS BIGINT) END AS p_band,
    CASE WHEN f.family = 'AH_OU_MOVE' THEN {_q('ah_line_move')} END AS ah_move_q,
    CASE WHEN f.family IN ('OU_MOVE', 'AH_OU_MOVE') THEN {_q('ou_line_move')} END AS ou_move_q,
    ah_signs, ah_profit, ou_signs, {S.micro(S.profit('ou_signs', 'ou_price'))} AS ou_profit
  FROM sides, (VALUES ('AH_OU'), ('AH_OU_PRICE'), ('AH_OU_PRICE_1X2'), ('OU_MOVE'), ('AH_OU_MOVE')) f(family)
  UNION ALL
  SELECT season, league, match_day, fixture_id, line_no, part_id, supp_id, qty, favorite_side, {_q('favorite_ah_line')}, f.family, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN f.family = 'AH_MOVE' THEN {_q('ah_line_move')} END, NULL, ah_signs, ah_profit, NULL, NULL
  FROM o1, (VALUES ('AH_LINE'), ('AH_MOVE')) f(family))
"""
KEYS = "family, favorite_side, ah_q, ou_side, ou_q, ah_band, ou_band, p_band, ah_move_q, ou_move_q"


def _edge(c, w):
    lo = f"(floor(({c} * {w}) * 1e4 + 0.5e0) / 1e4)"
    hi = f"(floor(({c} * {w} + {w}) * 1e4 + 0.5e0) / 1e4)"
    return f"printf('%.2f', {lo}) || '-' || printf('%.2f', {hi})"


TEXT = f"""concat_ws('|', family, favorite_side, 'AH=' || printf('%+.2f', ah_q / 4e0),
  ou_side || printf('%.2f', ou_q / 4e0), 'AH@' || {_edge('ah_band', '1e-1')}, 'OU@' || {_edge('ou_band', '1e-1')},
  'FAVP=' || {_edge('p_band', '5e-2')}, 'AHMOVE=' || printf('%+.2f', ah_move_q / 4e0), 'OUMOVE=' || printf('%+.2f', ou_move_q / 4e0))"""


def _counts(signs, prefix):
    return ", ".join(
        f"COUNT(*) FILTER (WHERE {signs} = {2 - i}) AS {prefix}_{c}" for i, c in enumerate(CLASSES)
    )


def _roi(profit, n="n"):
    return S.r(f"{profit} / 1e6 / {n}", 6)


# ---- AGG-01 / JON-02 --------------------------------------------------------------------------
AGG01 = f"""
WITH x AS (
  SELECT *, {SPLIT_SQL} AS split FROM market_rows),
e AS (
  SELECT split, result, 'H' AS side, open_h AS odds, fair_h AS fair, close_h AS cl FROM x UNION ALL
  SELECT split, result, 'D', open_d, fair_d, close_d FROM x UNION ALL
  SELECT split, result, 'A', open_a, fair_a, close_a FROM x),
g AS (
  SELECT split, side, CAST(floor((odds + 1e-9) / 1e-1) AS BIGINT) AS b, COUNT(*) AS n,
    COUNT(*) FILTER (WHERE result = side) AS wins, {S.avg_micro('fair')} AS market_expected, {S.avg_micro('odds')} AS avg_odds,
    {S.sum_micro("CASE WHEN result = side THEN odds - 1e0 ELSE -1e0 END")} AS profit,
    {S.avg_micro("odds / CASE WHEN cl > 1e0 THEN cl END - 1e0")} AS avg_clv
  FROM e GROUP BY ALL HAVING COUNT(*) >= 20),
report AS (
SELECT split, side, floor((b * 1e-1) * 1e2 + 0.5e0) / 1e2 AS odds_low, floor((b * 1e-1 + 1e-1) * 1e2 + 0.5e0) / 1e2 AS odds_high, n, wins,
  CAST(wins AS DOUBLE) / CAST(n AS DOUBLE) AS win_rate, market_expected,
  (CAST(wins AS DOUBLE) / CAST(n AS DOUBLE) - market_expected) * 1e2 AS calibration_gap_pp, avg_odds,
  profit / 1e6 AS profit_units, profit / 1e6 / n AS flat_stake_roi, avg_clv FROM g)
"""


@query("AGG-01", views=("market_rows",), sql=AGG01 + " SELECT * FROM report")
def agg_01(spark, sf):
    return P.side_backtest(V.market_rows(spark, sf), V.TEST_SEASONS, 20)


@query("SET-05", views=("market_rows",), sql=AGG01 + " SELECT side, odds_low, split, flat_stake_roi, calibration_gap_pp, avg_clv FROM report")
def set_05(spark, sf):
    return P.side_backtest(V.market_rows(spark, sf), V.TEST_SEASONS, 20).select(
        "side", "odds_low", "split", "flat_stake_roi", "calibration_gap_pp", "avg_clv"
    )


JON02 = AGG01 + """, p AS (
SELECT a.side, a.odds_low, a.odds_high, a.n AS train_n, b.n AS test_n, a.flat_stake_roi AS train_roi, b.flat_stake_roi AS test_roi,
  a.calibration_gap_pp AS train_gap_pp, b.calibration_gap_pp AS test_gap_pp, a.avg_clv AS train_clv, b.avg_clv AS test_clv,
  (a.win_rate - a.market_expected) / sqrt(a.market_expected * (1e0 - a.market_expected) / a.n) AS train_z,
  (b.win_rate - b.market_expected) / sqrt(b.market_expected * (1e0 - b.market_expected) / b.n) AS test_z
FROM report a JOIN report b ON a.side = b.side AND a.odds_low = b.odds_low AND a.odds_high = b.odds_high
WHERE a.split = 'train' AND b.split = 'test'),
d AS (SELECT *, train_n >= 60 AND test_n >= 20 AND train_roi > 0 AND test_roi > 0 AND train_gap_pp > 0 AND test_gap_pp > 0 AS ok,
  coalesce(train_clv >= 0 AND test_clv >= 0 AND train_z >= 1 AND test_z >= 1, false) AS st FROM p)
"""


@query("JON-02", "STA-01", views=("market_rows",), sql=JON02 + """SELECT * EXCLUDE (ok, st), CASE WHEN ok AND st THEN 'STRONG_RESEARCH_CANDIDATE'
  WHEN ok THEN 'CONSISTENT_POSITIVE_RESEARCH_CANDIDATE' ELSE 'NO_GO' END AS status FROM d""")
def jon_02(spark, sf):
    return A.side_audit(P.side_backtest(V.market_rows(spark, sf), V.TEST_SEASONS, 20))


# ---- AGG-03 family ----------------------------------------------------------------------------
@query("AGG-03", "AGG-04", views=("market_rows",), sql=f"""WITH {OBS},
g AS (SELECT {SPLIT_SQL} AS split, {KEYS}, COUNT(*) AS n, SUM(ah_profit) AS ahp, SUM(ou_profit) AS oup, {_counts('ah_signs', 'ah')}, {_counts('ou_signs', 'ou')}
  FROM obs GROUP BY {SPLIT_SQL}, {KEYS} HAVING COUNT(*) >= 20)
SELECT split, family, {TEXT} AS pattern, n, {_roi('ahp')} AS ah_roi, {_roi('oup')} AS ou_roi,
  {', '.join(f'{m}_{c}' for m in ('ah', 'ou') for c in CLASSES)} FROM g""")
def agg_03(spark, sf):
    return P.hierarchical_report(V.market_rows(spark, sf), V.TEST_SEASONS, 20)


@query("AGG-02", views=("market_rows",), sql=f"""WITH {OBS},
s AS (SELECT {SPLIT_SQL} AS split, season, {KEYS}, COUNT(*) AS n, SUM(ah_profit) AS ahp, SUM(ou_profit) AS oup
  FROM obs WHERE family = 'AH_OU_PRICE_1X2' GROUP BY ALL),
g AS (SELECT split, {KEYS}, SUM(n) AS n, SUM(ahp) AS ahp, SUM(oup) AS oup, string_agg(season || ':' || n, ',' ORDER BY season) AS seasons
  FROM s GROUP BY split, {KEYS} HAVING SUM(n) >= 20)
SELECT split, {TEXT} AS pattern, CAST(n AS BIGINT) AS n, {_roi('ahp')} AS ah_roi, {_roi('oup')} AS ou_roi, seasons FROM g""")
def agg_02(spark, sf):
    return P.joint_report(V.market_rows(spark, sf), V.TEST_SEASONS, 20)


def _stack(src, extra):
    return f"""SELECT {extra}, {KEYS}, 'AH' AS market, n, ahp AS profit FROM {src} UNION ALL
      SELECT {extra}, {KEYS}, 'OU', n, oup FROM {src} WHERE family NOT IN ('AH_LINE', 'AH_MOVE')"""


def _paired(where="", by=""):
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH {OBS},
s AS (SELECT {b}{SPLIT_SQL} AS split, season, {KEYS}, COUNT(*) AS n, SUM(ah_profit) AS ahp, SUM(ou_profit) AS oup FROM obs {where} GROUP BY ALL),
m AS ({_stack('s', f'{b}split, season')}),
p AS (SELECT {b}{KEYS}, market,
  {', '.join(f"CAST(SUM(n) FILTER (WHERE split = '{x}') AS BIGINT) AS {x}_n, SUM(profit) FILTER (WHERE split = '{x}') AS {x}_p, "
             f"COUNT(*) FILTER (WHERE split = '{x}' AND n >= 10) AS {x}_eligible_seasons, "
             f"COUNT(*) FILTER (WHERE split = '{x}' AND n >= 10 AND profit > 0) AS {x}_positive_seasons" for x in ('train', 'test'))}
  FROM m GROUP BY {b}{KEYS}, market),
r AS (SELECT *, {_roi('train_p', 'train_n')} AS train_roi, {_roi('test_p', 'test_n')} AS test_roi FROM p WHERE train_n >= 60 AND test_n >= 30),
z AS (SELECT *, train_roi * sqrt(CAST(train_n AS DOUBLE)) AS z1, test_roi * sqrt(CAST(test_n AS DOUBLE)) AS z2 FROM r),
t AS (SELECT *, {S.r(f"greatest({S.two_sided_p('z1')}, {S.two_sided_p('z2')})", 6)} AS p_conservative FROM z),
k AS (SELECT *, row_number() OVER ({part} ORDER BY p_conservative) AS rk, COUNT(*) OVER ({part}) AS mm FROM t),
q AS (SELECT *, MIN(p_conservative * mm / rk) OVER ({part} ORDER BY p_conservative, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qq FROM k),
f AS (SELECT *, {S.r('least(qq, 1e0)', 6)} AS q_bh FROM q)
SELECT {b}{TEXT} AS pattern, family, market, train_n, test_n, train_roi, test_roi, {S.r('z1', 6)} AS z_train, {S.r('z2', 6)} AS z_test, p_conservative, q_bh,
  train_eligible_seasons, train_positive_seasons, test_eligible_seasons, test_positive_seasons,
  CASE WHEN train_roi > 0 AND test_roi > 0 AND q_bh <= 1e-1
    AND coalesce(CAST(train_positive_seasons AS DOUBLE) / nullif(train_eligible_seasons, 0) >= 6e-1, false)
    AND coalesce(CAST(test_positive_seasons AS DOUBLE) / nullif(test_eligible_seasons, 0) >= 6e-1, false) THEN 'ROBUST_RESEARCH_CANDIDATE'
    WHEN train_roi > 0 AND test_roi > 0 THEN 'WATCHLIST' ELSE 'REJECT' END AS status FROM f"""


@query("GAT-01", "WIN-14", "AGG-35", "STA-02", "STA-03", views=("market_rows",), sql=_paired())
def gat_01(spark, sf):
    return A.paired_audit(V.market_rows(spark, sf), V.TEST_SEASONS)


@query("GAT-11", views=("market_rows",),
       sql="SELECT * FROM (" + _paired(by="league") + ") UNION ALL SELECT 'GLOBAL' AS league, * FROM (" + _paired() + ")")
def gat_11(spark, sf):
    return A.paired_audit(V.market_rows(spark, sf), V.TEST_SEASONS, by=("league",), also={"league": "GLOBAL"})


# ---- three-way --------------------------------------------------------------------------------
THREE = f"""WITH {OBS},
s AS (SELECT {PHASE_SQL} AS phase, league, {KEYS}, COUNT(*) AS n, SUM(ah_profit) AS ahp, SUM(ou_profit) AS oup, {_counts('ah_signs', 'ah')}, {_counts('ou_signs', 'ou')}
  FROM obs GROUP BY ALL),
m AS (SELECT phase, league, {KEYS}, 'AH' AS market, n, ahp AS profit, {', '.join(f'ah_{c} AS {c}' for c in CLASSES)} FROM s WHERE phase IS NOT NULL UNION ALL
  SELECT phase, league, {KEYS}, 'OU', n, oup, {', '.join(f'ou_{c}' for c in CLASSES)} FROM s WHERE phase IS NOT NULL AND family NOT IN ('AH_LINE', 'AH_MOVE')),
g AS (SELECT {KEYS}, market,
  COUNT(*) FILTER (WHERE phase = 'holdout' AND n >= 20) AS eligible_leagues,
  COUNT(*) FILTER (WHERE phase = 'holdout' AND n >= 20 AND {_roi('profit')} > 0) AS positive_leagues,
  {', '.join(f"CAST(SUM(n) FILTER (WHERE phase = '{x}') AS BIGINT) AS {x}_n, SUM(profit) FILTER (WHERE phase = '{x}') AS {x}_p, "
             + ', '.join(f"CAST(coalesce(SUM({c}) FILTER (WHERE phase = '{x}'), 0) AS BIGINT) AS {x}_{c}" for c in CLASSES) for x in V.PHASES)}
  FROM m GROUP BY {KEYS}, market),
r AS (SELECT *, {', '.join(f"{_roi(f'{x}_p', f'{x}_n')} AS {x}_roi" for x in V.PHASES)} FROM g WHERE train_n >= 150 AND validation_n >= 80 AND holdout_n >= 40),
z AS (SELECT *, validation_roi * sqrt(CAST(validation_n AS DOUBLE)) AS z1 FROM r),
t AS (SELECT *, {S.r('z1', 6)} AS z_validation, {S.r(S.two_sided_p('z1'), 6)} AS p_validation FROM z),
k AS (SELECT *, row_number() OVER (ORDER BY p_validation) AS rk, COUNT(*) OVER () AS mm FROM t),
q AS (SELECT *, {S.r("least(MIN(p_validation * mm / rk) OVER (ORDER BY p_validation, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1e0)", 6)} AS q_validation_bh FROM k),
c AS (SELECT *, coalesce(CAST(positive_leagues AS DOUBLE) / nullif(eligible_leagues, 0), 0e0) AS share FROM q),
audit AS (SELECT {TEXT} AS pattern, {KEYS}, market, {', '.join(f'{x}_n, {x}_roi' for x in V.PHASES)}, z_validation, p_validation, q_validation_bh,
  eligible_leagues, positive_leagues, {S.r('share', 6)} AS positive_share, {', '.join(f'{x}_{k}' for x in V.PHASES for k in CLASSES)},
  CASE WHEN train_roi > 0 AND validation_roi > 0 AND holdout_roi > 0 THEN
    CASE WHEN q_validation_bh <= 1e-1 THEN CASE WHEN eligible_leagues >= 3 AND share >= 6e-1 THEN 'GLOBAL_ROBUST_RESEARCH_CANDIDATE' ELSE 'LEAGUE_SPECIFIC_OR_UNSTABLE' END
    ELSE 'WATCHLIST' END ELSE 'REJECT' END AS status FROM c)
"""
_KEYLESS = ", ".join(k for k in P.KEY)


def three_way(spark, sf):
    return A.three_way_audit(V.market_rows(spark, sf), V.PHASES)


@query("GAT-02", "JON-03", "WIN-15", "AGG-39", views=("market_rows",), sql=THREE + f" SELECT * EXCLUDE ({_KEYLESS}) FROM audit")
def gat_02(spark, sf):
    return three_way(spark, sf).drop(*P.KEY)


@query("TOP-02", views=("market_rows",), sql=THREE + """ SELECT pattern, market, status, holdout_roi, holdout_n,
  CASE status WHEN 'GLOBAL_ROBUST_RESEARCH_CANDIDATE' THEN 3 WHEN 'LEAGUE_SPECIFIC_OR_UNSTABLE' THEN 2 WHEN 'WATCHLIST' THEN 1 ELSE 0 END AS priority
  FROM audit ORDER BY priority DESC, holdout_roi DESC, holdout_n DESC, pattern, market""")
def top_02(spark, sf):
    return A.ranked(three_way(spark, sf)).select("pattern", "market", "status", "holdout_roi", "holdout_n", "priority")


@query("GAT-07", views=("market_rows",), sql=THREE + """ SELECT market || '::' || pattern AS pattern_id, family, train_n, validation_n, holdout_n, q_validation_bh
  FROM audit WHERE status = 'WATCHLIST'""")
def gat_07(spark, sf):
    return A.registry(three_way(spark, sf), promotable=A.WATCH).select(
        "pattern_id", "family", "train_n", "validation_n", "holdout_n", "q_validation_bh"
    )


@query("AGG-34", views=("market_rows",), sql=f"""WITH {OBS},
s AS (SELECT {PHASE_SQL} AS phase, league, {KEYS}, COUNT(*) AS n, SUM(ah_profit) AS ahp, SUM(ou_profit) AS oup FROM obs GROUP BY ALL),
m AS ({_stack('(SELECT * FROM s WHERE phase IS NOT NULL)', 'phase, league')}),
g AS (SELECT {KEYS}, market, COUNT(*) FILTER (WHERE phase = 'holdout' AND n >= 20) AS eligible_leagues,
  COUNT(*) FILTER (WHERE phase = 'holdout' AND n >= 20 AND {_roi('profit')} > 0) AS positive_leagues FROM m GROUP BY {KEYS}, market)
SELECT {TEXT} AS pattern, market, eligible_leagues, positive_leagues,
  {S.r('coalesce(CAST(positive_leagues AS DOUBLE) / nullif(eligible_leagues, 0), 0e0)', 6)} AS positive_share,
  eligible_leagues >= 3 AND coalesce(CAST(positive_leagues AS DOUBLE) / nullif(eligible_leagues, 0), 0e0) >= 6e-1 AS cross_league_stable FROM g""")
def agg_34(spark, sf):
    fine = A.phase_markets(V.market_rows(spark, sf), V.PHASES, by=("league",))
    return A.league_consistency(fine).withColumn("pattern", P.pattern_text()).drop(*P.KEY)


@query("STO-03", views=("market_rows",), sql=f"""WITH {OBS},
s AS (SELECT {PHASE_SQL} AS phase, {KEYS}, COUNT(*) AS n FROM obs GROUP BY ALL HAVING COUNT(*) >= 20)
SELECT {TEXT} AS pattern FROM (SELECT {KEYS} FROM s WHERE phase = 'train' INTERSECT SELECT {KEYS} FROM s WHERE phase = 'validation' INTERSECT SELECT {KEYS} FROM s WHERE phase = 'holdout')""")
def sto_03(spark, sf):
    staged = V.market_rows(spark, sf).withColumn("phase", P.phase_label(V.PHASES)).filter(F.col("phase").isNotNull())
    big = P.season_buckets(P.observations(staged, ["phase"]), ("phase",)).filter("n >= 20")
    sets = [big.filter(F.col("phase") == p).select(*P.KEY) for p in V.PHASES]
    return sets[0].intersect(sets[1]).intersect(sets[2]).select(P.pattern_text().alias("pattern"))


# ---- AGG-05 distribution, AGG-27 --------------------------------------------------------------
@query("AGG-05", views=("market_rows",), sql=f"""WITH {OBS} SELECT favorite_side, ah_q, {_counts('ah_signs', 'ah')} FROM obs WHERE family = 'AH_LINE' GROUP BY favorite_side, ah_q""")
def agg_05(spark, sf):
    rows = V.market_rows(spark, sf)
    s = settlement.settle_handicap(
        F.col("home_goals"), F.col("away_goals"), F.col("favorite_ah_line"), F.col("favorite_ah_price"), F.col("favorite_side")
    )
    return (
        rows.filter(F.col("favorite_ah_price").between(1.5, 2.5))
        .select("favorite_side", F.rint(F.col("favorite_ah_line") * 4).cast("int").alias("ah_q"), s.alias("s"))
        .groupBy("favorite_side", "ah_q")
        .agg(*settlement.distribution(F.col("s.settlement"), "ah_"))
    )


# ---- multi-season validation ------------------------------------------------------------------
MIN_N = {"train": 150, "validation": 80, "holdout": 40}


def _gates(market, where=""):
    if market == "AH":
        bets = f"""SELECT season, league, favorite_side, {_q('favorite_ah_line')} AS ah_q, '-' AS ou_side, {AHS} AS sg, favorite_ah_price AS bp, favorite_fair_probability AS fp FROM market_rows"""
    else:
        bets = f"""SELECT season, league, favorite_side, {_q('favorite_ah_line')} AS ah_q, 'O' AS ou_side, {OVS} AS sg, over_price AS bp, favorite_fair_probability AS fp FROM market_rows
          UNION ALL SELECT season, league, favorite_side, {_q('favorite_ah_line')}, 'U', -{OVS}, under_price, favorite_fair_probability FROM market_rows"""
    vk = "favorite_side, ah_q, ou_side, price_band, p_band"
    return f"""WITH bets AS ({bets}),
b AS (SELECT season, league, favorite_side, ah_q, ou_side, CAST(floor((bp + 1e-12) / 2e-1) AS BIGINT) AS price_band, CAST(floor((fp + 1e-12) / 1e-1) AS BIGINT) AS p_band,
  {S.micro(S.profit('sg', 'bp'))} AS profit, {PHASE_SQL} AS phase FROM bets {where}),
l AS (SELECT {vk}, COUNT(*) AS leagues, COUNT(*) FILTER (WHERE profit > 0) AS positive_leagues FROM (
  SELECT {vk}, league, SUM(profit) AS profit FROM b WHERE phase <> 'train' GROUP BY ALL) GROUP BY ALL),
s AS (SELECT {vk}, phase, season, COUNT(*) AS n, SUM(profit) AS profit FROM b WHERE phase IS NOT NULL GROUP BY ALL),
t AS (SELECT {vk}, {', '.join(f"CAST(coalesce(SUM(n) FILTER (WHERE phase = '{x}'), 0) AS BIGINT) AS {x}_n, coalesce(SUM(profit) FILTER (WHERE phase = '{x}'), 0) AS {x}_profit" for x in V.PHASES)},
  COUNT(*) FILTER (WHERE phase = 'validation' AND profit > 0) AS validation_seasons_positive,
  COUNT(*) FILTER (WHERE phase = 'holdout' AND profit > 0) AS holdout_seasons_positive FROM s GROUP BY ALL),
g AS (SELECT t.*, coalesce(leagues, 0) AS leagues, coalesce(positive_leagues, 0) AS positive_leagues,
  {', '.join(f"coalesce({_roi(f'{x}_profit', f'nullif({x}_n, 0)')}, 0e0) AS {x}_roi" for x in V.PHASES)}
  FROM t LEFT JOIN l USING ({vk}) WHERE train_n >= 150 AND train_profit > 0),
gates AS (SELECT favorite_side || '|' || printf('%+.2f', ah_q / 4e0) || '|' || ou_side || '|' || {_edge('price_band', '2e-1')} || '|' || {_edge('p_band', '1e-1')} AS pattern,
  train_n, validation_n, holdout_n, train_roi, validation_roi, holdout_roi, leagues, positive_leagues, validation_seasons_positive, holdout_seasons_positive,
  concat_ws(',', CASE WHEN NOT coalesce(leagues >= 3, false) THEN 'cross_league_count' END, CASE WHEN NOT holdout_n >= 40 THEN 'holdout_n' END,
   CASE WHEN NOT holdout_profit > 0 THEN 'holdout_roi_positive' END, CASE WHEN holdout_seasons_positive <> 2 THEN 'holdout_season_positive' END,
   CASE WHEN NOT coalesce(CAST(positive_leagues AS DOUBLE) / nullif(leagues, 0) >= 6e-1, false) THEN 'positive_league_share' END,
   CASE WHEN NOT validation_n >= 80 THEN 'validation_n' END, CASE WHEN NOT validation_profit > 0 THEN 'validation_roi_positive' END,
   CASE WHEN validation_seasons_positive <> 2 THEN 'validation_seasons_positive' END) AS failed_gates FROM g)
"""


_OUT = ["pattern", "train_n", "validation_n", "holdout_n", "train_roi", "validation_roi", "holdout_roi", "leagues",
        "positive_leagues", "validation_seasons_positive", "holdout_seasons_positive", "failed_gates"]


def _gate_df(spark, sf, market):
    bets = A.validation_rows(V.market_rows(spark, sf), market)
    g = A.multi_season_gates(A.profit_histogram(bets, V.PHASES), V.PHASES, MIN_N).withColumn("pattern", A.validation_key_text())
    return A.multi_season_status(g, V.PHASES, MIN_N, None)


def _gates_sorted(sql):
    """Gate names in the order Spark sorts them."""
    return sql + f" SELECT * EXCLUDE (failed_gates), array_to_string(list_sort(string_split(failed_gates, ',')), ',') AS failed_gates FROM gates"


@query("AGG-37", views=("market_rows",), sql=_gates_sorted(_gates("AH")))
def agg_37(spark, sf):
    return _gate_df(spark, sf, "AH").select(*_OUT)


@query("AGG-38", views=("market_rows",), sql=_gates_sorted(_gates("OU")))
def agg_38(spark, sf):
    return _gate_df(spark, sf, "OU").select(*_OUT)


def _full(spark, sf, market, leagues=None):
    bets = A.validation_rows(V.market_rows(spark, sf), market)
    out = A.multi_season_validation(bets, V.PHASES, MIN_N, leagues=leagues)
    return out.select("pattern", "train_n", "validation_n", "holdout_n", "train_roi", "validation_roi", "holdout_roi",
                      "ci_low", "ci_high", "p_validation", "q_validation", "failed_gates", "status")


@query("GAT-03", "WIN-16")
def gat_03(spark, sf):
    return _full(spark, sf, "AH")


@query("GAT-05")
def gat_05(spark, sf):
    return _full(spark, sf, "OU")


@query("GAT-04")
def gat_04(spark, sf):
    return _full(spark, sf, "AH", leagues=[f"NATION_{i}" for i in range(10)])


RULES = {"prior_strength": 200, "minimum_train_n": 300, "minimum_oos_n": 200, "maximum_single_holdout_loss_roi": -0.10,
         "minimum_positive_league_share": 0.50}
DIAG = """SELECT {u}pattern, train_n, validation_n + holdout_n AS oos_n, holdout_n, train_roi, {pool} AS pooled_oos_roi, holdout_roi, {shr} AS shrunk_oos_roi,
  {sh} AS positive_league_share,
  concat_ws(',', CASE WHEN NOT train_n >= 300 THEN 'train_n' END, CASE WHEN NOT validation_n + holdout_n >= 200 THEN 'oos_n' END, CASE WHEN NOT train_roi > 0 THEN 'train_roi_positive' END,
   CASE WHEN NOT vp + hp > 0 THEN 'pooled_oos_roi_positive' END, CASE WHEN NOT (holdout_n = 0 OR holdout_roi >= -1e-1) THEN 'holdout_not_catastrophic' END,
   CASE WHEN NOT coalesce(CAST(positive_leagues AS DOUBLE) / nullif(leagues, 0), 0e0) >= 5e-1 THEN 'positive_league_share' END,
   CASE WHEN NOT vp + hp > 0 THEN 'shrunk_oos_roi_positive' END) AS failed_gates
FROM {src}"""


def _diag_sql(market, universe=None):
    base = _gates(market).replace("gates AS (SELECT", "gates AS (SELECT validation_profit AS vp, holdout_profit AS hp,")
    n = "nullif(validation_n + holdout_n, 0)"
    body = DIAG.format(
        u=f"'{universe}' AS universe, " if universe else "",
        pool=S.r(f"coalesce((vp + hp) / 1e6 / {n}, 0e0)", 8),
        shr=S.r("coalesce((vp + hp) / 1e6 / (CAST(validation_n + holdout_n AS DOUBLE) + 2e2), 0e0)", 8),
        sh=S.r("coalesce(CAST(positive_leagues AS DOUBLE) / nullif(leagues, 0), 0e0)", 8), src="gates",
    )
    return base + f" SELECT *, CASE WHEN failed_gates = '' THEN 'RESEARCH_CANDIDATE' ELSE 'RESEARCH_REJECT' END AS diagnostic_status FROM ({body})"


@query("GAT-06", views=("market_rows",), sql=_diag_sql("AH"))
def gat_06(spark, sf):
    return A.diagnose(_gate_df(spark, sf, "AH"), RULES)


@query("GAT-19", views=("market_rows",),
       sql="SELECT * FROM (" + _diag_sql("AH", "HANDICAP") + ") UNION ALL SELECT * FROM (" + _diag_sql("OU", "TOTAL") + ")")
def gat_19(spark, sf):
    parts = [
        A.diagnose(_gate_df(spark, sf, m), RULES).withColumn("universe", F.lit(u))
        for m, u in (("AH", "HANDICAP"), ("OU", "TOTAL"))
    ]
    return parts[0].unionByName(parts[1])

