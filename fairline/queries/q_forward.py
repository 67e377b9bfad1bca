"""Screening, forward entries, identity joins and registry-like dimension checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import names
from fairline.functions.exact import micro, rnd
from fairline.operators import identity, results
from fairline.plans import forward, screen
from fairline.queries import sqlviews as S
from fairline.queries.q_patterns import THREE, three_way
from fairline.queries.registry import query
from fairline.session import cut
from fairline.sources import views as V

c = F.col

# ---- screen -----------------------------------------------------------------------------------
_CLS = ["full_win", "half_win", "push", "half_loss", "full_loss"]


def _ev(ph):
    a = [f"{ph}_{k}" for k in _CLS]
    return f"(({a[0]} * (t - 1e0) + {a[1]} * ((t - 1e0) / 2e0) + {a[2]} * 0e0 + {a[3]} * -0.5e0 + {a[4]} * -1e0) / CAST({' + '.join(a)} AS DOUBLE))"


def _lo(x, w):
    return f"(floor(({x} * {w}) * 1e4 + 0.5e0) / 1e4)"


def _hi(x, w):
    return f"(floor(({x} * {w} + {w}) * 1e4 + 0.5e0) / 1e4)"


SCREEN = THREE + f""", pt AS (SELECT market || '::' || pattern AS pattern_id, * FROM audit WHERE status <> 'REJECT'),
mk AS (SELECT fixture_id, line_no, part_id, supp_id, qty, open_h, open_d, open_a, ah_home, ah_away, over_price, under_price, home_line, ou_line,
  CASE WHEN open_h < open_a THEN 'H' ELSE 'A' END AS side FROM quotes),
ml AS (SELECT *, CASE WHEN side = 'H' THEN home_line ELSE -home_line END AS fl, CASE WHEN side = 'H' THEN ah_home ELSE ah_away END AS fp, CASE WHEN side = 'H' THEN ah_away ELSE ah_home END AS fo,
  (1e0 / CASE WHEN side = 'H' THEN open_h ELSE open_a END) / (1e0 / open_h + 1e0 / open_d + 1e0 / open_a) AS pf FROM mk),
j0 AS (SELECT ml.*, pt.* EXCLUDE (favorite_side), CASE WHEN market = 'AH' THEN fp WHEN ou_side = 'O' THEN over_price ELSE under_price END AS t,
  CASE WHEN market = 'AH' THEN fo WHEN ou_side = 'O' THEN under_price ELSE over_price END AS oo FROM ml JOIN pt ON ml.side = pt.favorite_side AND CAST(round(fl * 4) AS INTEGER) = pt.ah_q),
j1 AS (SELECT *, least({_ev('train')}, {_ev('validation')}, {_ev('holdout')}) AS min_phase_ev FROM j0),
scr AS (SELECT *, CASE WHEN ah_band IS NOT NULL AND NOT (fp >= {_lo('ah_band', '1e-1')} AND fp < {_hi('ah_band', '1e-1')}) THEN 'AH_PRICE_STRUCTURE_MISMATCH'
  WHEN ou_q IS NOT NULL AND CAST(round(ou_line * 4) AS INTEGER) <> ou_q THEN 'OU_LINE_MISMATCH'
  WHEN ou_q IS NOT NULL AND ou_band IS NOT NULL AND NOT (CASE WHEN ou_side = 'O' THEN over_price ELSE under_price END >= {_lo('ou_band', '1e-1')} AND CASE WHEN ou_side = 'O' THEN over_price ELSE under_price END < {_hi('ou_band', '1e-1')}) THEN 'OU_PRICE_STRUCTURE_MISMATCH'
  WHEN p_band IS NOT NULL AND NOT (pf >= {_lo('p_band', '5e-2')} AND pf < {_hi('p_band', '5e-2')}) THEN '1X2_STRUCTURE_MISMATCH'
  WHEN t NOT BETWEEN 1.8e0 AND 2.2e0 THEN 'PRICE_OUT_OF_RANGE' WHEN min_phase_ev < 1e-2 THEN 'EDGE_ERODED' END AS reason FROM j1)
"""


def screen_patterns(spark, sf):
    """The pattern table is derived once and written, then read by both branches of the screen."""
    return cut(screen.screen_table(three_way(spark, sf).filter(c("status") != "REJECT")))


@query("JON-04", "SET-08", "FLT-20", views=("market_rows",), sql=SCREEN + " SELECT pattern_id, coalesce(reason, 'ELIGIBLE') AS reason, COUNT(*) AS n FROM scr GROUP BY ALL")
def jon_04(spark, sf):
    return screen.screen_counts(V.quotes(spark, sf), screen_patterns(spark, sf))


@query("TOP-01", views=("market_rows",), sql=SCREEN + f""" SELECT fixture_id, line_no, part_id, supp_id, qty, pattern_id, {S.r('min_phase_ev', 6)} AS min_phase_ev FROM scr WHERE reason IS NULL
  ORDER BY scr.min_phase_ev DESC, holdout_n DESC, q_validation_bh, fixture_id, line_no, part_id, supp_id, qty, pattern_id LIMIT 5""")
def top_01(spark, sf):
    ids = ["fixture_id", "line_no", "part_id", "supp_id", "qty", "k_pattern_id"]
    t = screen.top(screen.candidates(V.quotes(spark, sf), screen_patterns(spark, sf)), ids)
    return t.select(*ids[:-1], c("k_pattern_id").alias("pattern_id"), rnd(c("min_phase_ev"), 6).alias("min_phase_ev"))


@query("FLT-19", views=("fixtures",), sql="SELECT fixture_id, match_day BETWEEN DATE '1998-03-01' AND DATE '1998-03-08' AS in_window FROM fixtures")
def flt_19(spark, sf):
    return V.fixtures(spark, sf).select("fixture_id", screen.in_window(c("match_day"), F.lit("1998-03-01").cast("date")).alias("in_window"))


# ---- candidates and entries -------------------------------------------------------------------
CATALOG = """catalog(pattern_id, market, favorite_side, ah_q, ou_side, ou_q, price_lo, price_hi, prob_lo, prob_hi, universe) AS (
  SELECT 'C' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'OU' ELSE 'AH' END, CASE WHEN n_nationkey % 2 = 0 THEN 'H' ELSE 'A' END, n_nationkey % 9 - 4, 'U', 8 + n_nationkey % 5,
  1.5e0 + (n_nationkey % 4) / 10e0, 2e0 + (n_nationkey % 4) / 10e0, 2e-1, 6e-1, n_regionkey FROM nation)"""


def catalog(spark, sf):
    k = c("n_nationkey")
    return V.table(spark, sf, "nation").select(
        F.concat(F.lit("C"), k).alias("pattern_id"), F.when(k % 3 == 0, "OU").otherwise("AH").alias("market"), F.when(k % 2 == 0, "H").otherwise("A").alias("favorite_side"),
        (k % 9 - 4).alias("ah_q"), F.lit("U").alias("ou_side"), (k % 5 + 8).alias("ou_q"), (F.lit(1.5) + (k % 4) / F.lit(10.0)).alias("price_lo"),
        (F.lit(2.0) + (k % 4) / F.lit(10.0)).alias("price_hi"), F.lit(0.2).alias("prob_lo"), F.lit(0.6).alias("prob_hi"), c("n_regionkey").alias("universe"))


def _match(universe):
    extra = " AND s.fixture_id % 5 = k.universe" if universe else ""
    return f"""{CATALOG},
m AS (SELECT s.*, k.pattern_id, k.market FROM snapshots s JOIN catalog k ON s.favorite_side = k.favorite_side AND CAST(round(line * 4) AS INTEGER) = k.ah_q AND fair_probability >= prob_lo AND fair_probability < prob_hi{extra}
  AND CASE WHEN market = 'AH' THEN price ELSE under_price END >= price_lo AND CASE WHEN market = 'AH' THEN price ELSE under_price END < price_hi AND (market = 'AH' OR CAST(round(s.ou_line * 4) AS INTEGER) = k.ou_q))"""


@query("JON-06", views=("snapshots",), sql=f"WITH {_match(False)} SELECT event_id, pattern_id FROM m")
def jon_06(spark, sf):
    return forward.match_candidates(V.snapshots(spark, sf), catalog(spark, sf)).select("event_id", "pattern_id")


@query("JON-05", views=("snapshots",), sql=f"WITH {_match(True)} SELECT event_id, pattern_id FROM m")
def jon_05(spark, sf):
    s = V.snapshots(spark, sf).withColumn("universe", (c("fixture_id") % 5).cast("int"))
    return forward.match_candidates(s, catalog(spark, sf), universe=True).select("event_id", "pattern_id")


START = 1_704_500_000_000_000
ENTRIES = f"""{_match(False)},
a AS (SELECT pattern_id AS candidate_id, fixture_id, kickoff_us, observed_us AS entry_us, event_id, league, market, CASE WHEN market = 'AH' THEN favorite_side ELSE 'U' END AS selection,
  CASE WHEN market = 'AH' THEN line ELSE ou_line END AS entry_line, CASE WHEN market = 'AH' THEN price ELSE under_price END AS entry_price,
  row_number() OVER (PARTITION BY pattern_id, fixture_id ORDER BY observed_us, event_id) AS rn FROM m WHERE observed_us >= {START} AND observed_us < kickoff_us AND mainline_verified),
entries AS (SELECT * EXCLUDE (rn) FROM a WHERE rn = 1)"""


def entries(spark, sf):
    none = spark.createDataFrame([], "candidate_id string, fixture_id long, kickoff_us long, entry_us long, event_id long, league string, market string, selection string, entry_line double, entry_price double")
    return forward.forward_entries(V.snapshots(spark, sf), catalog(spark, sf), none, START)


@query("JON-07", "STM-09", views=("snapshots",), sql=f"WITH {ENTRIES} SELECT * FROM entries")
def jon_07(spark, sf):
    return entries(spark, sf)


_ESG = "(CASE WHEN market = 'AH' THEN " + S.ah_signs("h", "a", "entry_line", "selection") + " ELSE -" + S.over_signs("h", "a", "entry_line") + " END)"
SETTLED = f"""{ENTRIES}, ix AS (SELECT fixture_id, MIN(ft_home_goals) AS h, MIN(ft_away_goals) AS a, COUNT(*) AS records, COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) > 1 AS amb FROM snapshot_results GROUP BY fixture_id),
sx AS (SELECT e.*, CASE WHEN records IS NULL THEN 'MISSING_RESULT' WHEN amb THEN 'AMBIGUOUS_RESULT' END AS reason, CASE WHEN NOT amb THEN {_ESG} END AS sg FROM entries e LEFT JOIN ix USING (fixture_id)),
st AS (SELECT *, CASE WHEN reason IS NULL THEN {S.klass('sg')} END AS settlement, CASE WHEN reason IS NULL THEN {S.profit('sg', 'entry_price')} END AS profit_units FROM sx)"""
SV = ("snapshots", "snapshot_results")


def settled(spark, sf):
    return forward.settle(entries(spark, sf), results.result_index(V.snapshot_results(spark, sf)))


@query("JON-20", views=SV, sql=f"WITH {SETTLED} SELECT candidate_id, fixture_id, reason, settlement, profit_units FROM st")
def jon_20(spark, sf):
    return settled(spark, sf).select("candidate_id", "fixture_id", "reason", "settlement", "profit_units")


METRICS = f"""{SETTLED}, ok AS (SELECT *, {S.micro('profit_units')} AS m FROM st WHERE reason IS NULL),
lg AS (SELECT candidate_id, league, COUNT(*) AS n, SUM(m) AS p FROM ok GROUP BY ALL),
g AS (SELECT candidate_id, CAST(SUM(n) AS BIGINT) AS settled_entries, SUM(p) AS p, COUNT(*) AS distinct_leagues, COUNT(*) FILTER (WHERE p > 0) AS positive_leagues, MAX(abs(p)) AS big, SUM(abs(p)) AS tot FROM lg GROUP BY candidate_id),
sq AS (SELECT *, SUM(m) OVER w AS cum, row_number() OVER (PARTITION BY candidate_id ORDER BY kickoff_us, fixture_id) AS rn FROM ok WINDOW w AS (PARTITION BY candidate_id ORDER BY kickoff_us, fixture_id ROWS UNBOUNDED PRECEDING)),
sd AS (SELECT candidate_id, greatest(0, MAX(cum) OVER (PARTITION BY candidate_id ORDER BY rn ROWS UNBOUNDED PRECEDING)) - cum AS dd, rn - coalesce(MAX(CASE WHEN m >= 0 THEN rn END) OVER (PARTITION BY candidate_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS run FROM sq),
sm AS (SELECT candidate_id, MAX(dd) AS dd, MAX(run) AS longest_losing_streak FROM sd GROUP BY candidate_id),
metrics AS (SELECT candidate_id, settled_entries, p / 1e6 AS total_profit_units, p / 1e6 / settled_entries AS roi, distinct_leagues, positive_leagues, CAST(positive_leagues AS DOUBLE) / CAST(distinct_leagues AS DOUBLE) AS positive_league_share,
  CAST(big AS DOUBLE) / nullif(CAST(tot AS DOUBLE), 0) AS max_single_league_share, -(dd / 1e6) + 0e0 AS max_drawdown_units, longest_losing_streak FROM g JOIN sm USING (candidate_id))"""


@query("AGG-14", views=SV, sql=f"WITH {METRICS} SELECT * FROM metrics")
def agg_14(spark, sf):
    return forward.candidate_metrics(settled(spark, sf))


@query("GAT-08", views=SV, sql=f"""WITH {METRICS},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY observed_us DESC, event_id DESC) AS rn FROM snapshots WHERE mainline_verified AND observed_us < kickoff_us) WHERE rn = 1),
jv AS (SELECT e.*, l.observed_us AS t2, CASE WHEN market = 'OU' THEN l.ou_line WHEN selection = 'H' THEN l.home_line ELSE l.away_line END AS l2, CASE WHEN market = 'OU' THEN l.under_price WHEN selection = 'H' THEN l.home_price ELSE l.away_price END AS p2
  FROM entries e LEFT JOIN l ON e.fixture_id = l.fixture_id AND l.observed_us >= e.entry_us),
cv AS (SELECT candidate_id, CASE WHEN abs(l2 - entry_line) <= 1e-9 THEN entry_price / p2 - 1e0 END AS clv FROM jv),
cs AS (SELECT candidate_id, COUNT(*) AS entries, CAST(COUNT(clv) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS share, {S.avg_micro('clv')} AS mean_clv, median(clv) AS median_clv FROM cv GROUP BY candidate_id),
bt AS (SELECT candidate_id, avg(m / 1e6) - 1.959964e0 * stddev_pop(m / 1e6) / sqrt(COUNT(*)) AS low FROM ok GROUP BY candidate_id),
x AS (SELECT m.*, cs.entries, share, mean_clv, median_clv, concat_ws(',', CASE WHEN NOT distinct_leagues >= 3 THEN 'minimum_distinct_leagues' END, CASE WHEN NOT positive_league_share >= 6e-1 THEN 'minimum_positive_league_share' END,
  CASE WHEN NOT roi > 0 THEN 'positive_flat_stake_roi' END, CASE WHEN NOT coalesce(mean_clv > 0, false) THEN 'positive_mean_comparable_clv' END, CASE WHEN NOT coalesce(median_clv > 0, false) THEN 'positive_median_comparable_clv' END,
  CASE WHEN NOT coalesce(low > 0, false) THEN 'bootstrap_roi_ci95_lower_above_zero' END, CASE WHEN NOT coalesce(max_single_league_share <= 6e-1, false) THEN 'maximum_single_league_profit_concentration' END,
  CASE WHEN NOT coalesce(share >= 7e-1, false) THEN 'minimum_comparable_clv_share' END) AS failed FROM metrics m LEFT JOIN cs USING (candidate_id) LEFT JOIN bt USING (candidate_id))
SELECT candidate_id, CASE WHEN settled_entries < 150 THEN 'COLLECTING_FORWARD_EVIDENCE' WHEN failed = '' THEN 'FORWARD_PAPER_CONFIRMED' ELSE 'FORWARD_NOT_CONFIRMED' END AS status, settled_entries, greatest(0, 150 - settled_entries) AS remaining,
  CASE WHEN settled_entries >= 150 THEN failed ELSE '' END AS failed_gates FROM x""")
def gat_08(spark, sf):
    """Readiness with the lower bound of a bootstrap interval; SQL has the bound of the normal approximation, equal in sign."""
    from fairline.operators.resampling import bootstrap_interval, histogram

    e, s, done = entries(spark, sf), V.snapshots(spark, sf), settled(spark, sf)
    clv = forward.clv_summary(forward.closing_line_value(e, s)).drop("no_snapshot", "line_changed")
    hist = histogram(done.filter(c("reason").isNull()), ["candidate_id"], micro(c("profit_units")))
    low = bootstrap_interval(hist, ["candidate_id"], c("candidate_id"), 10_000).select("candidate_id", "ci_low")
    return forward.readiness(forward.candidate_metrics(done).join(low, "candidate_id", "left"), clv, bootstrap_low=c("ci_low"))


@query("STO-07", "GAT-10", views=("snapshots",), sql=f"""WITH {ENTRIES}, r AS (SELECT DISTINCT candidate_id AS id FROM entries) SELECT id, 'MISSING_IN_LEDGER' AS drift FROM (SELECT pattern_id AS id FROM catalog) ANTI JOIN r USING (id)
  UNION ALL SELECT id, 'NOT_REGISTERED' FROM r WHERE id NOT IN (SELECT pattern_id FROM catalog)""")
def sto_07(spark, sf):
    """Registered ids and ledger ids must be equal sets; each difference is one row."""
    cat = catalog(spark, sf).select(c("pattern_id").alias("id"))
    led = entries(spark, sf).select(c("candidate_id").alias("id")).distinct()
    return cat.join(led, "id", "left_anti").withColumn("drift", F.lit("MISSING_IN_LEDGER")).unionByName(
        led.join(cat, "id", "left_anti").withColumn("drift", F.lit("NOT_REGISTERED")))


# ---- identity joins ---------------------------------------------------------------------------
_KO = "(1704067200000000 + (10 + user_id % 20) * 86400000000 + 64800000000)"
FEED = f"""feed AS (SELECT DISTINCT event_type || ':' || user_id AS source_id, event_type AS provider, 'Town' || (user_id // 2) AS home, 'Unit' || (user_id // 2) AS away, 'L' || (user_id % 4) AS league, {_KO} AS kickoff_us FROM events)"""


def feed(spark, sf):
    """Provider fixtures: each match appears under several provider ids."""
    u = c("user_id")
    half = V.div(u, 2).cast("string")
    return V.table(spark, sf, "events").select(
        F.concat_ws(":", "event_type", u.cast("string")).alias("source_id"), c("event_type").alias("provider"), F.concat(F.lit("Town"), half).alias("home"), F.concat(F.lit("Unit"), half).alias("away"),
        F.concat(F.lit("L"), (u % 4).cast("string")).alias("league"),
        (F.lit(1_704_067_200_000_000) + (F.lit(10) + u % 20) * F.lit(V.DAY_US) + F.lit(18 * V.HOUR_US)).alias("kickoff_us"))


_BRIDGE = f"""WITH {FEED}, g AS (SELECT home, away, league, kickoff_us, COUNT(*) AS m, COUNT(*) FILTER (WHERE provider = 'view') AS n1, COUNT(*) FILTER (WHERE provider = 'click') AS n2, MIN(CASE WHEN provider = 'view' THEN source_id END) AS canon
  FROM feed WHERE provider IN ('view', 'click') GROUP BY ALL),
br AS (SELECT source_id, CASE WHEN n1 = 1 AND n2 = 1 AND m = 2 THEN canon END AS canonical_id, CASE WHEN n1 = 1 AND n2 = 1 AND m = 2 THEN NULL WHEN m >= 2 THEN 'AMBIGUOUS_PROVIDER_IDENTITY' ELSE 'NO_COUNTERPART' END AS reason FROM feed LEFT JOIN g USING (home, away, league, kickoff_us))"""


@query("JON-44", sql=_BRIDGE + " SELECT * FROM br")
def jon_44(spark, sf):
    return identity.identity_bridge(feed(spark, sf), ("view", "click"))


@query("NRM-41", sql=_BRIDGE + " SELECT feed.source_id, provider, coalesce(canonical_id, feed.source_id) AS fixture_key FROM feed JOIN br USING (source_id)")
def nrm_41(spark, sf):
    f = feed(spark, sf)
    return identity.project(f.distinct(), identity.identity_bridge(f, ("view", "click"))).select("source_id", "provider", "fixture_key")


@query("JON-11", "JON-12", "JON-16", sql=f"""WITH {FEED}, l AS (SELECT source_id, home, away, kickoff_us FROM feed WHERE provider = 'view'), r AS (SELECT DISTINCT source_id AS other_id, home, away, kickoff_us + CASE WHEN source_id LIKE '%1' THEN 0 ELSE 1 END AS kickoff_us FROM feed WHERE provider IN ('signup', 'error')),
x AS (SELECT l.source_id, COUNT(DISTINCT other_id) AS n, MIN(other_id) AS one FROM l LEFT JOIN r USING (home, away, kickoff_us) GROUP BY l.source_id)
SELECT source_id, CASE WHEN n = 1 THEN one END AS other_id, n AS matches, CASE WHEN n = 0 THEN 'UNMATCHED' WHEN n > 1 THEN 'AMBIGUOUS' END AS reason FROM x""")
def jon_11(spark, sf):
    """Exact (folded names, kickoff) join to a second source with a unique-match gate."""
    off = F.when(c("provider").isin("signup", "error") & ~c("source_id").endswith("1"), 1).otherwise(0)  # most rows of the other source differ
    f = feed(spark, sf).distinct().withColumn("kickoff_us", c("kickoff_us") + off).withColumn("key", names.match_key(names.fold_accents(c("home")), names.fold_accents(c("away")), c("kickoff_us").cast("string")))
    left = f.filter(c("provider") == "view")
    right = f.filter(c("provider").isin("signup", "error")).withColumnRenamed("source_id", "other_id")
    return identity.unique_match(left, right, ["key"], "source_id", "other_id")


@query("JON-14", sql=f"""WITH {FEED}, l AS (SELECT source_id, kickoff_us, lower(home) AS h FROM feed WHERE provider = 'view'), r AS (SELECT DISTINCT source_id AS other_id, kickoff_us + CASE WHEN source_id LIKE '%2' OR source_id LIKE '%7' THEN 0 ELSE 1 END AS kickoff_us, lower(home) AS h FROM feed WHERE provider = 'click'),
x AS (SELECT l.source_id, COUNT(DISTINCT other_id) AS n, MIN(other_id) AS one FROM l LEFT JOIN r USING (kickoff_us, h) GROUP BY l.source_id)
SELECT source_id, CASE WHEN n = 1 THEN one END AS other_id, n AS matches, CASE WHEN n = 0 THEN 'UNMATCHED' WHEN n > 1 THEN 'AMBIGUOUS' END AS reason FROM x""")
def jon_14(spark, sf):
    """Equal kickoff and overlapping alias sets of both teams; one side carries decorated names."""
    f = feed(spark, sf).distinct()
    left = f.filter(c("provider") == "view").withColumn("lh", names.alias_set(c("home"))).withColumn("la", names.alias_set(c("away")))
    same = c("source_id").endswith("2") | c("source_id").endswith("7")
    right = f.filter(c("provider") == "click").withColumn("kickoff_us", c("kickoff_us") + F.when(same, 0).otherwise(1))
    right = right.withColumn("rh", names.alias_set(F.concat(c("home"), F.lit(" FC")))).withColumn("ra", names.alias_set(F.concat(F.lit("Club "), c("away"))))
    return identity.alias_overlap(left, right.withColumnRenamed("source_id", "other_id"), ["kickoff_us"], "source_id", "other_id", [("lh", "rh"), ("la", "ra")])


_ID4 = "home, away, match_day"


@query("JON-15", views=("fixtures", "results"), sql=f"""WITH k AS (SELECT fixture_id, MIN(ft_home_goals) AS h, MIN(ft_away_goals) AS a FROM results GROUP BY fixture_id HAVING COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) = 1),
b AS (SELECT fixture_id FROM results GROUP BY fixture_id HAVING COUNT(DISTINCT ft_home_goals * 100 + ft_away_goals) > 1),
o AS (SELECT {_ID4}, MIN(h) AS h, MIN(a) AS a, MIN(fixture_id) AS reused_from FROM fixtures JOIN k USING (fixture_id) GROUP BY {_ID4} HAVING COUNT(DISTINCT h * 100 + a) = 1)
SELECT f.fixture_id, o.h AS ft_home_goals, o.a AS ft_away_goals, reused_from FROM fixtures f JOIN o USING ({_ID4}) WHERE f.fixture_id NOT IN (SELECT fixture_id FROM k) AND f.fixture_id NOT IN (SELECT fixture_id FROM b)""")
def jon_15(spark, sf):
    ix = results.result_index(V.results(spark, sf))
    return identity.reuse_results(V.fixtures(spark, sf), ix.filter(~c("ambiguous")), ["home", "away", "match_day"], ix.filter("ambiguous"))


@query("JON-17", "STM-14", "SRC-10", "STO-04", views=("fixtures", "results"), sql="""SELECT fixture_id, kickoff_us, priority = '1' AS prioritised FROM fixtures WHERE fixture_id NOT IN (SELECT fixture_id FROM results) AND 946684800000000 - kickoff_us >= 10800000000""")
def jon_17(spark, sf):
    """Fixtures matured by the clock 2000-01-01 without a result, priority flagged."""
    f = V.fixtures(spark, sf).join(V.results(spark, sf).select("fixture_id").distinct(), "fixture_id", "left_anti")
    return f.filter(results.maturity_reason(c("kickoff_us"), F.lit(946_684_800_000_000)).isNull()).select("fixture_id", "kickoff_us", (c("priority") == "1").alias("prioritised"))


@query("JON-18", views=SV, sql=f"WITH {ENTRIES} SELECT DISTINCT fixture_id FROM entries WHERE fixture_id NOT IN (SELECT fixture_id FROM snapshot_results) AND kickoff_us + 10800000000 <= 1706400000000000")
def jon_18(spark, sf):
    e = entries(spark, sf).filter(results.maturity_reason(c("kickoff_us"), F.lit(1_706_400_000_000_000)).isNull())
    return e.select("fixture_id").distinct().join(V.snapshot_results(spark, sf).select("fixture_id").distinct(), "fixture_id", "left_anti")


@query("JON-22", views=("snapshots",), sql="""WITH a AS (SELECT fixture_id, observed_us // 60000000 AS minute, COUNT(*) AS audits, MAX(k) AS top FROM snapshots WHERE provider = 'signup' GROUP BY ALL)
SELECT s.event_id, coalesce(audits, 0) AS audits, coalesce(top, -1) AS top FROM snapshots s LEFT JOIN a ON s.fixture_id = a.fixture_id AND s.observed_us // 60000000 = a.minute""")
def jon_22(spark, sf):
    """Left join of an audit row on two keys."""
    s = V.snapshots(spark, sf).withColumn("minute", V.div(c("observed_us"), 60_000_000))
    a = s.filter(c("provider") == "signup").groupBy("fixture_id", "minute").agg(F.count("*").alias("audits"), F.max("k").alias("top"))
    return s.select("event_id", "fixture_id", "minute").join(a, ["fixture_id", "minute"], "left").select("event_id", F.coalesce("audits", F.lit(0)).cast("long").alias("audits"), F.coalesce("top", F.lit(-1)).alias("top"))


@query("JON-23", sql="""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), o AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view')
SELECT p.event_id, MIN(abs(p.t - o.t)) / 6e7 AS nearest_minutes FROM p LEFT JOIN o USING (user_id) GROUP BY p.event_id""")
def jon_23(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).alias("t"))
    return identity.nearest_offset(e.filter(c("event_type") == "error"), e.filter(c("event_type") == "view"), ["user_id"], "t", "event_id")


@query("NRM-39", "SRC-19", sql="""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 AND c_nationkey < 20 AND c_custkey % 3 = 0 THEN NULL WHEN c_nationkey < 20 THEN 'COMP-' || c_nationkey END AS canonical_id,
  CASE WHEN c_nationkey % 5 = 0 AND c_nationkey < 20 AND c_custkey % 3 = 0 THEN 'CANONICAL_ID_CONFLICT' WHEN c_nationkey >= 20 THEN 'UNMAPPED' END AS reason FROM customer""")
def nrm_39(spark, sf):
    """Canonical competition by provider id from verified mappings; disagreement with an id on the row is a conflict."""
    n = c("n_nationkey")
    mapping = V.table(spark, sf, "nation").filter(n < 20).select(n.alias("provider_competition_id"), F.concat(F.lit("COMP-"), n).alias("internal_id"))
    have = F.when((c("c_nationkey") % 5 == 0) & (c("c_nationkey") < 20) & (c("c_custkey") % 3 == 0), "COMP-x")
    rows = V.table(spark, sf, "customer").select("c_custkey", c("c_nationkey").alias("provider_competition_id"), have.alias("known_id"))
    return identity.map_to_canonical(rows, mapping, ["provider_competition_id"], "internal_id", "known_id").select("c_custkey", "canonical_id", "reason")


@query("NRM-40", sql=f"""WITH {FEED}, n AS (SELECT league, kickoff_us, MIN(home) AS home, COUNT(DISTINCT home) AS m FROM feed WHERE provider = 'view' GROUP BY ALL)
SELECT DISTINCT f.source_id, CASE WHEN m = 1 THEN n.home END AS filled_home FROM feed f LEFT JOIN n USING (league, kickoff_us) WHERE provider = 'click'""")
def nrm_40(spark, sf):
    """Names filled only where the other table offers exactly one."""
    f = feed(spark, sf)
    n = f.filter(c("provider") == "view").groupBy("league", "kickoff_us").agg(F.min("home").alias("h"), F.max("home").alias("h2"))
    one = n.filter(c("h") == c("h2")).select("league", "kickoff_us", c("h").alias("filled_home"))
    return f.filter(c("provider") == "click").select("source_id", "league", "kickoff_us").distinct().join(one, ["league", "kickoff_us"], "left").select("source_id", "filled_home")
