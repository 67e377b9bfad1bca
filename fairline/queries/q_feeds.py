"""Feed normalisers over documents that Spark builds from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import filters
from fairline.queries import sqlviews as S
from fairline.queries.registry import query
from fairline.session import cut
from fairline.sources import feeds
from fairline.sources import views as V

c = F.col
KO = "strftime(make_timestamp(kickoff_us), '%Y-%m-%d')"


def iso(us):
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def json(struct):
    return F.to_json(struct, {"ignoreNullFields": "false"})


def snaps(spark, sf):
    return V.snapshots(spark, sf)


SEC = "(observed_us // 1000000 * 1000000)"


# ---- NRM-12: event documents ------------------------------------------------------------------
@query("NRM-12", "NRM-11", "MAP-01", "NRM-15", views=("snapshots",), sql=f"""WITH ah AS (SELECT event_id, home_line, home_price AS h, away_price AS a FROM snapshots UNION ALL SELECT event_id, home_line + 0.25e0, home_price + 1e0, away_price FROM snapshots),
ou AS (SELECT event_id, ou_line, over_price AS o, under_price AS u FROM snapshots WHERE k % 2 = 0)
SELECT s.event_id, 'scheduled' AS status, 2.5e0 AS open_h, 3.25e0 AS open_d, s.home_price AS open_a, ah.home_line, ah.h AS ah_home, ah.a AS ah_away, ou.ou_line, ou.o AS over_price, ou.u AS under_price,
  CASE WHEN k % 3 <> 0 THEN {SEC} - 3600000000 END AS as_of_us FROM snapshots s JOIN ah USING (event_id) JOIN ou USING (event_id)""")
def nrm_12(spark, sf):
    """Two handicap lines (a third is off the grid) x one valid total per event; total price 0.9 is unusable."""
    st = iso(c("observed_us"))
    n = F.lit(None).cast("double")
    odds = lambda **kw: F.struct(*[kw.get(f, n).alias(f) for f in ("hdp", "max", "home", "draw", "away", "over", "under")])
    market = lambda name, at, *o: F.struct(F.lit(name).alias("name"), at.alias("updatedAt"), F.array(*o).alias("odds"))
    doc = F.struct(
        c("event_id").cast("string").alias("id"), "home", "away", iso(c("kickoff_us")).alias("date"), F.lit("Pending").alias("status"),
        F.create_map(F.lit("BookOne"), F.array(
            market("ML", st, odds(home=F.lit(2.5), draw=F.lit(3.25), away=c("home_price"))),
            market("Spread", F.when(c("k") % 3 != 0, iso(c("observed_us") - 3_600_000_000)),
                   odds(hdp=c("home_line"), home=c("home_price"), away=c("away_price")), odds(hdp=c("home_line") + 0.25, home=c("home_price") + 1.0, away=c("away_price")),
                   odds(hdp=c("home_line") + 0.1, home=c("home_price"), away=c("away_price"))),
            market("Over/Under", st, odds(max=c("ou_line"), over=F.when(c("k") % 2 == 0, c("over_price")).otherwise(0.9), under=c("under_price"))),
        )).alias("bookmakers"))
    return feeds.event_combinations(snaps(spark, sf).select("event_id", json(doc).alias("doc")), "doc", "event_id", "bookone")


# ---- NRM-13..19: market map with catalog ------------------------------------------------------
def catalog(spark, sf):
    """Market catalog derived from the lines present in the data, with out-of-scope rows that must be filtered."""
    s = cut(snaps(spark, sf).select("home_line", "ou_line").distinct())  # the lines of the data, found in one scan
    side = lambda names, ids: F.array(*[F.struct(F.lit(i).alias("outcome_id"), F.lit(n).alias("outcome_name")) for n, i in zip(names, ids)])
    ah = s.select((c("home_line") * 4).cast("int").alias("q")).distinct().select(F.concat(F.lit("A"), c("q") + 4).alias("market_id"), F.lit("AH").alias("kind"), (c("q") / 4.0).alias("handicap"), side(["Home", "Away"], ["1", "2"]).alias("o"))
    ou = s.select((c("ou_line") * 4).cast("int").alias("q")).distinct().select(F.concat(F.lit("T"), c("q")).alias("market_id"), F.lit("OU").alias("kind"), (c("q") / 4.0).alias("handicap"), side(["Over", "Under"], ["1", "2"]).alias("o"))
    x = s.select(F.lit("X").alias("market_id"), F.lit("1X2").alias("kind"), F.lit(None).cast("double").alias("handicap"), side(["1", "X", "2"], ["1", "2", "3"]).alias("o")).distinct()
    good = ah.unionByName(ou).unionByName(x).withColumn("sport_id", F.lit(10)).withColumn("period", F.lit("FullTime")).withColumn("player_prop", F.lit(False))
    bad = ah.withColumn("sport_id", F.lit(11)).withColumn("period", F.lit("FullTime")).withColumn("player_prop", F.lit(False)).unionByName(
        ah.withColumn("sport_id", F.lit(10)).withColumn("period", F.lit("firsthalf")).withColumn("player_prop", F.lit(False)))
    return good.unionByName(bad).withColumn("o", F.explode("o")).select("*", "o.*").drop("o")


def market_docs(spark, sf, blank=None):
    """k % 5 = 0: handicap inactive; k % 7 = 0: two main totals; k % 11 = 0: bookmaker suspended; k % 13 = 0: in play; blank: no markets."""
    k = c("k")
    player = lambda p, main, active=F.lit(True): F.struct(F.create_map(F.lit("0"), F.struct(p.alias("price"), active.alias("active"), main.alias("mainLine"), c("_changed").alias("changedAt"), F.lit(None).cast("string").alias("bookmakerChangedAt"))).alias("players"))
    pair = lambda a, b, main, active=F.lit(True): F.struct(F.lit(True).alias("marketActive"), F.create_map(F.lit("1"), player(a, main, active), F.lit("2"), player(b, main, active)).alias("outcomes"))
    yes, no = F.lit(True), F.lit(False)
    three = F.struct(yes.alias("marketActive"), F.create_map(F.lit("1"), player(c("home_price") + 0.5, no), F.lit("2"), player(F.lit(3.25), no), F.lit("3"), player(c("away_price") + 0.5, no)).alias("outcomes"))
    ah_id = F.concat(F.lit("A"), (c("home_line") * 4).cast("int") + 4)
    ou_id = F.concat(F.lit("T"), (c("ou_line") * 4).cast("int"))
    other = F.concat(F.lit("T"), F.when(c("ou_line") * 4 == 12, 8).otherwise((c("ou_line") * 4).cast("int") + 1))
    markets = F.map_concat(
        F.create_map(F.lit("X"), three), F.create_map(ah_id, pair(c("home_price"), c("away_price"), yes, k % 5 != 0)), F.create_map(ou_id, pair(c("over_price"), c("under_price"), yes)),
        F.create_map(other, pair(c("over_price") + 0.25, c("under_price"), k % 7 == 0)))
    if blank is not None:
        markets = F.map_filter(markets, lambda i, m: ~blank)
    doc = F.struct(
        c("event_id").cast("string").alias("fixtureId"), F.when(k % 13 == 0, 1).otherwise(0).alias("statusId"), yes.alias("hasOdds"), iso(c("kickoff_us")).alias("startTime"), c("home").alias("participant1Name"),
        F.create_map(F.lit("bk"), F.struct(yes.alias("bookmakerIsActive"), (k % 11 == 0).alias("suspended"), markets.alias("markets"))).alias("bookmakerOdds"))
    stamped = snaps(spark, sf).withColumn("_changed", F.when(k % 4 != 0, iso(c("observed_us"))))
    return stamped.select("event_id", "observed_us", json(doc).alias("doc"))


def _markets(spark, sf, docs=None):
    cat = feeds.full_time_catalog(catalog(spark, sf), 10)
    return feeds.two_sided(feeds.selections(market_docs(spark, sf) if docs is None else docs, "doc", "event_id", "bk", cat), "event_id")


_OTHER = "CASE WHEN ou_line * 4 = 12 THEN 2e0 ELSE ou_line + 0.25e0 END"


@query("NRM-16", "NRM-14", views=("snapshots",), sql=f"""SELECT event_id, CAST(1 AS BIGINT) AS one_x_two_count, CAST(CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS ah_main_count, CAST(CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS ou_main_count,
  CASE WHEN k % 5 <> 0 THEN CAST(home_line AS VARCHAR) ELSE '' END AS ah_lines, CASE WHEN k % 7 = 0 THEN CAST(least(ou_line, {_OTHER}) AS VARCHAR) || ',' || CAST(greatest(ou_line, {_OTHER}) AS VARCHAR) ELSE CAST(ou_line AS VARCHAR) END AS ou_lines
  FROM snapshots WHERE k % 11 <> 0""")
def nrm_16(spark, sf):
    return feeds.mainline_shape(_markets(spark, sf), "event_id")


_X = "(1e0 / (home_price + 0.5e0) + 1e0 / 3.25e0 + 1e0 / (away_price + 0.5e0))"
_OKR = "k % 13 <> 0 AND kickoff_us > observed_us AND k % 11 <> 0 AND k % 17 <> 0 AND k % 5 <> 0 AND k % 7 <> 0"


@query("NRM-17", "NRM-42", "ARR-01", views=("snapshots",), sql=f"""WITH f AS (SELECT *, (1e0 / (home_price + 0.5e0)) / {_X} AS fh, (1e0 / (away_price + 0.5e0)) / {_X} AS fa FROM snapshots), g AS (SELECT *, CASE WHEN fh >= fa THEN 'H' ELSE 'A' END AS sd FROM f)
SELECT event_id, CASE WHEN k % 13 = 0 THEN 'NOT_PREMATCH_WITH_ODDS' WHEN kickoff_us <= observed_us THEN 'KICKOFF_NOT_FUTURE' WHEN k % 11 = 0 THEN 'BOOKMAKER_NOT_ACTIVE' WHEN k % 17 = 0 THEN 'AMBIGUOUS_OR_MISSING_1X2' WHEN k % 5 = 0 THEN 'AMBIGUOUS_OR_MISSING_MAIN_AH' WHEN k % 7 = 0 THEN 'AMBIGUOUS_OR_MISSING_MAIN_OU' END AS reason,
  CASE WHEN {_OKR} THEN sd END AS favorite_side, CASE WHEN {_OKR} THEN CASE WHEN sd = 'H' THEN fh ELSE fa END END AS favorite_fair_probability, CASE WHEN {_OKR} THEN CASE WHEN sd = 'H' THEN home_line ELSE -home_line END END AS line,
  CASE WHEN {_OKR} THEN CASE WHEN sd = 'H' THEN home_price ELSE away_price END END AS price, CASE WHEN {_OKR} THEN ou_line END AS ou_line, CASE WHEN {_OKR} THEN over_price END AS over_price, CASE WHEN {_OKR} THEN under_price END AS under_price FROM g""")
def nrm_17(spark, sf):
    """Documents with k % 17 = 0 have no markets."""
    docs = market_docs(spark, sf, blank=c("k") % 17 == 0)
    return feeds.mainline_snapshot(docs, _markets(spark, sf, docs), "doc", "event_id", c("observed_us"), "bk")


@query("NRM-13", views=("snapshots",), sql=f"""WITH ou AS (SELECT event_id, ou_line, over_price, under_price FROM snapshots UNION ALL SELECT event_id, {_OTHER}, over_price + 0.25e0, under_price FROM snapshots)
SELECT s.event_id, home_price + 0.5e0 AS open_h, 3.25e0 AS open_d, away_price + 0.5e0 AS open_a, home_line, home_price AS ah_home, away_price AS ah_away, ou.ou_line, ou.over_price, ou.under_price, CASE WHEN k % 4 <> 0 THEN {SEC} END AS price_changed_us
FROM snapshots s JOIN ou USING (event_id) WHERE k % 11 <> 0 AND k % 5 <> 0""")
def nrm_13(spark, sf):
    return feeds.current_rows(_markets(spark, sf), "event_id")


# ---- history ----------------------------------------------------------------------------------
def history_docs(spark, sf):
    tick = lambda h, p: F.struct(F.when(c("k") % 6 != 0, iso(c("observed_us") + F.lit(h * 3_600_000_000))).otherwise("bad").alias("createdAt"), p.alias("price"), (c("k") % 3 != 0).alias("active"), F.lit("t").alias("id"))
    ticks = lambda p: F.struct(F.create_map(F.lit("0"), F.array(tick(2, p + 0.1), tick(0, p), tick(1, F.lit(0.5)))).alias("players"))
    ah_id = F.concat(F.lit("A"), (c("home_line") * 4).cast("int") + 4)
    doc = F.struct(c("event_id").cast("string").alias("fixtureId"), F.create_map(F.lit("bk"), F.struct(F.create_map(ah_id, F.struct(F.create_map(F.lit("1"), ticks(c("home_price")), F.lit("2"), ticks(c("away_price"))).alias("outcomes"))).alias("markets"))).alias("bookmakers"))
    return snaps(spark, sf).select("event_id", json(doc).alias("doc"))


_HT = f"""h AS (SELECT event_id, side, line, p, {SEC} AS t0, k FROM (SELECT *, 'home' AS side, home_line AS line, home_price AS p FROM snapshots) UNION ALL SELECT event_id, 'away', home_line, away_price, {SEC}, k FROM snapshots)"""


def _hist(keep_invalid):
    extra = " UNION ALL SELECT event_id, side, line, t0 + 3600000000, 0.5e0 FROM h WHERE k % 6 <> 0" if keep_invalid else ""
    return _HT.replace("SELECT *, 'home' AS side, home_line AS line, home_price AS p FROM snapshots", "SELECT event_id, 'home' AS side, home_line AS line, home_price AS p, observed_us, k FROM snapshots") + f", t AS (SELECT event_id, side, line, t0 AS at_us, p AS price FROM h WHERE k % 6 <> 0 UNION ALL SELECT event_id, side, line, t0 + 7200000000, p + 0.1e0 FROM h WHERE k % 6 <> 0{extra})"


def _flat(df):
    return df.select("event_id", c("label").alias("side"), "line", F.explode("ticks").alias("t")).select("event_id", "side", "line", "t.at_us", "t.price")


@query("NRM-20", "NRM-21", views=("snapshots",), sql=f"WITH {_hist(False)} SELECT * FROM t")
def nrm_20(spark, sf):
    cat = feeds.full_time_catalog(catalog(spark, sf), 10)
    return _flat(feeds.history_ticks(history_docs(spark, sf), "doc", "event_id", "bk", cat))


@query("NRM-22", views=("snapshots",), sql=f"WITH {_hist(True)} SELECT * FROM t")
def nrm_22(spark, sf):
    """Invalid latest states stay in the series, so they can block a slot."""
    cat = feeds.full_time_catalog(catalog(spark, sf), 10)
    return _flat(feeds.history_ticks(history_docs(spark, sf), "doc", "event_id", "bk", cat, keep_invalid=True))


@query("AGG-17", "AGG-36", views=("snapshots",), sql=f"""WITH {_hist(False)} SELECT 'AH' AS kind, COUNT(*) AS ticks, COUNT(*) FILTER (WHERE k % 3 <> 0) AS active_ticks, MIN(at_us) AS earliest_us, MAX(at_us) AS latest_us, CAST(0 AS BIGINT) AS off_grid_ticks FROM t JOIN (SELECT event_id, k FROM snapshots) USING (event_id)""")
def agg_17(spark, sf):
    cat = feeds.full_time_catalog(catalog(spark, sf), 10)
    return feeds.tick_coverage(feeds.history_ticks(history_docs(spark, sf), "doc", "event_id", "bk", cat))


# ---- opening / closing, balanced lines --------------------------------------------------------
@query("NRM-10", "NRM-38", views=("snapshots",), sql=f"""SELECT event_id, k % 4 <> 0 AS has_book, CASE WHEN k % 4 <> 0 THEN (1e0 / (home_price + 0.5e0)) / {_X} END AS fair_h,
  CASE WHEN k % 4 <> 0 THEN (1e0 / home_price) / (1e0 / home_price + 1e0 / away_price) END AS ah_home_share, CASE WHEN k % 4 <> 0 THEN home_line END AS open_line,
  CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN -0.25e0 END AS ah_line_move, CASE WHEN k % 4 <> 0 THEN 0.5e0 END AS ou_line_move, CASE WHEN k % 4 <> 0 THEN {S.r('home_price + 0.07e0 - home_price', 4)} END AS ah_price_move FROM snapshots""")
def nrm_10(spark, sf):
    lad = lambda line, hp, tot: F.struct((c("home_price") + 0.5).alias("home"), F.lit(3.25).alias("draw"), (c("away_price") + 0.5).alias("away"), line.alias("line"), hp.alias("ahHome"), c("away_price").alias("ahAway"), tot.alias("total"), c("over_price").alias("over"), c("under_price").alias("under"))
    close = lad(F.when(c("k") % 3 != 0, c("home_line") - 0.25).otherwise(c("home_line") - 0.1), c("home_price") + 0.07, c("ou_line") + 0.5)
    doc = F.struct(c("event_id").cast("string").alias("fixture"), F.array(F.struct(F.when(c("k") % 4 != 0, "BookX").otherwise("other").alias("slug"), lad(c("home_line"), c("home_price"), c("ou_line")).alias("opening"), close.alias("closing"))).alias("books"))
    return feeds.open_close(snaps(spark, sf).select("event_id", json(doc).alias("doc")), "doc", "event_id", "bookx")


@query("NRM-23", "NRM-24", views=("snapshots",), sql="""WITH p AS (SELECT event_id, 1 AS i, home_line AS line, home_price AS home, away_price AS away FROM snapshots UNION ALL SELECT event_id, 2, home_line + 1e0, home_price + 0.3e0, away_price FROM snapshots WHERE k % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(home - away), line) AS rn FROM p) SELECT event_id, line, home, away FROM r WHERE rn = 1""")
def nrm_23(spark, sf):
    """Smallest price difference on opposite lines; unpaired and unreadable labels are ignored."""
    v = lambda side, line, odd: F.struct(F.concat(F.lit(side), F.lit(" "), line.cast("string")).alias("value"), odd.cast("string").alias("odd"))
    l2 = c("home_line") + 1.0
    values = F.array(v("Home", c("home_line"), c("home_price")), v("Away", -c("home_line"), c("away_price")), v("Home", l2, c("home_price") + 0.3),
                     F.when(c("k") % 2 == 0, v("Away", -l2, c("away_price"))).otherwise(v("Away", F.lit("?"), c("away_price"))))
    return snaps(spark, sf).select("event_id", feeds.balanced_line(values).alias("b")).select("event_id", "b.line", "b.home", "b.away")


@query("NRM-28", "FLT-18", views=("snapshots",), sql="""SELECT event_id, home_line AS opening_line, round(home_price, 6) AS opening_a, CASE WHEN k % 5 <> 0 THEN round(away_price, 6) END AS opening_b, CASE WHEN k % 5 = 0 THEN 'INCOMPLETE_RECORD' END AS reason,
  k % 3 <> 0 AND k % 2 = 0 AS eligible FROM snapshots""")
def nrm_28(spark, sf):
    text = lambda line, a, b: F.concat_ws(",", line.cast("string"), F.round(a - 1.0, 6).cast("string"), b)
    b = F.when(c("k") % 5 != 0, F.round(c("away_price") - 1.0, 6).cast("string")).otherwise("-")
    d = snaps(spark, sf).select("event_id", "k", text(c("home_line"), c("home_price"), b).alias("opening"), text(c("home_line"), c("home_price"), F.round(c("away_price") - 1.0, 6).cast("string")).alias("current"))
    eligible = ~F.coalesce(c("k") % 3 == 0, F.lit(False)) & F.when(c("k") % 2 == 0, "1").otherwise("3").isin("1", "2")
    return feeds.hong_kong_records(d).select("event_id", "opening_line", "opening_a", "opening_b", "reason", eligible.alias("eligible"))


# ---- results ----------------------------------------------------------------------------------
@query("NRM-29", views=("snapshots",), sql="SELECT event_id, CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN CAST(k % 5 AS BIGINT) END AS ft_home_goals, CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN CAST(k % 4 AS BIGINT) END AS ft_away_goals FROM snapshots")
def nrm_29(spark, sf):
    """Final status 2; a score given as text is no score."""
    k = c("k")
    away = F.when(k % 4 == 1, F.lit('"1"')).otherwise((k % 4).cast("string"))
    doc = F.concat(F.lit('{"fixtureId":"x","statusId":'), F.when(k % 3 == 0, "2").otherwise("1"), F.lit(',"scores":{"'), F.when(k % 2 == 0, "fulltime").otherwise("normaltime"), F.lit('":{"home":'), k % 5, F.lit(',"away":'), away, F.lit("}}}"))
    return feeds.result_from_scores(snaps(spark, sf).select("event_id", doc.alias("doc")), "doc", "event_id")


@query("NRM-30", views=("snapshots",), sql="SELECT event_id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN CAST(k % 5 AS BIGINT) END AS ft_home_goals, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN CAST(k % 4 AS BIGINT) END AS ft_away_goals FROM snapshots")
def nrm_30(spark, sf):
    k = c("k")
    doc = F.concat(F.lit('{"event":{"id":'), F.when(k % 2 == 0, c("event_id")).otherwise(F.lit(-1)), F.lit(',"status":{"type":"'), F.when(k % 3 == 0, "Finished").otherwise("inprogress"),
                   F.lit('"},"homeScore":{"normaltime":'), k % 5, F.lit('},"awayScore":{"normaltime":'), k % 4, F.lit("}}}"))
    return feeds.result_normal_time(snaps(spark, sf).select("event_id", doc.alias("doc")), "doc", "event_id", "event_id")


@query("NRM-31", views=("snapshots",), sql=f"""SELECT event_id, 'e' || event_id AS event_ref, home, away, {SEC} AS kickoff_us, k % 5 AS ft_home_goals, k % 4 AS ft_away_goals FROM snapshots WHERE k % 3 <> 0 AND k % 7 <> 0 AND k % 2 = 0""")
def nrm_31(spark, sf):
    k = c("k")
    side = lambda s, g, n: F.struct(F.lit(s).alias("homeAway"), g.alias("score"), F.struct(n.alias("displayName")).alias("team"))
    comp = F.struct(iso(c("observed_us")).alias("date"), F.struct(F.when(k % 7 != 0, 2).otherwise(4).alias("period"), F.struct(F.lit("STATUS_FULL_TIME").alias("name"), (k % 3 != 0).alias("completed")).alias("type")).alias("status"),
                    F.array(side("home", (k % 5).cast("string"), c("home")), side("away", F.when(k % 2 == 0, (k % 4).cast("string")).otherwise("-"), c("away"))).alias("competitors"))
    doc = F.struct(F.array(F.struct(F.concat(F.lit("e"), c("event_id")).alias("id"), F.array(comp).alias("competitions"))).alias("events"))
    return feeds.scoreboard_events(snaps(spark, sf).select("event_id", json(doc).alias("doc")), "doc", "event_id")


@query("NRM-32", views=("snapshots",), sql="SELECT event_id, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN CAST(k % 5 AS BIGINT) END AS hg, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN CAST(k % 2 AS BIGINT) END AS ag FROM snapshots")
def nrm_32(spark, sf):
    """Unique 90-minute score: repeated records agree, every fourth match contradicts itself."""
    k = c("k")
    row = lambda kind, h, a: F.struct(F.lit(kind).alias("resultTypeKind"), h.alias("pointsTeam1"), a.alias("pointsTeam2"))
    doc = F.struct((k % 3 != 0).alias("matchIsFinished"), F.array(row("HalfTime", F.lit(0), F.lit(0)), row("After90Minutes", k % 5, k % 2), row("After90Minutes", k % 5 + F.when(k % 4 == 0, 1).otherwise(0), k % 2), row("AfterExtraTime", k % 5 + 2, k % 2)).alias("matchResults"))
    return snaps(spark, sf).select("event_id", feeds.after_ninety(json(doc)).alias("s")).select("event_id", c("s.home").alias("hg"), c("s.away").alias("ag"))


@query("NRM-33", views=("snapshots",), sql=f"""SELECT event_id, league, event_id AS match_id, home, away, {SEC} AS kickoff_us, k % 3 = 0 AND k % 5 <> 0 AND k % 7 <> 0 AS finished, CAST(k % 5 AS BIGINT) AS hg, CAST(k % 4 AS BIGINT) AS ag FROM snapshots""")
def nrm_33(spark, sf):
    k = c("k")
    team = lambda n, g: F.struct(F.when(k % 2 == 0, n).alias("name"), n.alias("longName"), g.alias("score"))
    m = F.struct(c("event_id").alias("id"), team(c("home"), k % 5).alias("home"), team(c("away"), k % 4).alias("away"),
                 F.struct(iso(c("observed_us")).alias("utcTime"), (k % 3 == 0).alias("finished"), F.lit(False).alias("cancelled"), (k % 5 == 0).alias("awarded"), F.struct(F.when(k % 7 == 0, "AET").otherwise("FT").alias("short")).alias("reason")).alias("status"))
    doc = F.struct(F.array(F.struct(c("league").alias("name"), F.array(m).alias("matches"))).alias("leagues"))
    return feeds.daily_matches(snaps(spark, sf).select("event_id", json(doc).alias("doc")), "doc", "event_id")


@query("NRM-34", "NRM-50", views=("snapshots",), sql="""SELECT event_id, CASE WHEN k % 2 = 0 THEN league ELSE 'slug' END AS league, strftime(make_timestamp(kickoff_us), '%Y-%m-%d') AS match_day, strftime(make_timestamp(kickoff_us), '%H:%M') AS kickoff, home,
  CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'pre_match' ELSE 'half_time' END AS status FROM snapshots""")
def nrm_34(spark, sf):
    """Fixture fields from aliases, status normalised."""
    from fairline.functions.times import strict_utc

    k = c("k")
    doc = F.struct(F.when(k % 3 == 0, 0).otherwise(9).alias("statusId"), F.when(k % 5 == 0, "Pre-Game").otherwise("Half Time").alias("statusName"), iso(c("kickoff_us")).alias("startTime"), c("home").alias("participant1Name"),
                   F.when(k % 2 == 0, c("league")).alias("tournamentName"), F.lit("slug").alias("tournamentSlug"))
    d = snaps(spark, sf).select("event_id", feeds.parse(json(doc), feeds.MARKET_MAP).alias("e"))
    st = F.regexp_replace(F.lower("e.statusName"), "[- ]", "_")
    ko = strict_utc(c("e.startTime"))
    return d.select("event_id", F.coalesce("e.tournamentName", "e.tournamentSlug").alias("league"), F.date_format(ko, "yyyy-MM-dd").alias("match_day"), F.date_format(ko, "HH:mm").alias("kickoff"), c("e.participant1Name").alias("home"),
                    F.when(st.isin("pre_game", "pregame", "scheduled", "pre_match") | (c("e.statusId") == 0), "pre_match").otherwise(st).alias("status"))


@query("NRM-35", views=("snapshots",), sql="""SELECT event_id, CASE WHEN k % 3 = 0 THEN '' ELSE 'a' || k END AS a_id, CASE WHEN k % 2 = 0 THEN CAST(k + 1 AS VARCHAR) ELSE '' END AS n_id, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS ids FROM snapshots""")
def nrm_35(spark, sf):
    k = c("k")
    m = F.create_map(F.lit("a"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" a"), k)), F.lit("n"), F.when(k % 2 == 0, (k + 1).cast("string")).otherwise((-k).cast("string")), F.lit("z"), F.lit(None).cast("string"))
    d = snaps(spark, sf).select("event_id", feeds.external_ids(m).alias("m"))
    return d.select("event_id", F.coalesce(c("m")["a"], F.lit("")).alias("a_id"), F.coalesce(c("m")["n"], F.lit("")).alias("n_id"), F.size("m").alias("ids"))


@query("NRM-36", "NRM-37", views=("snapshots",), sql="""SELECT event_id, strftime(CAST(make_timestamp(kickoff_us) + INTERVAL 7 HOURS - INTERVAL 6 HOURS AS DATE), '%Y-%m-%d') AS football_day, CASE WHEN home_line < 0 THEN 'H' WHEN home_line > 0 THEN 'A' WHEN home_price <= away_price THEN 'H' ELSE 'A' END AS side,
  price BETWEEN 1.8e0 AND 2.2e0 AS core FROM snapshots WHERE observed_us < kickoff_us AND home_price > 1e0 AND away_price > 1e0""")
def nrm_36(spark, sf):
    """Snapshot rows of an open-market table: favourite by handicap sign, then by price."""
    from fairline.functions.times import football_day

    s = snaps(spark, sf)
    side = F.when(c("home_line") < 0, "H").when(c("home_line") > 0, "A").when(c("home_price") <= c("away_price"), "H").otherwise("A")
    ok = filters.is_prematch() & filters.selected_pair_consistent()
    return s.filter(ok).select("event_id", football_day(F.timestamp_micros("kickoff_us")).cast("string").alias("football_day"), side.alias("side"), c("price").between(1.8, 2.2).alias("core"))


@query("NRM-43", "WIN-17", "FLT-13", views=("snapshots",), sql="""WITH e AS (SELECT fixture_id, home_line, event_id, observed_us, home_price, away_price FROM snapshots WHERE observed_us < kickoff_us AND mainline_verified),
s AS (SELECT fixture_id, home_line, COUNT(DISTINCT home_price || '|' || away_price) AS states, MIN(home_price) AS h, MIN(away_price) AS a FROM (SELECT *, rank() OVER (PARTITION BY fixture_id, home_line ORDER BY observed_us DESC) AS rk FROM e) WHERE rk = 1 GROUP BY ALL),
g AS (SELECT *, floor(((h - 2e0) * (h - 2e0) + (a - 2e0) * (a - 2e0)) * 1e12 + 0.5e0) / 1e12 AS sc, floor(abs(h - a) * 1e12 + 0.5e0) / 1e12 AS df, h BETWEEN 1.8e0 AND 2.2e0 AND a BETWEEN 1.8e0 AND 2.2e0 AS ok FROM s),
b AS (SELECT fixture_id, COUNT(*) AS evaluated_lines, COUNT(*) FILTER (WHERE ok) AS eligible_lines FROM g GROUP BY fixture_id),
t AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY sc, df, home_line) AS rn FROM g WHERE ok)
SELECT b.fixture_id, evaluated_lines, eligible_lines, CASE WHEN eligible_lines = 0 THEN 'NO_ELIGIBLE_BALANCED_LINE' END AS reason, home_line, h AS home_price, a AS away_price FROM b LEFT JOIN t ON b.fixture_id = t.fixture_id AND rn = 1""")
def nrm_43(spark, sf):
    """Balanced representative line per fixture from the latest state of every line."""
    from fairline.operators.representative import balanced

    s = snaps(spark, sf).filter(filters.is_prematch() & c("mainline_verified"))
    return balanced(s, "fixture_id")
