"""Nested provider documents (JSON text columns) to flat rows.

Every normaliser is a projection, or explodes a document and aggregates it back by its own id; documents meet only
the market catalog, on (market id, outcome id). Field types are declared, so a mistyped value reads as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import prices, times
from fairline.functions.exact import rnd
from fairline.functions.lines import grid_or_null
from fairline.functions.reasons import first_reason, truly

# Document schemas (field names as delivered).
EVENT = (
    "struct<id:string,home:string,away:string,date:string,status:string,"
    "bookmakers:map<string,array<struct<name:string,updatedAt:string,odds:array<struct<"
    "hdp:double,max:double,home:double,draw:double,away:double,over:double,under:double>>>>>>"
)
_PLAYER = "struct<price:double,active:boolean,mainLine:boolean,changedAt:string,bookmakerChangedAt:string>"
MARKET_MAP = (
    "struct<fixtureId:string,statusId:int,statusName:string,hasOdds:boolean,startTime:string,participant1Name:string,"
    "participant2Name:string,tournamentName:string,tournamentSlug:string,bookmakerOdds:map<string,struct<"
    "bookmakerIsActive:boolean,suspended:boolean,markets:map<string,struct<marketActive:boolean,"
    f"outcomes:map<string,struct<players:map<string,{_PLAYER}>>>>>>>>"
)
_TICK = "struct<createdAt:string,price:double,active:boolean,id:string>"
HISTORY = (
    "struct<fixtureId:string,startTime:string,bookmakers:map<string,struct<markets:map<string,struct<"
    f"outcomes:map<string,struct<players:map<string,array<{_TICK}>>>>>>>>>"
)
_LADDER = "struct<home:double,draw:double,away:double,line:double,ahHome:double,ahAway:double,total:double,over:double,under:double>"
OPEN_CLOSE = f"struct<fixture:string,books:array<struct<slug:string,opening:{_LADDER},closing:{_LADDER}>>>"
RESULT = "struct<fixtureId:string,statusId:int,scores:struct<fulltime:struct<home:bigint,away:bigint>,normaltime:struct<home:bigint,away:bigint>>>"
EVENT_RESULT = "struct<event:struct<id:bigint,status:struct<type:string>,homeScore:struct<normaltime:bigint>,awayScore:struct<normaltime:bigint>>>"
SCOREBOARD = (
    "struct<events:array<struct<id:string,competitions:array<struct<date:string,status:struct<period:int,type:struct<name:string,completed:boolean>>,"
    "competitors:array<struct<homeAway:string,score:string,team:struct<displayName:string>>>>>>>>"
)
PHASED = "struct<matchIsFinished:boolean,matchResults:array<struct<resultTypeKind:string,pointsTeam1:bigint,pointsTeam2:bigint>>>"
DAILY = (
    "struct<leagues:array<struct<name:string,matches:array<struct<id:bigint,home:struct<name:string,longName:string,score:bigint>,away:struct<name:string,longName:string,score:bigint>,"
    "status:struct<utcTime:string,finished:boolean,cancelled:boolean,awarded:boolean,reason:struct<short:string>>>>>>>"
)


def parse(doc: Column, schema: str) -> Column:
    return F.from_json(doc, schema, {"mode": "PERMISSIVE"})


def parsed(docs: DataFrame, doc: str, schema: str, *keep: str) -> DataFrame:
    """Documents with the parsed value as column `e`.

    The generator keeps later filters from being merged into the parse, so each document is parsed once.
    """
    return docs.select(*keep, F.explode(F.array(parse(F.col(doc), schema))).alias("e"))


def lookup_ci(m: Column, key: str) -> Column:
    """Map value under a case-insensitive key."""
    return F.get(F.map_values(F.map_filter(m, lambda k, _: F.lower(k) == key.lower())), F.lit(0))


def oldest(stamps: Column) -> Column:
    """Oldest of the timestamps (micros); null as soon as one is missing or naive."""
    us = F.transform(stamps, lambda s: F.unix_micros(times.strict_utc(s)))
    return F.when(F.forall(us, lambda x: x.isNotNull()) & (F.size(us) > 0), F.array_min(us))


def event_combinations(docs: DataFrame, doc: str, key: str, bookmaker: str) -> DataFrame:
    """Every valid handicap x total combination of an event; no main line is guessed."""
    names = {"ml": ("ml", "moneyline"), "ah": ("spread", "asian handicap"), "ou": ("totals", "over/under")}
    d = parsed(docs, doc, EVENT, key).withColumn("markets", F.explode(F.array(lookup_ci(F.col("e.bookmakers"), bookmaker))))
    of = lambda kind: F.filter("markets", lambda m: F.lower(m["name"]).isin(*names[kind]))
    d = d.select(key, "e", F.get(of("ml"), F.lit(0)).alias("ml"), of("ah").alias("ah"), of("ou").alias("ou"))
    usable = lambda *cs: F.coalesce(F.least(*[F.coalesce(x, F.lit(0.0)) for x in cs]) > 1.0, F.lit(False))
    d = d.withColumn("x", F.get(F.filter("ml.odds", lambda o: usable(o["home"], o["draw"], o["away"])), F.lit(0))).filter(F.col("x").isNotNull())
    for kind, a, b in (("ah", "home", "away"), ("ou", "over", "under")):
        d = d.withColumn("m", F.explode(kind)).withColumn("o", F.explode("m.odds"))
        line = grid_or_null(F.col("o.hdp") if kind == "ah" else F.coalesce("o.hdp", "o.max"), 1e-9)
        d = d.filter(line.isNotNull() & usable(F.col(f"o.{a}"), F.col(f"o.{b}"))).select(
            *[c for c in d.columns if c not in ("m", "o")],
            F.struct(line.alias("line"), F.col(f"o.{a}").alias("a"), F.col(f"o.{b}").alias("b"), F.col("m.updatedAt").alias("at")).alias(f"{kind}_q"),
        )
    as_of = oldest(F.array("ml.updatedAt", "ah_q.at", "ou_q.at"))
    status = F.lower("e.status")
    return d.select(
        key, F.when(status.isin("pending", "scheduled", "not_started"), "scheduled").otherwise(status).alias("status"),
        F.col("x.home").alias("open_h"), F.col("x.draw").alias("open_d"), F.col("x.away").alias("open_a"),
        F.col("ah_q.line").alias("home_line"), F.col("ah_q.a").alias("ah_home"), F.col("ah_q.b").alias("ah_away"),
        F.col("ou_q.line").alias("ou_line"), F.col("ou_q.a").alias("over_price"), F.col("ou_q.b").alias("under_price"), as_of.alias("as_of_us"),
    )


def full_time_catalog(catalog: DataFrame, sport: int) -> DataFrame:
    """Markets of the sport, full time, no player props."""
    return catalog.filter(
        (F.col("sport_id") == sport) & (F.lower("period") == "fulltime") & ~F.coalesce("player_prop", F.lit(False))
    )


def _dimension(catalog: DataFrame, bound: int = 100_000) -> DataFrame:
    """A catalog of at most `bound` rows is broadcast, so that no selection is shuffled to its few markets; a larger one is shuffled."""
    return F.broadcast(catalog) if catalog.limit(bound + 1).count() <= bound else catalog


def selections(docs: DataFrame, doc: str, key: str, bookmaker: str, catalog: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per priced selection of an active market of one active bookmaker, with its catalog meaning."""
    d = parsed(docs, doc, MARKET_MAP, key, *keep).withColumn("book", F.col("e.bookmakerOdds").getItem(bookmaker))
    d = d.filter(truly(F.col("book.bookmakerIsActive")) & F.col("book.suspended").eqNullSafe(F.lit(False)))
    d = d.select(key, *keep, F.explode("book.markets").alias("market_id", "m")).filter(truly(F.col("m.marketActive")))
    d = d.select(key, *keep, "market_id", F.explode("m.outcomes").alias("outcome_id", "o"))
    player = F.coalesce(F.col("o.players").getItem("0"), F.get(F.map_values("o.players"), F.lit(0)))
    d = d.withColumn("p", F.explode(F.array(player))).filter((F.col("p.price") > 1) & truly(F.col("p.active")))
    return d.join(_dimension(catalog), ["market_id", "outcome_id"]).select(
        key, *keep, "market_id", "kind", F.lower(F.trim("outcome_name")).alias("label"), grid_or_null(F.col("handicap"), 1e-9).alias("line"),
        F.col("p.price").alias("price"), truly(F.col("p.mainLine")).alias("main"), F.coalesce("p.bookmakerChangedAt", "p.changedAt").alias("changed_at"),
    )


def two_sided(sel: DataFrame, key: str) -> DataFrame:
    """Markets with all their sides: prices a, (x), b, main flag, change stamps; one aggregate per (document, market)."""
    side = lambda *names: F.max(F.when(F.col("label").isin(*names), F.col("price")))
    g = sel.groupBy(key, "market_id", "kind", "line").agg(
        side("home", "1", "over").alias("a"), side("draw", "x").alias("x"), side("away", "2", "under").alias("b"),
        F.min("main").alias("main"), F.collect_list("changed_at").alias("stamps"), F.count("*").alias("sides"),
    )
    complete = F.col("a").isNotNull() & F.col("b").isNotNull() & ((F.col("kind") != "1X2") | F.col("x").isNotNull())
    return g.filter(complete & ((F.col("kind") == "1X2") | F.col("line").isNotNull()))


def mainline_shape(markets: DataFrame, key: str) -> DataFrame:
    """Main-line cardinality per document, without choosing a line."""
    ah, ou = (F.col("kind") == "AH") & F.col("main"), (F.col("kind") == "OU") & F.col("main")
    text = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.col("line")))), lambda v: v.cast("string")), ",")
    return markets.groupBy(key).agg(
        F.count_if(F.col("kind") == "1X2").alias("one_x_two_count"), F.count_if(ah).alias("ah_main_count"), F.count_if(ou).alias("ou_main_count"),
        text(ah).alias("ah_lines"), text(ou).alias("ou_lines"),
    )


def mainline_snapshot(docs: DataFrame, markets: DataFrame, doc: str, key: str, observed_us: Column, bookmaker: str) -> DataFrame:
    """Exactly one main handicap, one main total and one 1X2 per document, otherwise a reason.

    Whether the bookmaker is active is read from the document: an active one without complete markets lacks its 1X2.
    """
    is_main = lambda kind: (F.col("kind") == kind) & (F.col("main") | (F.col("kind") == "1X2"))
    q = F.struct("line", "a", "x", "b")
    g = markets.groupBy(key).agg(
        *[F.count_if(is_main(k)).alias(f"n_{k}") for k in ("1X2", "AH", "OU")], *[F.max(F.when(is_main(k), q)).alias(k) for k in ("1X2", "AH", "OU")]
    )
    j = parsed(docs.withColumn("_at", observed_us), doc, MARKET_MAP, key, "_at").join(g, key, "left")
    observed_us = F.col("_at")
    book = F.col("e.bookmakerOdds").getItem(bookmaker)
    trades = truly(book["bookmakerIsActive"]) & book["suspended"].eqNullSafe(F.lit(False))
    kickoff = F.unix_micros(times.strict_utc(F.col("e.startTime")))
    n = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0))
    fair = prices.devig3(F.col("1X2.a"), F.col("1X2.x"), F.col("1X2.b"))
    side = prices.favorite_by_probability(fair["home"], fair["away"])
    home = side == "H"
    reason = first_reason([
        (~(F.col("e.statusId") == 0) | ~truly(F.col("e.hasOdds")), "NOT_PREMATCH_WITH_ODDS"),
        (kickoff.isNull() | (kickoff <= observed_us), "KICKOFF_NOT_FUTURE"),
        (~trades, "BOOKMAKER_NOT_ACTIVE"),
        (n("1X2") != 1, "AMBIGUOUS_OR_MISSING_1X2"),
        (n("AH") != 1, "AMBIGUOUS_OR_MISSING_MAIN_AH"),
        (n("OU") != 1, "AMBIGUOUS_OR_MISSING_MAIN_OU"),
    ])
    j = j.withColumn("reason", reason).withColumn("side", side)
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    return j.select(
        key, "reason", ok(F.col("side")).alias("favorite_side"), ok(F.when(home, fair["home"]).otherwise(fair["away"])).alias("favorite_fair_probability"),
        ok(F.when(home, F.col("AH.line")).otherwise(-F.col("AH.line"))).alias("line"), ok(F.when(home, F.col("AH.a")).otherwise(F.col("AH.b"))).alias("price"),
        ok(F.col("OU.line")).alias("ou_line"), ok(F.col("OU.a")).alias("over_price"), ok(F.col("OU.b")).alias("under_price"),
    )


def current_rows(markets: DataFrame, key: str) -> DataFrame:
    """Handicap x total rows of each document with its 1X2 and the oldest change stamp of the seven prices.

    One aggregate per document, then two explodes: the product stays inside a document and its own lines.
    """
    q = F.struct("line", "a", "b", "stamps")
    of = lambda kind: F.when(F.col("kind") == kind, q)
    one = lambda c: F.max(F.when(F.col("kind") == "1X2", F.col(c)))
    g = markets.groupBy(key).agg(
        one("a").alias("open_h"), one("x").alias("open_d"), one("b").alias("open_a"), one("stamps").alias("stamps_1"),
        F.collect_list(of("AH")).alias("ahs"), F.collect_list(of("OU")).alias("ous"),
    )
    prefix = lambda arr, p: F.transform(arr, lambda m: F.struct(*[m[f].alias(f"{p}_{f}") for f in ("line", "a", "b", "stamps")]))
    g = g.filter(F.col("open_h").isNotNull()).select(
        key, "open_h", "open_d", "open_a", "stamps_1", F.inline(prefix("ahs", "h")), "ous"
    )
    g = g.select(*[c for c in g.columns if c != "ous"], F.inline(prefix("ous", "t")))
    stamps = F.concat("stamps_1", "h_stamps", "t_stamps")
    return g.select(
        key, "open_h", "open_d", "open_a",
        F.col("h_line").alias("home_line"), F.col("h_a").alias("ah_home"), F.col("h_b").alias("ah_away"),
        F.col("t_line").alias("ou_line"), F.col("t_a").alias("over_price"), F.col("t_b").alias("under_price"),
        F.when(F.size(stamps) == 7, oldest(stamps)).alias("price_changed_us"),
    )


def clean_ticks(ticks: Column, keep_invalid: bool = False) -> Column:
    """Ticks with a price above 1 and an aware timestamp, in time order; invalid states may be kept on purpose."""
    shaped = F.transform(
        ticks,
        lambda t: F.struct(F.unix_micros(times.strict_utc(t["createdAt"])).alias("at_us"), t["price"].alias("price"), truly(t["active"]).alias("active")),
    )
    ok = lambda t: t["at_us"].isNotNull() & (F.lit(keep_invalid) | F.coalesce(t["price"] > 1, F.lit(False)))
    return F.array_sort(F.filter(shaped, ok))


def history_ticks(docs: DataFrame, doc: str, key: str, bookmaker: str, catalog: DataFrame, keep_invalid: bool = False) -> DataFrame:
    """One row per (document, market, side) with its clean tick array."""
    d = parsed(docs, doc, HISTORY, key).select(key, F.explode(F.col("e.bookmakers").getItem(bookmaker).getField("markets")).alias("market_id", "m"))
    d = d.select(key, "market_id", F.explode("m.outcomes").alias("outcome_id", "o"))
    d = d.withColumn("ticks", F.explode(F.array(clean_ticks(F.col("o.players").getItem("0"), keep_invalid)))).filter(F.size("ticks") > 0)
    return d.join(_dimension(catalog), ["market_id", "outcome_id"]).select(
        key, "market_id", "kind", F.lower("outcome_name").alias("label"), F.col("handicap").alias("line"), "ticks"
    )


def tick_coverage(series: DataFrame) -> DataFrame:
    """Archive audit: counts, first and last tick, off-grid lines per kind."""
    t = series.withColumn("t", F.explode("ticks"))
    return t.groupBy("kind").agg(
        F.count("*").alias("ticks"), F.count_if("t.active").alias("active_ticks"), F.min("t.at_us").alias("earliest_us"), F.max("t.at_us").alias("latest_us"),
        F.count_if(grid_or_null(F.col("line")).isNull() & (F.col("kind") != "1X2")).alias("off_grid_ticks"),
    )


def open_close(docs: DataFrame, doc: str, key: str, bookmaker: str) -> DataFrame:
    """Opening and closing ladder of one bookmaker: shares and line moves."""
    d = parsed(docs, doc, OPEN_CLOSE, key).withColumn("b", F.get(F.filter("e.books", lambda x: F.lower(x["slug"]) == bookmaker), F.lit(0)))
    o, cl = (lambda f: F.col(f"b.opening.{f}")), (lambda f: F.col(f"b.closing.{f}"))
    share = prices.devig2(o("ahHome"), o("ahAway"))["a"]
    fair = prices.devig3(o("home"), o("draw"), o("away"))
    return d.select(
        key, F.col("b").isNotNull().alias("has_book"), fair["home"].alias("fair_h"), share.alias("ah_home_share"), grid_or_null(o("line")).alias("open_line"),
        rnd(grid_or_null(cl("line")) - grid_or_null(o("line")), 4).alias("ah_line_move"), rnd(grid_or_null(cl("total")) - grid_or_null(o("total")), 4).alias("ou_line_move"),
        rnd(cl("ahHome") - o("ahHome"), 4).alias("ah_price_move"),
    )


def balanced_line(values: Column) -> Column:
    """Home/away pair on opposite lines with the smallest price difference, from 'Home -0.5' style labels."""
    shaped = F.transform(
        values,
        lambda v: F.struct(F.lower(F.split(v["value"], " ", 2)[0]).alias("side"), F.element_at(F.split(v["value"], " "), -1).try_cast("double").alias("line"), prices.number(v["odd"]).alias("odd")),
    )
    ok = F.filter(shaped, lambda s: s["line"].isNotNull() & s["odd"].isNotNull())
    homes = F.filter(ok, lambda s: s["side"] == "home")
    away_of = lambda h: F.get(F.filter(ok, lambda s: (s["side"] == "away") & (s["line"] == -h["line"])), F.lit(0))
    pairs = F.transform(
        homes, lambda h: F.struct(F.abs(h["odd"] - away_of(h)["odd"]).alias("diff"), h["line"].alias("line"), h["odd"].alias("home"), away_of(h)["odd"].alias("away"))
    )
    return F.array_min(F.filter(pairs, lambda p: p["diff"].isNotNull()))


def result_from_scores(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """Explicit final score only; whole, not negative."""
    d = parsed(docs, doc, RESULT, key)
    s = F.coalesce("e.scores.fulltime", "e.scores.normaltime")
    ok = (F.col("e.statusId") == 2) & (s["home"] >= 0) & (s["away"] >= 0)
    return d.select(key, F.when(ok, s["home"]).alias("ft_home_goals"), F.when(ok, s["away"]).alias("ft_away_goals"))


def result_normal_time(docs: DataFrame, doc: str, key: str, expected: str) -> DataFrame:
    d = parsed(docs, doc, EVENT_RESULT, *dict.fromkeys((key, expected)))
    hg, ag = F.col("e.event.homeScore.normaltime"), F.col("e.event.awayScore.normaltime")
    ok = (F.lower("e.event.status.type") == "finished") & (F.col("e.event.id") == F.col(expected)) & (hg >= 0) & (ag >= 0)
    return d.select(key, F.when(ok, hg).alias("ft_home_goals"), F.when(ok, ag).alias("ft_away_goals"))


def scoreboard_events(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """Full-time events: one competition, completed, period 2, one side each, numeric scores."""
    d = docs.select(key, F.explode(parse(F.col(doc), SCOREBOARD).getField("events")).alias("ev")).filter(F.size("ev.competitions") == 1)
    d = d.withColumn("c", F.col("ev.competitions")[0])
    sides = lambda s: F.filter("c.competitors", lambda x: x["homeAway"] == s)
    d = d.withColumn("h", sides("home")).withColumn("a", sides("away")).filter((F.size("h") == 1) & (F.size("a") == 1))
    ok = (
        (F.col("c.status.type.name") == "STATUS_FULL_TIME") & truly(F.col("c.status.type.completed")) & (F.col("c.status.period") == 2)
        & F.col("h")[0]["score"].rlike("^[0-9]+$") & F.col("a")[0]["score"].rlike("^[0-9]+$") & times.strict_utc(F.col("c.date")).isNotNull()
    )
    return d.filter(ok).select(
        key, F.col("ev.id").alias("event_ref"), F.col("h")[0]["team"]["displayName"].alias("home"), F.col("a")[0]["team"]["displayName"].alias("away"),
        F.unix_micros(times.strict_utc(F.col("c.date"))).alias("kickoff_us"), F.col("h")[0]["score"].cast("int").alias("ft_home_goals"), F.col("a")[0]["score"].cast("int").alias("ft_away_goals"),
    )


def after_ninety(doc: Column) -> Column:
    """The unique 90-minute score of a finished match, as struct(home, away)."""
    m = parse(doc, PHASED)
    rows = F.filter(m["matchResults"], lambda r: (r["resultTypeKind"] == "After90Minutes") & (r["pointsTeam1"] >= 0) & (r["pointsTeam2"] >= 0))
    scores = F.array_distinct(F.transform(rows, lambda r: F.struct(r["pointsTeam1"].alias("home"), r["pointsTeam2"].alias("away"))))
    return F.when(truly(m["matchIsFinished"]) & (F.size(scores) == 1), scores[0])


def daily_matches(docs: DataFrame, doc: str, key: str) -> DataFrame:
    """Matches of a day document; `finished` excludes extra time, penalties, awarded and cancelled games."""
    d = docs.select(key, F.explode(parse(F.col(doc), DAILY).getField("leagues")).alias("l")).select(key, F.col("l.name").alias("league"), F.explode("l.matches").alias("m"))
    s = lambda f: F.col(f"m.status.{f}")
    ft = truly(s("finished")) & ~truly(s("cancelled")) & ~truly(s("awarded")) & F.coalesce(F.upper("m.status.reason.short") == "FT", F.lit(False))
    return d.select(
        key, "league", F.col("m.id").alias("match_id"), F.coalesce("m.home.name", "m.home.longName").alias("home"), F.coalesce("m.away.name", "m.away.longName").alias("away"),
        F.unix_micros(times.strict_utc(s("utcTime"))).alias("kickoff_us"), ft.alias("finished"), F.col("m.home.score").alias("hg"), F.col("m.away.score").alias("ag"),
    )


def external_ids(m: Column) -> Column:
    """Id map without blanks and without non-positive numbers."""
    number = lambda v: v.try_cast("long")
    return F.map_filter(F.transform_values(m, lambda _, v: F.trim(v)), lambda _, v: F.coalesce(v != "", F.lit(False)) & (number(v).isNull() | (number(v) > 0)))


def hong_kong_records(df: DataFrame) -> DataFrame:
    """Record text 'line,a,b' of the opening and current quote to decimal prices; incomplete rows carry a reason."""
    part = lambda c, i: prices.number(F.get(F.split(F.col(c), ","), F.lit(i)))
    out = df
    for stage in ("opening", "current"):
        out = out.withColumn(f"{stage}_line", grid_or_null(part(stage, 0), 1e-9))
        for i, s in ((1, "a"), (2, "b")):
            out = out.withColumn(f"{stage}_{s}", prices.from_hong_kong(part(stage, i)))
    cols = [f"{st}_{s}" for st in ("opening", "current") for s in ("line", "a", "b")]
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return out.withColumn("reason", F.when(missing, "INCOMPLETE_RECORD"))
