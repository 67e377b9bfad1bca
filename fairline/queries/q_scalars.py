"""Scalar rules applied to every row of a view: prices, lines, settlement, bands, labels, times, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import bands, lines, names, prices, settlement, stats, times
from fairline.functions.exact import rnd
from fairline.queries import sqlviews as S
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col
QKEY = ["fixture_id", "line_no", "part_id", "supp_id", "qty"]
QK = ", ".join(QKEY)


def on_quotes(*ids, cols, sql):
    """Register a projection of the quotes view; cols maps name -> function building the column."""

    @query(*ids, views=("quotes",), sql=f"SELECT {QK}, {sql} FROM quotes")
    def run(spark, sf):
        return V.quotes(spark, sf).select(*QKEY, *[f().alias(k) for k, f in cols.items()])


def on_snapshots(*ids, cols, sql):
    @query(*ids, views=("snapshots",), sql=f"SELECT event_id, {sql} FROM snapshots")
    def run(spark, sf):
        return V.snapshots(spark, sf).select("event_id", *[f().alias(k) for k, f in cols.items()])


def on_market(*ids, cols, sql, where=None, sql_where=""):
    @query(*ids, views=("market_rows",), sql=f"SELECT {QK}, {sql} FROM market_rows {sql_where}")
    def run(spark, sf):
        df = V.market_rows(spark, sf)
        if where is not None:
            df = df.filter(where())
        return df.select(*QKEY, *[f().alias(k) for k, f in cols.items()])


# ---- prices -----------------------------------------------------------------------------------
def _triplet():
    gap = lambda x: F.when(c("qty") % 3 != 0, c(x))
    return prices.first_complete(
        [("OPEN", [gap("open_h"), c("open_d"), c("open_a")]), ("CLOSE", [c("close_h"), c("close_d"), c("close_a")])],
        ["h", "d", "a"],
    )


on_quotes(
    "NRM-01",
    cols={"h": lambda: _triplet()["h"], "d": lambda: _triplet()["d"], "a": lambda: _triplet()["a"], "source": lambda: _triplet()["source"]},
    sql="""CASE WHEN qty % 3 <> 0 THEN open_h ELSE close_h END AS h, CASE WHEN qty % 3 <> 0 THEN open_d ELSE close_d END AS d,
  CASE WHEN qty % 3 <> 0 THEN open_a ELSE close_a END AS a, CASE WHEN qty % 3 <> 0 THEN 'OPEN' ELSE 'CLOSE' END AS source""",
)


def _pair():
    return prices.first_complete(
        [("AVG", [F.when(c("qty") > 25, c("ah_home")), c("ah_away")]), ("BOOK", [c("close_ah_home"), c("close_ah_away")])],
        ["a", "b"],
    )


on_quotes(
    "NRM-02",
    cols={"a": lambda: _pair()["a"], "b": lambda: _pair()["b"], "source": lambda: _pair()["source"]},
    sql="""CASE WHEN qty > 25 THEN ah_home ELSE close_ah_home END AS a, CASE WHEN qty > 25 THEN ah_away ELSE close_ah_away END AS b,
  CASE WHEN qty > 25 THEN 'AVG' ELSE 'BOOK' END AS source""",
)
on_quotes(
    "NRM-03",
    cols={"x": lambda: prices.first_number(F.when(c("returnflag") == "A", "n/a").when(c("returnflag") == "N", "").otherwise(c("open_h").cast("string")), c("close_h"))},
    sql="CASE WHEN returnflag IN ('A', 'N') THEN close_h ELSE open_h END AS x",
)


def _f3():
    return prices.devig3(c("open_h"), c("open_d"), c("open_a"))


_INV = "(1e0 / open_h + 1e0 / open_d + 1e0 / open_a)"
on_quotes(
    "NRM-04",
    cols={"fair_h": lambda: _f3()["home"], "fair_d": lambda: _f3()["draw"], "fair_a": lambda: _f3()["away"], "overround": lambda: _f3()["overround"]},
    sql=f"(1e0 / open_h) / {_INV} AS fair_h, (1e0 / open_d) / {_INV} AS fair_d, (1e0 / open_a) / {_INV} AS fair_a, {_INV} - 1e0 AS overround",
)


def _f2():
    return prices.devig2(c("over_price"), c("under_price"))


on_quotes(
    "NRM-05",
    cols={"fair_over": lambda: _f2()["a"], "fair_under": lambda: _f2()["b"], "overround": lambda: _f2()["overround"]},
    sql="""(1e0 / over_price) / (1e0 / over_price + 1e0 / under_price) AS fair_over,
  (1e0 / under_price) / (1e0 / over_price + 1e0 / under_price) AS fair_under, (1e0 / over_price + 1e0 / under_price) - 1e0 AS overround""",
)
on_market(
    "NRM-06",
    cols={k: (lambda k=k: c(k)) for k in ("season", "league", "home", "away", "result", "open_h", "open_d", "open_a", "fair_h", "fair_d", "fair_a", "overround")}
    | {"close_h": lambda: prices.price(F.when(c("returnflag") != "N", c("close_h")))},
    sql="season, league, home, away, result, open_h, open_d, open_a, fair_h, fair_d, fair_a, overround, CASE WHEN returnflag <> 'N' THEN close_h END AS close_h",
    where=lambda: prices.price(c("open_h")).isNotNull() & prices.price(c("open_d")).isNotNull() & prices.price(c("open_a")).isNotNull(),
)
_SAME = ("season", "league", "home_goals", "away_goals", "favorite_side", "favorite_fair_probability", "favorite_ah_line", "favorite_ah_price", "ou_line", "over_price", "under_price")
on_market("NRM-07", cols={k: (lambda k=k: c(k)) for k in _SAME}, sql=", ".join(_SAME))


def _ah():
    return settlement.settle_handicap(c("home_goals"), c("away_goals"), c("favorite_ah_line"), c("favorite_ah_price"), c("favorite_side"))


_AHS = S.ah_signs("home_goals", "away_goals", "favorite_ah_line", "favorite_side")
on_market(
    "NRM-08",
    cols={
        "favorite_side": lambda: c("favorite_side"), "ah_line": lambda: c("favorite_ah_line"), "ah_price": lambda: c("favorite_ah_price"),
        "ah_opposite_price": lambda: c("favorite_ah_other_price"),
        "favorite_probability": lambda: rnd(c("favorite_fair_probability"), 8),
        "price_band": lambda: bands.band_lo(bands.floor_band_no(c("favorite_ah_price"), 0.20), 0.20),
        "probability_band": lambda: bands.band_lo(bands.floor_band_no(c("favorite_fair_probability"), 0.10), 0.10),
        "closing_ah_line": lambda: c("favorite_close_line"), "closing_ah_price": lambda: c("favorite_close_price"),
        "line_move": lambda: c("ah_line_move"), "price_move": lambda: rnd(c("favorite_close_price") - c("favorite_ah_price"), 6),
        "settlement": lambda: _ah()["settlement"], "profit_units": lambda: _ah()["profit_units"],
    },
    sql=f"""favorite_side, favorite_ah_line AS ah_line, favorite_ah_price AS ah_price, favorite_ah_other_price AS ah_opposite_price,
  {S.r('favorite_fair_probability', 8)} AS favorite_probability,
  floor(floor((favorite_ah_price + 1e-12) / 2e-1) * 2e-1 * 1e4 + 0.5e0) / 1e4 AS price_band,
  floor(floor((favorite_fair_probability + 1e-12) / 1e-1) * 1e-1 * 1e4 + 0.5e0) / 1e4 AS probability_band,
  favorite_close_line AS closing_ah_line, favorite_close_price AS closing_ah_price, ah_line_move AS line_move,
  {S.r('favorite_close_price - favorite_ah_price', 6)} AS price_move, {S.klass(_AHS)} AS settlement, {S.profit(_AHS, 'favorite_ah_price')} AS profit_units""",
)


@query("NRM-09", "SRC-05", views=("market_rows",), sql=f"""WITH b AS (
  SELECT {QK}, season, 'O' AS side, over_price AS price, under_price AS other, close_over AS cl, {S.over_signs('home_goals', 'away_goals', 'ou_line')} AS sg, favorite_side FROM market_rows UNION ALL
  SELECT {QK}, season, 'U', under_price, over_price, close_under, -{S.over_signs('home_goals', 'away_goals', 'ou_line')}, favorite_side FROM market_rows)
  SELECT {QK}, season, favorite_side, side AS ou_side, price AS ou_price, other AS ou_opposite_price, cl AS closing_ou_price, {S.r('cl - price', 6)} AS price_move,
  {S.klass('sg')} AS settlement, {S.profit('sg', 'price')} AS profit_units FROM b""")
def nrm_09(spark, sf):
    """One row per total side."""
    side = lambda s, p, o, cl: F.struct(F.lit(s).alias("ou_side"), c(p).alias("ou_price"), c(o).alias("ou_opposite_price"), c(cl).alias("closing_ou_price"))
    df = V.market_rows(spark, sf).withColumn("b", F.explode(F.array(
        side("O", "over_price", "under_price", "close_over"), side("U", "under_price", "over_price", "close_under"))))
    st = settlement.settle_total(c("home_goals"), c("away_goals"), c("ou_line"), c("b.ou_price"), c("b.ou_side"))
    return df.withColumn("s", st).select(*QKEY, "season", "favorite_side", "b.*", rnd(c("b.closing_ou_price") - c("b.ou_price"), 6).alias("price_move"),
                                         "s.settlement", "s.profit_units")


on_quotes(
    "NRM-26",
    cols={"x": lambda: prices.from_american_or_decimal(F.when(c("qty") % 3 == 0, c("qty") * 10).when(c("qty") % 3 == 1, -(c("qty") * 10)).otherwise(c("open_h")).cast("string"))},
    sql="""CASE WHEN qty % 3 = 0 THEN 1e0 + qty * 10 / 100e0 WHEN qty % 3 = 1 THEN 1e0 + 100e0 / (qty * 10) ELSE open_h END AS x""",
)
on_quotes("NRM-27", cols={"x": lambda: prices.from_hong_kong((c("part_id") % 250).cast("double") / 100.0)},
          sql="round((part_id % 250) / 100e0 + 1e0, 6) AS x")
on_quotes("NRM-51", "NRM-52",
          cols={"opening": lambda: prices.price(c("open_h")), "closing": lambda: prices.price(F.when(c("returnflag") != "N", c("close_h"))),
                "move": lambda: lines.movement(F.coalesce(F.when(c("qty") > 30, c("close_home_line") - c("home_line")), c("close_ou_line") - c("ou_line")))},
          sql="open_h AS opening, CASE WHEN returnflag <> 'N' THEN close_h END AS closing, CASE WHEN qty > 30 THEN close_home_line - home_line ELSE close_ou_line - ou_line END AS move")
on_quotes("FLT-17",
          cols={"research": lambda: prices.research_price(c("ah_home")), "tradable": lambda: prices.tradable_price(c("ah_home"))},
          sql="ah_home BETWEEN 1.5e0 AND 2.5e0 AS research, ah_home BETWEEN 1.8e0 AND 2.2e0 AS tradable")
on_quotes("FLT-21",
          cols={"x": lambda: prices.in_band(c("ah_home"), F.when(c("returnflag") != "N", F.lit(1.8)), F.lit(2.0))},
          sql="returnflag = 'N' OR (ah_home >= 1.8e0 AND ah_home < 2e0) AS x")

# ---- settlement -------------------------------------------------------------------------------
on_market("SET-01", "SET-04",
          cols={"settlement": lambda: _ah()["settlement"], "profit_units": lambda: _ah()["profit_units"], "return_units": lambda: _ah()["return_units"]},
          sql=f"{S.klass(_AHS)} AS settlement, {S.profit(_AHS, 'favorite_ah_price')} AS profit_units, 1e0 + {S.profit(_AHS, 'favorite_ah_price')} AS return_units")
_UN = f"(-{S.over_signs('home_goals', 'away_goals', 'ou_line')})"


def _under():
    return settlement.settle_total(c("home_goals"), c("away_goals"), c("ou_line"), c("under_price"), F.lit("U"))


on_market("SET-02", cols={"settlement": lambda: _under()["settlement"], "profit_units": lambda: _under()["profit_units"]},
          sql=f"{S.klass(_UN)} AS settlement, {S.profit(_UN, 'under_price')} AS profit_units")
_HQ = "CAST(round(home_line * 4) AS INTEGER)"
on_quotes("SET-03", "BKT-13",
          cols={"lo": lambda: lines.split(c("home_line"))["lo"], "hi": lambda: lines.split(c("home_line"))["hi"], "quarter": lambda: lines.is_quarter_line(c("home_line"))},
          sql=f"({_HQ} - abs({_HQ} % 2)) / 4e0 AS lo, ({_HQ} + abs({_HQ} % 2)) / 4e0 AS hi, abs({_HQ} % 2) = 1 AS quarter")


def _entry_market():
    return F.when(c("line_no") % 2 == 0, "AH").otherwise("ou")


on_market("SET-11",
          cols={"settlement": lambda: settlement.settle_entry(_entry_market(), c("home_goals"), c("away_goals"), F.when(c("line_no") % 2 == 0, c("home_line")).otherwise(c("ou_line")), F.when(c("line_no") % 2 == 0, c("ah_home")).otherwise(c("over_price")), F.when(c("line_no") % 2 == 0, "H").otherwise("o"))["settlement"],
                "profit_units": lambda: settlement.settle_entry(_entry_market(), c("home_goals"), c("away_goals"), F.when(c("line_no") % 2 == 0, c("home_line")).otherwise(c("ou_line")), F.when(c("line_no") % 2 == 0, c("ah_home")).otherwise(c("over_price")), F.when(c("line_no") % 2 == 0, "H").otherwise("o"))["profit_units"]},
          sql=f"""CASE WHEN line_no % 2 = 0 THEN {S.klass(S.ah_signs('home_goals', 'away_goals', 'home_line', "'H'"))} ELSE {S.klass(S.over_signs('home_goals', 'away_goals', 'ou_line'))} END AS settlement,
  CASE WHEN line_no % 2 = 0 THEN {S.profit(S.ah_signs('home_goals', 'away_goals', 'home_line', "'H'"), 'ah_home')} ELSE {S.profit(S.over_signs('home_goals', 'away_goals', 'ou_line'), 'over_price')} END AS profit_units""")


_EVC = "(fw * (o - 1e0) + hw * ((o - 1e0) / 2e0) + pu * 0e0 + hl * -0.5e0 + fl * -1e0) / CAST(fw + hw + pu + hl + fl AS DOUBLE)"


@query("SET-06", "SET-07", views=("market_rows",), sql=f"""WITH b AS (SELECT favorite_side AS s, CAST(round(favorite_ah_line * 4) AS INTEGER) AS ah_q,
  CASE WHEN season IN ('9495','9596','9697','9798') THEN 1 WHEN season IN ('9899','9900') THEN 2 WHEN season IN ('0001','0102') THEN 3 END AS ph, {_AHS} AS sg FROM market_rows),
d AS (SELECT s, ah_q, ph, COUNT(*) FILTER (WHERE sg = 2) AS fw, COUNT(*) FILTER (WHERE sg = 1) AS hw, COUNT(*) FILTER (WHERE sg = 0) AS pu, COUNT(*) FILTER (WHERE sg = -1) AS hl, COUNT(*) FILTER (WHERE sg = -2) AS fl
  FROM b WHERE ph IS NOT NULL GROUP BY ALL),
e AS (SELECT s, ah_q, ph, {_EVC.replace('(o - 1e0)', '(1.95e0 - 1e0)')} AS ev FROM d)
SELECT s AS favorite_side, ah_q, MAX(ev) FILTER (WHERE ph = 1) AS train_ev, MAX(ev) FILTER (WHERE ph = 2) AS validation_ev, MAX(ev) FILTER (WHERE ph = 3) AS holdout_ev,
  CASE WHEN COUNT(*) = 3 THEN MIN(ev) END AS min_phase_ev FROM e GROUP BY s, ah_q""")
def set_06(spark, sf):
    """Expected return of each phase's class distribution at 1.95, and the worst phase."""
    from fairline.operators.patterns import phase_label

    df = V.market_rows(spark, sf).withColumn("phase", phase_label(V.PHASES)).withColumn("st", _ah()["settlement"])
    aggs = [F.count_if((c("phase") == ph) & (c("st") == k)).alias(f"{ph}_{k}") for ph in V.PHASES for k in settlement.CLASSES]
    g = df.groupBy("favorite_side", F.rint(c("favorite_ah_line") * 4).cast("int").alias("ah_q")).agg(*aggs)
    dist = {ph: {k: c(f"{ph}_{k}") for k in settlement.CLASSES} for ph in V.PHASES}
    return g.select("favorite_side", "ah_q", *[settlement.expected_return(dist[ph], F.lit(1.95)).alias(f"{ph}_ev") for ph in V.PHASES],
                    settlement.minimum_phase_return(list(dist.values()), F.lit(1.95)).alias("min_phase_ev"))


# ---- bands and labels -------------------------------------------------------------------------
on_quotes("BKT-01", cols={"lo": lambda: bands.band_lo(bands.bucket_no(c("open_h")), 0.10, 2), "hi": lambda: bands.band_hi(bands.bucket_no(c("open_h")), 0.10, 2)},
          sql="floor(floor((open_h + 1e-9) / 1e-1) * 1e-1 * 1e2 + 0.5e0) / 1e2 AS lo, floor((floor((open_h + 1e-9) / 1e-1) * 1e-1 + 1e-1) * 1e2 + 0.5e0) / 1e2 AS hi")
on_quotes("BKT-02", cols={"lo": lambda: bands.band_lo(bands.band_no(c("open_h"), 0.10), 0.10)},
          sql="floor(trunc(open_h / 1e-1) * 1e-1 * 1e4 + 0.5e0) / 1e4 AS lo")
on_quotes("BKT-03", cols={"lo": lambda: bands.band_lo(bands.floor_band_no(c("open_h"), 0.10), 0.10)},
          sql="floor(floor((open_h + 1e-12) / 1e-1) * 1e-1 * 1e4 + 0.5e0) / 1e4 AS lo")


def label_sql(x):
    return f"""CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN {x} < 1.8e0 THEN '<1.80' WHEN {x} > 2.2e0 THEN '>2.20' WHEN {x} < 1.9e0 THEN '1.80-1.89'
  WHEN {x} < 2e0 THEN '1.90-1.99' WHEN {x} < 2.1e0 THEN '2.00-2.09' ELSE '2.10-2.20' END"""


on_quotes("BKT-04", cols={"x": lambda: bands.price_label(F.when(c("returnflag") != "N", c("ah_home")))}, sql=f"{label_sql('CASE WHEN returnflag <> $$N$$ THEN ah_home END').replace('$$', chr(39))} AS x")
on_quotes("BKT-10", cols={"x": lambda: bands.price_label(c("over_price"))}, sql=f"{label_sql('over_price')} AS x")
on_snapshots("BKT-05", cols={"x": lambda: bands.probability_label(c("fair_probability"))},
             sql="""lpad(CAST(CAST(floor(fair_probability * 100e0 / 5e0) * 5 AS INTEGER) AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST(floor(fair_probability * 100e0 / 5e0) * 5 AS INTEGER) + 4 AS VARCHAR), 2, '0') || '%' AS x""")
_D = "(close_home_line - home_line)"
on_quotes("BKT-06", cols={"x": lambda: lines.quarter_delta((c("close_home_line") - c("home_line")) * (c("qty") % 4)), "off": lambda: lines.quarter_delta(c("open_h") - c("close_h"))},
          sql=f"""CASE WHEN {_D} * (qty % 4) = 0 THEN 'FLAT' ELSE CASE WHEN {_D} * (qty % 4) > 0 THEN 'UP_' ELSE 'DOWN_' END || CASE WHEN abs({_D} * (qty % 4)) >= 0.5e0 THEN '.50_PLUS' ELSE '.25' END END AS x,
  CASE WHEN qty % 5 = 2 THEN 'FLAT' ELSE 'NON_QUARTER_DELTA' END AS off""")
on_quotes("BKT-07", cols={"x": lambda: lines.movement(F.when(c("qty") > 10, c("close_home_line") - c("home_line")).otherwise(c("open_h") - c("close_h")))},
          sql=f"CASE WHEN qty > 10 THEN {_D} WHEN qty % 5 = 2 THEN 0e0 END AS x")
on_quotes("BKT-08", cols={"x": lambda: bands.sample_label(c("qty") * 8), "y": lambda: bands.total_sample_label(c("qty") * 3)},
          sql="""CASE WHEN qty * 8 < 30 THEN 'VERY_LOW' WHEN qty * 8 < 100 THEN 'DEVELOPING' WHEN qty * 8 < 300 THEN 'MODERATE' ELSE 'STRONG_300_PLUS' END AS x,
  CASE WHEN qty * 3 < 20 THEN 'TINY' WHEN qty * 3 < 40 THEN 'EARLY' WHEN qty * 3 < 60 THEN 'DEVELOPING' WHEN qty * 3 < 100 THEN 'MODERATE' ELSE 'LARGE' END AS y""")
on_quotes("BKT-09", cols={"x": lambda: lines.move_label(c("close_home_line") - c("home_line"), "AH"), "y": lambda: lines.move_label(c("close_ou_line") - c("ou_line"), "OU")},
          sql=f"""CASE WHEN {_D} = 0 THEN 'FLAT' WHEN {_D} < 0 THEN 'FAVORITE_STRENGTHENED' ELSE 'FAVORITE_WEAKENED' END AS x,
  CASE WHEN close_ou_line = ou_line THEN 'FLAT' WHEN close_ou_line < ou_line THEN 'TOTAL_DOWN' ELSE 'TOTAL_UP' END AS y""")
_L = "CAST(round(line * 4) AS INTEGER)"
on_snapshots("STR-15", cols={"x": lambda: lines.line_text(c("line"))},
             sql=f"CASE WHEN {_L} % 4 = 0 THEN CAST({_L} // 4 AS VARCHAR) ELSE CAST(line AS VARCHAR) END AS x")
on_snapshots("BKT-12", cols={"x": lambda: F.concat_ws("|", "provider", "bookmaker", "source_semantics", F.coalesce(F.when(c("k") > 50, "OU"), F.lit("AH")), F.lit("FT"))},
             sql="provider || '|' || bookmaker || '|' || source_semantics || '|' || CASE WHEN k > 50 THEN 'OU' ELSE 'AH' END || '|FT' AS x")


@query("BKT-11", "DAT-02", views=("fixtures",), sql="""SELECT fixture_id, season, CASE WHEN season IN ('9495','9596','9697','9798') THEN 'train' WHEN season IN ('9899','9900') THEN 'validation'
  WHEN season IN ('0001','0102') THEN 'holdout' ELSE 'none' END AS phase FROM fixtures""")
def bkt_11(spark, sf):
    return V.fixtures(spark, sf).select("fixture_id", "season", F.coalesce(bands.phase_of(c("season"), V.PHASES), F.lit("none")).alias("phase"))


# ---- statistics -------------------------------------------------------------------------------
@query("STA-04", "STA-07", "STA-08", views=("market_rows",), sql=f"""WITH b AS (SELECT league, {S.profit(_AHS, 'favorite_ah_price')} AS p, {_AHS} AS sg FROM market_rows),
g AS (SELECT league, COUNT(*) AS n, COUNT(*) FILTER (WHERE sg > 0) AS w, {S.sum_micro('p')} AS t, CAST(SUM({S.micro('p')} * {S.micro('p')}) AS DOUBLE) AS sq FROM b GROUP BY league),
v AS (SELECT *, CAST(w AS DOUBLE) / CAST(n AS DOUBLE) AS p, CAST(n AS DOUBLE) AS nn, 1.959963984540054e0 * 1.959963984540054e0 AS z2 FROM g)
SELECT league, n, w AS wins, {S.r('((p + z2 / (2e0 * nn)) / (1e0 + z2 / nn) - 1.959963984540054e0 * sqrt((p * (1e0 - p) + z2 / (4e0 * nn)) / nn) / (1e0 + z2 / nn)) * 100e0', 6)} AS low,
  {S.r('((p + z2 / (2e0 * nn)) / (1e0 + z2 / nn) + 1.959963984540054e0 * sqrt((p * (1e0 - p) + z2 / (4e0 * nn)) / nn) / (1e0 + z2 / nn)) * 100e0', 6)} AS high,
  {S.r('t / 1e6 / (nn + 2e2)', 8)} AS shrunk_roi, {S.r('1.96e0 * (sqrt(sq / nn - (t / nn) * (t / nn)) / 1e6) / sqrt(nn)', 8)} AS detectable_roi FROM v""")
def sta_04(spark, sf):
    from fairline.functions.exact import from_micro, micro

    df = V.market_rows(spark, sf).withColumn("s", _ah())
    m = micro(c("s.profit_units"))
    g = df.groupBy("league").agg(F.count("*").alias("n"), F.count_if(c("s.settlement").isin("FULL_WIN", "HALF_WIN")).alias("wins"),
                                 F.sum(m).alias("t"), F.sum(m * m).cast("double").alias("sq"))
    nn = c("n").cast("double")
    sd = F.sqrt(c("sq") / nn - (c("t") / nn) * (c("t") / nn)) / F.lit(1e6)
    lo, hi = stats.wilson(c("wins"), c("n"))
    return g.select("league", "n", "wins", rnd(lo, 6).alias("low"), rnd(hi, 6).alias("high"),
                    rnd(stats.shrunk_roi(from_micro(c("t")), c("n")), 8).alias("shrunk_roi"), rnd(stats.detectable_roi(sd, c("n")), 8).alias("detectable_roi"))


@query("STA-05", "AGG-28", views=("quotes",), sql="""SELECT line_no, COUNT(*) AS n, MIN(open_h) AS lo, median(open_h) AS mid, MAX(open_h) AS hi,
  quantile_cont(open_h, 2.5e-2) AS q025, quantile_cont(open_h, 9.75e-1) AS q975 FROM quotes GROUP BY line_no""")
def sta_05(spark, sf):
    """Exact distribution summary: min, median, max and interpolated quantiles."""
    return V.quotes(spark, sf).groupBy("line_no").agg(
        F.count("*").alias("n"), F.min("open_h").alias("lo"), F.median("open_h").alias("mid"), F.max("open_h").alias("hi"),
        F.percentile("open_h", 0.025).alias("q025"), F.percentile("open_h", 0.975).alias("q975"))


# ---- times ------------------------------------------------------------------------------------
@query("DAT-01", "FLT-39", sql="""WITH e AS (SELECT event_id, ts, event_id % 5 AS m FROM events)
SELECT event_id, CASE WHEN m IN (0, 1) THEN epoch_us(date_trunc('second', ts)) END AS us,
  CASE m WHEN 2 THEN 'TIMESTAMP_NAIVE' WHEN 3 THEN 'TIMESTAMP_INVALID' WHEN 4 THEN 'TIMESTAMP_MISSING' END AS reason,
  coalesce(m IN (0, 1) AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('second', ts) < TIMESTAMP '2024-01-20', false) AS in_window FROM e""")
def dat_01(spark, sf):
    """Strict parse with reason codes, and a frozen half-open window test."""
    m = c("event_id") % 5
    iso = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    plus7 = F.date_format(c("ts").cast("timestamp") + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(m == 0, F.concat(iso, F.lit("Z"))).when(m == 1, F.concat(plus7, F.lit("+07:00"))).when(m == 2, iso).when(m == 3, "soon"))
    df = V.table(spark, sf, "events").withColumn("t", text).withColumn("at", times.strict_utc(c("t")))
    lo, hi = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return df.select("event_id", F.unix_micros("at").alias("us"),
                     times.timestamp_problem(c("t"), "TIMESTAMP_MISSING", "TIMESTAMP_INVALID", "TIMESTAMP_NAIVE").alias("reason"),
                     F.coalesce((c("at") >= lo) & (c("at") < hi), F.lit(False)).alias("in_window"))


@query("DAT-03", views=("fixtures",), sql="""SELECT fixture_id, CASE WHEN fixture_id % 4 IN (0, 1) THEN season
  WHEN fixture_id % 4 = 2 THEN lpad(CAST(year(match_day) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(match_day) + 1) % 100 AS VARCHAR), 2, '0') ELSE CAST(year(match_day) AS VARCHAR) END AS code FROM fixtures""")
def dat_03(spark, sf):
    m = c("fixture_id") % 4
    y = F.year("match_day").cast("string")
    code = F.when(m == 0, F.concat(c("season"), F.lit(".0"))).when(m == 1, F.concat(F.substring("season", 1, 2), F.lit("/"), F.substring("season", 3, 2)))
    label = F.when(m == 2, F.concat(y, F.lit("-"), F.lit("99")))
    mid = F.concat(y, F.lit("-match-"), c("fixture_id").cast("string"))
    return V.fixtures(spark, sf).select("fixture_id", times.season_from_labels(code, label, mid).alias("code"))


_LOCAL = "(ts + INTERVAL 7 HOURS)"
_FDAY = f"CAST({_LOCAL} - INTERVAL 6 HOURS AS DATE)"


@query("DAT-04", "DAT-05", "STM-16", sql=f"""SELECT event_id, strftime({_FDAY}, '%Y-%m-%d') AS football_day, epoch_us(CAST({_FDAY} AS TIMESTAMP) + INTERVAL 5 HOURS) AS window_start_us,
  epoch_us(CAST({_FDAY} AS TIMESTAMP) + INTERVAL 23 HOURS) AS window_end_us FROM events""")
def dat_04(spark, sf):
    """Football day of an instant and that day's collection window."""
    df = V.table(spark, sf, "events").withColumn("d", times.football_day(c("ts").cast("timestamp")))
    start, end = times.football_window(c("d"))
    return df.select("event_id", c("d").cast("string").alias("football_day"), F.unix_micros(start).alias("window_start_us"), F.unix_micros(end).alias("window_end_us"))


@query("DAT-06", sql="""SELECT event_id, CASE WHEN event_id % 8 < 7 THEN epoch_us(date_trunc('minute', ts)) - 25200000000 END AS us FROM events""")
def dat_06(spark, sf):
    """Local date texts in seven formats; the eighth is not a date."""
    ts = c("ts").cast("timestamp")
    day = None
    for i, f in enumerate(times.LOCAL_FORMATS):
        piece = F.date_format(ts, f.split(" HH")[0])
        day = F.when(c("event_id") % 8 == i, piece) if day is None else day.when(c("event_id") % 8 == i, piece)
    return V.table(spark, sf, "events").select("event_id", F.unix_micros(times.parse_local(day.otherwise("tomorrow"), F.date_format(ts, "HH:mm"))).alias("us"))


@query("DAT-07", "DAT-09", "DAT-10", sql="""WITH d AS (SELECT CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1),
x AS (SELECT d, n, unnest(range(0, CAST(1 + n % 3 AS INTEGER))) AS i FROM d)
SELECT strftime(d, '%Y-%m-%d') AS start_day, strftime(d + CAST(i AS INTEGER), '%Y-%m-%d') AS day, h AS hour,
  epoch_us(CAST(d + CAST(i AS INTEGER) AS TIMESTAMP)) + (h + CASE WHEN h < 6 THEN 24 ELSE 0 END - 7) * 3600000000 AS slot_us,
  epoch_us(CAST(d + CAST(i AS INTEGER) AS TIMESTAMP)) // 1000000 AS first_second, epoch_us(CAST(d + CAST(i AS INTEGER) AS TIMESTAMP)) // 1000000 + 86399 AS last_second
FROM x, (VALUES (0), (15), (18), (21)) v(h)""")
def dat_07(spark, sf):
    """Day ranges expanded to collection slots."""
    d = V.table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    days = d.select("d", F.explode(times.day_range(c("d"), F.date_add("d", (c("n") % 3).cast("int")))).alias("x"))
    slots = days.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in (0, 15, 18, 21)])))
    first, last = times.epoch_window(c("x"))
    return slots.select(c("d").cast("string").alias("start_day"), c("x").cast("string").alias("day"), "hour",
                        F.unix_micros(times.slot_instant(c("x"), c("hour"))).alias("slot_us"), first.alias("first_second"), last.alias("last_second"))


# ---- names ------------------------------------------------------------------------------------
@query("STR-01", "STR-17", sql="""SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g')) AS h,
  CAST(length(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g')) AS INTEGER) AS n FROM documents""")
def str_01(spark, sf):
    """Accent-folded key of whole texts (hashed for transport)."""
    k = names.alnum_key(c("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.md5(k).alias("h"), F.length(k).alias("n"))


_SP = "replace(replace(replace(replace(replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ø', 'o'), 'æ', 'ae'), 'å', 'a'), 'ð', 'd'), 'þ', 'th'), 'ł', 'l'), 'đ', 'd')"


@query("STR-02", sql=f"SELECT conv_id, turn, md5(regexp_replace(strip_accents({_SP}), '[^a-z0-9]+', '', 'g')) AS h FROM conversations")
def str_02(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(names.letter_key(c("text"))).alias("h"))


# Club-like names derived from part names: prefixes, suffixes, reserves, age groups, women's sides.
CLUB_SQL = """clubs AS (SELECT p_partkey AS part_id, CASE p_partkey % 6 WHEN 0 THEN 'FC ' || p_name WHEN 1 THEN p_name || ' Fk.' WHEN 2 THEN 'AC CF ' || p_name || ' II'
  WHEN 3 THEN p_name || ' U' || (17 + p_partkey % 5) WHEN 4 THEN p_name || ' Women' ELSE upper(p_name) END AS club FROM part)"""


def clubs(spark, sf):
    return club_names(V.table(spark, sf, "part"))


def club_names(parts):
    m, n = c("p_partkey") % 6, c("p_name")
    club = (F.when(m == 0, F.concat(F.lit("FC "), n)).when(m == 1, F.concat(n, F.lit(" Fk."))).when(m == 2, F.concat(F.lit("AC CF "), n, F.lit(" II")))
            .when(m == 3, F.concat(n, F.lit(" U"), (F.lit(17) + c("p_partkey") % 5).cast("string"))).when(m == 4, F.concat(n, F.lit(" Women"))).otherwise(F.upper(n)))
    return parts.select(c("p_partkey").alias("part_id"), club.alias("club"))


_K = "regexp_replace(lower(strip_accents(club)), '[^a-z0-9]+', '', 'g')"
_CORE = f"regexp_replace(regexp_replace(regexp_replace({_K}, 'ii$', '2'), '^(fc|fk|cf|sc|sk|ac|cd|ca|bk)+', ''), '(fc|fk|cf|sc|sk|ac|cd|ca|bk|if)+$', '')"
_CK = f"CASE WHEN part_id % 6 IN (3, 4) THEN {_K} ELSE {_CORE} END"


@query("STR-03", "STR-05", "STR-06", "STR-09", sql=f"""WITH {CLUB_SQL} SELECT part_id, {_CK} AS club_key,
  CASE part_id % 6 WHEN 3 THEN 'u' || (17 + part_id % 5) WHEN 4 THEN 'women' END AS category,
  CASE part_id % 6 WHEN 3 THEN regexp_replace({_K}, 'u[0-9][0-9]$', '') WHEN 4 THEN regexp_replace({_K}, 'women$', '') ELSE {_CK} END AS base_key,
  CASE part_id % 6 WHEN 3 THEN 'u' || (17 + part_id % 5) END AS age FROM clubs""")
def str_03(spark, sf):
    club = c("club")
    return clubs(spark, sf).select("part_id", names.club_key(club).alias("club_key"), names.category(club).alias("category"),
                                   names.category_base_key(club, names.category(club)).alias("base_key"), names.age_token(club).alias("age"))


@query("STR-04", sql=f"""WITH {CLUB_SQL}, k AS (SELECT part_id, {_K} AS k FROM clubs),
a AS (SELECT part_id, k AS x FROM k UNION SELECT part_id, substr(k, 1, length(k) - length(t)) FROM k, (VALUES ('footballclub'), ('club'), ('fc'), ('sc')) v(t) WHERE ends_with(k, t) AND length(k) > length(t) + 2
  UNION SELECT part_id, substr(k, length(t) + 1) FROM k, (VALUES ('footballclub'), ('club'), ('fc'), ('sc')) v(t) WHERE starts_with(k, t) AND length(k) > length(t) + 2)
SELECT part_id, string_agg(x, ',' ORDER BY x) AS aliases FROM a GROUP BY part_id""")
def str_04(spark, sf):
    return clubs(spark, sf).select("part_id", F.array_join(names.alias_set(c("club")), ",").alias("aliases"))


# The same names with letters beyond ASCII in front of the part name.
_DECO = ("Preußen", "Bodø", "ﬁnal", "Málaga", "น้ำ", "Ĳsel")
_DECO_SQL = "(CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{w} '" for i, w in enumerate(_DECO)) + " ELSE '' END || p_name)"
_LOW = "replace(replace(replace(replace(lower(club), 'ß', 'ss'), 'ﬁ', 'fi'), 'ĳ', 'ij'), 'á', 'a')"
_DES = "|".join(names.SPELLING_DESIGNATORS)
_EDGES = "replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '{other}', ' ', 'g')), '^(?:(?:" + _DES + ")(?: |$))+', ''), '(?:(?:^| )(?:" + _DES + "))+$', ''), ' ', '')"


@query("STR-07", "STR-08", sql=f"""WITH {CLUB_SQL.replace("p_name", _DECO_SQL)} SELECT part_id, regexp_replace({_LOW}, '[^a-z0-9]+', '', 'g') AS spelling,
  {_EDGES.format(x=_LOW, other="[^a-z0-9]+")} AS club_spelling,
  {_EDGES.format(x="replace(" + _LOW + ", 'ำ', 'ํา')", other=r"[^\p{L}\p{N}\p{M}]+")} AS script_spelling FROM clubs""")
def str_07(spark, sf):
    deco = F.get(F.array(*[F.lit(w + " ") for w in _DECO]), (c("p_partkey") % 7).cast("int"))
    parts = V.table(spark, sf, "part").withColumn("p_name", F.concat(F.coalesce(deco, F.lit("")), c("p_name")))
    return club_names(parts).select("part_id", names.club_spelling(c("club")).alias("spelling"),
                                    names.club_spelling(c("club"), designators=True).alias("club_spelling"), names.script_spelling(c("club")).alias("script_spelling"))


@query("STR-10", "STR-11", "STR-18", views=("market_rows",), sql=f"""WITH l AS (SELECT {QK}, league || '|' || favorite_side || '|AH=' || printf('%+.2f', favorite_ah_line) || '|O' || printf('%.2f', ou_line) AS label FROM market_rows)
SELECT *, 'P_' || upper(substr(sha1(label), 1, 12)) AS pattern_id FROM l""")
def str_10(spark, sf):
    lab = F.concat_ws("|", "league", "favorite_side", F.format_string("AH=%+.2f", "favorite_ah_line"), F.format_string("O%.2f", "ou_line"))
    return V.market_rows(spark, sf).select(*QKEY, lab.alias("label")).withColumn("pattern_id", names.pattern_id("P_", c("label")))


@query("STR-12", sql="SELECT s_suppkey, 'TEAM-' || upper(substr(sha256(lower(trim(s_name))), 1, 12)) AS provisional_id FROM supplier")
def str_12(spark, sf):
    return V.table(spark, sf, "supplier").select("s_suppkey", names.provisional_id("TEAM-", c("s_name")).alias("provisional_id"))


@query("STR-13", views=("fixtures",), sql="SELECT fixture_id, sha1(lower(home) || '|' || lower(away) || '|' || kickoff_us) AS match_key FROM fixtures")
def str_13(spark, sf):
    return V.fixtures(spark, sf).select("fixture_id", names.match_key(c("home"), c("away"), c("kickoff_us").cast("string")).alias("match_key"))


on_snapshots("STR-14", cols={"x": lambda: names.provider_of(
    F.when(c("k") > 60, c("provider")).when(c("k") > 40, "UNKNOWN"),
    F.when(c("k") % 3 == 0, F.concat(F.lit("feed:"), c("fixture_id"))).when(c("k") % 3 == 1, c("fixture_id").cast("string")).otherwise("x-1"), "numeric")},
    sql="CASE WHEN k > 60 THEN provider WHEN k % 3 = 0 THEN 'feed' WHEN k % 3 = 1 THEN 'numeric' ELSE 'UNRESOLVED_PROVIDER' END AS x")


@query("JSN-01", sql="""SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS h FROM supplier""")
def jsn_01(spark, sf):
    """Canonical JSON hash: keys in name order."""
    return V.table(spark, sf, "supplier").select("s_suppkey", names.row_hash("s_suppkey", "s_name", "s_nationkey").alias("h"))


@query("FLT-22", "FLT-03", sql="""WITH t AS (SELECT p_partkey AS part_id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' (Corners)' WHEN 1 THEN ' Women' WHEN 2 THEN ' U-19' WHEN 3 THEN ' (cards)' WHEN 4 THEN ' Youthful' ELSE '' END AS n FROM part)
SELECT part_id, part_id % 7 IN (0, 3) AS derivative, CASE part_id % 7 WHEN 1 THEN 'WOMEN_OUT_OF_SCOPE' WHEN 2 THEN 'YOUTH_OUT_OF_SCOPE' END AS reason FROM t""")
def flt_22(spark, sf):
    """Derivative markets and population scope by explicit name markers."""
    from fairline.operators.filters import population_reason

    m, n = c("p_partkey") % 7, c("p_name")
    tail = (F.when(m == 0, " (Corners)").when(m == 1, " Women").when(m == 2, " U-19").when(m == 3, " (cards)").when(m == 4, " Youthful").otherwise(""))
    df = V.table(spark, sf, "part").select(c("p_partkey").alias("part_id"), F.concat(n, tail).alias("home"))
    return df.select("part_id", names.is_derivative(c("home")).alias("derivative"), population_reason(text=[c("home")]).alias("reason"))
