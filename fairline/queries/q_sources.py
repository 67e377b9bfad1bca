"""Scans, sinks, upserts and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import prices
from fairline.operators import results
from fairline.queries.registry import query
from fairline.sources import files
from fairline.sources import views as V

c = F.col
QKEY = ["fixture_id", "line_no", "part_id", "supp_id", "qty"]


# ---- CSV --------------------------------------------------------------------------------------
@query("SRC-01", sql="""WITH x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' ELSE 'latin-1' END AS encoding, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS cents FROM customer)
SELECT c_custkey AS id, encoding, 'Café ' || CASE encoding WHEN 'utf-8' THEN '日本' WHEN 'cp1252' THEN '€' ELSE chr(129) END || ', "' || c_custkey || '"' AS name, CASE WHEN c_custkey % 7 <> 0 THEN cents END AS cents FROM x""")
def src_01(spark, sf):
    """Files in three encodings, with headers of their own: each decoded by the first encoding that fits it."""
    path, k = files.scratch(spark), c("c_custkey")
    cents = F.when(k % 7 != 0, F.floor(c("c_acctbal") * 100 + 0.5).cast("long").cast("string"))
    t = V.table(spark, sf, "customer").select(k.cast("string").alias("id"), F.concat(F.lit("Café "), F.when(k % 3 == 0, "日本").when(k % 3 == 1, "\x80").otherwise("\x81"), F.lit(', "'), k.cast("string"), F.lit('"')).alias("name"), cents.alias("cents"), (k % 3).alias("m"))
    write = lambda m, cols, enc: t.filter(c("m") == m).select(*cols).write.csv(f"{path}/{enc}-{m}", header=True, escape='"', encoding=enc)
    write(0, ["id", "name", "cents"], "UTF-8")
    write(1, [c("cents").alias("Amount"), c("name").alias("Name"), c("id").alias("Key")], "ISO-8859-1")
    write(2, [c("name").alias("Name"), c("id").alias("Key"), c("cents").alias("Amount")], "ISO-8859-1")
    df = files.read_encoded_csv(spark, path, {"id": ["id", "Key"], "name": ["name", "Name"], "cents": ["cents", "Amount"]})
    return df.select(c("id").try_cast("bigint").alias("id"), "encoding", "name", c("cents").try_cast("bigint").alias("cents"))


@query("SRC-01Q", sql="SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS h FROM conversations")
def src_01q(spark, sf):
    """Quoted text with line breaks written as CSV and read back with an explicit all-string schema."""
    path = files.scratch(spark)
    V.table(spark, sf, "conversations").select(c("conv_id").cast("string"), c("turn").cast("string"), "text").write.csv(path, header=True, quoteAll=True, escape='"')
    df = files.non_empty(files.read_text_csv(spark, path, ["conv_id", "turn", "text"], multi_line=True))
    return df.select(c("conv_id").try_cast("bigint").alias("conv_id"), c("turn").try_cast("bigint").alias("turn"), F.length("text").alias("n_chars"), F.md5("text").alias("h"))


@query("SRC-02", views=("market_rows", "results"), sql="""WITH r AS (SELECT fixture_id, MIN(ft_home_goals) AS h FROM results GROUP BY fixture_id)
SELECT season, COUNT(*) AS rows, COUNT(h) AS matched, COUNT(*) - COUNT(h) AS unmatched, COUNT(*) >= 300 AS complete_season FROM market_rows LEFT JOIN r USING (fixture_id) GROUP BY season""")
def src_02(spark, sf):
    """Odds joined to results on match id; unmatched rows counted; a season needs 300 rows."""
    r = results.valid(V.results(spark, sf)).groupBy("fixture_id").agg(F.min("ft_home_goals").alias("h"))
    j = V.market_rows(spark, sf).select("fixture_id", "season").join(r, "fixture_id", "left")
    return j.groupBy("season").agg(F.count("*").alias("rows"), F.count("h").alias("matched"), F.count_if(c("h").isNull()).alias("unmatched")).withColumn("complete_season", c("rows") >= 300)


@query("SRC-03", views=("market_rows",), sql="""WITH x AS (SELECT *, CASE WHEN qty = 7 THEN 'BAD_NUMBER' WHEN qty = 11 THEN 'OFF_GRID_LINE' END AS reason FROM market_rows WHERE league IN ('NATION_1', 'NATION_2', 'NATION_3'))
SELECT league AS division, season, coalesce(reason, 'OK') AS reason, CASE WHEN qty = 7 THEN '?' ELSE favorite_side END AS favorite_side, COUNT(*) AS n FROM x GROUP BY ALL""")
def src_03(spark, sf):
    """Multi-league CSV round trip: some rows carry a broken number or an averaged line."""
    path = files.scratch(spark)
    m = V.market_rows(spark, sf)
    text = lambda x: c(x).cast("string")
    m.select(
        c("league").alias("Division"), c("match_day").cast("string").alias("MatchDate"), c("home").alias("HomeTeam"), c("away").alias("AwayTeam"),
        text("home_goals").alias("FTHome"), text("away_goals").alias("FTAway"), text("open_h").alias("OddHome"),
        F.when(c("qty") == 7, "n/a").otherwise(text("open_d")).alias("OddDraw"), text("open_a").alias("OddAway"), text("over_price").alias("Over25"), text("under_price").alias("Under25"),
        F.when(c("qty") == 11, "-0.30").otherwise(text("home_line")).alias("HandiSize"), text("ah_home").alias("HandiHome"), text("ah_away").alias("HandiAway"),
    ).write.csv(path, header=True)
    rows = files.league_rows(files.read_text_csv(spark, path, files.LEAGUE_FILE), ["NATION_1", "NATION_2", "NATION_3"], "0000", "9999")
    # The favourite of a broken row is unknown to the reader, so it is taken from the valid sides only.
    side = F.coalesce("favorite_side", F.lit("?"))
    return rows.groupBy("division", "season", F.coalesce("reason", F.lit("OK")).alias("reason"), side.alias("favorite_side")).agg(F.count("*").alias("n"))


@query("SRC-04", "SRC-18", views=("market_rows",), sql="""WITH g AS (SELECT season, league, COUNT(*) AS rows, COUNT(*) FILTER (WHERE favorite_ah_price BETWEEN 1.5e0 AND 2.5e0) AS kept_rows FROM market_rows WHERE league IN ('NATION_1', 'NATION_2') GROUP BY ALL),
e AS (SELECT season, league FROM (SELECT DISTINCT season FROM market_rows) , (VALUES ('NATION_1'), ('NATION_2'), ('NATION_99')) v(league))
SELECT season, league, CASE WHEN rows IS NULL THEN 'MISSING' ELSE 'OK' END AS status, coalesce(rows, 0) AS rows, coalesce(kept_rows, 0) AS kept_rows, rows IS NOT NULL AS hashed FROM e LEFT JOIN g USING (season, league)""")
def src_04(spark, sf):
    """Directory scan season x league against an expected manifest, with the sha256 of its files."""
    path = files.scratch(spark)
    m = V.market_rows(spark, sf)
    m.select("season", "league", "favorite_ah_price").write.partitionBy("season", "league").csv(path, header=True)
    raw = spark.read.schema("favorite_ah_price string, season string, league string").csv(path, header=True)
    seasons = V.fixtures(spark, sf).select("season").distinct()
    expected = seasons.withColumn("league", F.explode(F.array(F.lit("NATION_1"), F.lit("NATION_2"), F.lit("NATION_99"))))
    key = lambda k: F.regexp_extract("path", f"{k}=([^/]+)/", 1).alias(k)
    hashes = files.file_hashes(spark, path).select(key("season"), key("league"), "sha256").groupBy("season", "league").agg(F.min(F.length("sha256") == 64).alias("hashed"))
    manifest = files.scan_manifest(raw, expected, prices.research_price(prices.number(c("favorite_ah_price"))), ["season", "league"])
    return manifest.join(hashes, ["season", "league"], "left").withColumn("hashed", F.coalesce("hashed", F.lit(False)))


# ---- JSON lines -------------------------------------------------------------------------------
@query("SRC-06", sql="""SELECT event_id, user_id, CASE WHEN event_id % 5 <> 1 THEN CAST(event_id % 7 AS BIGINT) END AS goals FROM events WHERE event_id % 5 NOT IN (2, 3)""")
def src_06(spark, sf):
    """Malformed and non-object lines skipped; a mistyped score reads as null and keeps its row."""
    path = files.scratch(spark)
    m = c("event_id") % 5
    good = F.concat(F.lit('{"event_id":'), c("event_id"), F.lit(',"user_id":'), c("user_id"), F.lit(',"goals":'),
                    F.when(m == 1, F.concat(F.lit('"'), c("event_id") % 7, F.lit('"'))).otherwise((c("event_id") % 7).cast("string")), F.lit("}"))
    line = F.when(m == 2, F.lit("{broken")).when(m == 3, F.lit("[1, 2]")).otherwise(good)
    V.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id bigint, user_id bigint, goals bigint")


@query("SRC-07", sql="SELECT event_id, user_id, event_type FROM events")
def src_07(spark, sf):
    path = files.scratch(spark)
    V.table(spark, sf, "events").select("event_id", "user_id", "event_type").write.json(path)
    return files.read_jsonl_strict(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("SRC-08", "SRC-09", "SRC-11", "STO-01", sql="""SELECT CASE WHEN event_id % 9 = 0 THEN 'unknown-date' ELSE strftime(ts, '%Y-%m-%d') END AS kickoff_day, event_type, COUNT(*) AS n FROM events GROUP BY ALL
  UNION ALL SELECT 'legacy', event_type, COUNT(*) FROM events WHERE value > 20 GROUP BY event_type""")
def src_08(spark, sf):
    """Two appends into day shards plus the legacy table, read as one."""
    path = files.scratch(spark)
    iso = F.concat(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("event_id") % 9 != 0, F.lit("Z")).otherwise(F.lit("")))
    e = V.table(spark, sf, "events").withColumn("kickoff", iso).select("event_id", "event_type", "kickoff", "value")
    for half in (c("value") <= 10, c("value") > 10):
        files.write_shards(e.filter(half), path, c("kickoff"))
    legacy = e.filter(c("value") > 20).select("event_id", "event_type", F.lit("legacy").alias("kickoff_day"))
    day = F.when(c("kickoff_day").cast("string") == "unknown-date", "unknown-date").otherwise(c("kickoff_day").cast("string"))
    shards = files.read_shards(spark, path).withColumn("kickoff_day", day)
    return legacy.unionByName(shards, allowMissingColumns=True).groupBy("kickoff_day", "event_type").agg(F.count("*").alias("n"))


# ---- unions and upserts -----------------------------------------------------------------------
@query("SRC-12", "SRC-13", "STO-02", "STM-08", sql="""SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE value > 3 UNION SELECT user_id, event_type, CAST(floor(value) AS BIGINT) FROM events WHERE value < 12""")
def src_12(spark, sf):
    """Two overlapping copies; exact duplicates fall together, divergent rows stay."""
    e = V.table(spark, sf, "events").select("user_id", "event_type", F.floor("value").alias("v"), "value")
    return results.exact_union(e.filter("value > 3").drop("value"), e.filter("value < 12").drop("value"))


def _upsert(ids, keys, sql_keys):
    @query(*ids, views=("snapshots",), sql=f"""WITH t AS (SELECT *, CASE WHEN provider IN ('view', 'click') THEN 1 ELSE 0 END AS src FROM snapshots),
      r AS (SELECT {sql_keys}, event_id, price, line, row_number() OVER (PARTITION BY {sql_keys} ORDER BY src DESC, event_id DESC) AS rn FROM t) SELECT {sql_keys}, event_id, price, line FROM r WHERE rn = 1""")
    def run(spark, sf):
        s = V.snapshots(spark, sf).select(*keys, "event_id", "price", "line", "provider")
        new = c("provider").isin("view", "click")
        return results.upsert(s.filter(~new).drop("provider"), s.filter(new).drop("provider"), keys, "event_id")


_upsert(["SRC-14", "SRC-31"], ["fixture_id", "observed_us"], "fixture_id, observed_us")
_upsert(["SRC-15"], ["league", "fixture_id"], "league, fixture_id")
_upsert(["SRC-16"], ["fixture_id"], "fixture_id")


@query("SRC-17", "SRC-25", views=("snapshots",), sql="""SELECT league AS report, provider, max_by(k, CAST(observed_us AS HUGEINT) * 100000 + event_id) AS payload, MAX(observed_us) AS generated_us FROM snapshots WHERE observed_us >= 1704800000000000 GROUP BY ALL""")
def src_17(spark, sf):
    """Newest state per (report, provider) among responses complete through the required instant."""
    s = V.snapshots(spark, sf).filter(c("observed_us") >= 1_704_800_000_000_000)
    return s.groupBy(c("league").alias("report"), "provider").agg(F.max_by("k", F.struct("observed_us", "event_id")).alias("payload"), F.max("observed_us").alias("generated_us"))


@query("SRC-32", views=("snapshots",), sql="""SELECT fixture_id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS rounds, COUNT(DISTINCT provider) AS n FROM snapshots GROUP BY fixture_id""")
def src_32(spark, sf):
    """Attempt ledgers of two runs merged: each round id once per fixture (distinct pairs first, then a short list)."""
    s = V.snapshots(spark, sf).select("fixture_id", "provider")
    pairs = s.filter("fixture_id % 2 = 0").union(s).distinct()
    g = pairs.groupBy("fixture_id").agg(F.array_sort(F.collect_set("provider")).alias("r"))
    return g.select("fixture_id", F.array_join("r", ",").alias("rounds"), F.size("r").cast("long").alias("n"))


# ---- publishing -------------------------------------------------------------------------------
_PUB = """WITH x AS (SELECT fixture_id, provider, MAX(event_id) AS event_id FROM snapshots GROUP BY ALL), inc AS (SELECT fixture_id, provider, event_id % 10 AS v FROM x WHERE provider <> 'error'),
old AS (SELECT fixture_id, provider, CASE WHEN fixture_id % 3 = 0 THEN event_id % 10 + 1 ELSE event_id % 10 END AS v FROM x WHERE provider IN ('view', 'click', 'error')),
p AS (SELECT inc.*, CASE WHEN old.v IS NULL THEN 'NEW' WHEN old.v = inc.v THEN 'UNCHANGED' ELSE 'CONFLICT' END AS action FROM inc LEFT JOIN old USING (fixture_id, provider))"""


def _pub(spark, sf):
    x = V.snapshots(spark, sf).groupBy("fixture_id", "provider").agg(F.max("event_id").alias("event_id"))
    inc = x.filter("provider <> 'error'").select("fixture_id", "provider", (c("event_id") % 10).alias("v"))
    old = x.filter(c("provider").isin("view", "click", "error")).select("fixture_id", "provider", (c("event_id") % 10 + F.when(c("fixture_id") % 3 == 0, 1).otherwise(0)).alias("v"))
    return old, inc


@query("SRC-29", views=("snapshots",), sql=_PUB + " SELECT * FROM p")
def src_29(spark, sf):
    """Insert-only publish plan by slot key: new, unchanged or conflict."""
    old, inc = _pub(spark, sf)
    return results.publish_plan(old, inc, ["fixture_id", "provider"], ["v"])


@query("SRC-27", "NRM-44", "NRM-45", views=("snapshots",), sql=_PUB + " SELECT fixture_id, provider, v, false AS archived FROM inc UNION ALL SELECT fixture_id, provider, v, EXISTS (SELECT 1 FROM inc WHERE inc.fixture_id = old.fixture_id AND inc.provider = old.provider) FROM old")
def src_27(spark, sf):
    """Reviewed rows replace stored rows of their key; replaced rows go to the archive."""
    old, inc = _pub(spark, sf)
    keys = ["fixture_id", "provider"]
    flagged = old.join(inc.select(*keys, F.lit(True).alias("hit")), keys, "left").select(*keys, "v", F.coalesce("hit", F.lit(False)).alias("archived"))
    return inc.withColumn("archived", F.lit(False)).unionByName(flagged)


# ---- current-market CSV, pages ----------------------------------------------------------------
@query("SRC-20", views=("quotes",), sql="""SELECT fixture_id, line_no, part_id, supp_id, qty, 'Team ' || part_id AS home, 'Side ' || supp_id AS away, CASE WHEN qty % 4 = 0 THEN NULL ELSE home_line END AS line, CASE WHEN returnflag <> 'A' THEN ah_home END AS price FROM quotes""")
def src_20(spark, sf):
    q = V.quotes(spark, sf).select(
        *QKEY, F.concat(F.lit("Team "), c("part_id"), F.when(c("qty") % 2 == 0, " vs ").otherwise("  V. "), F.lit("Side "), c("supp_id")).alias("event"),
        F.when(c("qty") % 4 == 0, (c("home_line") + 0.1).cast("string")).otherwise(c("home_line").cast("string")).alias("line_text"),
        F.when(c("returnflag") == "A", "susp").otherwise(c("ah_home").cast("string")).alias("price_text"))
    return files.current_market_rows(q).select(*QKEY, "home", "away", "line", "price")


@query("SRC-21", sql=r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'FINAL_URL_ID_MISMATCH' WHEN page_id % 3 = 2 THEN 'SCORE_NOT_FOUND' WHEN page_id % 40 > 30 THEN 'SCORE_OUT_OF_RANGE' END AS reason,
  CASE WHEN page_id % 3 = 0 AND page_id % 40 <= 30 THEN CAST(page_id % 40 AS INTEGER) END AS ft_home_goals, CASE WHEN page_id % 3 = 0 AND page_id % 40 <= 30 THEN CAST(page_id % 4 AS INTEGER) END AS ft_away_goals FROM p""")
def src_21(spark, sf):
    """Result pages: each page with a score title prepended and an id in its URL, checked against the expected id."""
    pid = c("page_id")
    tag = F.when(pid % 3 != 2, F.concat(F.lit('<meta property="og:title" content="Home - Away '), pid % 40, F.lit(":"), pid % 4, F.lit('">'))).otherwise(F.lit(""))
    pages = V.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?mid="), pid).alias("url"), F.concat(tag, c("html")).alias("html"))
    refs = V.table(spark, sf, "pages").select("page_id", F.when(pid % 3 == 1, "other").otherwise(pid.cast("string")).alias("expected_id"))
    return files.page_results(pages, refs)


@query("SRC-22", sql=r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS json_ld_blocks, CASE WHEN page_id % 2 = 0 THEN 'SportsEvent' ELSE '' END AS json_ld_types, 0 AS og_properties,
  CAST(len(regexp_extract_all(html, '(?i)<script')) + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS scripts, CAST(len(regexp_extract_all(html, '(?i)<a ')) AS INTEGER) AS links FROM pages""")
def src_22(spark, sf):
    ld = F.when(c("page_id") % 2 == 0, F.lit('<script type="application/ld+json">{"@type": "SportsEvent"}</script>')).otherwise(F.lit(""))
    return files.page_inventory(V.table(spark, sf, "pages").withColumn("html", F.concat(ld, c("html"))))
