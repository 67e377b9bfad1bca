"""Receipts, contracts of evidence and publishing, catalog gaps, scoped alias matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.functions import names
from fairline.operators import identity, receipts
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col

# One stored response per observation: its window, whether it was filtered, up to when it is complete.
_RC = """rc AS (SELECT event_id, league, observed_us AS fetched_us, observed_us // 86400000000 * 86400000000 AS window_us, 1 + k % 3 AS window_days, k % 4 = 0 AS filtered, k % 5 <> 0 AS complete,
  observed_us + (k % 7 - 3) * 3600000000 AS complete_us, 'payload ' || (k % 17) AS payload FROM snapshots)"""


def responses(spark, sf):
    k, t = c("k"), c("observed_us")
    return V.snapshots(spark, sf).select(
        "event_id", "league", t.alias("fetched_us"), (V.div(t, V.DAY_US) * V.DAY_US).alias("window_us"), (1 + k % 3).alias("window_days"), (k % 4 == 0).alias("filtered"), (k % 5 != 0).alias("complete"),
        (t + (k % 7 - 3) * F.lit(V.HOUR_US)).alias("complete_us"), F.concat(F.lit("payload "), k % 17).alias("payload"))


@query("SRC-24", views=("snapshots",), sql=f"""WITH {_RC} SELECT league, window_us, event_id, fetched_us, sha256(payload) AS content_hash FROM rc WHERE complete_us >= window_us + 43200000000
  QUALIFY row_number() OVER (PARTITION BY league, window_us ORDER BY fetched_us DESC, event_id DESC) = 1""")
def src_24(spark, sf, hours: int = 12):
    """Newest stored response of a request that is complete through the required instant (hours into the window), by content hash."""
    r = responses(spark, sf).withColumn("content_hash", receipts.content_hash(c("payload")))
    return receipts.newest(r, ["league", "window_us"], c("complete_us") >= c("window_us") + hours * V.HOUR_US, ["fetched_us", "event_id"], ["event_id", "fetched_us", "content_hash"])


@query("SRC-26", views=("snapshots",), sql=f"""WITH {_RC} SELECT league, window_us, event_id, (window_us + 86400000000 - fetched_us) // 3600000000 AS age_hours FROM rc
  WHERE window_days = 1 AND complete AND window_us + 86400000000 - fetched_us BETWEEN 0 AND 64800000000 QUALIFY row_number() OVER (PARTITION BY league, window_us ORDER BY fetched_us DESC, event_id DESC) = 1""")
def src_26(spark, sf, most_hours: int = 18):
    """Schedule receipt for an exact one-day window: newest complete one, at most most_hours old at the window's end."""
    age = c("window_us") + V.DAY_US - c("fetched_us")
    r = responses(spark, sf).withColumn("age_hours", V.div(age, V.HOUR_US))
    usable = (c("window_days") == 1) & c("complete") & age.between(0, most_hours * V.HOUR_US)
    return receipts.newest(r, ["league", "window_us"], usable, ["fetched_us", "event_id"], ["event_id", "age_hours"])


@query("JON-45", views=("snapshots",), sql=f"""WITH {_RC}, t AS (SELECT DISTINCT league, window_us FROM rc), n AS (SELECT league, window_us, event_id FROM rc WHERE NOT filtered AND window_days = 2 QUALIFY row_number() OVER (PARTITION BY league, window_us ORDER BY fetched_us DESC, event_id DESC) = 1)
SELECT league, window_us, event_id, CASE WHEN event_id IS NULL THEN 'NO_SCHEDULE_RESPONSE' END AS reason FROM t LEFT JOIN n USING (league, window_us)""")
def jon_45(spark, sf, days: int = 2):
    """Newest unfiltered schedule response for an exact window; windows without one say so."""
    r = responses(spark, sf)
    n = receipts.newest(r, ["league", "window_us"], ~c("filtered") & (c("window_days") == days), ["fetched_us", "event_id"], ["event_id"])
    return r.select("league", "window_us").distinct().join(n, ["league", "window_us"], "left").withColumn("reason", F.when(c("event_id").isNull(), "NO_SCHEDULE_RESPONSE"))


@query("FLT-15", views=("fixtures",), sql="""WITH e AS (SELECT fixture_id, CASE WHEN fixture_id % 11 <> 0 THEN home END AS home, away, kickoff_us AS kickoff, fixture_id % 6 - CASE WHEN fixture_id % 13 = 0 THEN 7 ELSE 0 END AS hg, fixture_id % 4 AS ag,
  CASE WHEN fixture_id % 7 = 0 THEN 'http://' ELSE 'https://' END || league AS url, CASE WHEN fixture_id % 17 = 0 THEN '' ELSE season END AS retrieved_at, CASE fixture_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'aet' ELSE 'ft' END AS status FROM fixtures)
SELECT fixture_id, CASE WHEN home IS NULL OR retrieved_at = '' THEN 'MISSING_REQUIRED_FIELD' WHEN least(hg, ag) < 0 THEN 'INVALID_FT_SCORE' WHEN NOT starts_with(url, 'https://') THEN 'INVALID_SOURCE_URL' WHEN upper(coalesce(status, '')) <> 'FT' THEN 'RESULT_NOT_FINAL' ELSE 'VALID' END AS verdict FROM e""")
def flt_15(spark, sf):
    """Required fields of evidence items, one of each kind of damage among them."""
    i = c("fixture_id")
    item = {
        "fixture_id": i, "home": F.when(i % 11 != 0, c("home")), "away": c("away"), "kickoff": c("kickoff_us"), "ft_home_goals": i % 6 - F.when(i % 13 == 0, 7).otherwise(0), "ft_away_goals": i % 4,
        "source_url": F.concat(F.when(i % 7 == 0, "http://").otherwise("https://"), c("league")), "retrieved_at": F.when(i % 17 == 0, "").otherwise(c("season")), "status": F.when(i % 5 == 0, None).when(i % 5 == 1, "aet").otherwise("ft"),
    }
    return V.fixtures(spark, sf).select("fixture_id", receipts.required_fields(item).alias("verdict"))


@query("FLT-28", sql="""WITH o AS (SELECT user_id * 20 AS id, COUNT(*) AS n FROM events GROUP BY 1), m AS (SELECT MAX(c_custkey) AS top FROM customer), k AS (SELECT DISTINCT c_custkey AS id, true AS hit FROM customer WHERE c_custkey IS NOT NULL)
SELECT CASE WHEN hit THEN 'KNOWN' WHEN id <= top THEN 'MISSING_IN_RANGE' ELSE 'BEYOND_CATALOG' END AS class, COUNT(*) AS ids, CAST(SUM(n) AS BIGINT) AS observations FROM o LEFT JOIN k USING (id), m GROUP BY 1""")
def flt_28(spark, sf):
    """Gap classes of observed ids against a catalog, with all ids and observations counted."""
    seen = V.table(spark, sf, "events").select((c("user_id") * 20).alias("id"))
    return receipts.gap_classes(seen, V.table(spark, sf, "customer").select(c("c_custkey").alias("id")), "id")


@query("JON-42", sql="""WITH a AS (SELECT p_brand AS competition, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k, p_partkey AS canonical FROM part), g AS (SELECT competition, k, COUNT(DISTINCT canonical) AS n, MIN(canonical) AS one FROM a GROUP BY ALL),
l AS (SELECT p_partkey AS part_id, CASE WHEN p_partkey % 10 = 0 THEN 'elsewhere' ELSE p_brand END AS competition, regexp_replace(lower(upper(p_name)), '[^a-z0-9]+', '', 'g') AS k FROM part)
SELECT part_id, CASE WHEN n = 1 THEN one END AS canonical, coalesce(n, 0) AS matches, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n > 1 THEN 'AMBIGUOUS' END AS reason FROM l LEFT JOIN g USING (competition, k)""")
def jon_42(spark, sf):
    """Reviewed aliases, valid within their competition only; several owners of an alias there match nobody."""
    p = V.table(spark, sf, "part")
    aliases = p.select(c("p_brand").alias("competition"), names.alnum_key(c("p_name")).alias("k"), c("p_partkey").alias("canonical"))
    left = p.select(c("p_partkey").alias("part_id"), F.when(c("p_partkey") % 10 == 0, "elsewhere").otherwise(c("p_brand")).alias("competition"), names.alnum_key(F.upper("p_name")).alias("k"))
    return identity.unique_match(left, aliases, ["competition", "k"], "part_id", "canonical")


@query("JON-43", sql="""WITH x AS (SELECT p_partkey AS part_id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' U19' WHEN 1 THEN ' FC' ELSE '' END AS a, CASE WHEN p_partkey % 7 = 0 THEN 'New ' ELSE '' END || p_name AS b, p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' U19' ELSE ' Cup' END AS league FROM part),
y AS (SELECT part_id, regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') AS b, CASE WHEN regexp_matches(lower(league), '(^|[^a-z0-9])u19($|[^a-z0-9])') THEN 'u19' END AS age FROM x)
SELECT part_id, a = b OR regexp_replace(a, 'fc$', '') = b OR coalesce(a = b || age OR b = a || age, false) AS same_team FROM y""")
def jon_43(spark, sf):
    """Teams named with an age group on one side only are the same in a league of that age group."""
    i, n = c("p_partkey"), c("p_name")
    a = F.concat(n, F.when(i % 3 == 0, " U19").when(i % 3 == 1, " FC").otherwise(""))
    b = F.concat(F.when(i % 7 == 0, "New ").otherwise(""), n)
    league = F.concat(c("p_brand"), F.when(i % 4 == 0, " U19").otherwise(" Cup"))
    return V.table(spark, sf, "part").select(i.alias("part_id"), receipts.same_team_in_league(a, b, league).alias("same_team"))


def _proof_sql(name, where):
    return f"""{name}g AS (SELECT home AS team, COUNT(DISTINCT away) = 1 AND COUNT(*) >= 2 AS ok, MIN(away) AS nm FROM fixtures {where} GROUP BY home),
{name}o AS (SELECT away AS nm, COUNT(DISTINCT home) = 1 AS own FROM fixtures {where} GROUP BY away), {name} AS (SELECT team, true AS hit FROM {name}g JOIN {name}o USING (nm) WHERE ok AND own)"""


@query("JON-48", views=("fixtures",), sql=f"""WITH {_proof_sql("a", "WHERE season < '9899'")}, {_proof_sql("b", "")}
SELECT team, CASE WHEN a.hit IS NULL THEN 'NEW' WHEN b.hit IS NULL THEN 'LOST' ELSE 'KEPT' END AS state FROM a FULL JOIN b USING (team)""")
def jon_48(spark, sf):
    """Extra evidence may not change what was proven: proofs of the earlier seasons against proofs of all."""
    f = V.fixtures(spark, sf)
    return receipts.proof_changes(_proof(f.filter(c("season") < "9899")), _proof(f), "team")


def _proof(f):
    e = f.select(c("home").alias("team"), c("away").alias("nm"))
    g = e.groupBy("team").agg(F.count("*").alias("n"), F.min("nm").alias("nm"), F.max("nm").alias("hi"))
    o = e.groupBy("nm").agg(F.min("team").alias("t1"), F.max("team").alias("t2"))
    return g.join(o, "nm").select("team", ((c("nm") == c("hi")) & (c("t1") == c("t2")) & (c("n") >= 2)).alias("proven"))


@query("JON-49", sql="""SELECT p_type AS provider_competition, n_name AS competition, COUNT(*) AS rows FROM part JOIN nation ON n_nationkey = p_size % 30 WHERE n_regionkey <> 4 GROUP BY ALL""")
def jon_49(spark, sf):
    """Provider competitions registry: the mapping joined to the approved competitions; others drop out."""
    m = V.table(spark, sf, "part").select(c("p_type").alias("provider_competition"), (c("p_size") % 30).cast("int").alias("n_nationkey"))
    ok = V.table(spark, sf, "nation").filter("n_regionkey <> 4").select(c("n_nationkey").cast("int").alias("n_nationkey"), c("n_name").alias("competition"))
    return m.join(ok, "n_nationkey").groupBy("provider_competition", "competition").agg(F.count("*").alias("rows"))


@query("GAT-17", views=("snapshots",), sql="""SELECT provider, COUNT(*) AS observations, COUNT(*) FILTER (WHERE NOT mainline_verified) AS untrusted, COUNT(DISTINCT CASE WHEN league IN ('L3', 'L7') THEN fixture_id END) AS excluded_ids,
  COUNT(DISTINCT CASE WHEN mainline_verified AND league NOT IN ('L3', 'L7') THEN fixture_id END) AS population FROM snapshots GROUP BY provider""")
def gat_17(spark, sf, excluded=("L3", "L7")):
    """Population receipt of each source: untrusted observations, excluded ids, and what remains."""
    out = c("league").isin(*excluded)
    f = V.snapshots(spark, sf).groupBy("provider", "fixture_id").agg(F.count("*").alias("n"), F.count_if(~c("mainline_verified")).alias("u"), F.max(out).alias("x"), F.count_if(c("mainline_verified") & ~out).alias("p"))
    return f.groupBy("provider").agg(F.sum("n").alias("observations"), F.sum("u").alias("untrusted"), F.count_if("x").alias("excluded_ids"), F.count_if(c("p") > 0).alias("population"))
