"""Scope of competitions: exclusions, allow-list, replay by day and feed, target lists and hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import scope, textsearch
from fairline.queries.registry import query
from fairline.sources import views as V

c = F.col

# Fixtures as a feed lists them: ids that are missing, unknown or of another feed, names with the country in front, countries in other spellings.
_ROWS = """listed AS (SELECT fixture_id, match_day, CASE WHEN priority IN ('1', '2') THEN 'north' ELSE 'south' END AS provider, CASE WHEN fixture_id % 9 = 0 THEN NULL WHEN fixture_id % 13 = 0 THEN '999' ELSE substr(league, 8) END AS tournament_id,
  CASE WHEN fixture_id % 4 = 0 THEN 'Region' || region || ' - ' || upper(league) ELSE league END AS league, CASE WHEN fixture_id % 4 = 0 THEN NULL WHEN fixture_id % 17 = 0 THEN 'ELSEWHERE' WHEN fixture_id % 5 = 0 THEN 'region' || region ELSE 'Region' || region END AS country,
  CASE WHEN fixture_id % 7 = 0 THEN 'C' || substr(league, 8) WHEN fixture_id % 19 = 0 THEN 'C-1' END AS canonical FROM fixtures)"""
# Excluded: some by the id of one feed, some by name; approved: most leagues, verified in one feed or in both, one with two targets.
_BIND = """bind AS (SELECT 'north' AS provider, CAST(n_nationkey AS VARCHAR) AS provider_id, 'Region' || n_regionkey AS provider_country, 'Old ' || n_name AS provider_name, CASE WHEN n_nationkey % 8 = 3 THEN n_name ELSE 'Canonical' END AS canonical_name FROM nation WHERE n_nationkey % 4 = 3)"""
_MAPS = """maps AS (SELECT p AS provider, CAST(n_nationkey AS VARCHAR) AS provider_id, 'C' || n_nationkey AS canonical_id, NOT (p = 'south' AND n_nationkey % 5 = 1) AS verified FROM nation, (VALUES ('north'), ('south')) v(p) UNION ALL SELECT 'north', '6', 'C7', true),
approved AS (SELECT 'C' || n_nationkey AS canonical_id FROM nation WHERE n_nationkey % 6 <> 2), lands AS (SELECT 'C' || n_nationkey AS canonical_id, 'REGION' || n_regionkey AS country FROM nation)"""
_EXCL = f"""{_ROWS}, {_BIND}, sp AS (SELECT *, CASE WHEN coalesce(country, '') = '' AND contains(league, ' - ') THEN split_part(league, ' - ', 1) ELSE country END AS land, CASE WHEN coalesce(country, '') = '' AND contains(league, ' - ') THEN split_part(league, ' - ', 2) ELSE league END AS nm FROM listed),
ex AS (SELECT fixture_id, EXISTS (SELECT 1 FROM bind b WHERE b.provider = sp.provider AND b.provider_id = sp.tournament_id OR lower(b.provider_country) = lower(sp.land) AND lower(trim(sp.nm)) IN (lower(b.provider_name), lower(b.canonical_name))) AS excluded FROM sp)"""
_ALLOW = f"""{_MAPS}, m1 AS (SELECT provider, provider_id, MIN(canonical_id) AS cid FROM maps WHERE verified AND canonical_id IN (SELECT canonical_id FROM approved) GROUP BY ALL HAVING MIN(canonical_id) = MAX(canonical_id)),
al0 AS (SELECT listed.fixture_id, cid, CASE WHEN tournament_id IS NULL THEN 'COMPETITION_ID_MISSING' WHEN cid IS NULL THEN 'COMPETITION_UNMAPPED' WHEN canonical <> cid THEN 'CANONICAL_ID_CONFLICT' WHEN coalesce(listed.country, '') <> '' AND lower(listed.country) <> lower(lands.country) THEN 'COUNTRY_CONFLICT' END AS reason
  FROM listed LEFT JOIN m1 ON m1.provider = listed.provider AND m1.provider_id = tournament_id LEFT JOIN lands ON lands.canonical_id = cid),
al AS (SELECT fixture_id, CASE WHEN reason IS NULL THEN cid END AS canonical_id, reason FROM al0)"""


def listed(spark, sf):
    i, region, number = c("fixture_id"), c("region").cast("string"), F.substring("league", 8, 9)
    land = F.concat(F.lit("Region"), region)
    return V.fixtures(spark, sf).select(
        "fixture_id", "match_day", F.when(c("priority").isin("1", "2"), "north").otherwise("south").alias("provider"), F.when(i % 9 == 0, None).when(i % 13 == 0, "999").otherwise(number).alias("tournament_id"),
        F.when(i % 4 == 0, F.concat(land, F.lit(" - "), F.upper("league"))).otherwise(c("league")).alias("league"), F.when(i % 4 == 0, None).when(i % 17 == 0, "ELSEWHERE").when(i % 5 == 0, F.lower(land)).otherwise(land).alias("country"),
        F.when(i % 7 == 0, F.concat(F.lit("C"), number)).when(i % 19 == 0, "C-1").alias("canonical"))


def _excluded(spark, sf, rows):
    n = c("n_nationkey")
    bind = V.table(spark, sf, "nation").filter(n % 4 == 3).select(F.lit("north").alias("provider"), n.cast("string").alias("provider_id"), F.concat(F.lit("Region"), c("n_regionkey").cast("string")).alias("provider_country"),
                                                                  F.concat(F.lit("Old "), "n_name").alias("provider_name"), F.when(n % 8 == 3, c("n_name")).otherwise("Canonical").alias("canonical_name"))
    return scope.exclusions(rows, bind, "fixture_id")


def _allowed(spark, sf, rows):
    nation, n = V.table(spark, sf, "nation"), c("n_nationkey")
    cid = F.concat(F.lit("C"), n.cast("string"))
    maps = nation.withColumn("provider", F.explode(F.array(F.lit("north"), F.lit("south")))).select("provider", n.cast("string").alias("provider_id"), cid.alias("canonical_id"), (~((c("provider") == "south") & (n % 5 == 1))).alias("verified"))
    maps = maps.union(nation.filter(n == 6).select(F.lit("north"), n.cast("string"), F.lit("C7"), F.lit(True)))
    lands = nation.select(cid.alias("canonical_id"), F.concat(F.lit("REGION"), c("n_regionkey").cast("string")).alias("country"))
    return scope.allow_list(rows, maps, nation.filter(n % 6 != 2).select(cid.alias("canonical_id")), lands, "fixture_id")


@query("FLT-04", views=("fixtures",), sql=f"WITH {_EXCL} SELECT * FROM ex")
def flt_04(spark, sf):
    """Competitions excluded by the id of a feed, or by country and name, also where the label holds both."""
    return _excluded(spark, sf, listed(spark, sf))


@query("FLT-05", "JON-51", views=("fixtures",), sql=f"WITH {_ROWS}, {_ALLOW} SELECT * FROM al")
def flt_05(spark, sf):
    """Allow-list: verified mappings of approved competitions, with what speaks against a row."""
    return _allowed(spark, sf, listed(spark, sf))


@query("FLT-33", views=("fixtures",), sql=f"WITH {_EXCL}, {_ALLOW} SELECT fixture_id, provider, canonical_id FROM listed JOIN ex USING (fixture_id) JOIN al USING (fixture_id) WHERE NOT excluded AND reason IS NULL")
def flt_33(spark, sf):
    """Target list: what the exclusions and the allow-list both let through."""
    rows = listed(spark, sf)
    kept = _excluded(spark, sf, rows).filter("not excluded").join(_allowed(spark, sf, rows).filter("reason is null"), "fixture_id")
    return rows.select("fixture_id", "provider").join(kept.select("fixture_id", "canonical_id"), "fixture_id")


@query("JON-37", views=("fixtures",), sql=f"""WITH {_EXCL}, {_ALLOW} SELECT strftime(match_day, '%Y-%m-%d') AS day, provider, CASE WHEN excluded THEN '{scope.EXCLUDED}' ELSE coalesce(reason, 'IN_SCOPE') END AS reason, COUNT(*) AS rows
  FROM listed JOIN ex USING (fixture_id) JOIN al USING (fixture_id) GROUP BY ALL""")
def jon_37(spark, sf):
    """Scope replayed over all listed fixtures: rows per day, feed and reason."""
    rows = listed(spark, sf)
    j = rows.select("fixture_id", "match_day", "provider").join(_excluded(spark, sf, rows), "fixture_id").join(_allowed(spark, sf, rows), "fixture_id")
    reason = F.when(c("excluded"), scope.EXCLUDED).otherwise(F.coalesce("reason", F.lit("IN_SCOPE")))
    return j.groupBy(c("match_day").cast("string").alias("day"), "provider", reason.alias("reason")).agg(F.count("*").alias("rows"))


# Target lists over the catalog of parts: the brand is the country, half of the names are told by the slug only.
_CAT = """cat AS (SELECT row_number() OVER () AS r, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey END AS tournament_id, p_brand AS category, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'Series ' || p_partkey END AS name, CASE WHEN p_partkey % 3 = 0 THEN 's-' || p_partkey ELSE replace(p_name, ' ', '-') END AS slug FROM part)"""


def _targets(lists):
    """(universe, SQL test of a part name) per list, for the brands of all nations."""
    return " UNION ALL ".join(f"SELECT '{u}' AS universe, 'Brand#' || n_nationkey AS country, CASE WHEN n_nationkey % 5 = 0 THEN 'Brand#' || (n_nationkey + 1) END AS second, (SELECT list(DISTINCT p_name) FROM part WHERE {test}) AS aliases FROM nation" for u, test in lists)


def _resolved_sql(lists):
    return f"""WITH {_CAT}, t AS ({_targets(lists)}), w AS (SELECT universe, country, category, regexp_replace(lower(unnest(aliases)), '[^a-z0-9]+', '', 'g') AS key FROM (SELECT universe, country, country AS category, aliases FROM t UNION SELECT universe, country, second, aliases FROM t WHERE second IS NOT NULL)),
o AS (SELECT r, tournament_id, category, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM cat UNION SELECT r, tournament_id, category, regexp_replace(lower(slug), '[^a-z0-9]+', '', 'g') FROM cat),
g AS (SELECT universe, country, COUNT(DISTINCT r) AS hits, MIN(tournament_id) AS one FROM w JOIN o USING (category, key) GROUP BY ALL)
SELECT t.universe, t.country, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN one END AS tournament_id, CASE WHEN hits IS NULL THEN 'UNRESOLVED' WHEN hits > 1 THEN 'AMBIGUOUS' WHEN one IS NULL THEN 'TOURNAMENT_ID_MISSING' END AS reason FROM t LEFT JOIN g USING (universe, country)"""


_LISTS = {"FLT-25": [("FIRST", "p_name LIKE '% ring'"), ("SECOND", "p_name LIKE 'red %'")], "FLT-26": [("EXTENDED", "p_name LIKE '% widget' OR p_name LIKE 'small %'")], "FLT-27": [("TOP_DIVISION", "p_name = (SELECT min(p_name) FROM part)")]}


def _resolve(spark, sf, lists):
    part, n, k = V.table(spark, sf, "part"), c("n_nationkey"), c("p_partkey")
    rows = part.select(F.when(k % 50 != 0, k).alias("tournament_id"), c("p_brand").alias("category"), F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("Series "), k.cast("string"))).alias("name"),
                       F.when(k % 3 == 0, F.concat(F.lit("s-"), k.cast("string"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"))
    brand = lambda x: F.concat(F.lit("Brand#"), x.cast("string"))
    first = part.agg(F.min("p_name").alias("m"))
    out = None
    for universe, test in lists:
        chosen = part.join(first, c("p_name") == c("m")) if "min(" in test else part.filter(test)
        aliases = chosen.agg(F.collect_set("p_name").alias("aliases"))  # the list of a target: short by its nature
        t = V.table(spark, sf, "nation").select(F.lit(universe).alias("universe"), brand(n).alias("country"), F.when(n % 5 == 0, F.array(brand(n + 1))).otherwise(F.array().cast("array<string>")).alias("accepted"))
        t = t.join(aliases, F.lit(True))
        out = t if out is None else out.union(t)
    return scope.resolve_targets(out, rows)


for _id, _one in _LISTS.items():
    query(_id, sql=_resolved_sql(_one))(lambda spark, sf, _one=_one: _resolve(spark, sf, _one))


@query("JON-50", sql=f"""WITH {_CAT}, r AS ({_resolved_sql(_LISTS["FLT-25"])}), hint AS (SELECT DISTINCT country, unnest([lower(country), 'ring', lower(country) || ' red']) AS h FROM r WHERE reason = 'UNRESOLVED'),
t AS (SELECT r AS row_no, tournament_id, lower(category || ' ' || regexp_replace(name || ' ' || slug, '[-_ ]+', ' ', 'g')) AS txt FROM cat)
SELECT tournament_id, string_agg(DISTINCT country, ',' ORDER BY country) AS matched_for FROM t JOIN hint ON contains(txt, h) WHERE tournament_id IS NOT NULL GROUP BY tournament_id""")
def jon_50(spark, sf):
    """Catalog rows that may belong to an unresolved target, found by its hint words."""
    open_ = _resolve(spark, sf, _LISTS["FLT-25"]).filter("reason = 'UNRESOLVED'").select("country").distinct()
    low = F.lower("country")
    hints = open_.select("country", F.explode(F.array(low, F.lit("ring"), F.concat(low, F.lit(" red")))).alias("hint")).withColumn("hint_id", F.xxhash64("country", "hint"))
    k = c("p_partkey")
    name = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("Series "), k.cast("string")))
    slug = F.when(k % 3 == 0, F.concat(F.lit("s-"), k.cast("string"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    texts = V.table(spark, sf, "part").filter(k % 50 != 0).select(k.alias("tournament_id"), textsearch.search_text(c("p_brand"), name, slug).alias("txt"))
    found = textsearch.contains_join(texts, hints, "tournament_id", "txt", "hint_id", "hint").join(hints.select("hint_id", "country"), "hint_id")
    return found.groupBy("tournament_id").agg(F.array_join(F.array_sort(F.collect_set("country")), ",").alias("matched_for"))
