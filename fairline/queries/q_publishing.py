"""Publishing reviewed rows: promotion and its undoing, contracts, imports, bundles, the publication guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline.operators import publishing, quality
from fairline.queries.registry import query
from fairline.session import cut
from fairline.sources import files
from fairline.sources import views as V

c = F.col

PROVENANCE = "RECONSTRUCTED_FROM_REVIEWED_RUN"
FIRST_DAY, LAST_DAY = 19_737, 19_739  # the reviewed football days
_COLUMNS = ("event_id", "fixture_id", "bookmaker", "day", "cents", "provenance")


def _hash(columns, part):
    text = " || ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in columns)
    return f"CAST(SUM(CAST('0x' || substr(md5({text}), {1 + 15 * part}, 15) AS BIGINT)) % {publishing.PRIME} AS BIGINT)"


_SUMS = f"COUNT(*) AS rows, {_hash(_COLUMNS, 0)} AS sum1, {_hash(_COLUMNS, 1)} AS sum2"


def _canonical(spark, sf):
    return V.snapshots(spark, sf).select("event_id", "fixture_id", "bookmaker", V.div(c("observed_us"), V.DAY_US).alias("day"), (c("event_id") % 101 + 150).alias("cents"), F.lit("LIVE").alias("provenance"))


def _reviewed(table, more: int):
    """One slot per fixture, book and reviewed day: the newest price inside the gate, as the review corrected it."""
    gate = table.filter(c("day").between(FIRST_DAY, LAST_DAY) & c("cents").between(180, 220))
    best = gate.groupBy("fixture_id", "bookmaker", "day").agg(F.max(F.struct("event_id", "cents")).alias("m"))
    return best.select("m.event_id", "fixture_id", "bookmaker", "day", (c("m.cents") + more).alias("cents"), F.lit(PROVENANCE).alias("provenance"))


_SRC28 = f"""WITH t AS (SELECT event_id, fixture_id, bookmaker, observed_us // 86400000000 AS day, 150 + event_id % 101 AS cents, 'LIVE' AS provenance FROM snapshots),
b AS (SELECT arg_max(event_id, event_id) AS event_id, fixture_id, bookmaker, day, arg_max(cents, event_id) + 1 AS cents, '{PROVENANCE}' AS provenance FROM t WHERE day BETWEEN {FIRST_DAY} AND {LAST_DAY} AND cents BETWEEN 180 AND 220 GROUP BY ALL),
b2 AS (SELECT * REPLACE (cents + 1 AS cents) FROM b),
hit AS (SELECT t.*, b.day IS NOT NULL AS hit FROM t LEFT JOIN b USING (fixture_id, bookmaker, day)),
kept AS (SELECT * EXCLUDE hit FROM hit WHERE NOT hit), gone AS (SELECT * EXCLUDE hit FROM hit WHERE hit),
after AS (SELECT event_id, fixture_id, bookmaker, day, cents, provenance FROM kept UNION ALL SELECT * FROM b),
existing AS (SELECT * FROM after WHERE provenance = '{PROVENANCE}'),
back AS (SELECT event_id, fixture_id, bookmaker, day, cents, provenance FROM after WHERE provenance <> '{PROVENANCE}' UNION ALL SELECT event_id, fixture_id, bookmaker, day, cents, provenance FROM gone),
d AS (
  SELECT 1 AS step, 'original' AS part, {_SUMS} FROM t UNION ALL SELECT 1, 'archived', {_SUMS} FROM gone UNION ALL SELECT 1, 'retained', {_SUMS} FROM kept UNION ALL SELECT 1, 'batch', {_SUMS} FROM b UNION ALL SELECT 1, 'promoted', {_SUMS} FROM after
  UNION ALL SELECT 2, 'existing', {_SUMS} FROM existing UNION ALL SELECT 2, 'batch', {_SUMS} FROM b UNION ALL SELECT 2, 'archive', {_SUMS} FROM gone
  UNION ALL SELECT 3, 'existing', {_SUMS} FROM existing UNION ALL SELECT 3, 'batch', {_SUMS} FROM b2 UNION ALL SELECT 3, 'archive', {_SUMS} FROM gone
  UNION ALL SELECT 4, 'original', {_SUMS} FROM back UNION ALL SELECT 4, 'batch', {_SUMS} FROM existing),
same AS (SELECT step, max(CASE part WHEN 'existing' THEN (rows, sum1, sum2) END) = max(CASE part WHEN 'batch' THEN (rows, sum1, sum2) END) AS eq FROM d WHERE step IN (2, 3) GROUP BY step),
undo AS (SELECT count(*) = 2 AS ok FROM d x JOIN d y ON x.step = 4 AND y.step = 1 AND x.part = y.part AND x.rows = y.rows AND x.sum1 = y.sum1 AND x.sum2 = y.sum2)
SELECT step, CASE step WHEN 1 THEN 'PROMOTED' WHEN 4 THEN (SELECT CASE WHEN ok THEN 'REVERTED' ELSE 'CONFLICT' END FROM undo) ELSE CASE WHEN eq THEN 'NOOP' ELSE 'CONFLICT' END END AS state,
  CASE WHEN step IN (2, 3) AND NOT eq THEN 'EXISTING_DIFFERS' END AS reason, part, rows, sum1, sum2 FROM d LEFT JOIN same USING (step)"""


@query("SRC-28", views=("snapshots",), sql=_SRC28)
def src_28(spark, sf):
    """A reviewed cohort is promoted, promoted again, promoted with other prices, and undone; digests of every part."""
    table = _canonical(spark, sf)
    batch, other = _reviewed(table, 1), _reviewed(table, 2)
    key = ["fixture_id", "bookmaker", "day"]
    first = publishing.promote(table, table.limit(0), batch, key, PROVENANCE)
    after, archive, receipt = cut(first.table), cut(first.archive), cut(first.receipt)
    steps = [
        publishing.Promotion(first.state, first.reason, after, archive, receipt),
        publishing.promote(after, archive, batch, key, PROVENANCE, receipt),
        publishing.promote(after, archive, other, key, PROVENANCE, receipt),
        publishing.revert(after, archive, PROVENANCE, receipt),
    ]
    out = [p.receipt.select(F.lit(i).alias("step"), F.lit(p.state).alias("state"), F.lit(p.reason).cast("string").alias("reason"), "part", "rows", "sum1", "sum2") for i, p in enumerate(steps, 1)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


# ---- the contract of a publish ----------------------------------------------------------------
# A run per league; its report, manifest and result list carry one kind of damage each.
_RUNS = """runs AS (SELECT DISTINCT league AS run, CASE league WHEN 'L1' THEN 'STOPPED' WHEN 'L2' THEN 'STOPPED' ELSE 'COMPLETED' END AS status,
  CASE league WHEN 'L1' THEN ['TIMEOUT'] WHEN 'L2' THEN ['MANUAL_RUNTIME_BUDGET_REACHED_REUSE_SAVED_CACHE'] ELSE CAST([] AS VARCHAR[]) END AS errors,
  CASE league WHEN 'L3' THEN 1 ELSE 0 END AS production_writes, CASE league WHEN 'L4' THEN NULL ELSE true END AS research_only,
  CASE league WHEN 'L5' THEN 'ANY' ELSE 'VERIFIED_NATIVE_SNAPSHOT_FIXTURES_ONLY' END AS scope FROM snapshots),
pairs AS (SELECT league AS run, fixture_id, provider, COUNT(*) AS n FROM snapshots GROUP BY ALL),
candidates AS (SELECT run, fixture_id, provider FROM pairs WHERE NOT (run = 'L10' AND n > 12) UNION ALL SELECT run, fixture_id, provider FROM pairs WHERE run = 'L6' AND n > 12),
results_of AS (SELECT run, fixture_id, provider FROM pairs WHERE NOT (run IN ('L2', 'L8') AND n > 12) UNION ALL SELECT run, fixture_id, provider FROM pairs WHERE run = 'L7' AND n > 12)"""


@query("SRC-30", views=("snapshots",), sql=f"""WITH {_RUNS}, s AS (SELECT *, status = 'STOPPED' AND errors = ['{publishing.RUNTIME_STOP}'] AS part FROM runs),
cc AS (SELECT run, fixture_id, provider, COUNT(*) AS n FROM candidates GROUP BY ALL), rr AS (SELECT run, fixture_id, provider, COUNT(*) AS n FROM results_of GROUP BY ALL),
v AS (SELECT run, 'SCAN_NOT_COMPLETED' AS reason, NULL::BIGINT AS fixture_id, NULL::VARCHAR AS provider, 1 AS n FROM s WHERE NOT part AND (status <> 'COMPLETED' OR len(errors) > 0)
  UNION ALL SELECT run, 'UNTRUSTED_REPORT_ORIGIN', NULL, NULL, 1 FROM s WHERE NOT coalesce(production_writes = 0 AND research_only, false)
  UNION ALL SELECT run, 'UNTRUSTED_MANIFEST_SCOPE', NULL, NULL, 1 FROM s WHERE scope NOT IN {publishing.SCOPES}
  UNION ALL SELECT run, 'DUPLICATE_CANDIDATE', fixture_id, provider, n FROM cc WHERE n > 1 UNION ALL SELECT run, 'DUPLICATE_RESULT', fixture_id, provider, n FROM rr WHERE n > 1
  UNION ALL SELECT run, 'RESULT_MANIFEST_MISMATCH', fixture_id, provider, 1 FROM (SELECT run, fixture_id, provider FROM rr EXCEPT SELECT run, fixture_id, provider FROM cc)
  UNION ALL SELECT run, 'INCOMPLETE_RESULT_SET', fixture_id, provider, 1 FROM (SELECT run, fixture_id, provider FROM cc EXCEPT SELECT run, fixture_id, provider FROM rr) JOIN s USING (run) WHERE NOT part)
SELECT run, reason, fixture_id, provider, CAST(n AS BIGINT) AS n FROM v UNION ALL SELECT run, NULL, NULL, NULL, CAST((SELECT SUM(n) FROM cc WHERE cc.run = s.run) AS BIGINT) FROM s WHERE run NOT IN (SELECT run FROM v)""")
def src_30(spark, sf):
    """Runs of a publish against their contract: report, origin, scope, duplicates, sets of candidates and results."""
    s = V.snapshots(spark, sf).select("league", "fixture_id", "provider")
    is_ = lambda *runs: c("run").isin(*runs)
    errors = F.when(is_("L1"), F.array(F.lit("TIMEOUT"))).when(is_("L2"), F.array(F.lit(publishing.RUNTIME_STOP))).otherwise(F.array().cast("array<string>"))
    runs = s.select(c("league").alias("run")).distinct().select(
        "run", F.when(is_("L1", "L2"), "STOPPED").otherwise("COMPLETED").alias("status"), errors.alias("errors"), F.when(is_("L3"), 1).otherwise(0).alias("production_writes"),
        F.when(~is_("L4"), True).alias("research_only"), F.when(is_("L5"), "ANY").otherwise(publishing.SCOPES[0]).alias("scope"))
    pairs = cut(s.groupBy(c("league").alias("run"), "fixture_id", "provider").agg(F.count("*").alias("n")))
    many, key = c("n") > 12, ["run", "fixture_id", "provider"]
    candidates = pairs.filter(~(is_("L10") & many)).union(pairs.filter(is_("L6") & many)).select(*key)
    results = pairs.filter(~(is_("L2", "L8") & many)).union(pairs.filter(is_("L7") & many)).select(*key)
    return publishing.publish_contract(runs, candidates, results, ["fixture_id", "provider"], allow_partial=True)


# ---- import of a reviewed batch ---------------------------------------------------------------
_SLOTS = """slots AS (SELECT fixture_id, bookmaker, provider, event_id AS slot, 150 + event_id % 101 AS cents, CASE WHEN observed_us >= kickoff_us THEN 'NOT_PREMATCH_SLOT' WHEN 150 + event_id % 101 BETWEEN 180 AND 220 THEN 'BALANCED_LINE' ELSE 'MAINLINE_UNRESOLVED' END AS status FROM snapshots)"""
_BATCH = "SELECT fixture_id, bookmaker, slot, cents + {more} AS cents FROM slots WHERE status = 'BALANCED_LINE' AND provider {which}"


@query("SRC-23", views=("snapshots",), sql=f"""WITH {_SLOTS},
c1 AS (SELECT COUNT(*) FILTER (status = 'BALANCED_LINE') AS balanced, COUNT(*) FILTER (status = 'MAINLINE_UNRESOLVED') AS unresolved, COUNT(*) FILTER (status = 'NOT_PREMATCH_SLOT') AS late FROM slots WHERE provider IN ('view', 'click')),
c2 AS (SELECT COUNT(*) FILTER (status = 'BALANCED_LINE') AS balanced, COUNT(*) FILTER (status = 'MAINLINE_UNRESOLVED') AS unresolved, COUNT(*) FILTER (status = 'NOT_PREMATCH_SLOT') AS late FROM slots WHERE provider IN ('click', 'error'))
SELECT 1 AS step, 'CURRENT' AS state, NULL AS reason, balanced, unresolved, late, balanced AS added, 0::BIGINT AS replaced, 0::BIGINT AS unchanged, balanced AS published FROM c1
UNION ALL SELECT 2, 'CURRENT', NULL, balanced, unresolved, late, 0, (SELECT COUNT(*) FROM slots WHERE status = 'BALANCED_LINE' AND provider = 'view'), (SELECT COUNT(*) FROM slots WHERE status = 'BALANCED_LINE' AND provider = 'click'), balanced FROM c1
UNION ALL SELECT 3, 'BLOCKED', 'STATUS_COUNTS_DIFFER', balanced, unresolved, late, 0, 0, 0, (SELECT balanced FROM c1) FROM c2
UNION ALL SELECT 4, 'BLOCKED', 'DIFFERENT_PROVENANCE', balanced, unresolved, late, 0, 0, 0, (SELECT balanced FROM c1) FROM c2
UNION ALL SELECT 5, 'BLOCKED', 'PRICE_GATE_FAILED', balanced, unresolved, late, 0, 0, 0, (SELECT balanced FROM c1) FROM c1""")
def src_23(spark, sf):
    """Batches imported one after the other: clean, corrected by the same run, with a wrong manifest, from another run, outside the gate."""
    s = V.snapshots(spark, sf)
    cents = c("event_id") % 101 + 150
    status = F.when(c("observed_us") >= c("kickoff_us"), "NOT_PREMATCH_SLOT").when(cents.between(180, 220), "BALANCED_LINE").otherwise("MAINLINE_UNRESOLVED")
    slots = s.select("fixture_id", "bookmaker", c("event_id").alias("slot"), cents.alias("cents"), status.alias("status"), "provider")
    one, two = slots.filter(c("provider").isin("view", "click")), slots.filter(c("provider").isin("click", "error"))
    corrected = one.withColumn("cents", F.when(c("provider") == "view", c("cents") + 1).otherwise(c("cents")))
    path, names = files.scratch(spark), ("BALANCED_LINE", "MAINLINE_UNRESOLVED", "NOT_PREMATCH_SLOT")

    def declared(df):  # the manifest that came with a batch: three numbers
        r = df.agg(*[F.count_if(c("status") == n).alias(n) for n in names]).first()
        return {n: r[n] for n in names}

    good, other = declared(one), declared(two)
    wrong = {**other, names[0]: other[names[0]] + 1}
    batches = [(one, good, "run-1", 180), (corrected, good, "run-1", 180), (two, wrong, "run-1", 180), (two.withColumn("cents", c("cents") + 2), other, "run-2", 180), (one, good, "run-1", 200)]
    out = []
    for i, (df, told, run, least) in enumerate(batches, 1):
        r = publishing.import_reviewed(spark, path, i, df.drop("provider"), told, run, ["fixture_id", "bookmaker", "slot"], names[0], c("cents").between(least, 222))
        now = publishing.current_version(spark, path)
        out.append((i, r.state, r.reason, *(r.observed[n] for n in names), r.added, r.replaced, r.unchanged, spark.read.parquet(f"{path}/versions/{now}").count()))
    return spark.createDataFrame(out, "step int, state string, reason string, balanced long, unresolved long, late long, added long, replaced long, unchanged long, published long")


# ---- evidence bundle --------------------------------------------------------------------------
_SETTLED = """settled AS (SELECT s.* FROM snapshots s JOIN (SELECT fixture_id FROM snapshot_results GROUP BY ALL HAVING MIN(ft_home_goals) = MAX(ft_home_goals) AND MIN(ft_away_goals) = MAX(ft_away_goals)) USING (fixture_id)),
per AS (SELECT fixture_id, bookmaker, league, kickoff_us // 86400000000 AS day, COUNT(*) AS n FROM settled GROUP BY ALL)"""


@query("GAT-13", views=("snapshots", "snapshot_results"), sql=f"""WITH {_SETTLED}, t(name, k) AS (VALUES ('movement', 1), ('statistics', 1), ('operational', 1), ('end_to_end', 1)),
w AS (SELECT COUNT(*) AS members, COUNT(*) FILTER (n > (SELECT MIN(n) FROM per)) AS fewer FROM per)
SELECT 1 AS bundle, name, members, true AS agrees, true AS visible FROM t, w UNION ALL SELECT 2, name, CASE WHEN name = 'movement' THEN members ELSE fewer END, name = 'movement' OR members = fewer, members = fewer FROM t, w""")
def gat_13(spark, sf):
    """Four reports from one staged scan: shown together when their populations agree; a second bundle leaves fixtures out and is not."""
    r = V.snapshot_results(spark, sf).groupBy("fixture_id").agg(*[f(g).alias(f"{n}_{g}") for g in ("ft_home_goals", "ft_away_goals") for n, f in (("lo", F.min), ("hi", F.max))])
    r = r.filter("lo_ft_home_goals = hi_ft_home_goals and lo_ft_away_goals = hi_ft_away_goals").select("fixture_id")
    settled = V.snapshots(spark, sf).join(r, "fixture_id").groupBy("fixture_id", "bookmaker", "league", V.div(c("kickoff_us"), V.DAY_US).alias("day")).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    staged = cut(settled.withColumns({"members": F.lit(1), "members_hash": publishing.population(["fixture_id"])}))

    def reports(rows):
        by = lambda key: rows.groupBy(key).agg(F.sum("n").alias("observations"), F.sum("members").alias("members"), F.sum("members_hash").alias("members_hash"))
        return {"movement": staged.select("fixture_id", (c("high") - c("low")).alias("move"), "members", "members_hash"), "statistics": by("league"), "operational": by("bookmaker"), "end_to_end": by("day")}

    path, out = files.scratch(spark), []
    fewest = staged.agg(F.min("n")).first()[0]
    for i, rows in enumerate((staged, staged.filter(c("n") > F.lit(fewest))), 1):
        told = publishing.bundle(spark, path, i, reports(rows))
        visible = publishing.current_version(spark, path) == i
        out += [(i, name, n, agrees, visible) for name, n, _, agrees in told]
    return spark.createDataFrame(out, "bundle int, name string, members long, agrees boolean, visible boolean")


# ---- publication guard ------------------------------------------------------------------------
@query("GAT-18", views=("fixtures", "results"), sql="""WITH a AS (SELECT r.fixture_id, f.league, MIN(ft_home_goals) AS h FROM results r JOIN fixtures f USING (fixture_id) WHERE seq = 1 GROUP BY ALL),
b AS (SELECT CASE WHEN f.league = 'NATION_3' THEN -r.fixture_id ELSE r.fixture_id END AS fixture_id, f.league, CASE WHEN f.league IN ('NATION_5', 'NATION_7') THEN MAX(ft_home_goals) ELSE MIN(ft_home_goals) END AS h FROM results r JOIN fixtures f USING (fixture_id) GROUP BY r.fixture_id, f.league),
x AS (SELECT league, CASE WHEN a.h IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM a FULL JOIN b USING (league, fixture_id))
SELECT league, COUNT(*) FILTER (state = 'UNCHANGED') AS unchanged, COUNT(*) FILTER (state = 'ADDED') AS added, COUNT(*) FILTER (state = 'REMOVED') AS removed, COUNT(*) FILTER (state = 'CHANGED') AS changed,
  CASE WHEN removed > 0 THEN 'RETAINED_RESULT_REMOVED' WHEN changed > 0 THEN 'RETAINED_RESULT_CHANGED' END AS reason FROM x GROUP BY league""")
def gat_18(spark, sf):
    """A league's new results are published only if none of its retained ones would be lost or altered."""
    r = V.results(spark, sf).join(V.fixtures(spark, sf).select("fixture_id", "league"), "fixture_id")
    old = r.filter("seq = 1").groupBy("league", "fixture_id").agg(F.min("ft_home_goals").alias("h"))
    new = r.groupBy("league", "fixture_id").agg(F.when(c("league").isin("NATION_5", "NATION_7"), F.max("ft_home_goals")).otherwise(F.min("ft_home_goals")).alias("h"))
    new = new.withColumn("fixture_id", F.when(c("league") == "NATION_3", -c("fixture_id")).otherwise(c("fixture_id")))
    return quality.publication_guard(old, new, ["league", "fixture_id"], ["h"], ["league"])
