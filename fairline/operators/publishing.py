"""Publishing reviewed rows: digests of tables, comparisons of key sets, reversible promotion, imports and bundles.

A table's digest does not depend on the order of its rows: their number and two sums of 60-bit row hashes modulo a prime,
combined on the map side. Nothing is sorted or collected for it; what reaches the driver is one row a table or bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fairline.session import cut

PRIME = (1 << 61) - 1
_SMALL_PRIME = (1 << 31) - 1


def row_text(columns: Sequence[str]) -> Column:
    """One text for a row: per column `-` for null, else its length in bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*[one(c) for c in columns])


def row_hash(columns: Sequence[str], part: int = 0) -> Column:
    """60 bits of the row's md5: the first (part 0) or the next ones (part 1)."""
    return F.conv(F.substring(F.md5(row_text(columns)), 1 + 15 * part, 15), 16, 10).cast("long")


def _sum_mod(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("decimal(38,0)")) % F.lit(PRIME), F.lit(0)).cast("long")


def digests(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, rows, sum1, sum2: the digest of the columns of the rows, for the whole table or each group of it."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), _sum_mod(row_hash(columns)).alias("sum1"), _sum_mod(row_hash(columns, 1)).alias("sum2"))


def tagged(parts: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part"), *columns) for name, df in parts.items()])


def differing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """keys, side ('left' or 'right'): keys that only one table has; both hold each key once.

    One aggregate over both sides gives a fingerprint per bucket of keys. Buckets that agree are proven equal and not
    looked at again; the keys of the others (at most `buckets` numbers, broadcast) are compared one by one.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    prints = [F.pmod(F.xxhash64(F.lit(n), *keys), F.lit(_SMALL_PRIME)) for n in (1, 2)]
    sides = [df.select(*keys).withColumn("_bucket", at) for df in (left, right)]
    both = reduce(DataFrame.unionByName, [df.select("_bucket", F.lit(sign).alias("s"), *[(p * sign).alias(f"p{i}") for i, p in enumerate(prints)]) for df, sign in zip(sides, (1, -1), strict=True)])
    apart = both.groupBy("_bucket").agg(*[F.sum(x).alias(x) for x in ("s", "p0", "p1")]).filter("s <> 0 or p0 <> 0 or p1 <> 0").select("_bucket")
    a, b = (df.join(F.broadcast(apart), "_bucket", "left_semi").drop("_bucket") for df in sides)
    u = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    return u.groupBy(*keys).agg(F.sum("_d").alias("_d")).filter("_d <> 0").select(*keys, F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"))


@dataclass(frozen=True)
class Promotion:
    """What a promotion or its undoing does: the state, why, the table and the archive afterwards, digests of all parts."""

    state: str
    reason: str | None
    table: DataFrame
    archive: DataFrame
    receipt: DataFrame


def _numbers(receipt: DataFrame) -> dict[str, tuple[int, int, int]]:
    return {r["part"]: (r["rows"], r["sum1"], r["sum2"]) for r in receipt.select("part", "rows", "sum1", "sum2").collect()}  # a row per part


_NONE = (0, 0, 0)


def promote(table: DataFrame, archive: DataFrame, batch: DataFrame, identity: Sequence[str], provenance: str, receipt: DataFrame | None = None) -> Promotion:
    """Replace the rows of the batch's identities by the batch; those rows go to the archive.

    NOOP if the table already holds exactly the batch under this provenance; CONFLICT (nothing changes) if it holds other
    rows of it, if it holds them without a receipt, or if the archive is in use. Null identities replace nothing.
    """
    columns = table.columns
    mine = F.col("provenance").eqNullSafe(F.lit(provenance))
    before = digests(tagged({"existing": table.filter(mine), "batch": batch, "archive": archive}, columns), columns, ["part"])
    now = _numbers(before)
    existing, new, stored = (now.get(p, _NONE) for p in ("existing", "batch", "archive"))
    if existing != _NONE:
        reason = None if existing == new and receipt is not None else "RECEIPT_MISSING" if existing == new else "EXISTING_DIFFERS"
        return Promotion("NOOP" if reason is None else "CONFLICT", reason, table, archive, before)
    if stored != _NONE:
        return Promotion("CONFLICT", "ARCHIVE_EXISTS", table, archive, before)
    wanted = batch.select(*identity).distinct().withColumn("_hit", F.lit(True))
    marked = table.join(wanted, list(identity), "left")
    kept, gone = marked.filter("_hit is null").select(*columns), marked.filter("_hit").select(*columns)
    after = kept.unionByName(batch.select(*columns))
    parts = {"original": table, "archived": gone, "retained": kept, "batch": batch, "promoted": after}
    return Promotion("PROMOTED", None, after, gone, digests(tagged(parts, columns), columns, ["part"]))


def revert(table: DataFrame, archive: DataFrame, provenance: str, receipt: DataFrame) -> Promotion:
    """Promotion with the sides swapped: the batch leaves, the archive returns.

    REVERTED only if that gives back the table that the receipt calls original and takes away what it calls batch.
    """
    columns = table.columns
    mine = F.col("provenance").eqNullSafe(F.lit(provenance))
    after, gone = table.filter(~mine).unionByName(archive), table.filter(mine)
    told = digests(tagged({"original": after, "batch": gone}, columns), columns, ["part"])
    now, then = _numbers(told), _numbers(receipt)
    if any(now.get(p, _NONE) != then.get(p, _NONE) for p in ("original", "batch")):
        return Promotion("CONFLICT", "NOT_AS_IN_RECEIPT", table, archive, told)
    return Promotion("REVERTED", None, after, archive.limit(0), told)


# What a report and its manifest must say.
SCOPES = ("VERIFIED_NATIVE_SNAPSHOT_FIXTURES_ONLY", "VERIFIED_NATIVE_OR_EXTERNAL_ODDSPAPI_FIXTURES")
RUNTIME_STOP = "MANUAL_RUNTIME_BUDGET_REACHED_REUSE_SAVED_CACHE"


def publish_contract(runs: DataFrame, candidates: DataFrame, results: DataFrame, identity: Sequence[str], allow_partial: bool = False) -> DataFrame:
    """run, reason, identity, n: every broken rule of every run, and one row with a null reason for an accepted run.

    runs: run, status, errors (array), production_writes, research_only, scope. candidates and results: run and identity.
    Rules of a run carry a null identity; n is how often a key occurs (duplicates), else 1, for accepted runs the number
    of their candidates. A stopped run may be partial if allowed: its candidates need not all have results, but one must.

    Counted keys and broken rules are written once and read again: as one plan every rule would count all keys anew, and
    the metrics that each task of such a plan sends to the driver would outgrow the result.
    """
    keys = ["run", *identity]
    partial = F.lit(allow_partial) & (F.col("status") == "STOPPED") & (F.col("errors") == F.array(F.lit(RUNTIME_STOP)))
    clean = (F.col("status") == "COMPLETED") & (F.size(F.coalesce("errors", F.array().cast("array<string>"))) == 0)
    said = runs.withColumn("partial", F.coalesce(partial, F.lit(False))).withColumn("clean", F.coalesce(clean, F.lit(False)))
    of_run = F.array_compact(F.array(
        F.when(~F.col("clean") & ~F.col("partial"), F.lit("SCAN_NOT_COMPLETED")),
        F.when(~F.coalesce((F.col("production_writes") == 0) & F.col("research_only"), F.lit(False)), F.lit("UNTRUSTED_REPORT_ORIGIN")),
        F.when(~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), F.lit("UNTRUSTED_MANIFEST_SCOPE")),
    ))
    none = [F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in identity]
    report = said.select("run", F.explode(of_run).alias("reason"), *none, F.lit(1).cast("long").alias("n"))
    counted = [cut(df.groupBy(*keys).agg(F.count("*").alias("n"))) for df in (candidates, results)]
    for df, reason in zip(counted, ("DUPLICATE_CANDIDATE", "DUPLICATE_RESULT"), strict=True):
        report = report.unionByName(df.filter("n > 1").select("run", F.lit(reason).alias("reason"), *identity, "n"))
    apart = differing_keys(counted[0], counted[1], keys).join(said.select("run", "partial"), "run")
    reason = F.when(F.col("side") == "right", "RESULT_MANIFEST_MISMATCH").when(~F.col("partial"), "INCOMPLETE_RESULT_SET")
    report = report.unionByName(apart.select("run", reason.alias("reason"), *identity, F.lit(1).cast("long").alias("n")).filter("reason is not null"))
    per_run = counted[0].groupBy("run").agg(F.sum("n").alias("asked")).join(counted[1].groupBy("run").agg(F.sum("n").alias("got")), "run", "full")
    per_run = cut(per_run)
    empty = said.filter("partial").join(per_run.filter("got > 0"), "run", "left_anti")
    report = report.unionByName(empty.select("run", F.lit("NO_VERIFIED_PARTIAL_RESULTS").alias("reason"), *none, F.lit(1).cast("long").alias("n")))
    report = cut(report)
    good = said.select("run").join(report.select("run").distinct(), "run", "left_anti").join(per_run, "run", "left")
    return report.unionByName(good.select("run", F.lit(None).cast("string").alias("reason"), *none, F.coalesce("asked", F.lit(0)).cast("long").alias("n")))


# ---- versions: a pointer row names the current one --------------------------------------------
def point(spark: SparkSession, path: str, version: int) -> None:
    """Make a written version current. Pointers are added, never changed; a version that failed to be written has none."""
    spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{path}/pointers/at={version}")


def current_version(spark: SparkSession, path: str) -> int | None:
    from fairline.streaming.stream import stored

    pointers = stored(spark, f"{path}/pointers")
    return None if pointers is None else pointers.agg(F.max("version")).first()[0]


@dataclass(frozen=True)
class Import:
    """state, reason, what the writing pass counted, and the numbers of the merge."""

    state: str
    reason: str | None
    observed: dict[str, int]
    added: int = 0
    replaced: int = 0
    unchanged: int = 0


def import_reviewed(spark: SparkSession, path: str, version: int, slots: DataFrame, declared: dict[str, int], run: str, keys: Sequence[str], usable: str, gate: Column) -> Import:
    """Import a reviewed batch as the next version of the table under path; it becomes current only if the batch is clean.

    slots: status and the columns of the table. The pass that writes the usable rows also counts the statuses and the
    rows that fail the gate; the counts must be those declared. Rows of another source run are never replaced. Whatever
    fails, the current version stays as it was.
    """
    columns = [c for c in slots.columns if c != "status"]
    last = current_version(spark, path)
    known = F.col("status").isin(*declared)
    seen = Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in declared]
    ok = F.coalesce(gate, F.lit(False))
    watched = slots.observe(seen, *counts, F.count_if(~F.coalesce(known, F.lit(False))).alias("other"), F.count_if((F.col("status") == usable) & ~ok).alias("outside_gate"))
    watched.filter(F.col("status") == usable).select(*columns).withColumn("source_run", F.lit(run)).write.mode("overwrite").parquet(f"{path}/staged/{version}")
    observed = {k: int(v) for k, v in seen.get.items()}
    if observed["other"] or any(observed[s] != n for s, n in declared.items()):
        return Import("BLOCKED", "STATUS_COUNTS_DIFFER", observed)
    if observed["outside_gate"]:
        return Import("BLOCKED", "PRICE_GATE_FAILED", observed)
    staged = spark.read.parquet(f"{path}/staged/{version}").distinct()
    if not staged.groupBy(*keys).count().filter("count > 1").isEmpty():
        return Import("BLOCKED", "CONFLICTING_DUPLICATE", observed)
    old = spark.read.parquet(f"{path}/versions/{last}") if last is not None else staged.limit(0)
    values = [c for c in staged.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pack(old, "old").join(pack(staged, "new"), list(keys), "full")
    action = (
        F.when(F.col("new").isNull(), "KEPT").when(F.col("old").isNull(), "ADDED").when(F.col("old") == F.col("new"), "UNCHANGED")
        .when(F.col("old.source_run").eqNullSafe(F.col("new.source_run")), "REPLACED").otherwise("FOREIGN")
    )
    merge = Observation()
    merged = both.withColumn("action", action).observe(merge, *[F.count_if(F.col("action") == a).alias(a) for a in ("ADDED", "REPLACED", "UNCHANGED", "FOREIGN")])
    merged.select(*keys, F.coalesce("new", "old").alias("v")).select(*keys, "v.*").write.mode("overwrite").parquet(f"{path}/versions/{version}")
    n = {k: int(v) for k, v in merge.get.items()}
    if n["FOREIGN"]:
        return Import("BLOCKED", "DIFFERENT_PROVENANCE", observed)
    point(spark, path, version)
    return Import("CURRENT", None, observed, n["ADDED"], n["REPLACED"], n["UNCHANGED"])


def population(keys: Sequence[str]) -> Column:
    """Sum over distinct members of a hash of their key, for a column `members_hash`; whole groups add theirs up."""
    return F.pmod(F.xxhash64(*keys), F.lit(_SMALL_PRIME))


def bundle(spark: SparkSession, path: str, version: int, tables: dict[str, DataFrame]) -> list[tuple[str, int, int, bool]]:
    """Write derived tables as one version; it becomes current, for all of them at once, only if their populations agree.

    Every table has, whatever its grain, `members` (how many members of the population a row stands for) and
    `members_hash` (the sum of their hashes): the totals, counted while writing, must be equal across the tables.
    Returns name, members, hash total, agrees (with the first table).
    """
    totals = {}
    for name, df in tables.items():
        seen = Observation()
        watched = df.observe(seen, F.coalesce(F.sum("members"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("members_hash"), F.lit(0)).cast("long").alias("h"))
        watched.write.mode("overwrite").parquet(f"{path}/versions/{version}/{name}")
        totals[name] = (int(seen.get["n"]), int(seen.get["h"]))
    first = next(iter(totals.values()))
    if all(t == first for t in totals.values()):
        point(spark, path, version)
    return [(name, *t, t == first) for name, t in totals.items()]


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the current bundle; None before the first one."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/versions/{version}/{name}")
