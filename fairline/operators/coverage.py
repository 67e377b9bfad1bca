"""Collection slots, coverage, deadlines, retirement and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.exact import ratio, rnd
from fairline.functions.reasons import first_reason, truly
from fairline.functions.times import slot_instant

# Schedule versions (local hours; hour 0 is midnight at the end of the football day) and tolerances.
EFFECTIVE_DAY, PREPARATION_DAY, MIDNIGHT_DAY = "2026-10-12", "2026-10-13", "2026-10-13"
LEGACY_WEEKEND, LEGACY_WEEKDAY = (12, 15, 18, 19, 20, 21, 22), (18, 21)
CURRENT_FULL, CURRENT_SHORT = (15, 18, 21), (18, 21)
RECOVERY_US, ON_TIME_US = 150 * 60_000_000, 30 * 60_000_000


def slot_hours(day: Column) -> Column:
    """Local slot hours of a football day under the versioned schedule."""
    arr = lambda hs: F.array(*[F.lit(h) for h in hs])
    text = day.cast("string")
    weekend = F.weekday(day) >= 5
    legacy = F.when(weekend, arr(LEGACY_WEEKEND)).otherwise(arr(LEGACY_WEEKDAY))
    base = F.when(weekend | (text >= PREPARATION_DAY), arr(CURRENT_FULL)).otherwise(arr(CURRENT_SHORT))
    midnight = F.when(weekend | (text >= MIDNIGHT_DAY), arr((0,))).otherwise(F.array().cast("array<int>"))
    return F.when(text < EFFECTIVE_DAY, legacy).otherwise(F.concat(base, midnight))


def slots(days: DataFrame, day: str = "football_day") -> DataFrame:
    """One row per slot: football_day, hour, target_us."""
    return days.select(F.col(day), F.explode(slot_hours(F.col(day))).alias("hour")).withColumn(
        "target_us", F.unix_micros(slot_instant(F.col(day), F.col("hour")))
    )


def assign_slots(obs: DataFrame, slot_table: DataFrame, day: str = "football_day", now_us: Column | None = None) -> DataFrame:
    """Each observation with the latest slot of its football day at or before it, within the recovery time.

    A day's few slots travel as one sorted array per day, so the join is an equi-join on the day and no pair of
    observation and slot is formed.
    """
    per_day = slot_table.groupBy(day).agg(F.sort_array(F.collect_set("target_us")).alias("_targets"))
    j = obs.join(per_day, day)
    t = F.array_max(F.filter("_targets", lambda x: x <= F.col("observed_us")))
    ok = (F.col("observed_us") - F.col("target_us")) <= RECOVERY_US
    out = j.withColumn("target_us", t).filter(F.col("target_us").isNotNull() & ok).drop("_targets")
    return out if now_us is None else out.filter(F.col("observed_us") <= now_us)


def slot_coverage(slot_table: DataFrame, matched: DataFrame, now_us: int) -> DataFrame:
    """State per slot: OBSERVED, UPCOMING, MISSED or MISSING, with timing of the latest observation."""
    m = matched.groupBy("target_us").agg(
        F.count("*").alias("n"), F.count_distinct("fixture_id").alias("fixtures"), F.max("observed_us").alias("last_us"),
        F.min("observed_us").alias("first_us"),
    )
    j = slot_table.join(m, "target_us", "left")
    now = F.lit(now_us)
    state = (
        F.when(F.col("n") > 0, "OBSERVED").when(F.col("target_us") > now, "UPCOMING")
        .when(now > F.col("target_us") + RECOVERY_US, "MISSED").otherwise("MISSING")
    )
    lag = F.col("last_us") - F.col("target_us")
    return j.select(
        "football_day", "hour", "target_us", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("valid_snapshot_count"),
        F.coalesce("fixtures", F.lit(0)).cast("long").alias("canonical_fixture_count"), rnd(lag / F.lit(6e7), 2).alias("lag_minutes"),
        F.when(lag <= ON_TIME_US, "ON_TIME").when(lag > ON_TIME_US, "LATE").otherwise(state).alias("observation_timing"),
    )


def day_coverage(cov: DataFrame) -> DataFrame:
    elapsed, done = F.col("state") != "UPCOMING", F.col("state") == "OBSERVED"
    on_time = done & (F.col("observation_timing") == "ON_TIME")
    g = cov.groupBy("football_day").agg(
        F.count_if(elapsed).alias("expected_elapsed_slots"), F.count_if(done).alias("observed_slots"), F.count_if(on_time).alias("on_time_slots"),
        F.count_if(F.col("state") == "MISSED").alias("missed_slots"),
    )
    state = (
        F.when(F.col("expected_elapsed_slots") == 0, "NOT_DUE").when(F.col("on_time_slots") == F.col("expected_elapsed_slots"), "COMPLETE")
        .when(F.col("observed_slots") == F.col("expected_elapsed_slots"), "DEGRADED_TIMING").otherwise("DEGRADED")
    )
    return g.withColumn("coverage_fraction", rnd(ratio(F.col("observed_slots"), F.col("expected_elapsed_slots")), 3)).withColumn("collection_state", state)


def deadline_state(target: Column, now: Column, observed: Column, count: Column, active: Column, failure: Column) -> Column:
    """30-minute deadline of a slot; a late observation stays late."""
    seen = F.coalesce((observed >= target) & (count > 0), F.lit(False))
    return (
        F.when(seen & (observed <= target + ON_TIME_US), "PASS").when(seen, "LATE_OBSERVED").when(now < target, "UPCOMING")
        .when(now >= target + ON_TIME_US, "OVERDUE").when(failure.isNotNull(), "RECOVERY_REQUIRED").when(truly(active), "RUNNING").otherwise("RECOVERY_REQUIRED")
    )


def alert_required(state: Column) -> Column:
    return state.isin("PASS", "LATE_OBSERVED", "OVERDUE", "RECOVERY_REQUIRED")


def valid_completion(target: Column, now: Column, observed: Column, state: Column, snapshots: Column, day_fixtures: Column, succeeded: Column) -> Column:
    """A receipt closes a slot when it proves an observation, or a verified empty day, in time."""
    in_time = (observed >= target) & (observed <= F.least(now, target + RECOVERY_US))
    proof = F.when(state == "OBSERVED", F.coalesce(snapshots, F.lit(0)) > 0).when(
        state.isin("ZERO_FIXTURES", "ZERO_COHORT"), (day_fixtures == 0) & (F.coalesce(snapshots, F.lit(0)) == 0) & truly(succeeded)
    )
    return F.coalesce(in_time & proof, F.lit(False))


def attempt_receipt(requests: Column, status: Column, state: Column, count: Column) -> Column:
    """Zero-request skips are not attempts."""
    return F.coalesce(
        (requests > 0) | (requests.isNull() & (status == "RATE_LIMITED")) | ((state == "OBSERVED") & (count > 0)), F.lit(False)
    )


def expired_slots(cov: DataFrame) -> DataFrame:
    """Slots that must be recorded as missed."""
    return cov.filter(F.col("state") == "MISSED").select("football_day", "hour", "target_us")


def retirement(fixtures: DataFrame, attempts: DataFrame, blocked: DataFrame, now_us: int, key: str = "fixture_id", identities: DataFrame | None = None) -> DataFrame:
    """Unresolved fixtures with the gates they still miss.

    attempts: key, provider, recorded_us, fingerprint; identical evidence counts once (first record). identities: key and
    the fields that a fixture was seen with; one that was seen with two is not retired.
    """
    day = 24 * 3_600_000_000
    distinct = attempts.groupBy(key, "provider", "fingerprint").agg(F.min("recorded_us").alias("recorded_us"))
    a = distinct.groupBy(key).agg(
        F.count("*").alias("attempts"), F.count_distinct("provider").alias("sources"), (F.max("recorded_us") - F.min("recorded_us")).alias("span"),
    )
    j = fixtures.join(a, key, "left").join(blocked.select(key, F.lit(True).alias("conflict")).distinct(), key, "left")
    if identities is None:
        j = j.withColumn("_two", F.lit(False))
    else:
        one = F.struct(*[c for c in identities.columns if c != key])
        j = j.join(identities.groupBy(key).agg((~F.min(one).eqNullSafe(F.max(one))).alias("_two")), key, "left")
    age = F.lit(now_us) - F.col("kickoff_us")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gates = [
        ("RESULT_CONFLICT", F.coalesce("conflict", F.lit(False))), ("MINIMUM_DISTINCT_ROUNDS", n("attempts") < 4), ("MINIMUM_SOURCES", n("sources") < 2),
        ("MINIMUM_AGE_72H", age < 3 * day), ("MINIMUM_ATTEMPT_SPAN_24H", n("span") < day),
        ("INCONSISTENT_IDENTITY", F.coalesce("_two", F.lit(False))),
    ]
    unmet = F.array_compact(F.array(*[F.when(bad, F.lit(g)) for g, bad in gates]))
    return j.filter(age >= 3 * 3_600_000_000).select(
        key, n("attempts").cast("long").alias("attempt_count"), F.array_join(unmet, ",").alias("unmet_gates"),
        F.when(F.size(unmet) == 0, "RETIRED_UNRESOLVED").otherwise("ACTIVE_UNRESOLVED").alias("status"),
    )


def covered_attempts(fixtures: DataFrame, round_days: DataFrame) -> DataFrame:
    """Rounds whose proofs cover the day before, of and after kickoff; fingerprint = the three proofs.

    round_days: round_id, provider, recorded_us, day, proof.
    """
    need = fixtures.withColumn("day", F.explode(F.sequence(F.date_sub("kickoff_day", 1), F.date_add("kickoff_day", 1))))
    j = need.join(round_days, "day").filter(F.col("recorded_us") - F.col("kickoff_us") >= 3 * 3_600_000_000)
    return j.groupBy("fixture_id", "round_id", "provider", "recorded_us").agg(
        F.count_distinct("day").alias("days"), F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", F.col("day").cast("string"), "proof"))), "|").alias("fingerprint")
    ).filter(F.col("days") == 3).drop("days")


def health(receipts: DataFrame) -> DataFrame:
    """Issue list and PASS / WARNING / FAIL per scan receipt."""
    quota = F.col("scan_status").startswith("SKIPPED_QUOTA")
    failed = (F.col("errors") > 0) & ~quota | F.col("scan_status").contains("FAILED") | F.col("scan_status").contains("INVALID")
    checks = [
        ("API_OR_CONFIGURATION_FAILURE", failed), ("SKIPPED_QUOTA", quota), ("COVERAGE_INCOMPLETE", ~truly(F.col("coverage_complete"))),
        ("QUOTA_OR_UNQUERIED_FIXTURES", F.col("unqueried") > 0), ("SCAN_LATE", F.col("timing").isin("LATE", "OUTSIDE_WINDOW")),
        ("FIXTURE_COUNT_UNKNOWN", F.col("found").isNull()), ("COLLECTION_NOT_CONFIRMED", ~F.col("scan_status").isin("RESEARCH_V2_OBSERVED", "ZERO_USABLE_FIXTURES")),
        ("FIXTURES_WITHOUT_VALID_CORE_ODDS", (F.col("found") > 0) & (F.col("valid") < F.col("found"))),
    ]
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks]))
    return receipts.withColumn("issues", F.array_join(issues, ",")).withColumn(
        "health", F.when(F.coalesce(failed, F.lit(False)), "FAIL").when(F.size(issues) > 0, "WARNING").otherwise("PASS")
    )


def expected_coverage(rows: DataFrame, targets: DataFrame, keys: Sequence[str], fixture: str) -> DataFrame:
    """Coverage per expected target; zero rows kept, unexpected groups kept as well."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_distinct(fixture).alias("unique_fixtures"))
    t = targets.select(*keys).distinct().withColumn("expected", F.lit(True))
    return g.join(t, list(keys), "full").select(
        *keys, F.coalesce("observations", F.lit(0)).cast("long").alias("observations"), F.coalesce("unique_fixtures", F.lit(0)).cast("long").alias("unique_fixtures"),
        F.coalesce("expected", F.lit(False)).alias("expected"), F.when(F.col("observations") > 0, "OBSERVED").otherwise("NO_STRICT_OBSERVATION_YET").alias("coverage_status"),
    )


def pending_age(rows: DataFrame, now_us: int, by: Sequence[str] = ()) -> DataFrame:
    age = F.lit(now_us) - F.col("kickoff_us")
    limit = 3 * 3_600_000_000
    return rows.groupBy(*by).agg(
        F.count_if(age >= limit).alias("overdue"), F.count_if(age < limit).alias("future_or_recent"), F.count_if(F.col("kickoff_us").isNull()).alias("unknown_kickoff")
    )


def usage(ledger: DataFrame) -> DataFrame:
    """Requests per UTC day: the maximum of each attempt, then the sum; month totals by a window over days."""
    from pyspark.sql import Window

    per = ledger.groupBy("attempt_id").agg(F.max("requests_used").alias("used"), F.min("finalized_us").alias("at"))
    d = per.withColumn("day", F.to_date(F.timestamp_micros("at"))).groupBy("day").agg(F.sum("used").alias("day_requests"))
    month = Window.partitionBy(F.trunc("day", "month"))
    return d.select(F.col("day").cast("string").alias("day"), "day_requests", F.sum("day_requests").over(month).alias("month_requests"))


def schedule_reason(n: Column, remaining: Column, complete: Column) -> Column:
    return first_reason(
        [(remaining > 0, "AWAITING_ODDS"), (n > 0, "KICKOFF_PASSED_OR_NOT_PREMATCH"), (truly(complete), "NO_MATCHES")], accepted="NO_SCHEDULE_EVIDENCE"
    )
