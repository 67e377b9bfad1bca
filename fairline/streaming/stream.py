"""Structured Streaming forms of the time-driven operators.

Each function takes a (streaming or static) DataFrame of snapshots; state is keyed by fixture or slot and bounded
by a watermark, and first-write-wins ledgers are kept by foreachBatch with an anti-join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.functions.times import LOCAL_ZONE
from fairline.operators import filters, publishing
from fairline.operators.results import insert_only


def event_time(snaps: DataFrame, lateness: str = "150 minutes") -> DataFrame:
    """Event time from the observation, late rows beyond the recovery time dropped by the watermark."""
    return snaps.withColumn("observed_at", F.timestamp_micros("observed_us")).withWatermark("observed_at", lateness)


def football_day_counts(snaps: DataFrame) -> DataFrame:
    """Tumbling football day (starts 05:00 UTC); rows outside 12:00-06:00 local do not count."""
    hour = F.hour(F.from_utc_timestamp("observed_at", LOCAL_ZONE))
    return (
        event_time(snaps).filter((hour >= 12) | (hour < 6))
        .groupBy(F.window("observed_at", "24 hours", "24 hours", "5 hours").alias("football_day"), "provider")
        .agg(F.count("*").alias("n"))
    )


def deduplicate(snaps: DataFrame, keys: list[str]) -> DataFrame:
    """Exact-record dedupe inside the watermark."""
    return event_time(snaps).dropDuplicatesWithinWatermark(keys)


def movement_state(snaps: DataFrame) -> DataFrame:
    """First and last observation per fixture (update mode on a stream)."""
    return snaps.groupBy("fixture_id").agg(
        F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"), F.count("*").alias("n")
    )


def slot_counts(snaps: DataFrame, slot_days: DataFrame) -> DataFrame:
    """Observations per collection slot: stream-static equi-join on the day, then a watermark-bounded count."""
    from fairline.operators.coverage import assign_slots

    assigned = assign_slots(event_time(snaps), slot_days)
    return assigned.groupBy(F.window("observed_at", "1 day"), "target_us").agg(F.count("*").alias("n"))


def route_by_reason(snaps: DataFrame, now_us: int, max_age_us: int) -> DataFrame:
    """Late and future rows keep a reason, so accepted and rejected rows can go to different sinks."""
    age = F.lit(now_us) - F.col("observed_us")
    reason = F.when(age < -300_000_000, "QUOTE_TIMESTAMP_IN_FUTURE").when(age > max_age_us, "QUOTE_TOO_OLD").when(
        ~filters.is_prematch(), "NOT_PREMATCH"
    )
    return snaps.withColumn("reason", reason)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, None only when its folder does not exist yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def ledger_writer(path: str, keys: list[str], seq: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch function of an insert-only ledger: a key, once written, is never replaced.

    Folders are batch=<id>/bucket=<hash of the key>. A batch reads only the buckets that its own keys fall into, and
    only earlier batches, so a replayed batch overwrites its own output instead of adding to it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` numbers
        seen = stored(spark, path)
        fresh = insert_only(rows.limit(0), rows, keys, seq)
        if seen is not None:
            earlier = seen.filter((F.col("batch") < batch_id) & F.col("bucket").isin(touched)).select(*keys)
            fresh = fresh.join(earlier, keys, "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return write


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The version that the newest pointer row names; None before the first publication."""
    last = publishing.current_version(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/versions/{last}")


def monotone_writer(path: str, key: str, exempt: DataFrame | None = None, values: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """foreachBatch guard: a load that would lose a published key, or change its values, is not published.

    Every load is written whole as a version of its own; a pointer row makes it current only after that, so a write that
    fails leaves the published version as it was. Keys are compared, rows are published. Keys of `exempt` (results in
    conflict) may go or change.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/versions/{batch_id}")
        new, old = spark.read.parquet(f"{path}/versions/{batch_id}"), published(spark, path)
        if old is not None:
            same = [key, *values]
            kept = old.select(*same).distinct()
            kept = kept if exempt is None else kept.join(exempt.select(key), key, "left_anti")
            fresh = new.select(*same).distinct()
            equal = reduce(and_, [kept[c].eqNullSafe(fresh[c]) for c in same])
            if not kept.join(fresh, equal, "left_anti").isEmpty():
                return
        publishing.point(spark, path, batch_id)

    return write


def snapshot_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """File source over an append-only snapshot folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
