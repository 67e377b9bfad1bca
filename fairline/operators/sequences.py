"""Metrics of an ordered profit sequence: drawdown and losing streak.

Both are associative, so a long sequence is cut into ordered chunks (a range partitioning on key and
order), each chunk is reduced on its own, and the few chunk summaries are combined in order. No task
ever holds a whole group; one hot pattern spreads over as many tasks as the range partitioning needs.
Profits are whole millionths, hence exact in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Tag each row with its range partition; the tag grows with (keys, order).

    Use the tag in one branch only: a second evaluation may sample other boundaries.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(_CHUNK, F.spark_partition_id())


def sequence_metrics(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    profit: str,
    loss: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """keys, n, total, max_drawdown (>= 0, peak starts at 0), longest_losing_streak."""
    loss = F.col(profit) < 0 if loss is None else loss
    rows = ordered_chunks(
        df.select(*keys, *order, F.col(profit).alias("_p"), F.coalesce(loss, F.lit(False)).alias("_loss")),
        keys, order, parts,
    )
    chunk = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("_rn", F.row_number().over(chunk))
        .withColumn("_cum", F.sum("_p").over(upto))
        .withColumn("_hold", F.max(F.when(~F.col("_loss"), F.col("_rn"))).over(upto))
        .withColumn("_peak", F.greatest(F.lit(0), F.max("_cum").over(upto)))
        .withColumn("_run", F.col("_rn") - F.coalesce("_hold", F.lit(0)))
    )
    parts_df = rows.groupBy(*keys, _CHUNK).agg(
        F.count("*").alias("n"),
        F.sum("_p").alias("total"),
        F.max("_cum").alias("hi"),
        F.min("_cum").alias("lo"),
        F.max(F.col("_peak") - F.col("_cum")).alias("dd"),
        F.max("_run").alias("best"),
        F.coalesce(F.max(F.when(F.col("_hold").isNull(), F.col("_run"))), F.lit(0)).alias("lead"),
        F.max_by("_run", "_rn").alias("tail"),
    )
    order_c = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = order_c.rowsBetween(Window.unboundedPreceding, -1)
    all_loss = F.col("lead") == F.col("n")
    parts_df = (
        parts_df.withColumn("_off", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .withColumn("_breaks", F.coalesce(F.sum(F.when(all_loss, 0).otherwise(1)).over(before), F.lit(0)))
        .withColumn(
            "_carry", F.coalesce(F.last(F.when(~all_loss, F.col("tail")), ignorenulls=True).over(before), F.lit(0))
        )
        .withColumn("_top", F.col("_off") + F.col("hi"))
        .withColumn("_prev", F.greatest(F.lit(0), F.coalesce(F.max("_top").over(before), F.lit(0))))
    )
    island = (
        Window.partitionBy(*keys, "_breaks").orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    parts_df = parts_df.withColumn(
        "_in", F.col("_carry") + F.coalesce(F.sum(F.when(all_loss, F.col("n")).otherwise(0)).over(island), F.lit(0))
    )
    return parts_df.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.max(F.greatest(F.col("dd"), F.col("_prev") - F.col("_off") - F.col("lo"))).alias("max_drawdown"),
        F.max(F.greatest(F.col("best"), F.col("_in") + F.col("lead"))).alias("longest_losing_streak"),
    )
