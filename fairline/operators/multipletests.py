"""Benjamini-Hochberg q values.

p values are rounded (six digits) or come from a finite number of draws, so there are at most about
a million distinct ones whatever the number of tests. The ordered pass runs over distinct p values with
their multiplicity, never over the tests themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions.exact import rnd


def benjamini_hochberg(
    tests: DataFrame, p: str, q: str, by: Sequence[str] = (), digits: int | None = 6, cap: bool = True
) -> DataFrame:
    """Adds q. Ties share the q of the last of them, which is what a stable rank-by-rank pass gives."""
    distinct = tests.groupBy(*by, p).agg(F.count("*").alias("_m"))
    order = Window.partitionBy(*by).orderBy(p)
    up = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = distinct.withColumn("_rank", F.sum("_m").over(up)).withColumn(
        "_raw", F.col(p) * F.sum("_m").over(Window.partitionBy(*by)) / F.col("_rank")
    )
    value = F.min("_raw").over(down)
    if cap:
        value = F.least(value, F.lit(1.0))
    if digits is not None:
        value = rnd(value, digits)
    lookup = ranked.withColumn(q, value).select(*by, p, q)
    return tests.join(lookup, [*by, p])
