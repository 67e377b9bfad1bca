"""Reason columns: the first rule that holds names the rejection, null means accepted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(rules: Iterable[tuple[Column, str]], accepted: str | None = None) -> Column:
    """A null condition counts as false, so write each rule so that doubt makes it true."""
    out = None
    for cond, reason in rules:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, F.lit(reason)) if out is None else out.when(cond, F.lit(reason))
    return out.otherwise(F.lit(accepted).cast("string"))


def failed_gates(gates: Iterable[tuple[str, Column]]) -> Column:
    """Array of the names of the gates that do not hold (null counts as not held)."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates])
    )


def truly(c: Column) -> Column:
    """Tri-state test: only TRUE passes; null and FALSE do not."""
    return c.eqNullSafe(F.lit(True))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))
