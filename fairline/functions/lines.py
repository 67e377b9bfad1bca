"""Asian lines. A line is compared and grouped as a whole number of quarters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_grid(line: Column, tol: float = 1e-8) -> Column:
    q = line * 4.0
    return F.abs(q - F.rint(q)) < F.lit(tol)


def grid_or_null(line: Column, tol: float = 1e-8) -> Column:
    """The line itself when it lies on the quarter grid; never rounded onto it."""
    return F.when(on_grid(line, tol), line)


def quarters(line: Column) -> Column:
    """Grouping key; null off the grid."""
    return F.when(on_grid(line), F.rint(line * 4.0).cast("int"))


def split(line: Column) -> Column:
    """The two half-stake lines: struct(lo, hi)."""
    q = quarters(line)
    odd = F.abs(q % 2)
    return F.when(q.isNotNull(), F.struct(((q - odd) / 4.0).alias("lo"), ((q + odd) / 4.0).alias("hi")))


def is_quarter_line(line: Column) -> Column:
    """On the quarter grid but not on the half grid."""
    return F.coalesce(F.abs(quarters(line) % 2) == 1, F.lit(False))


def line_text(line: Column) -> Column:
    """Canonical text of a validated line: 0, -0.0 and '0.0' are equal."""
    q = quarters(line)
    return F.when(q % 4 == 0, (q / 4).cast("long").cast("string")).otherwise((q / 4.0).cast("string"))


def movement(value: Column) -> Column:
    """A line move on the quarter grid, otherwise null."""
    return F.when(on_grid(value), F.rint(value * 4.0) / 4.0)


def quarter_delta(delta: Column) -> Column:
    q = F.rint(delta * 4.0) / 4.0
    size = F.when(F.abs(q) >= 0.5, F.lit(".50_PLUS")).otherwise(F.lit(".25"))
    return (
        F.when(delta.isNull(), F.lit(None).cast("string"))
        .when(F.abs(q - delta) > 1e-9, F.lit("NON_QUARTER_DELTA"))
        .when(F.abs(q) < 1e-9, F.lit("FLAT"))
        .when(q > 0, F.concat(F.lit("UP_"), size))
        .otherwise(F.concat(F.lit("DOWN_"), size))
    )


def move_label(value: Column, market: str) -> Column:
    """Direction of a favourite-view handicap move or of a total move."""
    down, up = (
        ("FAVORITE_STRENGTHENED", "FAVORITE_WEAKENED") if market == "AH" else ("TOTAL_DOWN", "TOTAL_UP")
    )
    return (
        F.when(value.isNull() | (F.abs(value) < 1e-9), F.lit("FLAT"))
        .when(value < 0, F.lit(down))
        .otherwise(F.lit(up))
    )
