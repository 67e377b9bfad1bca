"""Price and probability bands.

Three rules exist and differ on values such as 1.90 (1.9/0.1 is 18.999... in doubles), so they
stay three functions. Each returns the band number (the grouping key); `band_lo`/`band_hi` turn
a number into edges for display.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairline.functions.exact import rnd


def bucket_no(v: Column, width: float = 0.10) -> Column:
    return F.floor((v + F.lit(1e-9)) / F.lit(width))


def band_no(v: Column, width: float) -> Column:
    """Truncating, no epsilon."""
    return (v / F.lit(width)).cast("long")


def floor_band_no(v: Column, width: float) -> Column:
    return F.floor((v + F.lit(1e-12)) / F.lit(width))


def edge_band_no(v: Column, width: float) -> Column:
    """The band whose displayed edges satisfy lo <= v < hi (the test a screen makes against stored bands)."""
    k = F.floor(v / F.lit(width))
    return F.when(v >= band_hi(k, width), k + 1).when(v < band_lo(k, width), k - 1).otherwise(k)


def band_lo(no: Column, width: float, digits: int = 4) -> Column:
    return rnd(no * F.lit(width), digits)


def band_hi(no: Column, width: float, digits: int = 4) -> Column:
    return rnd(no * F.lit(width) + F.lit(width), digits)


def band_text(no: Column, width: float) -> Column:
    return F.format_string("%.2f-%.2f", band_lo(no, width), band_hi(no, width))


def price_label(v: Column) -> Column:
    """Six price labels plus UNKNOWN."""
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("UNKNOWN"))
        .when(v < 1.80, F.lit("<1.80"))
        .when(v > 2.20, F.lit(">2.20"))
        .when(v < 1.90, F.lit("1.80-1.89"))
        .when(v < 2.00, F.lit("1.90-1.99"))
        .when(v < 2.10, F.lit("2.00-2.09"))
        .otherwise(F.lit("2.10-2.20"))
    )


def probability_label(p: Column) -> Column:
    lo = (F.floor(p * 100.0 / 5.0) * 5).cast("int")
    return F.when(p.isNull() | F.isnan(p), F.lit("UNKNOWN")).otherwise(
        F.concat(F.lpad(lo.cast("string"), 2, "0"), F.lit("-"), F.lpad((lo + 4).cast("string"), 2, "0"), F.lit("%"))
    )


def sample_label(n: Column) -> Column:
    return (
        F.when(n < 30, F.lit("VERY_LOW"))
        .when(n < 100, F.lit("DEVELOPING"))
        .when(n < 300, F.lit("MODERATE"))
        .otherwise(F.lit("STRONG_300_PLUS"))
    )


def total_sample_label(n: Column) -> Column:
    return (
        F.when(n < 20, F.lit("TINY"))
        .when(n < 40, F.lit("EARLY"))
        .when(n < 60, F.lit("DEVELOPING"))
        .when(n < 100, F.lit("MODERATE"))
        .otherwise(F.lit("LARGE"))
    )


def phase_of(season: Column, phases: dict[str, tuple[str, ...]]) -> Column:
    """Phase name of a season, null outside every phase."""
    out = None
    for name, seasons in phases.items():
        cond = season.isin(*seasons)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out
