"""Timestamps. Text without an offset is invalid unless a function says otherwise; session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Local zone of the collection schedule and the local date formats of one feed.
LOCAL_ZONE = "Asia/Bangkok"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
LOCAL_FORMATS = (
    "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm", "dd/MM/yy HH:mm",
    "dd MMM yyyy HH:mm", "dd MMMM yyyy HH:mm", "dd MMM yy HH:mm",
)


def strict_utc(text: Column) -> Column:
    """Timestamp of ISO text that carries an offset; otherwise null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*" + OFFSET), F.try_to_timestamp(t))


def lenient_utc(text: Column) -> Column:
    """As strict_utc, but text without an offset is read as UTC."""
    return F.try_to_timestamp(F.trim(text))


def timestamp_problem(text: Column, missing: str, invalid: str, naive: str) -> Column:
    """Reason code of a timestamp text, null when usable."""
    t = F.trim(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(missing))
        .when(F.try_to_timestamp(t).isNull(), F.lit(invalid))
        .when(~t.rlike(OFFSET), F.lit(naive))
    )


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def season_code(day: Column) -> Column:
    """July-cut season such as '2324'."""
    start = F.year(day) - F.when(F.month(day) >= 7, F.lit(0)).otherwise(F.lit(1))
    return F.concat(
        F.lpad((start % 100).cast("string"), 2, "0"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    )


def season_from_labels(code: Column, label: Column, match_id: Column) -> Column:
    """First usable of: numeric code, 'YYYY-YY' label, match id prefix; empty when none fits."""
    code, label, match_id = (F.trim(F.coalesce(c, F.lit(""))) for c in (code, label, match_id))
    whole = F.regexp_extract(code, r"^(\d{1,4})(?:\.0+)?$", 1)
    digits = F.regexp_replace(code, r"\D", "")
    start = F.regexp_extract(label, r"^(\d{4})-(?:\d{2}|\d{4})$", 1)
    year = start.try_cast("int")
    prefix = F.regexp_extract(match_id, r"^(\d{4})-", 1)
    return F.coalesce(
        F.when(whole != "", F.lpad(whole, 4, "0")),
        F.when((code != "") & (F.length(digits) == 4), digits),
        F.when(
            start != "",
            F.concat(
                F.lpad((year % 100).cast("string"), 2, "0"),
                F.lpad(((year + 1) % 100).cast("string"), 2, "0"),
            ),
        ),
        prefix,
    )


def football_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local day; hours before 06:00 belong to the day before."""
    return F.to_date(local(ts, zone) - F.expr("INTERVAL 6 HOURS"))


def football_window(day: Column, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """12:00 local to 06:00 local of the next day, as UTC instants."""
    start = F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 12 HOURS"), zone)
    return start, start + F.expr("INTERVAL 18 HOURS")


def slot_instant(day: Column, hour: Column, minute: Column | None = None, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant of a local clock on a football day; clocks before 06:00 fall on the next calendar day."""
    shift = F.when(hour < 6, F.lit(24)).otherwise(F.lit(0))
    minute = F.lit(0) if minute is None else minute
    wall = day.cast("timestamp") + F.make_dt_interval(F.lit(0), (hour + shift).cast("int"), minute.cast("int"))
    return F.to_utc_timestamp(wall, zone)


def parse_local(date_text: Column, time_text: Column, zone: str = LOCAL_ZONE) -> Column:
    """First format that fits, read as local wall time, returned as a UTC instant."""
    raw = F.trim(F.concat_ws(" ", date_text, time_text))
    wall = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in LOCAL_FORMATS])
    return F.to_utc_timestamp(wall, zone)


def day_range(start: Column, end: Column, limit: int = 7) -> Column:
    """Days from start to end inclusive; null unless the range holds 1 to `limit` days."""
    span = F.datediff(end, start)
    return F.when(span.between(0, limit - 1), F.sequence(start, end))


def epoch_window(day: Column) -> tuple[Column, Column]:
    """UTC day as [first second, last second]."""
    first = F.unix_timestamp(day.cast("timestamp"))
    return first, first + F.lit(86399)


def same_minute(value: Column, target: Column) -> Column:
    return F.coalesce(F.date_trunc("minute", value) == target, F.lit(False))
