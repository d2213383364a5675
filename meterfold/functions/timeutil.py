"""Time columns: epoch seconds, interval truncation, calendar buckets, interval lists.

Stored times are TIMESTAMP_NTZ in UTC; the session time zone must be UTC
(``session.configure``).
"""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds from 0001-01-01 to 1970-01-01: truncation counts from year 1, which only
# matters for intervals that do not divide a day.
_YEAR_ONE = 62_135_596_800
UNITS = ("day", "week", "month", "year")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def truncate(ts: Column, seconds: int) -> Column:
    """Start of the interval of the given length that contains ``ts``."""
    s = epoch_seconds(ts) + F.lit(_YEAR_ONE)
    return from_epoch(s - F.pmod(s, F.lit(seconds)) - F.lit(_YEAR_ONE))


def truncate_instant(now: dt.datetime, seconds: int) -> dt.datetime:
    base = dt.datetime(1, 1, 1)
    return base + dt.timedelta(seconds=int((now - base).total_seconds()) // seconds * seconds)


def freshness_cutoff(now: dt.datetime, seconds: int) -> dt.datetime:
    """Oldest admissible time: ``now`` minus the span, truncated to the span."""
    return truncate_instant(now - dt.timedelta(seconds=seconds), seconds)


def _unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, got {unit!r}")
    return unit


def bucket_start(ts: Column, unit: str) -> Column:
    """Day, week (Monday), month or year that contains ``ts``."""
    return F.date_trunc(_unit(unit), ts.cast("timestamp")).cast("timestamp_ntz")


def bucket_end(ts: Column, unit: str) -> Column:
    return bucket_start(ts, unit) + F.expr(f"INTERVAL 1 {_unit(unit).upper()}")


def bucket_bounds(when: dt.datetime, unit: str) -> tuple[dt.datetime, dt.datetime]:
    """The same ``[start, end)`` for a driver-side parameter."""
    day = dt.datetime(when.year, when.month, when.day)
    if _unit(unit) == "day":
        return day, day + dt.timedelta(days=1)
    if unit == "week":
        start = day - dt.timedelta(days=day.weekday())
        return start, start + dt.timedelta(days=7)
    if unit == "month":
        start = day.replace(day=1)
        return start, (start + dt.timedelta(days=32)).replace(day=1)
    return dt.datetime(when.year, 1, 1), dt.datetime(when.year + 1, 1, 1)


def year_before(day: Column) -> Column:
    """Same calendar day one year earlier; 29 February maps to 1 March."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.date_add(F.add_months(day, -12), F.when(leap, 1).otherwise(0))


def day_one_year_before(day: dt.date) -> dt.date:
    """The same for a driver-side parameter."""
    if (day.month, day.day) == (2, 29):
        return dt.date(day.year - 1, 3, 1)
    return day.replace(year=day.year - 1)


def year_after_candidates(day: Column) -> Column:
    """All days whose ``year_before`` is ``day``: one, or two when 1 March follows a leap day."""
    nxt = F.add_months(day, 12)
    march = (F.month(day) == 3) & (F.dayofmonth(day) == 1)
    before = F.date_sub(nxt, 1)
    feb29 = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return (
        F.when(march & (F.dayofmonth(before) == 29), F.array(before, nxt))
        .when(feb29, F.array().cast("array<date>"))
        .otherwise(F.array(nxt))
    )


def intervals(start: Column, end: Column, seconds: int) -> Column:
    """Array of starts of all complete intervals in ``[start, end)``; empty when none fits."""
    step = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return F.when(start + step <= end, F.sequence(start, end - step, step)).otherwise(
        F.array().cast("array<timestamp_ntz>")
    )
