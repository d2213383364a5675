"""Validity guards, ranges, key lists and routing."""

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold import params
from meterfold.functions import timeutil


def valid_heartbeats(df: DataFrame, ts: str = "time", hub: str = "hub_id", macrozone: str = "macrozone") -> DataFrame:
    """Keep messages with a positive timestamp, a hub id and a macrozone."""
    t = F.col(ts)
    positive = t > 0 if df.schema[ts].dataType.simpleString() == "bigint" else timeutil.epoch_seconds(t) > 0
    return df.filter(positive & (F.col(hub) != "") & (F.col(macrozone) != ""))


def in_range(col: str, start: dt.datetime, end: dt.datetime) -> Column:
    """Half-open ``[start, end)``; literals are NTZ so the range reaches the scan."""
    return (F.col(col) >= F.lit(start).cast("timestamp_ntz")) & (F.col(col) < F.lit(end).cast("timestamp_ntz"))


def on_day(col: str, day: dt.date) -> Column:
    start = dt.datetime(day.year, day.month, day.day)
    return in_range(col, start, start + dt.timedelta(days=1))


def in_days(col: str, first: dt.date, last: dt.date) -> Column:
    """Closed day range on a timestamp column, written as a time range."""
    start = dt.datetime(first.year, first.month, first.day)
    end = dt.datetime(last.year, last.month, last.day) + dt.timedelta(days=1)
    return in_range(col, start, end)


def within(df: DataFrame, start: dt.datetime, end: dt.datetime, col: str = "time") -> DataFrame:
    """Rows of ``[start, end)``; of a table stored by day only the folders of those days are read."""
    rows = df.filter(in_range(col, start, end))
    if "day" in df.columns and col != "day":
        rows = rows.filter(F.col("day").between(F.lit(start.date()), F.lit((end - dt.timedelta(microseconds=1)).date())))
    return rows


def within_days(df: DataFrame, first: dt.date, last: dt.date, col: str = "time") -> DataFrame:
    """Rows of a closed range of days."""
    start = dt.datetime(first.year, first.month, first.day)
    return within(df, start, dt.datetime(last.year, last.month, last.day) + dt.timedelta(days=1), col)


def within_minute(df: DataFrame, minute: dt.datetime, col: str = "time") -> DataFrame:
    start = minute.replace(second=0, microsecond=0)
    return within(df, start, start + dt.timedelta(minutes=1), col)


def in_minute(col: str, minute: dt.datetime) -> Column:
    start = minute.replace(second=0, microsecond=0)
    return in_range(col, start, start + dt.timedelta(minutes=1))


def member_of(df: DataFrame, keys: DataFrame | Iterable, on: str | list[str]) -> DataFrame:
    """Rows whose key is in a literal list or in a frame of keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys, on, "left_semi")
    if not isinstance(on, str):
        raise ValueError("a literal list needs a single key column")
    return df.filter(F.col(on).isin(list(keys)))


def by_key(df: DataFrame, **key) -> DataFrame:
    """Entity lookup; an unknown key gives no rows."""
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def with_grain(df: DataFrame, zone: str = "zone", macrozone: str = "macrozone") -> DataFrame:
    """``grain`` = zone or macrozone by the finest non-empty key; rows with neither are dropped."""
    grain = F.when(F.col(zone) != "", "zone").when(F.col(macrozone) != "", "macrozone")
    return df.withColumn("grain", grain).filter(F.col("grain").isNotNull())


def with_target(df: DataFrame, msg_type: str = "msg_type") -> DataFrame:
    """Device table a configuration message belongs to; unknown types are dropped."""
    target = (
        F.when(F.col(msg_type) == params.MSG_NEW_SENSOR, "sensors")
        .when(F.col(msg_type) == params.MSG_NEW_EDGE, "zone_hubs")
        .when(F.col(msg_type) == params.MSG_NEW_PROXIMITY, "macrozone_hubs")
    )
    return df.withColumn("target", target).filter(F.col("target").isNotNull())


def fresh(df: DataFrame, now: dt.datetime, seconds: int = params.FRESHNESS, col: str = "time") -> DataFrame:
    """Rows not older than the truncated cutoff."""
    cutoff = timeutil.freshness_cutoff(now, seconds)
    return df.filter(F.col(col) >= F.lit(cutoff).cast("timestamp_ntz"))


def with_status(df: DataFrame, status: str) -> DataFrame:
    if status not in (params.PENDING, params.SENT):
        raise ValueError(f"unknown status {status!r}")
    return df.filter(F.col("status") == status)
