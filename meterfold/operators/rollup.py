"""Roll-ups of readings to zone, macrozone, region and calendar buckets.

Every level keeps the mergeable partials min, max, sum and count, so a coarser
level reads the much smaller finer one and never averages averages. The counts are
additive, hence Spark's map-side partial aggregation absorbs hot keys.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold import params, schemas
from meterfold.functions import timeutil
from meterfold.functions.scalars import ratio_or_null, ratio_or_zero
from meterfold.operators import filters

STAT_COLUMNS = ["min_value", "max_value", "avg_value", "avg_sum", "avg_count"]


def from_readings(value: str = "value") -> list[Column]:
    v = F.col(value)
    return [
        F.min(v).cast("double").alias("min_value"),
        F.max(v).cast("double").alias("max_value"),
        F.avg(v).cast("double").alias("avg_value"),
        F.sum(v).cast("double").alias("avg_sum"),
        F.count(v).alias("avg_count"),
    ]


def merge_partials() -> list[Column]:
    return [
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        ratio_or_zero(F.sum("avg_sum"), F.sum("avg_count")).alias("avg_value"),
        F.sum("avg_sum").alias("avg_sum"),
        F.sum("avg_count").alias("avg_count"),
    ]


def _window(seconds: int) -> Column:
    return F.window("time", f"{int(seconds)} seconds")


def _stamped(df: DataFrame, edge: str, keys: list[str], measures: list[str]) -> DataFrame:
    return df.select(F.col(f"window.{edge}").alias("time"), *keys, *measures)


def sensor_means(readings: DataFrame, seconds: int = params.MINUTE) -> DataFrame:
    """Mean per sensor and interval, stamped with its start, with the type of the newest reading.

    Rows are added up by type in a hash aggregation first; only the few types of a sensor's
    interval are compared by time.
    """
    typed = readings.groupBy(_window(seconds), *schemas.SENSOR, "type").agg(
        F.sum(F.col("value").cast("double")).alias("_sum"), F.count("value").alias("_n"), F.max("time").alias("_at")
    )
    out = typed.groupBy("window", *schemas.SENSOR).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("value"), F.max_by("type", F.struct("_at", "type")).alias("type")
    )
    return out.select(F.col("window.start").alias("time"), *schemas.SENSOR, "type", "value")


def zone_stats(readings: DataFrame, seconds: int = params.ZONE_INTERVAL) -> DataFrame:
    """Statistics per zone and type, stamped with the interval end."""
    keys = ["region_name", "macrozone_name", "zone_name", "type"]
    out = readings.groupBy(_window(seconds), *keys).agg(*from_readings())
    return _stamped(out, "end", keys, STAT_COLUMNS)


def macrozone_stats(zones: DataFrame) -> DataFrame:
    """Macrozone rows from zone rows of the same stamp."""
    return zones.groupBy("time", "region_name", "macrozone_name", "type").agg(*merge_partials())


def region_stats(macrozones: DataFrame, seconds: int = params.REGION_INTERVAL) -> DataFrame:
    """Region rows over macrozone rows stamped inside ``[start, end)``, stamped with the end."""
    keys = ["region_name", "type"]
    out = macrozones.groupBy(_window(seconds), *keys).agg(*merge_partials())
    return _stamped(out, "end", keys, STAT_COLUMNS)


def region_range_stats(macrozones: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Ad-hoc region roll-up; ``avg_count`` counts the merged rows, ``total_count`` the readings."""
    total = F.sum("avg_count")
    return (
        macrozones.filter(filters.in_range("time", start, end))
        .groupBy("region_name", "type")
        .agg(
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.sum("avg_sum"), total)).alias("avg_value"),
            F.sum("avg_sum").alias("avg_sum"),
            F.count("avg_count").alias("avg_count"),
            total.alias("total_count"),
        )
        .withColumn("time", F.lit(end).cast("timestamp_ntz"))
    )


def calendar_rollup(
    stats: DataFrame, unit: str, keys: list[str], time: str = "time", span: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """Day, week, month or year roll-up of stored statistics; the bucket column is named after the unit.

    ``span`` keeps the buckets of the days first..last; written as a range of ``time`` it
    reaches the scan, which a filter on the bucket would not.
    """
    if span is not None:
        lo, hi = (timeutil.bucket_bounds(dt.datetime(d.year, d.month, d.day), unit) for d in span)
        stats = stats.filter(filters.in_range(time, lo[0], hi[1]))
    return (
        stats.groupBy(timeutil.bucket_start(F.col(time), unit).alias(unit), *keys)
        .agg(
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            ratio_or_null(F.sum("avg_sum"), F.sum("avg_count")).alias("avg_value"),
            F.sum("avg_sum").alias("total_sum"),
            F.sum("avg_count").alias("total_count"),
        )
    )


MACROZONE_KEYS = ["region_name", "macrozone_name", "type"]
REGION_KEYS = ["region_name", "type"]


def macrozone_calendar(stats: DataFrame, unit: str, span: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    return calendar_rollup(stats, unit, MACROZONE_KEYS, span=span)


def region_calendar(stats: DataFrame, unit: str, span: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    return calendar_rollup(stats, unit, REGION_KEYS, span=span)


def coarser_calendar(rollup: DataFrame, unit_from: str, unit: str, keys: list[str]) -> DataFrame:
    """Month or year from days (partials merge exactly): reads the daily table, not the base rows."""
    as_stats = rollup.withColumnsRenamed({"total_sum": "avg_sum", "total_count": "avg_count"})
    return calendar_rollup(as_stats, unit, keys, time=unit_from)


def zone_and_macrozone_stats(zones: DataFrame) -> DataFrame:
    """Both grains in one output, zone_name '' marking the coarser one.

    The grouping sets expand the zone partials, not the readings.
    """
    fine = ["time", "region_name", "macrozone_name", "zone_name", "type"]
    coarse = ["time", "region_name", "macrozone_name", "type"]
    out = zones.groupingSets([[F.col(c) for c in fine], [F.col(c) for c in coarse]], *[F.col(c) for c in fine]).agg(
        *merge_partials(), F.grouping("zone_name").alias("coarse")
    )
    zone = F.when(F.col("coarse") == 1, F.lit("")).otherwise(F.col("zone_name"))
    return out.withColumn("zone_name", zone).drop("coarse")


def last_aggregated(stats: DataFrame, keys: list[str] = ("region_name",)) -> DataFrame:
    """Newest stamp per region (or macrozone): where the next run resumes."""
    return stats.groupBy(*keys).agg(F.max("time").alias("last_time"))


def missing_intervals(
    last: DataFrame,
    now: dt.datetime,
    seconds: int = params.ZONE_INTERVAL,
    delay: int = params.ZONE_DELAY,
    look_back: int = params.FIRST_LOOK_BACK,
) -> DataFrame:
    """Aligned complete intervals from the resume point (or the first look-back) to now minus the delay."""
    shift = lambda s: now - dt.timedelta(seconds=s)
    end = timeutil.truncate_instant(shift(delay), seconds)
    first = timeutil.truncate_instant(shift(look_back + delay + seconds), seconds)
    start = F.coalesce(F.col("last_time"), F.lit(first).cast("timestamp_ntz"))
    spine = timeutil.intervals(start, F.lit(end).cast("timestamp_ntz"), seconds)
    keys = [c for c in last.columns if c != "last_time"]
    return last.select(*keys, F.explode(spine).alias("start")).withColumn(
        "end", F.col("start") + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    )


def catch_up_zone_stats(
    readings: DataFrame, last: DataFrame, now: dt.datetime, seconds: int = params.ZONE_INTERVAL,
    delay: int = params.ZONE_DELAY, look_back: int = params.FIRST_LOOK_BACK,
) -> DataFrame:
    """Statistics of every complete interval after the resume point; empty intervals give nothing.

    ``last`` is ``last_aggregated`` of the stored statistics, per region or per macrozone.
    """
    end = timeutil.truncate_instant(now - dt.timedelta(seconds=delay), seconds)
    first = timeutil.truncate_instant(now - dt.timedelta(seconds=look_back + delay + seconds), seconds)
    start = F.coalesce(F.col("last_time"), F.lit(first).cast("timestamp_ntz"))
    # The earliest resume point, one row, bounds the scan from below; the join keeps the exact test.
    earliest = last.agg(F.min(start)).first()[0] or first
    due = (
        readings.filter(filters.in_range("time", earliest, end))
        .join(last, [c for c in last.columns if c != "last_time"], "left")
        .filter(F.col("time") >= start)
        .drop("last_time")
    )
    return zone_stats(due, seconds)
