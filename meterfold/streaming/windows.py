"""Event-time windows with a grace period, emitted once (append mode).

Streams carry TIMESTAMP event times because watermarks need them. A reading that
arrives after its window was emitted is left out here and kept by the raw table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold import params, schemas
from meterfold.operators import rollup


def _window(seconds: int):
    return F.window("time", f"{int(seconds)} seconds")


def sensor_means(readings: DataFrame, seconds: int = params.MINUTE, delay: str = "1 minute") -> DataFrame:
    """Mean per sensor and interval with the type of the newest reading.

    Readings are added up by type first; a chained aggregate compares the few types of a
    sensor's interval.
    """
    typed = readings.withWatermark("time", delay).groupBy(_window(seconds), *schemas.SENSOR, "type").agg(
        F.sum(F.col("value").cast("double")).alias("_sum"), F.count("value").alias("_n"), F.max("time").alias("_at")
    )
    out = typed.groupBy(F.window(F.window_time("window"), f"{int(seconds)} seconds"), *schemas.SENSOR).agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("value"), F.max_by("type", F.struct("_at", "type")).alias("type")
    )
    return out.select(F.col("window.start").alias("time"), *schemas.SENSOR, "type", "value")


def zone_stats(readings: DataFrame, seconds: int = params.ZONE_INTERVAL, delay: int = params.ZONE_DELAY) -> DataFrame:
    keys = ["region_name", "macrozone_name", "zone_name", "type"]
    out = readings.withWatermark("time", f"{delay} seconds").groupBy(_window(seconds), *keys).agg(*rollup.from_readings())
    return out.select(F.col("window.end").alias("time"), *keys, *rollup.STAT_COLUMNS)


def macrozone_stats(readings: DataFrame, seconds: int = params.ZONE_INTERVAL, delay: int = params.ZONE_DELAY) -> DataFrame:
    """Zone rows merged to macrozones by a chained aggregate over the same windows."""
    keys = ["region_name", "macrozone_name", "type"]
    zones = readings.withWatermark("time", f"{delay} seconds").groupBy(_window(seconds), *keys, "zone_name").agg(*rollup.from_readings())
    out = zones.groupBy(F.window(F.window_time("window"), f"{int(seconds)} seconds"), *keys).agg(*rollup.merge_partials())
    return out.select(F.col("window.end").alias("time"), *keys, *rollup.STAT_COLUMNS)


def zone_and_macrozone_stats(readings: DataFrame, seconds: int = params.ZONE_INTERVAL, delay: int = params.ZONE_DELAY) -> DataFrame:
    """Zone and macrozone rows of one stream, told apart by ``grain``: the readings are read and aggregated once.

    Each closed zone window goes on as itself and as a part of its macrozone; the chained
    aggregate lets the first pass and merges the second.
    """
    keys = ["region_name", "macrozone_name", "type"]
    zones = readings.withWatermark("time", f"{delay} seconds").groupBy(_window(seconds), *keys, "zone_name").agg(*rollup.from_readings())
    levels = F.array(
        F.struct(F.lit("zone").alias("grain"), F.col("zone_name").alias("zone_name")),
        F.struct(F.lit("macrozone").alias("grain"), F.lit("").alias("zone_name")),
    )
    parts = zones.withColumn("_level", F.explode(levels)).drop("zone_name").withColumns({"grain": F.col("_level.grain"), "zone_name": F.col("_level.zone_name")})
    again = F.window(F.window_time("window"), f"{int(seconds)} seconds")
    out = parts.groupBy(again, *keys, "zone_name", "grain").agg(*rollup.merge_partials())
    return out.select(F.col("window.end").alias("time"), "grain", *keys, "zone_name", *rollup.STAT_COLUMNS)


def region_stats(
    readings: DataFrame, fine: int = params.ZONE_INTERVAL, seconds: int = params.REGION_INTERVAL,
    delay: int = params.REGION_DELAY,
) -> DataFrame:
    """Region rows over macrozone rows by their end stamps.

    A chained aggregate knows a fine window by its last instant, not by its end stamp, so
    the coarse window is shifted back by one fine interval and the stamp moved forward again.
    """
    keys = ["region_name", "type"]
    shift = f"{seconds - fine} seconds"
    macro = readings.withWatermark("time", f"{delay} seconds").groupBy(_window(fine), *keys, "macrozone_name").agg(*rollup.from_readings())
    out = macro.groupBy(
        F.window(F.window_time("window"), f"{seconds} seconds", f"{seconds} seconds", shift), *keys
    ).agg(*rollup.merge_partials())
    stamp = F.col("window.end") + F.expr(f"INTERVAL {int(fine)} SECONDS")
    return out.select(stamp.alias("time"), *keys, *rollup.STAT_COLUMNS)


def latest_per_key(messages: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Newest message per key, as a compacted topic keeps it (update mode)."""
    rest = [c for c in messages.columns if c not in keys]
    order = F.struct(time, *[c for c in rest if c != time])
    return messages.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_m")).select(*keys, "_m.*")
