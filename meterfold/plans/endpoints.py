"""The fourteen read queries over stored tables, each as one lazy plan.

Tables are passed as frames; parameters are checked here and defaults kept as keywords.
"""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold import params
from meterfold.functions.scalars import contains_text, is_alive
from meterfold.operators import analysis, catalog, filters, latest, series, spatial
from meterfold.sources import tables

_STATS = ["time", "type", "min_value", "max_value", "avg_value"]


def region_list(regions: DataFrame, macrozones: DataFrame) -> DataFrame:
    return catalog.region_list(regions, macrozones)


def region_by_name(regions: DataFrame, macrozones: DataFrame, region_hubs: DataFrame, name: str) -> DataFrame:
    key = {"region_name": name}
    return catalog.region_detail(
        filters.by_key(regions, name=name), filters.by_key(macrozones, **key), filters.by_key(region_hubs, **key)
    )


def region_statistics(stats: DataFrame, region: str, limit: int = params.ROW_LIMIT) -> DataFrame:
    rows = filters.by_key(stats, region_name=region)
    return latest.latest(rows, limit, ("type",)).select(*_STATS)


def macrozone_list(macrozones: DataFrame, zones: DataFrame, region: str) -> DataFrame:
    key = {"region_name": region}
    return catalog.macrozone_list(filters.by_key(macrozones, **key), filters.by_key(zones, **key))


def macrozone_by_name(
    macrozones: DataFrame, zones: DataFrame, macrozone_hubs: DataFrame, zone_hubs: DataFrame, sensors: DataFrame,
    region: str, name: str,
) -> DataFrame:
    key = {"region_name": region, "macrozone_name": name}
    return catalog.macrozone_detail(
        filters.by_key(macrozones, region_name=region, name=name),
        *[filters.by_key(t, **key) for t in (zones, macrozone_hubs, zone_hubs, sensors)],
    )


def macrozone_statistics(stats: DataFrame, region: str, macrozone: str, limit: int = params.ROW_LIMIT) -> DataFrame:
    rows = filters.by_key(stats, region_name=region, macrozone_name=macrozone)
    return latest.latest(rows, limit, ("type",)).select("macrozone_name", *_STATS)


def statistics_around(
    stats: DataFrame, macrozones: DataFrame, lat: float, lon: float, radius_m: float, now: dt.datetime,
    freshness: int = params.FRESHNESS,
) -> DataFrame:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError("latitude or longitude out of range")
    return analysis.around_point(stats, macrozones, lat, lon, radius_m, now, freshness)


def yearly_variation(macro_daily: DataFrame, date: dt.date, region: str | None = None) -> DataFrame:
    rows = macro_daily if region is None else filters.by_key(macro_daily, region_name=region)
    return analysis.yearly_variation(rows, date)


def variation_against_neighbours(
    macro_daily: DataFrame, places: DataFrame, radius_m: float, date: dt.date, nested: bool = False,
    region: str | None = None,
) -> DataFrame:
    """``region`` limits the judged macrozones; neighbours may lie in any region."""
    pairs = spatial.neighbours(places, radius_m)
    variations = analysis.yearly_variation(macro_daily, date)
    if region is not None:
        pairs = filters.by_key(pairs, region_name=region)
    return analysis.anomalies(variations, pairs, nested)


def trend_similarity(
    macro_daily: DataFrame, region_daily: DataFrame, date: dt.date, days: int = params.TREND_DAYS,
    region: str | None = None,
) -> DataFrame:
    if region is not None:
        macro_daily, region_daily = (filters.by_key(d, region_name=region) for d in (macro_daily, region_daily))
    return series.trend_similarity(macro_daily, region_daily, date, days, series=True)


def zone_list(zones: DataFrame, region: str, macrozone: str) -> DataFrame:
    return catalog.zone_list(filters.by_key(zones, region_name=region, macrozone_name=macrozone))


def zone_by_name(zones: DataFrame, zone_hubs: DataFrame, sensors: DataFrame, region: str, macrozone: str, name: str) -> DataFrame:
    place = {"region_name": region, "macrozone_name": macrozone}
    return catalog.zone_detail(
        filters.by_key(zones, **place, name=name),
        *[filters.by_key(t, **place, zone_name=name) for t in (zone_hubs, sensors)],
    )


def zone_statistics(stats: DataFrame, region: str, macrozone: str, zone: str, limit: int = params.ROW_LIMIT) -> DataFrame:
    rows = filters.by_key(stats, region_name=region, macrozone_name=macrozone, zone_name=zone)
    return latest.latest(rows, limit, ("type",)).select("macrozone_name", "zone_name", *_STATS)


def raw_readings(readings: DataFrame, region: str, macrozone: str, zone: str, sensor: str, limit: int = params.ROW_LIMIT) -> DataFrame:
    rows = filters.by_key(readings, region_name=region, macrozone_name=macrozone, zone_name=zone, sensor_id=sensor)
    return latest.latest(rows, limit, ("type",)).select("time", "macrozone_name", "zone_name", "sensor_id", "type", "value")


def newest_readings(spark, path: str, region: str, macrozone: str, zone: str, sensor: str, limit: int = params.ROW_LIMIT) -> DataFrame:
    """``raw_readings`` of a table stored by day, without reading its history."""
    key = {"region_name": region, "macrozone_name": macrozone, "zone_name": zone, "sensor_id": sensor}
    rows = tables.newest(spark, path, limit, ("type",), **key)
    return rows.select("time", "macrozone_name", "zone_name", "sensor_id", "type", "value")


def newest_statistics(spark, path: str, limit: int = params.ROW_LIMIT, **place: str) -> DataFrame:
    """Newest statistics of a region, macrozone or zone (``region_name`` and so on) in a table stored by day."""
    levels = [c for c in ("macrozone_name", "zone_name") if c in place]
    return tables.newest(spark, path, limit, ("type",), **place).select(*levels, *_STATS)


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows that contain the text in any column, ignoring case."""
    return rows.filter(contains_text(text, *rows.columns)) if text else rows


def liveness(devices: DataFrame, now: dt.datetime, within: int = params.CARD_ALIVE_WITHIN) -> DataFrame:
    return devices.withColumn("active", is_alive(F.col("last_seen"), now, within))
