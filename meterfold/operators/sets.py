"""Set operations."""

from functools import reduce

from pyspark.sql import DataFrame

from meterfold import schemas


def unique_union(*frames: DataFrame) -> DataFrame:
    """Distinct rows of any number of frames; duplicates collapse before the shuffle."""
    return reduce(DataFrame.unionByName, frames).distinct()


def known_sensors(registered: DataFrame, readings: DataFrame) -> DataFrame:
    """Registered sensors and those that have readings."""
    return unique_union(registered.withColumnRenamed("id", "sensor_id").select(*schemas.SENSOR), readings.select(*schemas.SENSOR))


def with_neighbours(requested: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requested macrozones and their neighbours, each once. ``requested`` has (region_name, name)."""
    around = pairs.join(requested, ["region_name", "name"], "left_semi").selectExpr(
        "neighbour_region AS region_name", "neighbour AS name"
    )
    return unique_union(requested.select("region_name", "name"), around)


def all_grains(zones: DataFrame, macrozones: DataFrame) -> DataFrame:
    """Zone rows and macrozone rows in one frame; the coarser ones get zone_name ''."""
    return zones.unionByName(macrozones.selectExpr("*", "'' AS zone_name"))
