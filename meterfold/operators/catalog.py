"""Location and device catalogue: lists with child counts, nested details."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterfold.functions import geo

def with_child_count(parents: DataFrame, children: DataFrame, parent_keys: list[str], child_keys: list[str], name: str) -> DataFrame:
    """Parents with the number of their children, 0 included; children are counted before the join."""
    counts = children.groupBy(*[F.col(c).alias(p) for p, c in zip(parent_keys, child_keys)]).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, parent_keys, "left").fillna(0, [name])


def region_list(regions: DataFrame, macrozones: DataFrame) -> DataFrame:
    return with_child_count(regions, macrozones, ["name"], ["region_name"], "macrozone_count").orderBy("name")


def with_centroid(places: DataFrame) -> DataFrame:
    return places.withColumn("_c", geo.centroid(F.col("ring"))).withColumn("lat", F.col("_c.lat")).withColumn("lon", F.col("_c.lon")).drop("_c")


def macrozone_list(macrozones: DataFrame, zones: DataFrame) -> DataFrame:
    counted = with_child_count(macrozones, zones, ["region_name", "name"], ["region_name", "macrozone_name"], "zone_count")
    return with_centroid(counted).select("region_name", "name", "lat", "lon", "creation_time", "zone_count")


def zone_list(zones: DataFrame) -> DataFrame:
    return zones.select("region_name", "macrozone_name", "name", "creation_time")


def nest(parents: DataFrame, keys: list[str], children: dict[str, tuple[DataFrame, list[str]]], pages: int = 1) -> DataFrame:
    """Parents with one sorted array column per child frame.

    ``children`` maps the array's name to (frame with the key columns, element columns). Every
    parent gives ``pages`` rows, numbered by the column ``page``, however many children it has;
    children are spread over the pages by hash, and ``<name>_count`` always holds the total. A
    caller whose parents have very many children asks for more pages, so that no array is too
    long. All kinds are gathered in one aggregation, in which each child is read once.
    """
    kinds = list(children)
    gathered = None
    for kind, (frame, cols) in children.items():
        item = F.struct(*cols)
        rows = frame.select(*keys, F.pmod(F.xxhash64(*cols), F.lit(pages)).cast("long").alias("page"), *[
            (item if k == kind else F.lit(None)).alias(k) for k in kinds
        ])
        gathered = rows if gathered is None else gathered.unionByName(rows, allowMissingColumns=True)
    arrays = gathered.groupBy(*keys, "page").agg(*[F.sort_array(F.collect_list(k)).alias(k) for k in kinds])
    every = parents.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    out = every.join(arrays, [*keys, "page"], "left")
    for k in kinds:
        out = out.withColumn(k, F.coalesce(F.col(k), F.array().cast(arrays.schema[k].dataType)))
        size = F.size(k).cast("long")
        total = size if pages == 1 else F.sum(size).over(Window.partitionBy(*keys))
        out = out.withColumn(f"{k}_count", total)
    return out.select(*parents.columns, "page", *[f"{k}_count" for k in kinds], *kinds)


def region_detail(regions: DataFrame, macrozones: DataFrame, region_hubs: DataFrame, pages: int = 1) -> DataFrame:
    mz = with_centroid(macrozones).withColumn("region", F.col("region_name"))
    return nest(regions.withColumnRenamed("name", "region"), ["region"], {
        "macrozones": (mz, ["name", "lat", "lon"]),
        "hubs": (region_hubs.withColumnRenamed("region_name", "region"), ["id", "service", "registration_time", "last_seen"]),
    }, pages).withColumnRenamed("region", "name")


def macrozone_detail(macrozones: DataFrame, zones: DataFrame, macrozone_hubs: DataFrame, zone_hubs: DataFrame, sensors: DataFrame, pages: int = 1) -> DataFrame:
    times = ["registration_time", "last_seen"]
    base = with_centroid(macrozones).select("region_name", F.col("name").alias("macrozone_name"), "lat", "lon", "creation_time")
    return nest(base, ["region_name", "macrozone_name"], {
        "zones": (zones, ["name", "creation_time"]),
        "hubs": (macrozone_hubs, ["id", "service", *times]),
        "zone_hubs": (zone_hubs, ["id", "zone_name", "service", *times]),
        "sensors": (sensors, ["id", "zone_name", "type", "reference", *times]),
    }, pages)


def zone_detail(zones: DataFrame, zone_hubs: DataFrame, sensors: DataFrame, pages: int = 1) -> DataFrame:
    times = ["registration_time", "last_seen"]
    base = zones.select("region_name", "macrozone_name", F.col("name").alias("zone_name"), "creation_time")
    return nest(base, ["region_name", "macrozone_name", "zone_name"], {
        "hubs": (zone_hubs, ["id", "service", *times]),
        "sensors": (sensors, ["id", "type", "reference", *times]),
    }, pages)
