"""Year-over-year variation, neighbour anomalies, statistics around a point."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold import params
from meterfold.functions import geo, timeutil
from meterfold.functions.scalars import percent_change
from meterfold.operators import filters, latest, spatial

KEYS = ["region_name", "macrozone_name", "type"]


def compared_days(col: str, first: dt.date, last: dt.date) -> Column:
    """The days ``[first, last]`` and the same days one year earlier, as ranges that reach the scan."""
    lo, hi = timeutil.day_one_year_before(first), timeutil.day_one_year_before(last)
    return filters.in_days(col, first, last) | filters.in_days(col, min(lo, hi), hi)


def current_and_previous(macro_daily: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Each day in ``[first, last]`` beside the same day one year earlier.

    A missing current value is 0; days without a previous value are dropped. Every
    daily row is sent to the day it is current for and to the day(s) it is the previous
    year of, so one aggregation replaces the self-join.
    """
    day = F.to_date("day")
    lo, hi = F.lit(first), F.lit(last)
    null = F.lit(None).cast("double")
    avg = F.col("avg_value")
    roles = F.concat(
        F.array(F.struct(day.alias("target"), avg.alias("cur"), null.alias("prev"))),
        F.transform(
            timeutil.year_after_candidates(day),
            lambda d: F.struct(d.alias("target"), null.alias("cur"), avg.alias("prev")),
        ),
    )
    return (
        macro_daily.filter(compared_days("day", first, last))
        .select(*KEYS, F.explode(roles).alias("r"))
        .select(*KEYS, F.col("r.target").alias("day"), "r.cur", "r.prev")
        .filter(F.col("day").between(lo, hi))
        .groupBy(*KEYS, "day")
        .agg(F.coalesce(F.max("cur"), F.lit(0.0)).alias("current"), F.max("prev").alias("previous"))
        .filter(F.col("previous").isNotNull())
    )


def yearly_variation(macro_daily: DataFrame, first: dt.date, last: dt.date | None = None) -> DataFrame:
    """Change in percent against the same day last year; a previous value of 0 gives no row."""
    pairs = current_and_previous(macro_daily, first, last or first).filter(F.col("previous") != 0)
    return pairs.withColumn("delta_perc", percent_change(F.col("current"), F.col("previous")))


_DAYS = 64


def _block(day: Column) -> list[Column]:
    """The 64 days a day belongs to, and its place there."""
    n = F.datediff(day, F.lit(dt.date(1970, 1, 1)))
    return [F.floor(n / _DAYS).alias("_block"), F.pmod(n, F.lit(_DAYS)).alias("_bit")]


def _neighbour_days(own: DataFrame, theirs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``theirs`` (neighbour_region, neighbour, type, day, ...) for every own row they are a neighbour of.

    An own row is known by its key alone, so a macrozone's days of a type travel to its neighbours as bits of
    64 days each; a row of own days and one of theirs meet there, and the bit says which days both have.
    """
    near = pairs.withColumnRenamed("name", "macrozone_name").drop("distance_m")
    # Rows that repeat a key count as often as they come; their days travel apart.
    days = own.repartition(*KEYS).groupBy(*KEYS, "day").agg(F.count(F.lit(1)).alias("_times")).select(*KEYS, "_times", *_block(F.col("day")))
    packed = days.groupBy(*KEYS, "_times", "_block").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_days"))
    sent = packed.join(near, ["region_name", "macrozone_name"])
    met = sent.join(theirs.select("*", *_block(F.col("day"))), ["neighbour_region", "neighbour", "type", "_block"])
    both = met.filter(F.getbit("_days", F.col("_bit")) == 1).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    keys = ["neighbour_region", "neighbour", "type", "day", "region_name", "macrozone_name"]
    rest = [c for c in [*near.columns, *theirs.columns] if c not in keys]
    return both.select(*keys, *rest)


def neighbour_variations(variations: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each own variation the neighbours' of the same type and day, one row each."""
    theirs = variations.withColumnsRenamed(
        {"region_name": "neighbour_region", "macrozone_name": "neighbour"}
    )
    return _neighbour_days(variations, theirs, pairs)


_VALUES = ["current", "previous", "delta_perc"]


def neighbour_spread(around: DataFrame, nested: bool = False) -> DataFrame:
    """Mean and population deviation of the neighbours' changes; ``nested`` also lists them."""
    aggs = [F.avg("delta_perc").alias("neighbor_mean"), F.stddev_pop("delta_perc").alias("neighbor_std_dev")]
    if nested:
        item = F.struct("neighbour_region", "neighbour", *_VALUES)
        aggs.append(F.sort_array(F.collect_list(item)).alias("neighbor_variation"))
    return around.groupBy(*KEYS, "day").agg(*aggs)


def anomalies(variations: DataFrame, pairs: DataFrame, nested: bool = False) -> DataFrame:
    """Own change against the neighbours'. No row without neighbours; z is 0 when they agree.

    The spread of the neighbours depends on the own key only, so own values stay where they are
    and meet it in the end. ``nested=True`` adds the neighbours as an array, which is as long as the radius makes
    it; ``neighbour_variations`` gives the same as rows.
    """
    mine = variations.groupBy(*KEYS, "day", *_VALUES).agg(F.count(F.lit(1)).alias("_times"))
    theirs = variations.withColumnsRenamed({"region_name": "neighbour_region", "macrozone_name": "neighbour"})
    theirs = theirs.select("neighbour_region", "neighbour", "type", "day", *_VALUES)
    around = _neighbour_days(variations.select(*KEYS, "day").distinct(), theirs, pairs)
    rows = mine.join(neighbour_spread(around, nested), [*KEYS, "day"])
    if nested:
        # an own row that comes twice has every neighbour twice
        each = F.flatten(F.transform("neighbor_variation", lambda v: F.array_repeat(v, F.col("_times").cast("int"))))
        rows = rows.withColumn("neighbor_variation", each)
    off = F.col("delta_perc") - F.col("neighbor_mean")
    z = F.when(F.col("neighbor_std_dev") != 0, off / F.col("neighbor_std_dev")).otherwise(F.lit(0.0))
    return rows.drop("_times").withColumn("abs_error", F.abs(off)).withColumn("z_score", z)


def with_centre(stats: DataFrame, places: DataFrame) -> DataFrame:
    """Statistics with the centre of their macrozone."""
    centre = places.select("region_name", F.col("name").alias("macrozone_name"), "lat", "lon")
    return stats.join(centre, ["region_name", "macrozone_name"])


def around_point(
    macro_stats: DataFrame, macrozones: DataFrame, lat: float, lon: float, radius_m: float,
    now: dt.datetime, freshness: int = params.FRESHNESS,
) -> DataFrame:
    """Inverse-distance-weighted statistics per type from the newest row of each macrozone nearby."""
    near = spatial.near_point(macrozones, lat, lon, radius_m)
    centre = geo.centroid(F.col("ring"))
    near = near.withColumn("_c", centre).select("region_name", "name", F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"))
    # the cutoff reaches the scan; the join keeps only the macrozones nearby
    rows = latest.latest_row(with_centre(filters.fresh(macro_stats, now, freshness), near), KEYS)
    km = geo.haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))
    weight = 1 / F.when(km == 0, F.lit(params.ZERO_DISTANCE_KM)).otherwise(km)
    return (
        rows.withColumn("_w", weight)
        .groupBy("type")
        .agg(
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.try_divide(F.sum("avg_sum"), F.sum("avg_count")).alias("avg_value"),
            F.sum("avg_sum").alias("avg_sum"),
            F.sum("avg_count").alias("avg_count"),
            F.try_divide(F.sum(F.col("avg_value") * F.col("_w")), F.sum("_w")).alias("weighted_avg"),
            F.sum(F.col("avg_value") * F.col("_w")).alias("weighted_sum"),
            F.sum("_w").alias("weighted_count"),
        )
        .filter(F.col("avg_count") != 0)
        .withColumn("time", F.lit(now).cast("timestamp_ntz"))
    )
