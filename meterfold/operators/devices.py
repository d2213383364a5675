"""Device tables: registration, last_seen, liveness."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold import params, schemas


def last_seen(readings: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    return readings.groupBy(*keys).agg(F.max(time).alias("last_seen"))


def first_and_last(messages: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    return messages.groupBy(*keys).agg(
        F.min(time).alias("registration_time"), F.max(time).alias("last_seen")
    )


def advance_last_seen(devices: DataFrame, seen: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Devices with last_seen moved forward where a newer message exists; unknown keys are ignored.

    Messages collapse to one row per device before the join.
    """
    newest = seen.groupBy(*keys).agg(F.max(time).alias("_seen"))
    return (
        devices.join(newest, keys, "left")
        .withColumn("last_seen", F.greatest("last_seen", "_seen"))
        .drop("_seen")
    )


def touch(devices: DataFrame, now: dt.datetime, **key) -> DataFrame:
    """Set last_seen of the device with the given key to ``now``."""
    hit = F.lit(True)
    for name, value in key.items():
        hit = hit & (F.col(name) == F.lit(value))
    return devices.withColumn(
        "last_seen", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_seen"))
    )


def upsert(devices: DataFrame, messages: DataFrame, keys: list[str], attributes: list[str], time: str = "time") -> DataFrame:
    """Devices after registering a batch of messages.

    A known device keeps its attributes and registration time and moves last_seen
    forward; a new one takes the attributes of its earliest message. One aggregation
    over both inputs, so a device repeated in the batch collapses before the shuffle.
    """
    old = devices.select(
        *keys, *attributes, "registration_time", "last_seen", F.lit(0).alias("_new"),
        F.col("registration_time").alias("_at"),
    )
    at = F.col(time)
    new = messages.select(
        *keys, *attributes, at.alias("registration_time"), at.alias("last_seen"), F.lit(1).alias("_new"),
        at.alias("_at"),
    )
    kept = F.struct(*attributes, "registration_time")
    order = F.struct("_new", "_at", *attributes)
    return (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(F.min_by(kept, order).alias("_k"), F.max("last_seen").alias("last_seen"))
        .select(*keys, *[F.col(f"_k.{a}").alias(a) for a in attributes], "_k.registration_time", "last_seen")
    )


def first_registrations(messages: DataFrame, known: DataFrame, keys: list[str] = schemas.SENSOR, time: str = "time") -> DataFrame:
    """The earliest message of every sensor that is not known yet. ``known`` has the key columns."""
    rest = [c for c in messages.columns if c not in keys]
    first = messages.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("_m")
    )
    return first.join(known.select(*keys), keys, "left_anti").select(*keys, "_m.*")


def health(
    known: DataFrame, seen: DataFrame, now: dt.datetime, unhealthy_after: int = params.UNHEALTHY_AFTER,
    deregister_after: int = params.DEREGISTER_AFTER, keys: list[str] = schemas.SENSOR,
) -> DataFrame:
    """healthy, unhealthy or removed for every known sensor; one never seen is removed.

    ``seen`` has the keys and last_seen.
    """
    at = F.lit(now).cast("timestamp_ntz")
    age = lambda s: at - F.expr(f"INTERVAL {int(s)} SECONDS")
    last = F.col("last_seen")
    status = (
        F.when(last.isNull() | (last < age(deregister_after)), "removed")
        .when(last < age(unhealthy_after), "unhealthy")
        .otherwise("healthy")
    )
    return known.select(*keys).join(seen.select(*keys, "last_seen"), keys, "left").withColumn("status", status)
