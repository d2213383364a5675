"""Message sources and sinks: JSON payloads in a ``value`` column, keyed by ``key``.

``fmt`` is any Spark source or sink with that shape (kafka on a cluster, json or text
files in tests), for streams and batches alike.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold import schemas
from meterfold.functions import timeutil
from meterfold.sources import files

PAYLOAD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def open_messages(spark: SparkSession, fmt: str, stream: bool = False, path: str | None = None, **options) -> DataFrame:
    """Raw messages; file formats need a path, message formats their own options."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    if fmt in ("json", "parquet", "orc", "csv"):
        reader = reader.schema(PAYLOAD)
    return reader.load(path) if path else reader.load()


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Payload columns; a payload that is no JSON object of these types is dropped.

    Missing strings become '' and missing numbers 0, unknown fields are ignored.
    """
    # a malformed payload shows only in the corrupt-record column
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = messages.select(
        F.from_json(F.col("value").cast("string"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m")
    ).filter(F.col("m").isNotNull() & F.col("m._bad").isNull())
    return parsed.select(*[_or_zero(F.col(f"m.{f.name}"), f) for f in schema.fields])


def _or_zero(c: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        zero = F.lit("")
    else:
        zero = F.lit(0).cast(field.dataType)
    return F.coalesce(c, zero).alias(field.name)


def readings(messages: DataFrame) -> DataFrame:
    return decode(messages, schemas.READING)


def statistics(messages: DataFrame) -> DataFrame:
    return decode(messages, schemas.STATS)


def configurations(messages: DataFrame) -> DataFrame:
    return decode(messages, schemas.CONFIG).filter(F.col("timestamp") > 0)


def heartbeats(messages: DataFrame) -> DataFrame:
    return decode(messages, schemas.HEARTBEAT).filter(F.col("timestamp") > 0)


def encode(df: DataFrame, key: Column) -> DataFrame:
    """(key, JSON value) from message columns."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def reading_messages(stored: DataFrame) -> DataFrame:
    """Stored readings as wire messages keyed by macrozone."""
    wire = stored.select(
        F.col("macrozone_name").alias("macrozone"), F.col("zone_name").alias("zone"), "sensor_id",
        timeutil.epoch_seconds(F.col("time")).alias("timestamp"), "type", F.col("value").cast("double").alias("data"),
    )
    return encode(wire, F.col("macrozone"))


def statistics_messages(stored: DataFrame) -> DataFrame:
    """Stored statistics as wire messages keyed by macrozone; absent levels become ''."""
    level = lambda c: F.col(c) if c in stored.columns else F.lit("")
    wire = stored.select(
        timeutil.epoch_seconds(F.col("time")).alias("timestamp"),
        level("region_name").alias("region"), level("macrozone_name").alias("macrozone"), level("zone_name").alias("zone"),
        "type", F.col("min_value").alias("min"), F.col("max_value").alias("max"), F.col("avg_value").alias("avg"),
        F.col("avg_sum").alias("sum"), F.col("avg_count").alias("count"),
    )
    return encode(wire, F.col("macrozone"))


def configuration_messages(messages: DataFrame) -> DataFrame:
    return encode(messages, F.col("macrozone"))


def heartbeat_messages(messages: DataFrame) -> DataFrame:
    """Keyed by macrozone-zone-hub, so a compacted topic keeps one heartbeat per hub."""
    return encode(messages, F.concat_ws("-", "macrozone", "zone", "hub_id"))


def publish(messages: DataFrame, fmt: str, path: str | None = None, **options):
    """Append (key, value) messages to a batch sink."""
    writer = messages.write.format(fmt).mode("append").options(**options)
    return writer.save(path) if path else writer.save()


def publish_once(messages: DataFrame, fmt: str, path: str, batch: int) -> None:
    """Messages of a numbered batch to a folder of its own; a number that is complete is left alone,
    one that broke off is written anew."""
    spark, folder = messages.sparkSession, f"{path}/batch={batch}"
    if not files.exists(spark, f"{folder}/_SUCCESS"):
        messages.write.format(fmt).mode("overwrite").save(folder)


def with_region(rows: DataFrame, region: str | DataFrame) -> DataFrame:
    """Rows with ``region_name``: one region's name, or looked up by macrozone in a table of macrozones.

    A macrozone that is not in the table, or whose name several regions use, does not say its
    region: such rows keep a null and are no rows of a neighbour's region by chance.
    """
    if isinstance(region, str):
        return rows.withColumn("region_name", F.lit(region))
    places = region.groupBy(F.col("name").alias("macrozone_name")).agg(
        F.when(F.min("region_name") == F.max("region_name"), F.min("region_name")).alias("region_name")
    )
    return rows.join(places, "macrozone_name", "left")


def stored_readings(wire: DataFrame) -> DataFrame:
    """Decoded readings with the column names and event time of the stored table."""
    return wire.select(
        timeutil.from_epoch(F.col("timestamp")).alias("time"), F.col("macrozone").alias("macrozone_name"),
        F.col("zone").alias("zone_name"), "sensor_id", "type", F.col("data").alias("value"),
    )


def stored_statistics(wire: DataFrame) -> DataFrame:
    return wire.select(
        timeutil.from_epoch(F.col("timestamp")).alias("time"), F.col("region").alias("region_name"),
        F.col("macrozone").alias("macrozone_name"), F.col("zone").alias("zone_name"), "type",
        F.col("min").alias("min_value"), F.col("max").alias("max_value"), F.col("avg").alias("avg_value"),
        F.col("sum").alias("avg_sum"), F.col("count").alias("avg_count"),
    )
