"""Ingestion queries: every micro-batch goes to idempotent sinks, then offsets are committed.

Each function returns a started query. ``trigger`` is passed to ``writeStream.trigger``:
``{"availableNow": True}`` drains the source once, ``{"processingTime": "15 seconds"}``
together with the source's per-trigger limits gives batches by size or time.

Device tables are keyed logs (``sources/keyed.py``): an epoch writes its own changes and reads
nothing, a replayed epoch replaces them. ``compact_every`` epochs the log is merged into the
touched buckets; 0 leaves that to another process. ``writer`` names the query in the log.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterfold import schemas
from meterfold.operators import filters
from meterfold.sources import keyed, messages, tables

ONCE = {"availableNow": True}
COMPACT_EVERY = 50


def per_batch(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Run ``save(batch, epoch)`` per micro-batch; the batch is computed once for all sinks."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            save(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _compact(spark, epoch: int, every: int, *stored: keyed.KeyedTable) -> None:
    if every and (epoch + 1) % every == 0:
        for table in stored:
            keyed.compact(spark, table)


def append_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE, fmt: str = "parquet") -> StreamingQuery:
    """Append-mode file sink."""
    return (
        stream.writeStream.format(fmt).outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def deduplicated(stream: DataFrame, keys: list[str], time: str = "time", lateness: str = "10 minutes") -> DataFrame:
    """Drop repeated keys that arrive within the lateness; the sinks drop the later ones."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def facts(stream: DataFrame, path: str, keys: list[str], checkpoint: str, trigger: dict = ONCE, arrival: str | None = None) -> StreamingQuery:
    """Insert-if-absent into one fact table. ``arrival`` is the column that says which of equal keys came first."""
    return per_batch(stream, lambda b, e: tables.append_absent(b, path, keys, arrival=arrival), checkpoint, trigger)


def readings(
    stream: DataFrame, table: str, sensors: keyed.KeyedTable, checkpoint: str, trigger: dict = ONCE,
    keys: list[str] = schemas.READING_KEY, arrival: str | None = None, writer: str = "readings", compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Readings to the fact table and to the sensors' last_seen."""

    def save(batch: DataFrame, epoch: int) -> None:
        tables.append_absent(batch, table, keys, arrival=arrival)
        keyed.touch(batch.withColumn("id", F.col("sensor_id")), sensors, writer, epoch)
        _compact(batch.sparkSession, epoch, compact_every, sensors)

    return per_batch(stream, save, checkpoint, trigger)


def statistics(stream: DataFrame, zone_table: str, macrozone_table: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Statistics to the zone or macrozone table by their grain."""

    def save(batch: DataFrame, epoch: int) -> None:
        routed = filters.with_grain(batch, "zone_name", "macrozone_name")
        zone = routed.filter("grain = 'zone'").drop("grain")
        macro = routed.filter("grain = 'macrozone'").drop("grain", "zone_name")
        tables.append_absent(zone, zone_table, schemas.ZONE_STATS_KEY)
        tables.append_absent(macro, macrozone_table, schemas.MACRO_STATS_KEY)

    return per_batch(stream, save, checkpoint, trigger)


def configurations(
    stream: DataFrame, macrozone_hubs: keyed.KeyedTable, zone_hubs: keyed.KeyedTable, sensors: keyed.KeyedTable, checkpoint: str,
    trigger: dict = ONCE, writer: str = "configurations", compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Configuration messages (stored column names, region included) to the three device tables."""

    def save(batch: DataFrame, epoch: int) -> None:
        routed = filters.with_target(batch)
        hub = routed.withColumn("id", F.col("hub_id"))
        sensor = routed.withColumn("id", F.col("sensor_id")).withColumnsRenamed(
            {"sensor_type": "type", "sensor_reference": "reference"}
        )
        stored = {"macrozone_hubs": (macrozone_hubs, hub), "zone_hubs": (zone_hubs, hub), "sensors": (sensors, sensor)}
        for target, (table, rows) in stored.items():
            keyed.register(rows.filter(F.col("target") == target), table, writer, epoch)
        _compact(batch.sparkSession, epoch, compact_every, macrozone_hubs, zone_hubs, sensors)

    return per_batch(stream, save, checkpoint, trigger)


def heartbeats(
    stream: DataFrame, region: str | DataFrame, macrozone_hubs: keyed.KeyedTable, zone_hubs: keyed.KeyedTable, checkpoint: str,
    trigger: dict = ONCE, writer: str = "heartbeats", compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Heartbeats (time, macrozone, zone, hub_id) to the hubs' last_seen; ``region`` as in ``messages.with_region``."""

    def save(batch: DataFrame, epoch: int) -> None:
        routed = filters.with_grain(filters.valid_heartbeats(batch)).withColumnsRenamed(
            {"hub_id": "id", "macrozone": "macrozone_name", "zone": "zone_name"}
        )
        routed = messages.with_region(routed, region)
        for table, grain in ((macrozone_hubs, "macrozone"), (zone_hubs, "zone")):
            keyed.touch(routed.filter(F.col("grain") == grain), table, writer, epoch)
        _compact(batch.sparkSession, epoch, compact_every, macrozone_hubs, zone_hubs)

    return per_batch(stream, save, checkpoint, trigger)


def relay(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], fmt: str, checkpoint: str, path: str | None = None, trigger: dict = ONCE, **options) -> StreamingQuery:
    """Forward control messages with a time unchanged; ``encode`` is one of the ``messages.*_messages``."""
    valid = stream.filter(F.col("timestamp") > 0)
    writer = encode(valid).writeStream.format(fmt).outputMode("append").options(**options)
    if path:
        writer = writer.option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
