"""Sensor-hierarchy tables derived from the star-schema test tables.

Suppliers play macrozones, users play sensors, events play readings and line items play
daily statistics, so every derived table grows with the given data. The oracle states
the same views in SQL (``plans/oracle.py``).
"""

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold.functions import geo
from meterfold.session import configure

NOW = dt.datetime(2024, 1, 31)
SPLIT = dt.datetime(2024, 1, 16)
REGISTERED_BEFORE = dt.datetime(2024, 1, 3)
SIDE = 0.02


class Tables:
    """Lazily opened base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.base("events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("k", k)

    @cached_property
    def regions(self) -> DataFrame:
        return self.base("region").select(F.col("r_name").alias("name"))

    @cached_property
    def dimensions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return (
            self.base("supplier").withColumnRenamed("s_name", "macrozone_name"), self.base("nation"),
            self.base("region").withColumnRenamed("r_name", "region_name"),
        )

    def _place(self, facts: DataFrame, key: str) -> DataFrame:
        """Facts with macrozone and region. One dimension is joined after the other, so that
        Spark judges each by its own size and never takes the facts for the smaller side."""
        s, n, r = self.dimensions
        return (
            facts.join(s, F.col(key) == F.col("s_suppkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        )

    @cached_property
    def placed(self) -> DataFrame:
        """Suppliers with their region."""
        s, n, r = self.dimensions
        return (
            s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "region_name", "macrozone_name", "s_acctbal")
        )

    @cached_property
    def macrozones(self) -> DataFrame:
        k = F.col("s_suppkey")
        div = lambda m: F.floor(k / m)
        col = k % 25 + 25 * (div(2500) % 28)
        lon0 = F.lit(-175.0) + col.cast("double") * 0.5
        lat0 = F.lit(30.0) + (div(25) % 100).cast("double") * 0.4 - (div(70000) % 3).cast("double") * 40.0
        return self.placed.select(
            "region_name", F.col("macrozone_name").alias("name"), geo.square(lon0, lat0, SIDE).alias("ring"),
            F.when(F.col("s_acctbal") >= 5000, "indoor").otherwise("outdoor").alias("type"),
            F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("creation_time"),
        )

    @cached_property
    def places(self) -> DataFrame:
        c = geo.centroid(F.col("ring"))
        return self.macrozones.withColumn("c", c).select("region_name", "name", "c.lat", "c.lon")

    @cached_property
    def zones(self) -> DataFrame:
        zone = F.explode(F.array(*[F.lit(f"zone-{i}") for i in range(3)]))
        return self.placed.filter("s_acctbal >= 0").select(
            "region_name", "macrozone_name", zone.alias("name"),
            F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("creation_time"),
        )

    @cached_property
    def located(self) -> DataFrame:
        """Events with the place of their sensor."""
        home = (F.floor(F.col("user_id") / 15) * 10).alias("home")
        e = self.events.select("*", home)
        zone = F.concat(F.lit("zone-"), (F.col("user_id") % 3).cast("string"))
        return (
            self._place(e, "home")
            .select(
                "region_name", "macrozone_name", zone.alias("zone_name"), (F.col("user_id") % 5).cast("string").alias("sensor_id"),
                F.col("ts").alias("time"), F.col("event_type").alias("type"), "value", "event_id", "k",
            )
        )

    @cached_property
    def readings(self) -> DataFrame:
        return self.located.drop("k")

    @cached_property
    def outbox(self) -> DataFrame:
        """A quarter of the readings still waits."""
        status = F.when(F.col("k") < 25, "pending").otherwise("sent")
        return self.located.withColumn("status", status).drop("k")

    @cached_property
    def macro_stats(self) -> DataFrame:
        li = self.base("lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")
        price = F.col("l_extendedprice")
        daily = li.groupBy(
            F.col("l_shipdate").cast("timestamp_ntz").alias("time"), "l_suppkey", F.col("l_returnflag").alias("type")
        ).agg(
            F.min(price).alias("min_value"), F.max(price).alias("max_value"),
            F.sum(price).alias("avg_sum"), F.count(F.lit(1)).alias("avg_count"),
        )
        return self._place(daily, "l_suppkey").select(
            "time", "region_name", "macrozone_name", "type", "min_value", "max_value",
            (F.col("avg_sum") / F.col("avg_count")).alias("avg_value"), "avg_sum", "avg_count",
        )

    @cached_property
    def heartbeats(self) -> DataFrame:
        """View events; a few lack time, hub or macrozone."""
        k = F.col("k")
        return self.located.filter("type = 'view'").select(
            F.when(k != 0, F.col("time")).alias("time"),
            F.when(k == 2, "").otherwise(F.col("macrozone_name")).alias("macrozone"),
            F.when(k >= 50, "").otherwise(F.col("zone_name")).alias("zone"),
            F.when(k == 1, "").otherwise(F.concat(F.lit("hub-"), F.col("zone_name"))).alias("hub_id"),
        )

    @cached_property
    def configs(self) -> DataFrame:
        """All other events as configuration messages."""
        t = F.col("type")
        msg = (
            F.when(t == "signup", "new_sensor").when(t == "purchase", "new_edge").when(t == "click", "new_proximity")
            .otherwise("bogus")
        )
        return self.located.filter("type <> 'view'").select(
            msg.alias("msg_type"), F.when(F.col("k") < 50, "edge_hub").otherwise("edge_hub_filter").alias("service"),
            "time", "region_name", "macrozone_name", "zone_name", F.concat(F.lit("hub-"), F.col("zone_name")).alias("hub_id"),
            "sensor_id", F.when(F.col("k") < 50, "temperature").otherwise("humidity").alias("sensor_type"),
            F.concat(F.lit("ref-"), F.col("k").cast("string")).alias("sensor_reference"),
        )

    def _registered(self, msg_type: str, key: str, attributes: dict[str, str]) -> DataFrame:
        """Device table as registered by the first half of the messages."""
        rows = self.configs.filter((F.col("msg_type") == msg_type) & (F.col("time") < F.lit(SPLIT).cast("timestamp_ntz")))
        keys = ["region_name", "macrozone_name"] + (["zone_name"] if msg_type != "new_proximity" else [])
        first = F.min_by(F.struct(*attributes), F.struct("time", *attributes))
        out = rows.groupBy(*keys, F.col(key).alias("id")).agg(
            first.alias("a"), F.min("time").alias("registration_time"), F.max("time").alias("last_seen")
        )
        return out.select("id", *keys, *[F.col(f"a.{c}").alias(a) for c, a in attributes.items()], "registration_time", "last_seen")

    @cached_property
    def macrozone_hubs(self) -> DataFrame:
        return self._registered("new_proximity", "hub_id", {"service": "service"})

    @cached_property
    def zone_hubs(self) -> DataFrame:
        return self._registered("new_edge", "hub_id", {"service": "service"})

    @cached_property
    def device_sensors(self) -> DataFrame:
        return self._registered("new_sensor", "sensor_id", {"sensor_type": "type", "sensor_reference": "reference"})

    @cached_property
    def region_hubs(self) -> DataFrame:
        return self.located.groupBy("region_name", F.concat(F.lit("rh-"), F.col("type")).alias("id")).agg(
            F.min("type").alias("service"), F.min("time").alias("registration_time"), F.max("time").alias("last_seen")
        )

    @cached_property
    def sensors(self) -> DataFrame:
        """Sensors registered in the first days; one that registered once was not seen since."""
        rows = self.located.filter((F.col("type") == "signup") & (F.col("time") < F.lit(REGISTERED_BEFORE).cast("timestamp_ntz")))
        return rows.groupBy(F.col("sensor_id").alias("id"), "region_name", "macrozone_name", "zone_name").agg(
            F.min("time").alias("registration_time"),
            F.when(F.count(F.lit(1)) > 1, F.max("time")).alias("last_seen"),
        )

    @cached_property
    def received(self) -> DataFrame:
        """Events that got through: 15 percent are lost."""
        return self.located.filter("k >= 15")

    # ---- streams ----------------------------------------------------------------

    def event_stream(self) -> DataFrame:
        """The events as a stream; the pattern fits a single file as well as a folder of files."""
        schema = self.base("events").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/events.parquet*")

    def reading_stream(self) -> DataFrame:
        """Readings as a stream with a TIMESTAMP event time, placed by a stream-static join."""
        home = F.floor(F.col("user_id") / 15) * 10
        zone = F.concat(F.lit("zone-"), (F.col("user_id") % 3).cast("string"))
        return (
            self._place(self.event_stream().withColumn("home", home), "home")
            .select(
                "region_name", "macrozone_name", zone.alias("zone_name"), (F.col("user_id") % 5).cast("string").alias("sensor_id"),
                F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("type"), "value", "event_id",
            )
        )
