"""Fixed schemas of the wire messages and stored tables. Nothing is inferred."""

from pyspark.sql import types as T

READING = T.StructType([
    T.StructField("macrozone", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", T.DoubleType()),
])

STATS = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("region", T.StringType()),
    T.StructField("macrozone", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("avg", T.DoubleType()),
    T.StructField("sum", T.DoubleType()),
    T.StructField("count", T.LongType()),
])

CONFIG = T.StructType([
    T.StructField("msg_type", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("macrozone", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("hub_id", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("sensor_location", T.StringType()),
    T.StructField("sensor_type", T.StringType()),
    T.StructField("sensor_reference", T.StringType()),
])

HEARTBEAT = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("macrozone", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("hub_id", T.StringType()),
])

# Primary keys of the stored tables; region_name is a real key column because all
# regions share one table here.
READING_KEY = ["time", "region_name", "macrozone_name", "zone_name", "sensor_id", "type"]
ZONE_STATS_KEY = ["time", "region_name", "macrozone_name", "zone_name", "type"]
MACRO_STATS_KEY = ["time", "region_name", "macrozone_name", "type"]
REGION_STATS_KEY = ["time", "region_name", "type"]

# Device ids are unique within their place only.
SENSOR = ["region_name", "macrozone_name", "zone_name", "sensor_id"]
MACROZONE_HUB_KEY = ["id", "region_name", "macrozone_name"]
ZONE_HUB_KEY = ["id", "region_name", "macrozone_name", "zone_name"]
SENSOR_KEY = ["id", "region_name", "macrozone_name", "zone_name"]
