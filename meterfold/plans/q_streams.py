"""Registered queries: sources, sinks, streams and stored results."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold import schemas
from meterfold.functions import geo, timeutil
from meterfold.operators import analysis, devices, filters, latest, outbox, rollup, sets
from meterfold.plans import jobs
from meterfold.plans.fixtures import NOW, SPLIT, Tables
from meterfold.plans.oracle import query
from meterfold.plans.q_analytics import compared_daily, macro_q, ntz, region_q, variation
from meterfold.plans.q_basic import rnd, sql_stats, stats_rounded, wkt
from meterfold.session import scratch_path
from meterfold.sources import keyed, messages, tables
from meterfold.sources.outbox import Outbox
from meterfold.streaming import ingest, state, windows


DAYS = [dt.datetime(2000, 5, 2) + dt.timedelta(days=i) for i in range(60)]


def fresh(t: Tables, name: str) -> str:
    return scratch_path(t.spark, name)


def drained(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into files and read them."""
    path = fresh(t, name)
    ingest.append_files(stream, path, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def as_ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols or ("time",)})


def topic(t: Tables, rows: DataFrame, name: str) -> str:
    """Publish messages to JSON files and return their path."""
    path = fresh(t, name)
    messages.publish(rows, "json", path)
    return path


def consumed(t: Tables, rows: DataFrame, decode, name: str) -> DataFrame:
    """Messages published to files and read back through the streaming source."""
    raw = messages.open_messages(t.spark, "json", stream=True, path=topic(t, rows, name))
    return drained(t, decode(raw), f"{name}-decoded")


# ---- S and K: sources and sinks ------------------------------------------------

_WIRE = """SELECT macrozone_name AS macrozone, zone_name AS zone, sensor_id, cast(floor(epoch(time)) AS bigint) AS timestamp,
  type, value AS data FROM readings"""


def _with_garbage(rows: DataFrame) -> DataFrame:
    """Beside each message an undecodable one, which the source must drop."""
    return rows.unionByName(rows.select("key", F.expr("substr(value, 1, length(value) - 3)").alias("value")))


@query("s1", _WIRE)
def s1(t):
    return consumed(t, _with_garbage(messages.reading_messages(t.readings)), messages.readings, "s1")


@query("s2", """SELECT cast(epoch(time) AS bigint) AS timestamp, region_name AS region, macrozone_name AS macrozone,
  zone_name AS zone, type, min_value AS min, max_value AS max, round(avg_value, 6) AS avg, round(avg_sum, 2) AS sum,
  avg_count AS count FROM zone_q""")
def s2(t):
    out = consumed(t, messages.statistics_messages(rollup.zone_stats(t.readings)), messages.statistics, "s2")
    return rnd(rnd(out, 6, "avg"), 2, "sum")


def config_wire(t: Tables) -> DataFrame:
    return t.configs.select(
        "msg_type", "service", timeutil.epoch_seconds(F.col("time")).alias("timestamp"), F.col("macrozone_name").alias("macrozone"),
        F.col("zone_name").alias("zone"), "hub_id", "sensor_id", F.lit("").alias("sensor_location"), "sensor_type", "sensor_reference",
    )


_CONFIG_WIRE = """SELECT msg_type, service, cast(floor(epoch(time)) AS bigint) AS timestamp, macrozone_name AS macrozone,
  zone_name AS zone, hub_id, sensor_id, '' AS sensor_location, sensor_type, sensor_reference FROM configs"""


@query("s3", _CONFIG_WIRE)
def s3(t):
    rows = messages.configuration_messages(config_wire(t))
    empty = rows.select("key", F.lit("{}").alias("value"))
    return consumed(t, rows.unionByName(empty), messages.configurations, "s3")


def beat_wire(t: Tables) -> DataFrame:
    return t.heartbeats.select(timeutil.epoch_seconds(F.col("time")).alias("timestamp"), "macrozone", "zone", "hub_id")


_BEAT_WIRE = "SELECT cast(floor(epoch(time)) AS bigint) AS timestamp, macrozone, zone, hub_id FROM heartbeats WHERE time IS NOT NULL"


@query("s4", _BEAT_WIRE)
def s4(t):
    return consumed(t, messages.heartbeat_messages(beat_wire(t)), messages.heartbeats, "s4")


@query("s5", "SELECT date_trunc('second', ts) AS time, value FROM ev WHERE k >= 5")
def s5(t):
    path = fresh(t, "s5")
    rows = t.events.select(
        F.date_format(F.when(F.col("k") != 4, F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("k") < 4, "n/a").otherwise(F.col("value").cast("string")).alias("pm10"),
    )
    rows.write.option("sep", ";").option("header", True).csv(path)
    return tables.historical_csv(t.spark, path, "pm10")


@query("s6", "SELECT * FROM readings WHERE region_name = 'AFRICA'")
def s6(t):
    path = fresh(t, "s6")
    tables.overwrite_partitions(t.readings, path, ["region_name"])
    return tables.scan(t.spark, path, region_name="AFRICA")


@query("s7", "SELECT region_name, name, type, creation_time, round(lat, 9) AS lat, round(lon, 9) AS lon FROM macrozones")
def s7(t):
    path = fresh(t, "s7")
    t.macrozones.withColumn("location", wkt(F.col("ring"))).drop("ring").write.parquet(path)
    rows = tables.locations(t.spark.read.parquet(path))
    rows = rows.withColumn("c", geo.centroid(F.col("ring"))).withColumns({"lat": F.col("c.lat"), "lon": F.col("c.lon")})
    return rnd(rows.drop("ring", "c"), 9, "lat", "lon")


def _sent(t: Tables, rows: DataFrame, schema, name: str) -> DataFrame:
    """What a batch sink holds: key and decoded payload."""
    raw = messages.open_messages(t.spark, "json", path=topic(t, rows, name))
    body = F.from_json("value", schema)
    return raw.select("key", body.alias("m")).select("key", "m.*")


@query("k1", _WIRE.replace("SELECT macrozone_name AS", "SELECT macrozone_name AS key, macrozone_name AS", 1))
def k1(t):
    return _sent(t, messages.reading_messages(t.readings), schemas.READING, "k1")


@query("k2", """SELECT macrozone_name AS key, cast(epoch(time) AS bigint) AS timestamp, region_name AS region,
  macrozone_name AS macrozone, '' AS zone, type, min_value AS min, max_value AS max, round(avg_value, 6) AS avg,
  round(avg_sum, 2) AS sum, avg_count AS count FROM macro_q""")
def k2(t):
    return rnd(rnd(_sent(t, messages.statistics_messages(macro_q(t)), schemas.STATS, "k2"), 6, "avg"), 2, "sum")


@query("k3", f"SELECT macrozone AS key, * FROM ({_CONFIG_WIRE})")
def k3(t):
    return _sent(t, messages.configuration_messages(config_wire(t)), schemas.CONFIG, "k3")


@query("k4", f"SELECT concat_ws('-', macrozone, zone, hub_id) AS key, * FROM ({_BEAT_WIRE})")
def k4(t):
    return _sent(t, messages.heartbeat_messages(beat_wire(t).filter("timestamp IS NOT NULL")), schemas.HEARTBEAT, "k4")


@query("f18", _WIRE)
def f18(t):
    """Encode every reading as JSON and decode it again."""
    return messages.readings(messages.reading_messages(t.readings))


def _twice(t: Tables, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Append the first half, then everything: each key must be stored once."""
    path = fresh(t, name)
    tables.append_absent(rows.filter(F.col("time") < ntz(SPLIT)), path, keys)
    tables.append_absent(rows.unionByName(rows), path, keys)
    return t.spark.read.parquet(path).drop("day")


@query("k5", "SELECT * FROM readings")
def k5(t):
    return _twice(t, t.readings, schemas.READING_KEY, "k5")


@query("k6", sql_stats("time, region_name, macrozone_name, zone_name, type", "zone_q"))
def k6(t):
    return stats_rounded(_twice(t, rollup.zone_stats(t.readings), schemas.ZONE_STATS_KEY, "k6"))


@query("k7", sql_stats("time, region_name, type", "region_q"))
def k7(t):
    return stats_rounded(_twice(t, region_q(t), schemas.REGION_STATS_KEY, "k7"))


@query("k8", """SELECT day, region_name, macrozone_name, type, round(current, 6) AS current, round(previous, 6) AS previous,
  round(delta_perc, 6) AS delta_perc FROM variation""")
def k8(t):
    path = fresh(t, "k8")
    rows = variation(t)
    tables.save_analysis(rows, path)
    out = t.spark.read.parquet(path).withColumn("day", F.col("day").cast("timestamp_ntz"))
    return rnd(out, 6, "current", "previous", "delta_perc")


@query("k9", """SELECT event_type, cast(count(*) AS varchar) AS n, cast(max(k) AS varchar) AS worst FROM ev GROUP BY event_type
  UNION ALL SELECT 'all', cast(count(*) AS varchar), cast(max(k) AS varchar) FROM ev""")
def k9(t):
    path = fresh(t, "k9")
    row = [F.count(F.lit(1)).alias("n"), F.max("k").alias("worst")]
    tables.append_csv(t.events.groupBy("event_type").agg(*row), path)
    tables.append_csv(t.events.groupBy(F.lit("all").alias("event_type")).agg(*row), path)
    return t.spark.read.option("header", True).csv(path)


_ACCEPTED = """RECURSIVE o AS (SELECT concat_ws('/', region_name, macrozone_name, zone_name, sensor_id) AS sensor, event_id, value,
  row_number() OVER (PARTITION BY region_name, macrozone_name, zone_name, sensor_id ORDER BY date_trunc('second', time), value) AS rn FROM readings),
f AS (SELECT sensor, event_id, rn, [value] AS h, true AS accepted FROM o WHERE rn = 1
  UNION ALL
  SELECT sensor, event_id, rn, CASE WHEN ok THEN list_append(h, value)[-100:] ELSE h END, ok
  FROM (SELECT o.*, f.h, len(f.h) < 5 OR abs(o.value - list_avg(f.h)) <= 3 * list_stddev_pop(f.h) AS ok
        FROM f JOIN o ON o.sensor = f.sensor AND o.rn = f.rn + 1))"""


# From payloads to region statistics: messages are published in three lots, each drained by the same
# query, which goes on from its checkpoint with the histories it had.
@query("flow", _ACCEPTED + """,
z AS (SELECT time_bucket(INTERVAL '15 minutes', time) + INTERVAL '15 minutes' AS time, region_name, macrozone_name, type,
        min(value) AS low, max(value) AS high, sum(cast(value AS decimal(18,2))) AS s, count(*) AS n
      FROM readings WHERE event_id IN (SELECT event_id FROM f WHERE accepted) GROUP BY ALL)
SELECT time_bucket(INTERVAL '30 minutes', time) + INTERVAL '30 minutes' AS time, region_name, type, min(low) AS min_value, max(high) AS max_value,
  round(cast(sum(s) AS double) / sum(n), 6) AS avg_value, round(cast(sum(s) AS double), 2) AS avg_sum, cast(sum(n) AS bigint) AS avg_count
FROM z GROUP BY time_bucket(INTERVAL '30 minutes', time), region_name, type""")
def flow(t):
    path = fresh(t, "flow")
    cuts = [dt.datetime(2000, 1, 1), dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21), dt.datetime(2100, 1, 1)]
    for start, end in zip(cuts, cuts[1:]):
        lot = t.readings.filter(filters.in_range("time", start, end))
        messages.publish(_with_garbage(messages.reading_messages(lot)), "json", f"{path}-topic")
        raw = messages.open_messages(t.spark, "json", stream=True, path=f"{path}-topic")
        known = messages.with_region(messages.stored_readings(messages.readings(raw)), t.macrozones)
        save = lambda rows, epoch: tables.append_absent(rows, path, schemas.READING_KEY)
        state.filter_outliers(known, save, f"{path}-histories", f"{path}-checkpoint", forget_after=None).awaitTermination()
    facts = t.spark.read.parquet(path)
    return stats_rounded(rollup.region_stats(rollup.macrozone_stats(rollup.zone_stats(facts))))


# ---- stored roll-ups and results -----------------------------------------------

_DAILY = sql_stats("day, region_name, macrozone_name, type", "macro_daily", "total_sum", "total_count",
                   "WHERE day BETWEEN TIMESTAMP '{}' AND TIMESTAMP '{}'")


@query("a14", _DAILY.format("2000-05-02", "2000-06-30"))
def a14(t):
    path = fresh(t, "a14")
    jobs.refresh_missing(t.macro_stats, path, "day", rollup.MACROZONE_KEYS, DAYS[20:40])
    out = jobs.refresh_missing(t.macro_stats, path, "day", rollup.MACROZONE_KEYS, DAYS)
    return stats_rounded(out.drop("bucket"))


@query("a15", _DAILY.format("2000-06-28", "2000-06-30"))
def a15(t):
    path = fresh(t, "a15")
    stale = t.macro_stats.filter("time = TIMESTAMP_NTZ '2000-06-29 00:00:00'").limit(1)
    jobs.scheduled_refresh(stale, path, "day", rollup.MACROZONE_KEYS, dt.datetime(2000, 6, 29, 12))
    out = jobs.scheduled_refresh(t.macro_stats, path, "day", rollup.MACROZONE_KEYS, dt.datetime(2000, 6, 30, 0, 10))
    return stats_rounded(out.drop("bucket"))


@query("e15", """SELECT day, region_name, macrozone_name, type, round(delta_perc, 6) AS delta_perc FROM variation
  WHERE day BETWEEN TIMESTAMP '2000-05-02' AND TIMESTAMP '2000-05-31'""")
def e15(t):
    path, days = fresh(t, "e15"), [d.date() for d in DAYS[:30]]

    def compute(missing):
        span = min(missing), max(missing)
        rows = analysis.yearly_variation(compared_daily(t, *span), *span)
        return rows.filter(F.col("day").isin(missing))

    jobs.read_through(t.spark, path, days[5:15], {"radius": 50_000}, compute, NOW)
    out = jobs.read_through(t.spark, path, days, {"radius": 50_000}, compute, NOW)
    out = out.withColumn("day", F.col("day").cast("timestamp_ntz"))
    return rnd(out.select("day", *analysis.KEYS, "delta_perc"), 6, "delta_perc")


# ---- ST: streams ---------------------------------------------------------------

@query("st1", """RECURSIVE o AS (SELECT concat_ws('/', region_name, macrozone_name, zone_name, sensor_id) AS sensor, sensor_id, event_id, value,
  row_number() OVER (PARTITION BY region_name, macrozone_name, zone_name, sensor_id ORDER BY time, value) AS rn FROM readings),
f AS (SELECT sensor, sensor_id, event_id, rn, [value] AS h, true AS accepted FROM o WHERE rn = 1
  UNION ALL
  SELECT sensor, sensor_id, event_id, rn, CASE WHEN ok THEN list_append(h, value)[-100:] ELSE h END, ok
  FROM (SELECT o.*, f.h, len(f.h) < 5 OR abs(o.value - list_avg(f.h)) <= 3 * list_stddev_pop(f.h) AS ok
        FROM f JOIN o ON o.sensor = f.sensor AND o.rn = f.rn + 1))
SELECT event_id, sensor_id FROM f WHERE accepted""")
def st1(t):
    """The readings in three micro-batches by time, judged by the histories of the ones before."""
    path = fresh(t, "st1")
    for n in range(3):
        days = F.least(F.floor((F.dayofmonth("time") - 1) / 10), F.lit(2)) == n
        t.readings.filter(days).withColumn("time", F.col("time").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}-in")
        stream = t.spark.readStream.schema("event_id long, sensor_id string, region_name string, macrozone_name string, zone_name string, time timestamp, type string, value double").parquet(f"{path}-in")
        save = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        state.filter_outliers(stream, save, f"{path}-histories", f"{path}-checkpoint", forget_after=None).awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "sensor_id")


# the watermark ends at the newest reading minus the delay; later windows stay open
@query("st2", """SELECT date_trunc('minute', time) AS time, region_name, macrozone_name, zone_name, sensor_id, arg_max(type, (time, type)) AS type,
  round(avg(value), 6) AS value FROM readings GROUP BY date_trunc('minute', time), region_name, macrozone_name, zone_name, sensor_id
HAVING date_trunc('minute', any_value(time)) + INTERVAL '1 minute' <= (SELECT max(time) FROM readings) - INTERVAL '1 minute'""")
def st2(t):
    return rnd(as_ntz(drained(t, windows.sensor_means(t.reading_stream()), "st2")), 6, "value")


_CLOSED = "WHERE time <= (SELECT max(time) FROM readings) - INTERVAL '{} minutes'"


@query("st3", sql_stats("time, region_name, macrozone_name, zone_name, type", "zone_q", tail=_CLOSED.format(10))
       + " UNION ALL " + sql_stats("time, region_name, macrozone_name, '' AS zone_name, type", "macro_q", tail=_CLOSED.format(10)))
def st3(t):
    """Both grains from one stream."""
    both = drained(t, windows.zone_and_macrozone_stats(t.reading_stream()), "st3")
    return stats_rounded(as_ntz(both.drop("grain")))


# stamp - 15 min is the end of the last covered macrozone window
@query("st4", sql_stats("time, region_name, type", "region_q",
       tail="WHERE time - INTERVAL '15 minutes' <= (SELECT max(time) FROM readings) - INTERVAL '20 minutes'"))
def st4(t):
    return stats_rounded(as_ntz(drained(t, windows.region_stats(t.reading_stream()), "st4")))


@query("st5", "SELECT * FROM readings")
def st5(t):
    """Raw rows are kept however late they are: the late half arrives first, then the early one."""
    path = fresh(t, "st5")
    drop = f"{path}-in"
    t.readings.filter(F.col("time") >= ntz(SPLIT)).write.mode("append").parquet(drop)
    for part in (None, t.readings.filter(F.col("time") < ntz(SPLIT))):
        if part is not None:
            part.write.mode("append").parquet(drop)
        stream = t.spark.readStream.schema(t.readings.schema).parquet(drop)
        ingest.facts(stream, path, schemas.READING_KEY, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.parquet(path).drop("day").select(*t.readings.columns)


@query("st6", sql_stats("time, region_name, macrozone_name, zone_name, type", "zone_q z", tail="""WHERE time <= TIMESTAMP '2024-01-30 23:45:00'
  AND time > coalesce((SELECT max(time) FROM zone_q l WHERE l.macrozone_name = z.macrozone_name AND l.time <= TIMESTAMP '2024-01-16 00:00:00'), TIMESTAMP '2024-01-29 23:30:00')"""))
def st6(t):
    done = rollup.zone_stats(t.readings.filter(F.col("time") < ntz(SPLIT)))
    out = rollup.catch_up_zone_stats(t.readings, rollup.last_aggregated(done, ["region_name", "macrozone_name"]), NOW)
    return stats_rounded(out)


@query("st7", "SELECT * FROM readings")
def st7(t):
    """Each message delivered twice in the same batch."""
    doubled = t.reading_stream().withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return as_ntz(drained(t, ingest.deduplicated(doubled, schemas.READING_KEY), "st7"))


@query("st8", "SELECT * FROM readings")
def st8(t):
    """Several micro-batches, limited by the source, into one fact table."""
    path = fresh(t, "st8")
    t.readings.repartition(4).write.parquet(f"{path}-in")
    stream = t.spark.readStream.schema(t.readings.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-in")
    ingest.facts(stream, path, schemas.READING_KEY, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.parquet(path).drop("day").select(*t.readings.columns)


@query("st9", """SELECT 'sensor' AS kind, s.id, greatest(s.last_seen, m.seen) AS time
FROM sensors s LEFT JOIN (SELECT sensor_id, region_name, macrozone_name, zone_name, max(time) AS seen FROM readings GROUP BY ALL) m
  ON m.sensor_id = s.id AND m.region_name = s.region_name AND m.macrozone_name = s.macrozone_name AND m.zone_name = s.zone_name
UNION ALL SELECT 'reading', cast(event_id AS varchar), time FROM readings""")
def st9(t):
    path = fresh(t, "st9")
    sensors = _device_table(t.sensors, f"{path}-sensors", schemas.SENSOR_KEY)
    stream = as_ntz(t.reading_stream())
    ingest.readings(stream, path, sensors, f"{path}-checkpoint").awaitTermination()
    now = keyed.read(t.spark, sensors)
    facts = t.spark.read.parquet(path)
    return now.select(F.lit("sensor").alias("kind"), "id", F.col("last_seen").alias("time")).unionByName(
        facts.select(F.lit("reading").alias("kind"), F.col("event_id").cast("string").alias("id"), "time")
    )


def _device_table(rows: DataFrame, path: str, keys: list[str], attributes: list[str] = ()) -> keyed.KeyedTable:
    """A device table that starts with the given rows."""
    table = keyed.KeyedTable(path, keys, list(attributes))
    keyed.create(rows, table)
    return table


def _as_stream(t: Tables, rows: DataFrame, path: str, **options) -> DataFrame:
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).options(**options).parquet(path)


_BEATS = "SELECT hub_id, macrozone, {}, max(time) AS seen FROM heartbeats WHERE time IS NOT NULL AND hub_id <> '' AND macrozone <> '' AND zone {} '' GROUP BY ALL"


@query("st10", f"""SELECT h.id, h.macrozone_name, '' AS zone_name, greatest(h.last_seen, b.seen) AS last_seen
FROM macrozone_hubs h LEFT JOIN ({_BEATS.format("'' AS zone", "=")}) b ON b.hub_id = h.id AND b.macrozone = h.macrozone_name
UNION ALL SELECT h.id, h.macrozone_name, h.zone_name, greatest(h.last_seen, b.seen)
FROM zone_hubs h LEFT JOIN ({_BEATS.format("zone", "<>")}) b ON b.hub_id = h.id AND b.macrozone = h.macrozone_name AND b.zone = h.zone_name""")
def st10(t):
    path = fresh(t, "st10")
    macro = _device_table(t.macrozone_hubs, f"{path}-macro", schemas.MACROZONE_HUB_KEY, ["service"])
    zone = _device_table(t.zone_hubs, f"{path}-zone", schemas.ZONE_HUB_KEY, ["service"])
    stream = _as_stream(t, t.heartbeats.repartition(4), f"{path}-in", maxFilesPerTrigger=1)
    ingest.heartbeats(stream, t.macrozones, macro, zone, f"{path}-checkpoint", compact_every=2).awaitTermination()
    cols = ["id", "macrozone_name", "zone_name", "last_seen"]
    both = keyed.read(t.spark, macro).withColumn("zone_name", F.lit("")).select(*cols)
    return both.unionByName(keyed.read(t.spark, zone).select(*cols))


_PLACE = "region_name, macrozone_name, zone_name"
_KNOWN = f"SELECT {_PLACE}, sensor_id FROM readings UNION SELECT {_PLACE}, id FROM sensors"


@query("st11", f"""SELECT k.region_name, k.macrozone_name, k.zone_name, k.sensor_id, s.last_seen, CASE WHEN s.last_seen IS NULL OR s.last_seen < TIMESTAMP '2024-01-30 18:00:00' THEN 'removed'
  WHEN s.last_seen < TIMESTAMP '2024-01-30 23:55:00' THEN 'unhealthy' ELSE 'healthy' END AS status
FROM ({_KNOWN}) k LEFT JOIN (SELECT {_PLACE}, sensor_id, max(time) AS last_seen FROM readings GROUP BY ALL) s USING ({_PLACE}, sensor_id)""")
def st11(t):
    return devices.health(sets.known_sensors(t.sensors, t.readings), devices.last_seen(t.readings, schemas.SENSOR), NOW)


# All readings come in one micro-batch, which makes every sensor healthy; the batch that only moves the
# watermark then finds those silent that were last seen more than five minutes before it.
@query("st11_stream", f"""SELECT {_PLACE}, sensor_id, date_trunc('milliseconds', max(time)) AS last_seen, 'healthy' AS status FROM readings GROUP BY ALL
UNION ALL SELECT {_PLACE}, sensor_id, date_trunc('milliseconds', max(time)), 'unhealthy' FROM readings GROUP BY ALL
HAVING max(time) + INTERVAL '5 minutes' < (SELECT max(time) FROM readings) - INTERVAL '1 minute'""")
def st11_stream(t):
    return as_ntz(drained(t, state.health_changes(t.reading_stream()), "st11"), "last_seen")


@query("st12", f"SELECT DISTINCT {_PLACE}, sensor_id FROM configs WHERE msg_type = 'new_sensor'")
def st12(t):
    stream = _as_stream(t, t.configs, fresh(t, "st12-in")).filter("msg_type = 'new_sensor'")
    return drained(t, state.first_registrations(stream), "st12").select(*schemas.SENSOR)


@query("st13", """SELECT macrozone, zone, hub_id, max(time) AS time FROM heartbeats WHERE time IS NOT NULL GROUP BY macrozone, zone, hub_id""")
def st13(t):
    """Update mode: the sink keeps the newest row per key of every micro-batch."""
    path = fresh(t, "st13")
    keys = ["macrozone", "zone", "hub_id"]
    stream = _as_stream(t, t.heartbeats.filter("time IS NOT NULL"), f"{path}-in")
    newest = windows.latest_per_key(stream, keys)
    writer = newest.writeStream.outputMode("update").option("checkpointLocation", f"{path}-checkpoint")
    writer.trigger(availableNow=True).foreachBatch(lambda b, e: b.write.mode("append").parquet(path)).start().awaitTermination()
    return latest.latest_row(t.spark.read.parquet(path), keys)


@query("st14", """SELECT 'outbox' AS kind, sensor_id, type, 'sent' AS status, count(*) AS n FROM outbox GROUP BY ALL
UNION ALL SELECT 'topic', sensor_id, type, '', count(*) FROM outbox WHERE status = 'pending' GROUP BY ALL""")
def st14(t):
    """The first attempt breaks off in the middle of its messages; the next one publishes the same batch."""
    path = fresh(t, "st14")
    box = Outbox(f"{path}-box", schemas.READING_KEY)
    box.add(t.outbox)
    after = _sent_after_a_failure(t, box, messages.reading_messages, f"{path}-topic")
    sent = messages.readings(messages.open_messages(t.spark, "json", path=f"{path}-topic")).withColumn("status", F.lit(""))
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), "sensor_id", "type", "status").agg(F.count(F.lit(1)).alias("n"))
    return count(after, "outbox").unionByName(count(sent, "topic"))


def _sent_after_a_failure(t: Tables, box: Outbox, encode, topic_path: str) -> DataFrame:
    def breaks_off(rows, number):
        encode(rows.limit(100)).write.format("json").save(f"{topic_path}/batch={number}/_temporary")
        raise OSError("lost")

    try:
        box.dispatch(t.spark, breaks_off, attempts=1)
    except OSError:
        pass
    for _ in range(2):  # the second finds nothing
        box.dispatch(t.spark, lambda rows, number: messages.publish_once(encode(rows), "json", topic_path, number))
    return box.rows(t.spark)


@query("st14_statistics", """SELECT 'outbox' AS kind, region_name AS region, type, 'sent' AS status, count(*) AS n FROM zone_q GROUP BY ALL
UNION ALL SELECT 'topic', region_name, type, '', count(*) FROM zone_q GROUP BY ALL""")
def st14_statistics(t):
    """Statistics wait in an outbox of their own."""
    path = fresh(t, "st14s")
    box = Outbox(f"{path}-box", schemas.ZONE_STATS_KEY)
    box.add(rollup.zone_stats(t.readings))
    after = _sent_after_a_failure(t, box, messages.statistics_messages, f"{path}-topic").withColumnRenamed("region_name", "region")
    sent = messages.statistics(messages.open_messages(t.spark, "json", path=f"{path}-topic")).withColumn("status", F.lit(""))
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), "region", "type", "status").agg(F.count(F.lit(1)).alias("n"))
    return count(after, "outbox").unionByName(count(sent, "topic"))


@query("st15", """SELECT event_id, status, time >= TIMESTAMP '2024-01-30 00:00:00' AS retained FROM outbox
  WHERE NOT (status = 'sent' AND time < TIMESTAMP '2024-01-30 12:00:00')""")
def st15(t):
    left = outbox.purge_sent(t.outbox, NOW)
    kept = outbox.retain(t.outbox, NOW).select("event_id", F.lit(True).alias("retained"))
    return left.join(kept, "event_id", "left").select("event_id", "status", F.coalesce("retained", F.lit(False)).alias("retained"))


@query("st17", """SELECT 'macrozone_hubs' AS target, hub_id AS id, region_name, macrozone_name, '' AS zone_name, min(time) AS registration_time, max(time) AS last_seen
  FROM configs WHERE msg_type = 'new_proximity' GROUP BY hub_id, region_name, macrozone_name
UNION ALL SELECT 'zone_hubs', hub_id, region_name, macrozone_name, zone_name, min(time), max(time) FROM configs WHERE msg_type = 'new_edge' GROUP BY hub_id, region_name, macrozone_name, zone_name
UNION ALL SELECT 'sensors', sensor_id, region_name, macrozone_name, zone_name, min(time), max(time) FROM configs WHERE msg_type = 'new_sensor' GROUP BY sensor_id, region_name, macrozone_name, zone_name""")
def st17(t):
    path = fresh(t, "st17")
    stored = {
        "macrozone_hubs": _device_table(t.macrozone_hubs, f"{path}-macro", schemas.MACROZONE_HUB_KEY, ["service"]),
        "zone_hubs": _device_table(t.zone_hubs, f"{path}-zone", schemas.ZONE_HUB_KEY, ["service"]),
        "sensors": _device_table(t.device_sensors, f"{path}-sensors", schemas.SENSOR_KEY, ["type", "reference"]),
    }
    ingest.configurations(_as_stream(t, t.configs, f"{path}-in"), *stored.values(), f"{path}-checkpoint").awaitTermination()
    out = None
    for name, table in stored.items():
        rows = keyed.read(t.spark, table)
        zone = F.col("zone_name") if "zone_name" in rows.columns else F.lit("")
        rows = rows.select(F.lit(name).alias("target"), "id", "region_name", "macrozone_name", zone.alias("zone_name"), "registration_time", "last_seen")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("st18", sql_stats("time, region_name, macrozone_name, zone_name, type", "zone_q")
       + " UNION ALL " + sql_stats("time, region_name, macrozone_name, '' AS zone_name, type", "macro_q"))
def st18(t):
    path = fresh(t, "st18")
    both = rollup.zone_and_macrozone_stats(rollup.zone_stats(t.readings))
    raw = messages.open_messages(t.spark, "json", stream=True, path=topic(t, messages.statistics_messages(both), "st18-in"))
    stream = messages.stored_statistics(messages.statistics(raw))
    ingest.statistics(stream, f"{path}-zone", f"{path}-macro", f"{path}-checkpoint").awaitTermination()
    macro = t.spark.read.parquet(f"{path}-macro").withColumn("zone_name", F.lit(""))
    return stats_rounded(t.spark.read.parquet(f"{path}-zone").unionByName(macro).drop("day"))


@query("st19", f"SELECT 'config' AS kind, macrozone AS key, count(*) AS n FROM ({_CONFIG_WIRE}) GROUP BY macrozone UNION ALL "
       f"SELECT 'heartbeat', concat_ws('-', macrozone, zone, hub_id), count(*) FROM ({_BEAT_WIRE}) GROUP BY ALL")
def st19(t):
    out = None
    for kind, wire, decode, encode in (
        ("config", messages.configuration_messages(config_wire(t)), messages.configurations, messages.configuration_messages),
        ("heartbeat", messages.heartbeat_messages(beat_wire(t)), messages.heartbeats, messages.heartbeat_messages),
    ):
        path = fresh(t, f"st19-{kind}")
        raw = messages.open_messages(t.spark, "json", stream=True, path=topic(t, wire, f"st19-{kind}-in"))
        ingest.relay(decode(raw), encode, "json", f"{path}-checkpoint", path).awaitTermination()
        sent = messages.open_messages(t.spark, "json", path=path)
        rows = sent.groupBy(F.lit(kind).alias("kind"), "key").agg(F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
