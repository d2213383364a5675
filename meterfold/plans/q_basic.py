"""Registered queries: projections, filters, sets, functions, top-N."""

import datetime as dt

from pyspark.sql import functions as F

from meterfold import schemas
from meterfold.functions import geo, scalars, timeutil
from meterfold.operators import analysis, catalog, filters, latest, rollup, sets, spatial
from meterfold.plans import endpoints
from meterfold.plans.fixtures import NOW
from meterfold.plans.oracle import nudge, query
from meterfold.session import scratch_path
from meterfold.sources import tables

LAT, LON, RADIUS = 31.0, -172.3, 150_000.0
DAY = dt.date(2024, 1, 10)
PERIOD = (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))


def near(col, digits: int):
    return F.round((F.col(col) if isinstance(col, str) else col) + nudge(digits), digits)


def rnd(df, digits: int, *cols: str):
    return df.withColumns({c: near(c, digits) for c in cols})


def stats_rounded(df):
    """Sums have two decimals; means are compared to six."""
    total = [c for c in ("avg_sum", "total_sum") if c in df.columns]
    return rnd(rnd(df, 6, "avg_value"), 2, *total)


def sql_stats(keys: str, view: str, total: str = "avg_sum", count: str = "avg_count", tail: str = "") -> str:
    return (
        f"SELECT {keys}, min_value, max_value, round(avg_value, 6) AS avg_value, round({total}, 2) AS {total}, "
        f"cast({count} AS bigint) AS {count} FROM {view} {tail}"
    )


def ts(value) -> str:
    return f"TIMESTAMP '{value}'"


# ---- P: projections and filters ------------------------------------------------

@query("p1", "SELECT event_id, cast(floor(epoch(ts)) AS bigint) AS seconds, date_trunc('second', ts) AS time FROM events")
def p1(t):
    s = timeutil.epoch_seconds(F.col("ts"))
    return t.events.select("event_id", s.alias("seconds"), timeutil.from_epoch(s).alias("time"))


@query("p2", "SELECT * FROM heartbeats WHERE epoch(time) >= 1 AND hub_id <> '' AND macrozone <> ''")
def p2(t):
    return filters.valid_heartbeats(t.heartbeats)


def by_day(t, name):
    """The readings as a table stored by day."""
    path = scratch_path(t.spark, name)
    rows = t.readings.withColumn("day", F.to_date("time"))
    tables.by_partition(rows, ["day"], ["time"]).parquet(path)
    return t.spark.read.parquet(path)


@query("p3", f"SELECT * FROM readings WHERE time >= {ts(PERIOD[0])} AND time < {ts(PERIOD[1])}")
def p3(t):
    return filters.within(by_day(t, "p3"), *PERIOD).drop("day")


@query("p4", f"SELECT event_id, cast(time AS date) = DATE '{DAY}' AS on_day FROM readings WHERE cast(time AS date) BETWEEN DATE '{DAY}' AND DATE '2024-01-20'")
def p4(t):
    rows = filters.within_days(by_day(t, "p4"), DAY, dt.date(2024, 1, 20))
    return rows.select("event_id", filters.on_day("time", DAY).alias("on_day"))


@query("p5", """SELECT * FROM readings WHERE region_name IN ('AFRICA', 'ASIA', 'EUROPE')
  AND macrozone_name IN (SELECT name FROM macrozones WHERE type = 'outdoor')""")
def p5(t):
    rows = filters.member_of(t.readings, ["AFRICA", "ASIA", "EUROPE"], "region_name")
    outdoor = t.macrozones.filter("type = 'outdoor'").select(F.col("name").alias("macrozone_name"))
    return filters.member_of(rows, outdoor, "macrozone_name")


@query("p6", """SELECT region_name, macrozone_name, name FROM zones
  WHERE region_name = 'AFRICA' AND macrozone_name = 'Supplier#000000000' AND name = 'zone-1'""")
def p6(t):
    return filters.by_key(t.zones, region_name="AFRICA", macrozone_name="Supplier#000000000", name="zone-1").select(
        "region_name", "macrozone_name", "name"
    )


@query("p7", """SELECT *, CASE WHEN zone <> '' THEN 'zone' ELSE 'macrozone' END AS grain FROM heartbeats
  WHERE zone <> '' OR macrozone <> ''""")
def p7(t):
    return filters.with_grain(t.heartbeats)


@query("p8", """SELECT *, CASE msg_type WHEN 'new_sensor' THEN 'sensors' WHEN 'new_edge' THEN 'zone_hubs'
  ELSE 'macrozone_hubs' END AS target FROM configs WHERE msg_type <> 'bogus'""")
def p8(t):
    return filters.with_target(t.configs)


# now - 24 h, truncated to 24 h
@query("p9", "SELECT * FROM readings WHERE time >= TIMESTAMP '2024-01-29 00:00:00'")
def p9(t):
    return filters.fresh(t.readings, dt.datetime(2024, 1, 30, 13, 30), 24 * 3600)


@query("p10", "SELECT * FROM outbox WHERE status = 'pending'")
def p10(t):
    return filters.with_status(t.outbox, "pending")


@query("p11", """SELECT * FROM device_sensors WHERE contains(lower(concat_ws(' ', id, region_name, macrozone_name,
  zone_name, type, reference)), 'humidity ref-7')""")
def p11(t):
    cols = ["id", "region_name", "macrozone_name", "zone_name", "type", "reference"]
    return t.device_sensors.filter(scalars.contains_text("HUMIDITY ref-7", *cols))


@query("p13", """SELECT * FROM readings WHERE date_trunc('minute', time) = (SELECT date_trunc('minute', min(time)) FROM readings)""")
def p13(t):
    first = t.readings.agg(F.min("time").alias("m")).first().m
    return filters.within_minute(by_day(t, "p13"), first).drop("day")


# ---- U: sets -------------------------------------------------------------------

@query("u1", "SELECT sensor_id FROM readings UNION SELECT id FROM sensors UNION SELECT sensor_id FROM configs")
def u1(t):
    return sets.unique_union(
        t.readings.select("sensor_id"), t.sensors.selectExpr("id AS sensor_id"), t.configs.select("sensor_id")
    )


@query("u2", """SELECT region_name, macrozone_name, zone_name, id AS sensor_id FROM sensors
  UNION SELECT region_name, macrozone_name, zone_name, sensor_id FROM readings""")
def u2(t):
    return sets.known_sensors(t.sensors, t.readings)


@query("u3", """SELECT region_name, name FROM macrozones WHERE type = 'indoor'
  UNION SELECT neighbour_region, neighbour FROM pairs WHERE name IN (SELECT name FROM macrozones WHERE type = 'indoor')""")
def u3(t):
    pairs = spatial.neighbours(t.places, 50_000)
    return sets.with_neighbours(t.macrozones.filter("type = 'indoor'"), pairs)


_GRAINS = (
    "SELECT time, region_name, macrozone_name, zone_name, type, min_value, max_value, round(avg_value, 6) AS avg_value, "
    "round(avg_sum, 2) AS avg_sum, avg_count FROM zone_q UNION ALL "
    "SELECT time, region_name, macrozone_name, '' AS zone_name, type, min_value, max_value, round(avg_value, 6) AS avg_value, "
    "round(avg_sum, 2) AS avg_sum, avg_count FROM macro_q"
)


@query("u4", _GRAINS)
def u4(t):
    zones = rollup.zone_stats(t.readings)
    return stats_rounded(sets.all_grains(zones, rollup.macrozone_stats(zones)))


@query("a23", _GRAINS)
def a23(t):
    return stats_rounded(rollup.zone_and_macrozone_stats(rollup.zone_stats(t.readings)))


# ---- F: functions --------------------------------------------------------------

_HAVERSINE = (
    "2 * 6371e0 * asin(sqrt(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) "
    "* pow(sin(radians({lo2} - {lo1}) / 2), 2)))"
)


@query("f1", f"SELECT name, round({_HAVERSINE.format(la1=LAT, lo1=LON, la2='lat', lo2='lon')}, 6) AS km FROM macrozones")
def f1(t):
    km = geo.haversine_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    return t.places.select("name", near(km, 6).alias("km"))


@query("f2", """SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS quarter,
  time_bucket(INTERVAL '7 days', ts, TIMESTAMP '0001-01-01') AS week FROM events""")
def f2(t):
    ts_ = F.col("ts")
    return t.events.select("event_id", timeutil.truncate(ts_, 900).alias("quarter"), timeutil.truncate(ts_, 7 * 86400).alias("week"))


@query("f3", "SELECT event_id, " + ", ".join(
    f"cast(date_trunc('{u}', ts) AS timestamp) AS {u}_start, cast(date_trunc('{u}', ts) AS timestamp) + INTERVAL 1 {u} AS {u}_end"
    for u in timeutil.UNITS) + " FROM events")
def f3(t):
    cols = []
    for u in timeutil.UNITS:
        cols += [timeutil.bucket_start(F.col("ts"), u).alias(f"{u}_start"), timeutil.bucket_end(F.col("ts"), u).alias(f"{u}_end")]
    return t.events.select("event_id", *cols)


@query("f4", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"cast(date_trunc('{u}', l_shipdate) AS timestamp) AS {u}_key" for u in timeutil.UNITS) + " FROM lineitem")
def f4(t):
    keys = [timeutil.bucket_start(F.col("l_shipdate").cast("timestamp_ntz"), u).alias(f"{u}_key") for u in timeutil.UNITS]
    return t.base("lineitem").select("l_orderkey", "l_linenumber", *keys)


@query("f5", "SELECT region_name, name, round(lat, 9) AS lat, round(lon, 9) AS lon FROM macrozones")
def f5(t):
    return rnd(t.places, 9, "lat", "lon")


@query("f6", "SELECT name, s_acctbal >= 0 AS inside FROM macrozones")
def f6(t):
    rows = t.macrozones.join(t.placed.select("region_name", F.col("macrozone_name").alias("name"), "s_acctbal"), ["region_name", "name"])
    first = F.col("ring")[0]
    inside = geo.contains(F.col("ring"), first["lon"] + 0.01, first["lat"] + F.col("s_acctbal") / 500_000 + F.when(F.col("s_acctbal") < 0, -1e-9).otherwise(1e-9))
    return rows.select("name", inside.alias("inside"))


_BOX_LON = f"greatest(lon0, least(lon0 + 0.02e0, {LON}))"
_BOX_LAT = f"greatest(lat0, least(lat0 + 0.02e0, {LAT}))"
# nearest point of each side of the square; 0 inside
_SIDES = [(_BOX_LON, "lat0"), (_BOX_LON, "(lat0 + 0.02e0)"), ("lon0", _BOX_LAT), ("(lon0 + 0.02e0)", _BOX_LAT)]
_BOX = (
    f"(CASE WHEN {LON} BETWEEN lon0 AND lon0 + 0.02e0 AND {LAT} BETWEEN lat0 AND lat0 + 0.02e0 THEN 0 ELSE 1000 * least("
    + ", ".join(_HAVERSINE.format(la1=LAT, lo1=LON, la2=la, lo2=lo) for lo, la in _SIDES) + ") END)"
)


@query("f7", f"SELECT name, round({_BOX}, 1) AS distance_m FROM macrozones")
def f7(t):
    d = geo.distance_m(F.col("ring"), F.lit(LON), F.lit(LAT))
    return t.macrozones.select("name", near(d, 1).alias("distance_m"))


def wkt(ring):
    pair = F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(pair, ", "), F.lit("))"))


@query("f9", "SELECT name, cast(5 AS integer) AS vertices, lon0 AS first_lon, lat0 AS first_lat, lat0 + 0.02e0 AS third_lat FROM macrozones")
def f9(t):
    ring = geo.parse_polygon(wkt(F.col("ring")))
    rows = t.macrozones.select("name", ring.alias("ring"))
    return rows.select(
        "name", F.size("ring").alias("vertices"), F.col("ring")[0]["lon"].alias("first_lon"),
        F.col("ring")[0]["lat"].alias("first_lat"), F.col("ring")[2]["lat"].alias("third_lat"),
    )


@query("f10", """SELECT event_id, round((value - k) / k * 100, 8) AS change FROM ev WHERE k <> 0""")
def f10(t):
    change = scalars.percent_change(F.col("value"), F.col("k"))
    return t.events.select("event_id", near(change, 8).alias("change")).filter("change IS NOT NULL")


@query("f11", """SELECT event_id, round(value / nullif(k, 0), 10) AS or_null,
  CASE WHEN k = 0 THEN 0 ELSE round(value / k, 10) END AS or_zero FROM ev""")
def f11(t):
    v, k = F.col("value"), F.col("k")
    return t.events.select(
        "event_id", near(scalars.ratio_or_null(v, k), 10).alias("or_null"), near(scalars.ratio_or_zero(v, k), 10).alias("or_zero")
    )


@query("f12", "SELECT event_id, CASE WHEN k < 10 THEN 0 ELSE value END AS clean FROM ev")
def f12(t):
    x = F.when(F.col("k") < 5, F.lit(float("nan"))).when(F.col("k") >= 10, F.col("value"))
    return t.events.select("event_id", scalars.nan_to_zero(x).alias("clean"))


@query("f13", """SELECT event_id, CASE WHEN k > 50 THEN 'up' WHEN k < 50 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN k > 50 THEN 'increase' WHEN k < 50 THEN 'decrease' ELSE 'stable' END AS sign FROM ev""")
def f13(t):
    d = F.col("k") - 50
    return t.events.select("event_id", scalars.direction(d).alias("direction"), scalars.sign_label(d).alias("sign"))


@query("f14", "SELECT event_id, k / 100e0 > 0.2e0 AS diverges FROM ev")
def f14(t):
    return t.events.select("event_id", scalars.diverges(F.col("k") / 100.0).alias("diverges"))


@query("f15", """SELECT id, region_name, macrozone_name, coalesce(last_seen > TIMESTAMP '2024-01-02 12:00:00', false) AS active FROM sensors""")
def f15(t):
    return endpoints.liveness(t.sensors, dt.datetime(2024, 1, 2, 12, 5)).select("id", "region_name", "macrozone_name", "active")


@query("f16", """SELECT region_name, start, start + INTERVAL '30 minutes' AS end FROM (
  SELECT region_name, unnest(generate_series(max(time), TIMESTAMP '2024-01-30 23:00:00', INTERVAL '30 minutes')) AS start
  FROM region_q WHERE time <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY region_name)""")
def f16(t):
    regions = rollup.region_stats(rollup.macrozone_stats(rollup.zone_stats(t.readings)))
    last = rollup.last_aggregated(regions.filter("time <= TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return rollup.missing_intervals(last, dt.datetime(2024, 1, 30, 23, 55), 1800, 1200)


# ---- T: top-N ------------------------------------------------------------------

def per_key_sql(keys: str, cols: str, view: str, n: int, ties: str) -> str:
    return (
        f"SELECT {cols} FROM {view} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY time DESC, {ties}) <= {n}"
    )


@query("t1", per_key_sql("region_name, macrozone_name, zone_name, sensor_id", "*", "readings", 50, "type"))
def t1(t):
    return latest.latest_per_key(t.readings, schemas.SENSOR, 50, ("type",))


_SHOWN = "time, type, min_value, max_value, round(avg_value, 6) AS avg_value"


@query("t2", per_key_sql("region_name, macrozone_name, zone_name", "macrozone_name, zone_name, " + _SHOWN, "zone_q", 50, "type"))
def t2(t):
    rows = latest.latest_per_key(rollup.zone_stats(t.readings), ["region_name", "macrozone_name", "zone_name"], 50, ("type",))
    return rnd(rows.select("macrozone_name", "zone_name", *endpoints._STATS), 6, "avg_value")


@query("t3", per_key_sql("region_name, macrozone_name", "macrozone_name, " + _SHOWN, "macro_stats", 50, "type"))
def t3(t):
    rows = latest.latest_per_key(t.macro_stats, ["region_name", "macrozone_name"], 50, ("type",))
    return rnd(rows.select("macrozone_name", *endpoints._STATS), 6, "avg_value")


@query("t4", f"SELECT region_name, {_SHOWN} FROM region_q ORDER BY time DESC, region_name, type LIMIT 50")
def t4(t):
    regions = rollup.region_stats(rollup.macrozone_stats(rollup.zone_stats(t.readings)))
    return rnd(latest.latest(regions, 50, ("region_name", "type")).select("region_name", *endpoints._STATS), 6, "avg_value")


@query("t5", "SELECT * FROM outbox WHERE status = 'pending' ORDER BY time, event_id LIMIT 50")
def t5(t):
    return latest.oldest_pending(t.outbox, 50, ("event_id",))


@query("t6", sql_stats("macrozone_name, type, day",
                       "macro_daily", "total_sum", "total_count"))
def t6(t):
    daily = rollup.macrozone_calendar(t.macro_stats, "day")
    return stats_rounded(daily.drop("region_name")).orderBy("macrozone_name", "type", "day")


# ---- W9, A16, A22 and point searches -------------------------------------------

@query("w9", """SELECT region_name, macrozone_name, type, time, row_number() OVER
  (PARTITION BY region_name, macrozone_name, type ORDER BY time DESC) AS rank FROM macro_stats""")
def w9(t):
    return latest.ranked(t.macro_stats, analysis.KEYS, None).select(*analysis.KEYS, "time", F.col("rank").cast("long").alias("rank"))


@query("a16", sql_stats("region_name, macrozone_name, type, time", "macro_stats", tail="""QUALIFY row_number() OVER
  (PARTITION BY region_name, macrozone_name, type ORDER BY time DESC) = 1"""))
def a16(t):
    return stats_rounded(latest.latest_row(t.macro_stats, analysis.KEYS))


@query("a22", "SELECT region_name, max(time) AS last_time FROM region_q GROUP BY region_name")
def a22(t):
    return rollup.last_aggregated(rollup.region_stats(rollup.macrozone_stats(rollup.zone_stats(t.readings))))


@query("j9", f"SELECT region_name, name, round({_BOX}, 1) AS distance_m FROM macrozones WHERE {_BOX} <= {RADIUS}")
def j9(t):
    found = spatial.near_point(t.macrozones, LAT, LON, RADIUS)
    return found.select("region_name", "name", near("distance_m", 1).alias("distance_m"))


# Customers ask for what is near them: some by a pole or the date line, with a radius of 0 m to 3,000 km. The zones are
# squares of a fiftieth of a degree, so the distance is the least of those to their sides.
_ASKED = """SELECT c_custkey AS point_id,
  CASE WHEN c_custkey % 50 = 1 THEN 89.9e0 WHEN c_custkey % 50 = 2 THEN -89.95e0 ELSE 30e0 + cast((c_custkey * 7) % 400 AS double) * 0.01e0 END AS lat,
  CASE WHEN c_custkey % 50 = 3 THEN 179.99e0 WHEN c_custkey % 50 = 4 THEN -179.99e0 ELSE -175e0 + cast((c_custkey * 13) % 1250 AS double) * 0.01e0 END AS lon,
  CASE c_custkey % 7 WHEN 0 THEN 0e0 WHEN 1 THEN 500e0 WHEN 2 THEN 5000e0 WHEN 3 THEN 30000e0 WHEN 4 THEN 700e0 WHEN 5 THEN 100e0
    ELSE CASE WHEN c_custkey % 101 = 0 THEN 3000000e0 ELSE 60000e0 END END AS radius_m
FROM customer"""


def asked_points(t):
    k = F.col("c_custkey")
    lat = F.when(k % 50 == 1, 89.9).when(k % 50 == 2, -89.95).otherwise(30.0 + ((k * 7) % 400).cast("double") * 0.01)
    lon = F.when(k % 50 == 3, 179.99).when(k % 50 == 4, -179.99).otherwise(-175.0 + ((k * 13) % 1250).cast("double") * 0.01)
    r = k % 7
    radius = F.when(r == 0, 0.0).when(r == 1, 500.0).when(r == 2, 5000.0).when(r == 3, 30000.0).when(r == 4, 700.0).when(r == 5, 100.0)
    radius = radius.otherwise(F.when(k % 101 == 0, 3_000_000.0).otherwise(60_000.0))
    return t.base("customer").select(k.alias("point_id"), lat.alias("lat"), lon.alias("lon"), radius.alias("radius_m"))


_BOX_FROM_POINT = _BOX.replace(f"{LON}", "q.lon").replace(f"{LAT}", "q.lat")


@query("j9_points", f"""SELECT q.point_id, m.region_name, m.name, round({_BOX_FROM_POINT}, 0) AS distance_m
  FROM ({_ASKED}) q JOIN macrozones m ON {_BOX_FROM_POINT} <= q.radius_m""")
def j9_points(t):
    found = spatial.near_points(asked_points(t), t.macrozones)
    return found.withColumn("distance_m", near("distance_m", 0))


@query("j8", "SELECT region_name, name, neighbour_region, neighbour, round(distance_m, 3) AS distance_m FROM pairs")
def j8(t):
    return rnd(spatial.neighbours(t.places, 50_000), 3, "distance_m")


_AROUND = f"""
SELECT m.type, min(m.min_value) AS min_value, max(m.max_value) AS max_value,
       round(sum(m.avg_sum) / sum(m.avg_count), 4) AS avg_value, round(sum(m.avg_sum), 2) AS avg_sum,
       cast(sum(m.avg_count) AS bigint) AS avg_count, round(sum(m.avg_value / d.km) / sum(1 / d.km), 4) AS weighted_avg,
       round(sum(m.avg_value / d.km), 3) AS weighted_sum, round(sum(1 / d.km), 6) AS weighted_count,
       TIMESTAMP '2001-10-20 00:00:00' AS time
FROM (SELECT * FROM macro_stats QUALIFY row_number() OVER (PARTITION BY region_name, macrozone_name, type ORDER BY time DESC) = 1) m
JOIN (SELECT *, CASE WHEN km0 = 0 THEN 0.001e0 ELSE km0 END AS km FROM
      (SELECT *, {_HAVERSINE.format(la1=LAT, lo1=LON, la2='lat', lo2='lon')} AS km0 FROM macrozones WHERE {_BOX} <= {RADIUS})) d
  ON d.region_name = m.region_name AND d.name = m.macrozone_name
WHERE m.time >= TIMESTAMP '2001-09-19 00:00:00' GROUP BY m.type"""
AROUND_NOW = dt.datetime(2001, 10, 20)


def around(t):
    out = analysis.around_point(t.macro_stats, t.macrozones, LAT, LON, RADIUS, AROUND_NOW, 30 * 86400)
    return rnd(rnd(rnd(out, 4, "avg_value", "weighted_avg"), 3, "weighted_sum"), 6, "weighted_count").withColumn(
        "avg_sum", near("avg_sum", 2)
    )


_CUT = timeutil.freshness_cutoff(AROUND_NOW, 30 * 86400)
_AROUND = _AROUND.replace("TIMESTAMP '2001-09-19 00:00:00'", ts(_CUT))
query("a17", _AROUND)(around)
query("e7", _AROUND)(lambda t: rnd(rnd(rnd(rnd(endpoints.statistics_around(
    t.macro_stats, t.macrozones, LAT, LON, RADIUS, AROUND_NOW, 30 * 86400), 4, "avg_value", "weighted_avg"),
    3, "weighted_sum"), 6, "weighted_count"), 2, "avg_sum"))


@query("j10", """SELECT s.region_name, s.macrozone_name, s.type, s.time, round(m.lat, 9) AS lat, round(m.lon, 9) AS lon
  FROM macro_stats s JOIN macrozones m ON m.region_name = s.region_name AND m.name = s.macrozone_name""")
def j10(t):
    return rnd(analysis.with_centre(t.macro_stats, t.places).select(*analysis.KEYS, "time", "lat", "lon"), 9, "lat", "lon")
