"""Registered queries: joins, aggregates, series, analyses, devices, quality."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterfold import params, schemas
from meterfold.operators import analysis, catalog, devices, outbox, outlier, quality, rollup, series, spatial
from meterfold.plans import endpoints, stored
from meterfold.plans.fixtures import NOW, SPLIT
from meterfold.plans.oracle import query
from meterfold.plans.q_basic import _SHOWN, rnd, sql_stats, stats_rounded, ts
from meterfold.session import scratch_path
from meterfold.sources import tables

AFRICA, FIRST = "AFRICA", "Supplier#000000000"
FIRST_DAY, LAST_DAY = dt.date(1996, 1, 2), dt.date(2001, 11, 4)
TREND_DAY = dt.date(2000, 6, 30)
TREND_SPAN = (dt.date(2000, 5, 2), TREND_DAY)
LEAP_DAY = dt.date(2000, 2, 29)
FAR = 50_000.0


def ntz(value):
    return F.lit(value).cast("timestamp_ntz")


def at_day(df):
    return df.withColumn("day", F.col("day").cast("timestamp_ntz"))


def joined(array: str, *cols: str):
    """Elements of a nested array as one text, for comparison with SQL."""
    return F.array_join(F.transform(array, lambda e: F.concat_ws("|", *[e[c].cast("string") for c in cols])), ";").alias(array)


def agg_text(expr: str, name: str, order: str = "c.id") -> str:
    return f"coalesce(string_agg({expr}, ';' ORDER BY {order}), '') AS {name}"


# ---- J: joins ------------------------------------------------------------------

_J1 = "SELECT r.r_name AS name, count(m.name) AS macrozone_count FROM region r LEFT JOIN macrozones m ON m.region_name = r.r_name GROUP BY r.r_name"


@query("j1", _J1)
def j1(t):
    return catalog.region_list(t.regions, t.macrozones)


query("e1", _J1)(lambda t: endpoints.region_list(t.regions, t.macrozones))

_J2 = """SELECT m.region_name, m.name, round(any_value(m.lat), 9) AS lat, round(any_value(m.lon), 9) AS lon,
  any_value(m.creation_time) AS creation_time, count(z.name) AS zone_count
FROM macrozones m LEFT JOIN zones z ON z.region_name = m.region_name AND z.macrozone_name = m.name
{where} GROUP BY m.region_name, m.name"""


@query("j2", _J2.format(where=""))
def j2(t):
    return rnd(catalog.macrozone_list(t.macrozones, t.zones), 9, "lat", "lon")


query("e4", _J2.format(where="WHERE m.region_name = 'AFRICA'"))(
    lambda t: rnd(endpoints.macrozone_list(t.macrozones, t.zones, AFRICA), 9, "lat", "lon")
)


@query("j3", "SELECT region_name, macrozone_name, name, creation_time FROM zones")
def j3(t):
    return catalog.zone_list(t.zones)


query("e11", f"SELECT region_name, macrozone_name, name, creation_time FROM zones WHERE region_name = '{AFRICA}' AND macrozone_name = '{FIRST}'")(
    lambda t: endpoints.zone_list(t.zones, AFRICA, FIRST)
)

_J4 = f"""SELECT r.r_name AS name, cast(0 AS bigint) AS page,
  (SELECT count(*) FROM macrozones m WHERE m.region_name = r.r_name) AS macrozones_count,
  (SELECT count(*) FROM region_hubs h WHERE h.region_name = r.r_name) AS hubs_count,
  (SELECT {agg_text('m.name', 'x', 'm.name')} FROM macrozones m WHERE m.region_name = r.r_name) AS macrozones,
  (SELECT {agg_text("h.id || '|' || h.service || '|' || strftime(h.last_seen, '%Y-%m-%d %H:%M:%S')", 'x', 'h.id')}
   FROM region_hubs h WHERE h.region_name = r.r_name) AS hubs
FROM region r"""


def _region_text(df):
    hubs = F.transform("hubs", lambda h: F.concat_ws("|", h["id"], h["service"], F.date_format(h["last_seen"], "yyyy-MM-dd HH:mm:ss")))
    return df.select("name", "page", "macrozones_count", "hubs_count", joined("macrozones", "name"), F.array_join(hubs, ";").alias("hubs"))


query("j4", _J4)(lambda t: _region_text(catalog.region_detail(t.regions, t.macrozones, t.region_hubs)))
query("e2", _J4 + " WHERE r.r_name = 'AFRICA'")(
    lambda t: _region_text(endpoints.region_by_name(t.regions, t.macrozones, t.region_hubs, AFRICA))
)


@query("j4_pages", """SELECT r.r_name AS name, m.name AS macrozone, count(*) OVER (PARTITION BY r.r_name) AS macrozones_count, cast(8 AS bigint) AS pages
FROM region r JOIN macrozones m ON m.region_name = r.r_name""")
def j4_pages(t):
    """Eight pages a region hold every macrozone once; each page knows the total."""
    out = catalog.region_detail(t.regions, t.macrozones, t.region_hubs, pages=8)
    pages = F.count("*").over(Window.partitionBy("name"))
    return out.withColumn("pages", pages).select("name", F.explode("macrozones").alias("m"), "macrozones_count", "pages").select(
        "name", F.col("m.name").alias("macrozone"), "macrozones_count", "pages"
    )


def _children(table: str, cols: str, macro: str = "m.macrozone_name", zone: str = "") -> str:
    return f"FROM {table} c WHERE c.region_name = m.region_name AND c.macrozone_name = {macro}{zone}"


_J5 = f"""SELECT m.region_name, m.name AS macrozone_name, round(m.lat, 9) AS lat, round(m.lon, 9) AS lon, m.creation_time,
  cast(0 AS bigint) AS page,
  (SELECT {agg_text('c.name', 'x', 'c.name')} {_children('zones', '', 'm.name')}) AS zones,
  (SELECT {agg_text("c.id || '|' || c.service", 'x')} {_children('macrozone_hubs', '', 'm.name')}) AS hubs,
  (SELECT {agg_text("c.id || '|' || c.zone_name || '|' || c.service", 'x', 'c.id, c.zone_name')} {_children('zone_hubs', '', 'm.name')}) AS zone_hubs,
  (SELECT {agg_text("c.id || '|' || c.zone_name || '|' || c.type || '|' || c.reference", 'x', 'c.id, c.zone_name')} {_children('device_sensors', '', 'm.name')}) AS sensors,
  (SELECT count(*) {_children('device_sensors', '', 'm.name')}) AS sensors_count
FROM macrozones m"""


def _macro_text(df):
    return rnd(df, 9, "lat", "lon").select(
        "region_name", "macrozone_name", "lat", "lon", "creation_time", "page", joined("zones", "name"),
        joined("hubs", "id", "service"), joined("zone_hubs", "id", "zone_name", "service"),
        joined("sensors", "id", "zone_name", "type", "reference"), "sensors_count",
    )


query("j5", _J5)(lambda t: _macro_text(catalog.macrozone_detail(t.macrozones, t.zones, t.macrozone_hubs, t.zone_hubs, t.device_sensors)))
query("e5", _J5 + f" WHERE m.region_name = '{AFRICA}' AND m.name = '{FIRST}'")(
    lambda t: _macro_text(endpoints.macrozone_by_name(t.macrozones, t.zones, t.macrozone_hubs, t.zone_hubs, t.device_sensors, AFRICA, FIRST))
)

_Z = " AND c.zone_name = m.name"
_J6 = f"""SELECT m.region_name, m.macrozone_name, m.name AS zone_name, m.creation_time, cast(0 AS bigint) AS page,
  (SELECT {agg_text("c.id || '|' || c.service", 'x')} {_children('zone_hubs', '', zone=_Z)}) AS hubs,
  (SELECT {agg_text("c.id || '|' || c.type || '|' || c.reference", 'x')} {_children('device_sensors', '', zone=_Z)}) AS sensors,
  (SELECT count(*) {_children('zone_hubs', '', zone=_Z)}) AS hubs_count,
  (SELECT count(*) {_children('device_sensors', '', zone=_Z)}) AS sensors_count
FROM zones m"""


def _zone_text(df):
    return df.select(
        "region_name", "macrozone_name", "zone_name", "creation_time", "page", joined("hubs", "id", "service"),
        joined("sensors", "id", "type", "reference"), "hubs_count", "sensors_count",
    )


query("j6", _J6)(lambda t: _zone_text(catalog.zone_detail(t.zones, t.zone_hubs, t.device_sensors)))
query("e12", _J6 + f" WHERE m.region_name = '{AFRICA}' AND m.macrozone_name = '{FIRST}' AND m.name = 'zone-1'")(
    lambda t: _zone_text(endpoints.zone_by_name(t.zones, t.zone_hubs, t.device_sensors, AFRICA, FIRST, "zone-1"))
)


def macro_daily(t, *span):
    return rollup.macrozone_calendar(t.macro_stats, "day", span or None)


def compared_daily(t, first, last=None):
    """Daily rows of the days and of the same days one year earlier only."""
    return rollup.macrozone_calendar(t.macro_stats.filter(analysis.compared_days("time", first, last or first)), "day")


def region_daily(t, *span):
    """From the daily macrozone rows: the partials merge exactly."""
    return rollup.coarser_calendar(macro_daily(t, *span), "day", "day", rollup.REGION_KEYS)


@query("j7", """SELECT day, region_name, macrozone_name, type, round(current, 6) AS current, round(previous, 6) AS previous FROM variation""")
def j7(t):
    return at_day(rnd(analysis.current_and_previous(macro_daily(t), FIRST_DAY, LAST_DAY), 6, "current", "previous"))


_VARIATION = """SELECT day, region_name, macrozone_name, type, round(current, 6) AS current,
  round(previous, 6) AS previous, round(delta_perc, 6) AS delta_perc FROM variation"""


def variation(t):
    return analysis.yearly_variation(compared_daily(t, FIRST_DAY, LAST_DAY), FIRST_DAY, LAST_DAY)


@query("w6", _VARIATION)
def w6(t):
    return at_day(rnd(variation(t), 6, "current", "previous", "delta_perc"))


@query("e8", _VARIATION + " WHERE day = TIMESTAMP '2000-02-29'")
def e8(t):
    """Through the store: the second call finds the first one's day."""
    path = scratch_path(t.spark, "e8")
    for _ in range(2):
        out = stored.yearly_variation(t.spark, path, compared_daily(t, LEAP_DAY), [LEAP_DAY], NOW)
    return at_day(rnd(out.drop("region"), 6, "current", "previous", "delta_perc"))


@query("j11", """SELECT m.day, m.region_name, m.macrozone_name, m.type, round(m.avg_value, 6) AS macro_avg, round(r.avg_value, 6) AS region_avg
  FROM macro_daily m JOIN region_daily r USING (day, region_name, type)""")
def j11(t):
    rows = series.aligned_days(macro_daily(t), region_daily(t))
    return rnd(rows.select(
        "day", "region_name", "macrozone_name", "type", F.col("m.avg_value").alias("macro_avg"), F.col("r.avg_value").alias("region_avg")
    ), 6, "macro_avg", "region_avg")


_AROUND = """SELECT p.region_name, p.name AS macrozone_name, p.neighbour_region, p.neighbour, v.type, v.day,
  v.current, v.previous, v.delta_perc
FROM variation o JOIN pairs p ON p.region_name = o.region_name AND p.name = o.macrozone_name
JOIN variation v ON v.region_name = p.neighbour_region AND v.macrozone_name = p.neighbour AND v.type = o.type AND v.day = o.day"""


def variation_once(t):
    """The variation as an intermediate table, for analyses that read it as own rows and as neighbours'."""
    path = scratch_path(t.spark, "variation")
    variation(t).write.parquet(path)
    return t.spark.read.parquet(path)


def neighbours_of(t):
    return analysis.neighbour_variations(variation_once(t), spatial.neighbours(t.places, FAR))


@query("j12", f"SELECT * REPLACE (round(current, 6) AS current, round(previous, 6) AS previous, round(delta_perc, 6) AS delta_perc) FROM ({_AROUND})")
def j12(t):
    return at_day(rnd(neighbours_of(t), 6, "current", "previous", "delta_perc"))


_SPREAD = f"SELECT region_name, macrozone_name, type, day, avg(delta_perc) AS neighbor_mean, stddev_pop(delta_perc) AS neighbor_std_dev FROM ({_AROUND}) GROUP BY ALL"


@query("a18", f"SELECT * REPLACE (round(neighbor_mean, 5) AS neighbor_mean, round(neighbor_std_dev, 5) AS neighbor_std_dev) FROM ({_SPREAD})")
def a18(t):
    return at_day(rnd(analysis.neighbour_spread(neighbours_of(t)), 5, "neighbor_mean", "neighbor_std_dev"))


_W7 = f"""SELECT v.region_name, v.macrozone_name, v.type, v.day, round(v.delta_perc, 6) AS delta_perc,
  round(s.neighbor_mean, 5) AS neighbor_mean, round(s.neighbor_std_dev, 5) AS neighbor_std_dev,
  round(abs(v.delta_perc - s.neighbor_mean), 5) AS abs_error,
  CASE WHEN s.neighbor_std_dev = 0 THEN 0 ELSE round((v.delta_perc - s.neighbor_mean) / s.neighbor_std_dev, 5) END AS z_score
FROM variation v JOIN ({_SPREAD}) s USING (region_name, macrozone_name, type, day)"""


def _anomaly_columns(df):
    return at_day(rnd(rnd(df.drop("current", "previous"), 6, "delta_perc"), 5, "neighbor_mean", "neighbor_std_dev", "abs_error", "z_score"))


@query("w7", _W7)
def w7(t):
    return _anomaly_columns(analysis.anomalies(variation_once(t), spatial.neighbours(t.places, FAR)))


@query("e9", _W7.replace("SELECT v.region_name", "SELECT (SELECT string_agg(a.neighbour, ';' ORDER BY a.neighbour) FROM (" + _AROUND + ") a WHERE a.region_name = v.region_name AND a.macrozone_name = v.macrozone_name AND a.type = v.type AND a.day = v.day) AS neighbor_variation, v.region_name") + f" WHERE v.day = {ts(dt.datetime(2000, 6, 30))}")
def e9(t):
    """Through the store, neighbours by pages of two; their names are put together again for the comparison."""
    path, keys = scratch_path(t.spark, "e9"), [*analysis.KEYS, "day"]
    for days in ([TREND_DAY - dt.timedelta(days=1)], [TREND_DAY - dt.timedelta(days=1), TREND_DAY]):
        found, pages = stored.variation_against_neighbours(t.spark, path, compared_daily(t, days[0], days[-1]), t.places, FAR, days, NOW, page=2)
    names = pages.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(F.transform("neighbours", lambda v: v["neighbour"])))).alias("n"))
    names = names.select(*keys, F.array_join(F.array_sort("n"), ";").alias("neighbor_variation"))
    return _anomaly_columns(found.drop("radius_m", "region").join(names, keys).filter(F.col("day") == F.lit(TREND_DAY)))


@query("k8_neighbours", f"SELECT * REPLACE (round(current, 6) AS current, round(previous, 6) AS previous, round(delta_perc, 6) AS delta_perc) FROM ({_AROUND}) WHERE day = {ts(dt.datetime(2000, 6, 30))}")
def k8_neighbours(t):
    """Stored pages give every neighbour's variation back."""
    path = scratch_path(t.spark, "k8")
    _, pages = stored.variation_against_neighbours(t.spark, path, compared_daily(t, TREND_DAY), t.places, FAR, [TREND_DAY], NOW, page=3)
    rows = pages.select(*analysis.KEYS, "day", F.explode("neighbours").alias("v")).select(*analysis.KEYS, "day", "v.*")
    return at_day(rnd(rows, 6, "current", "previous", "delta_perc"))


@query("j13", """SELECT s.id, s.region_name, s.macrozone_name, s.zone_name, s.registration_time,
  greatest(s.last_seen, m.seen) AS last_seen
FROM sensors s LEFT JOIN (SELECT sensor_id, region_name, macrozone_name, zone_name, max(time) AS seen FROM readings GROUP BY ALL) m
  ON m.sensor_id = s.id AND m.region_name = s.region_name AND m.macrozone_name = s.macrozone_name AND m.zone_name = s.zone_name""")
def j13(t):
    seen = t.readings.select(F.col("sensor_id").alias("id"), "region_name", "macrozone_name", "zone_name", "time")
    return devices.advance_last_seen(t.sensors, seen, schemas.SENSOR_KEY)


@query("j14", """SELECT c.sensor_id AS id, c.region_name, c.macrozone_name, c.zone_name,
  coalesce(any_value(d.type), arg_min(c.sensor_type, (c.time, c.sensor_type, c.sensor_reference))) AS type,
  coalesce(any_value(d.reference), arg_min(c.sensor_reference, (c.time, c.sensor_type, c.sensor_reference))) AS reference,
  coalesce(any_value(d.registration_time), min(c.time)) AS registration_time, max(c.time) AS last_seen
FROM configs c LEFT JOIN device_sensors d ON d.id = c.sensor_id AND d.region_name = c.region_name AND d.macrozone_name = c.macrozone_name AND d.zone_name = c.zone_name
WHERE c.msg_type = 'new_sensor' GROUP BY c.sensor_id, c.region_name, c.macrozone_name, c.zone_name""")
def j14(t):
    batch = t.configs.filter((F.col("msg_type") == "new_sensor") & (F.col("time") >= ntz(SPLIT))).select(
        F.col("sensor_id").alias("id"), "region_name", "macrozone_name", "zone_name", F.col("sensor_type").alias("type"),
        F.col("sensor_reference").alias("reference"), "time",
    )
    return devices.upsert(t.device_sensors, batch, schemas.SENSOR_KEY, ["type", "reference"])


@query("j15", "SELECT * REPLACE (CASE WHEN type = 'click' THEN 'sent' ELSE status END AS status) FROM outbox")
def j15(t):
    published = t.outbox.filter("type = 'click'")
    return outbox.mark_sent(t.outbox, published, schemas.READING_KEY)


@query("j16", """SELECT * FROM configs WHERE msg_type = 'new_sensor' AND (region_name, macrozone_name, zone_name, sensor_id) NOT IN (SELECT (region_name, macrozone_name, zone_name, id) FROM sensors)
  QUALIFY row_number() OVER (PARTITION BY region_name, macrozone_name, zone_name, sensor_id ORDER BY time, service) = 1""")
def j16(t):
    rows = t.configs.filter("msg_type = 'new_sensor'")
    return devices.first_registrations(rows, t.sensors.withColumnRenamed("id", "sensor_id"))


# ---- A: aggregates -------------------------------------------------------------

@query("a1", """SELECT date_trunc('minute', time) AS time, region_name, macrozone_name, zone_name, sensor_id,
  arg_max(type, (time, type)) AS type, round(avg(value), 6) AS value
FROM readings GROUP BY date_trunc('minute', time), region_name, macrozone_name, zone_name, sensor_id""")
def a1(t):
    return rnd(rollup.sensor_means(t.readings), 6, "value")


@query("a2", sql_stats("time, region_name, macrozone_name, zone_name, type", "zone_q"))
def a2(t):
    return stats_rounded(rollup.zone_stats(t.readings))


def macro_q(t):
    return rollup.macrozone_stats(rollup.zone_stats(t.readings))


def region_q(t):
    return rollup.region_stats(macro_q(t))


@query("a3", sql_stats("time, region_name, macrozone_name, type", "macro_q"))
def a3(t):
    return stats_rounded(macro_q(t))


@query("a4", sql_stats("time, region_name, type", "region_q"))
def a4(t):
    return stats_rounded(region_q(t))


@query("a5", """SELECT region_name, type, min(min_value) AS min_value, max(max_value) AS max_value,
  round(cast(sum(avg_sum) AS double) / sum(avg_count), 6) AS avg_value, round(cast(sum(avg_sum) AS double), 2) AS avg_sum, count(*) AS avg_count,
  cast(sum(avg_count) AS bigint) AS total_count, TIMESTAMP '2001-01-01 00:00:00' AS time
FROM (SELECT * REPLACE (cast(avg_sum AS decimal(18,2)) AS avg_sum) FROM macro_stats) WHERE time >= TIMESTAMP '2000-01-01' AND time < TIMESTAMP '2001-01-01' GROUP BY region_name, type""")
def a5(t):
    return stats_rounded(rollup.region_range_stats(t.macro_stats, dt.datetime(2000, 1, 1), dt.datetime(2001, 1, 1)))


def _calendar_sql(unit: str, keys: str, view: str) -> str:
    return f"""SELECT cast(date_trunc('{unit}', time) AS timestamp) AS {unit}, {keys}, min(min_value) AS min_value,
  max(max_value) AS max_value, round(cast(sum(cast(avg_sum AS decimal(18,2))) AS double) / sum(avg_count), 6) AS avg_value,
  round(cast(sum(cast(avg_sum AS decimal(18,2))) AS double), 2) AS total_sum, cast(sum(avg_count) AS bigint) AS total_count
FROM {view} GROUP BY cast(date_trunc('{unit}', time) AS timestamp), {keys}"""


def _calendar_queries():
    for i, unit in enumerate(("day", "week", "month", "year")):
        query(f"a{6 + i}", _calendar_sql(unit, "region_name, macrozone_name, type", "macro_stats"))(
            lambda t, u=unit: stats_rounded(rollup.macrozone_calendar(t.macro_stats, u))
        )
        query(f"a{10 + i}", _calendar_sql(unit, "region_name, type", "region_q"))(
            lambda t, u=unit: stats_rounded(rollup.region_calendar(region_q(t), u))
        )


_calendar_queries()


@query("a19", "SELECT region_name, macrozone_name, zone_name, sensor_id, max(time) AS last_seen FROM readings GROUP BY ALL")
def a19(t):
    return devices.last_seen(t.readings, schemas.SENSOR)


@query("a20", "SELECT hub_id, region_name, macrozone_name, zone_name, min(time) AS registration_time, max(time) AS last_seen FROM configs GROUP BY ALL")
def a20(t):
    return devices.first_and_last(t.configs, ["hub_id", "region_name", "macrozone_name", "zone_name"])


@query("a21", """SELECT cast(h.hour AS integer) AS hour, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std
  FROM range(24) h(hour) LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY h.hour""")
def a21(t):
    return rnd(quality.hourly_profile(t.readings), 6, "mean", "std")


SPAN = 30 * 24 * 3600
_RATES = ("missing_rate", "missing_rate_adj")


@query("a24", """SELECT unique_sensors, received, expected, expected_adj, greatest(expected - received, 0) AS expected_missed,
  round(greatest((expected - received) / expected * 100, 0), 6) AS missing_rate,
  round(greatest((expected_adj - received) / expected_adj * 100, 0), 6) AS missing_rate_adj
FROM (SELECT *, cast(round(expected * 0.85e0) AS bigint) AS expected_adj FROM
  (SELECT count(DISTINCT (region_name, macrozone_name, zone_name, sensor_id)) AS unique_sensors, count(*) AS received,
          count(DISTINCT (region_name, macrozone_name, zone_name, sensor_id)) * 60 AS expected FROM received))""")
def a24(t):
    out = quality.delivery_quality(t.received, schemas.SENSOR, SPAN, 12 * 3600)
    return rnd(out, 6, *_RATES)


@query("a25", """SELECT sent, sent_missing, sent_outliers, received, rejected, greatest(sent - received, 0) AS missed,
  round(greatest(sent - received, 0) / sent * 100, 6) AS missing_rate,
  round((greatest(sent - received, 0) - sent_missing) / sent * 100, 6) AS missing_rate_adj,
  round(abs(rejected - sent_outliers) / sent_outliers * 100, 6) AS outlier_error
FROM (SELECT count(*) AS sent, count(*) FILTER (k < 15) AS sent_missing, count(*) FILTER (value > 150) AS sent_outliers FROM ev),
     (SELECT count(*) AS received, count(*) FILTER (value > 160) AS rejected FROM received)""")
def a25(t):
    k, v = F.col("k"), F.col("value")
    out = quality.loss_report(t.events, t.received, k < 15, v > 150, v > 160)
    return rnd(out, 6, *_RATES, "outlier_error")


@query("a26", f"""SELECT count(*) AS received, count(DISTINCT (region_name, macrozone_name, zone_name, sensor_id)) AS unique_sensors,
  round(count(*) / {SPAN / 60}, 6) AS msg_per_min, round(count(*) / {SPAN}, 6) AS msg_per_sec, count(k) AS lat_count,
  round(avg(k), 6) AS lat_avg_s, max(k) AS lat_max_s FROM received""")
def a26(t):
    # processing time = event time + k seconds
    out = quality.throughput(t.received, F.col("k"), SPAN / 60, schemas.SENSOR)
    return rnd(out, 6, "msg_per_min", "msg_per_sec", "lat_avg_s")


@query("a27", """SELECT e.event_type, round(b.bound, 6) AS bound, round(avg(e.value), 6) AS trimmed_mean, count(*) AS kept
FROM events e JOIN (SELECT event_type, avg(value) + 2 * stddev_samp(value) AS bound FROM events GROUP BY event_type) b
  USING (event_type) WHERE e.value <= b.bound GROUP BY e.event_type, b.bound""")
def a27(t):
    return rnd(quality.trimmed_mean(t.events, "value", ["event_type"]), 6, "bound", "trimmed_mean")


def _box(col: str) -> str:
    q = ", ".join(
        f"round(quantile_cont(cast({col} AS double), {p}), 6) AS {n}"
        for p, n in ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))
    )
    return f"SELECT '{col}' AS metric, {q} FROM lineitem"


BOX_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("a28", " UNION ALL ".join(_box(c) for c in BOX_COLUMNS))
def a28(t):
    return rnd(quality.box_plot(t.base("lineitem"), BOX_COLUMNS, enough=20_000), 6, "min", "q1", "median", "q3", "max")


# ---- W: series -----------------------------------------------------------------

_KEY = "region_name, macrozone_name, type"
_SERIES = f"""SELECT *, count(*) OVER (PARTITION BY {_KEY}) AS n, row_number() OVER (PARTITION BY {_KEY} ORDER BY day) AS pos,
  avg(avg_value) OVER (PARTITION BY {_KEY} ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ma FROM macro_daily"""


@query("w1", f"""SELECT {_KEY}, day, round(CASE WHEN n < 3 THEN avg_value ELSE ma END, 5) AS smoothed FROM ({_SERIES})
  WHERE n < 3 OR pos <= n - 2""")
def w1(t):
    out = series.moving_average(macro_daily(t), analysis.KEYS, "day", "avg_value")
    return rnd(out.select(*analysis.KEYS, "day", "smoothed"), 5, "smoothed")


@query("w2", f"""SELECT {_KEY}, round(coalesce(regr_slope(avg_value, pos - 1), 0), 4) AS slope FROM ({_SERIES}) GROUP BY ALL""")
def w2(t):
    return rnd(series.slope(macro_daily(t), analysis.KEYS, "day", "avg_value"), 4, "slope")


_ALIGNED = """SELECT m.day, m.region_name, m.macrozone_name, m.type, m.avg_value AS x, r.avg_value AS y
  FROM macro_daily m JOIN region_daily r USING (day, region_name, type)"""


def aligned(t):
    return series.aligned_days(macro_daily(t), region_daily(t)).select(
        *analysis.KEYS, "day", F.col("m.avg_value").alias("x"), F.col("r.avg_value").alias("y")
    )


@query("w3", f"SELECT {_KEY}, round(corr(x, y), 6) AS correlation FROM ({_ALIGNED}) GROUP BY ALL")
def w3(t):
    return rnd(series.pearson(aligned(t), analysis.KEYS, "x", "y"), 6, "correlation")


@query("w4", f"SELECT {_KEY}, round(sum(CASE WHEN y <> 0 THEN abs(x - y) / abs(y) ELSE 0 END) / count(*), 6) AS divergence FROM ({_ALIGNED}) GROUP BY ALL")
def w4(t):
    return rnd(series.mean_relative_difference(aligned(t), analysis.KEYS, "x", "y"), 6, "divergence")


_OVER = f"OVER (PARTITION BY {_KEY} ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
_TREND = f"""SELECT {_KEY}, TIMESTAMP '2000-06-30 00:00:00' AS day,
  round(CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) <= 0 THEN 0
        ELSE (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 4) AS correlation,
  round(CASE WHEN n < 2 THEN 0 ELSE (n * six - si * sx) / (n * sii - si * si) END, 3) AS slope_macro,
  round(CASE WHEN n < 2 THEN 0 ELSE (n * siy - si * sy) / (n * sii - si * si) END, 3) AS slope_region,
  round(rel / n, 6) AS divergence{{extra}}
FROM (SELECT {_KEY}, cast(count(x) AS double) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy,
        cast(sum(pos - 1) AS double) AS si, cast(sum((pos - 1) * (pos - 1)) AS double) AS sii, sum((pos - 1) * x) AS six, sum((pos - 1) * y) AS siy,
        sum(CASE WHEN y <> 0 THEN abs(x - y) / abs(y) ELSE 0 END) AS rel, any_value(cnt) AS days
      FROM (SELECT {_KEY}, pos, cnt, CASE WHEN cnt < 3 THEN x ELSE mx END AS x, CASE WHEN cnt < 3 THEN y ELSE my END AS y
            FROM (SELECT *, count(*) OVER (PARTITION BY {_KEY}) AS cnt, row_number() OVER (PARTITION BY {_KEY} ORDER BY day) AS pos,
                         avg(x) {_OVER} AS mx, avg(y) {_OVER} AS my
                  FROM ({_ALIGNED}) WHERE day BETWEEN TIMESTAMP '2000-05-02' AND TIMESTAMP '2000-06-30')
            WHERE cnt < 3 OR pos <= cnt - 2)
      GROUP BY ALL)"""


def _trend_columns(df):
    return at_day(rnd(rnd(rnd(df, 4, "correlation"), 3, "slope_macro", "slope_region"), 6, "divergence"))


@query("w5", _TREND.format(extra=""))
def w5(t):
    return _trend_columns(series.trend_similarity(macro_daily(t, *TREND_SPAN), region_daily(t, *TREND_SPAN), TREND_DAY))


@query("e10", _TREND.format(extra=", days AS macrozone_series, days AS region_series"))
def e10(t):
    """Through the store: the second call finds the first one's day."""
    path = scratch_path(t.spark, "e10")
    for _ in range(2):
        out = stored.trend_similarity(t.spark, path, macro_daily(t, *TREND_SPAN), region_daily(t, *TREND_SPAN), [TREND_DAY], NOW)
    lengths = {c: F.size(c).cast("long") for c in ("macrozone_series", "region_series")}
    return _trend_columns(out.withColumns(lengths).drop("days", "region"))


@query("k8_series", """SELECT m.region_name, m.macrozone_name, m.type, m.day, round(m.avg_value, 6) AS avg_value, m.total_count, round(r.avg_value, 6) AS region_avg_value, r.total_count AS region_total_count
  FROM macro_daily m JOIN region_daily r USING (day, region_name, type) WHERE m.day BETWEEN TIMESTAMP '2000-05-02' AND TIMESTAMP '2000-06-30'""")
def k8_series(t):
    """The series of stored trends give every aligned day back."""
    out = stored.trend_similarity(t.spark, scratch_path(t.spark, "k8"), macro_daily(t, *TREND_SPAN), region_daily(t, *TREND_SPAN), [TREND_DAY], NOW)
    both = F.explode(F.arrays_zip("macrozone_series", "region_series"))
    rows = out.select(*analysis.KEYS, both.alias("s")).select(
        *analysis.KEYS, "s.macrozone_series.day", "s.macrozone_series.avg_value", "s.macrozone_series.total_count",
        F.col("s.region_series.avg_value").alias("region_avg_value"), F.col("s.region_series.total_count").alias("region_total_count"),
    )
    return at_day(rnd(rows, 6, "avg_value", "region_avg_value"))


def _filter_sql(size: int) -> str:
    return f"""RECURSIVE o AS (SELECT concat_ws('/', region_name, macrozone_name, zone_name, sensor_id) AS sensor, sensor_id, event_id, value,
  row_number() OVER (PARTITION BY region_name, macrozone_name, zone_name, sensor_id ORDER BY time, value) AS rn FROM readings),
f AS (SELECT sensor, sensor_id, event_id, rn, [value] AS h, true AS accepted FROM o WHERE rn = 1
  UNION ALL
  SELECT sensor, sensor_id, event_id, rn, CASE WHEN ok THEN list_append(h, value)[-{size}:] ELSE h END, ok
  FROM (SELECT o.*, f.h, len(f.h) < 5 OR abs(o.value - list_avg(f.h)) <= 3 * list_stddev_pop(f.h) AS ok
        FROM f JOIN o ON o.sensor = f.sensor AND o.rn = f.rn + 1))
SELECT event_id, sensor_id, accepted FROM f"""


@query("w8", _filter_sql(20))
def w8(t):
    return outlier.flag_outliers(t.readings, size=20).select("event_id", "sensor_id", "accepted")


@query("w8_default", _filter_sql(params.HISTORY_SIZE))
def w8_default(t):
    return outlier.flag_outliers(t.readings, split=False).select("event_id", "sensor_id", "accepted")


@query("w8_split", _filter_sql(20))
def w8_split(t):
    """The same over more partitions than there are tasks: histories cross many borders."""
    return outlier.flag_outliers(t.readings, size=20, partitions=23).select("event_id", "sensor_id", "accepted")


# ---- endpoints over statistics -------------------------------------------------

def _by_day(t, rows, keys, name):
    """Rows in a table stored by day."""
    path = scratch_path(t.spark, name)
    tables.append_absent(rows, path, keys)
    return path


@query("e3", f"SELECT {_SHOWN} FROM region_q WHERE region_name = 'AFRICA' ORDER BY time DESC, type LIMIT 50")
def e3(t):
    path = _by_day(t, region_q(t), schemas.REGION_STATS_KEY, "e3")
    return rnd(endpoints.newest_statistics(t.spark, path, region_name=AFRICA), 6, "avg_value")


query("e6", f"SELECT macrozone_name, {_SHOWN} FROM macro_stats WHERE region_name = '{AFRICA}' AND macrozone_name = '{FIRST}' ORDER BY time DESC, type LIMIT 50")(
    lambda t: rnd(endpoints.macrozone_statistics(t.macro_stats, AFRICA, FIRST), 6, "avg_value")
)


@query("e13", f"SELECT macrozone_name, zone_name, {_SHOWN} FROM zone_q WHERE region_name = '{AFRICA}' AND macrozone_name = '{FIRST}' AND zone_name = 'zone-1' ORDER BY time DESC, type LIMIT 50")
def e13(t):
    path = _by_day(t, rollup.zone_stats(t.readings), schemas.ZONE_STATS_KEY, "e13")
    return rnd(endpoints.newest_statistics(t.spark, path, region_name=AFRICA, macrozone_name=FIRST, zone_name="zone-1"), 6, "avg_value")


@query("e14", f"""SELECT time, macrozone_name, zone_name, sensor_id, type, value FROM readings WHERE region_name = '{AFRICA}'
  AND macrozone_name = '{FIRST}' AND zone_name = 'zone-1' AND sensor_id = '1' ORDER BY time DESC, type LIMIT 50""")
def e14(t):
    path = _by_day(t, t.readings, schemas.READING_KEY, "e14")
    return endpoints.newest_readings(t.spark, path, AFRICA, FIRST, "zone-1", "1")
