import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterfold import schemas
from meterfold.operators import catalog, devices, filters, outbox, sets
from meterfold.plans import endpoints

T = dt.datetime
DEVICE = "id string, macrozone_name string, service string, registration_time timestamp_ntz, last_seen timestamp_ntz"
KEY = ["id", "macrozone_name"]


def hubs(spark, *rows):
    return spark.createDataFrame(list(rows), DEVICE)


def test_upsert(spark):
    old = hubs(spark, ("h1", "m", "edge", T(2024, 1, 1), T(2024, 1, 5)), ("h2", "m", "edge", T(2024, 1, 1), None), ("h3", "m", "edge", None, T(2024, 1, 9)))
    batch = spark.createDataFrame(
        [("h1", "m", "other", T(2024, 1, 3)), ("h2", "m", "edge", T(2024, 1, 2)), ("h3", "m", "edge", T(2024, 1, 10)),
         ("h4", "m", "late", T(2024, 1, 8)), ("h4", "m", "first", T(2024, 1, 7))],
        "id string, macrozone_name string, service string, time timestamp_ntz",
    )
    got = {r.id: (r.service, r.registration_time, r.last_seen) for r in devices.upsert(old, batch, KEY, ["service"]).collect()}
    assert got == {
        "h1": ("edge", T(2024, 1, 1), T(2024, 1, 5)),
        "h2": ("edge", T(2024, 1, 1), T(2024, 1, 2)),
        "h3": ("edge", None, T(2024, 1, 10)),
        "h4": ("first", T(2024, 1, 7), T(2024, 1, 8)),
    }


def test_upsert_is_idempotent(spark):
    batch = spark.createDataFrame([("h", "m", "s", T(2024, 1, 2))], "id string, macrozone_name string, service string, time timestamp_ntz")
    once = devices.upsert(hubs(spark).limit(0), batch, KEY, ["service"])
    assert once.collect() == devices.upsert(once, batch, KEY, ["service"]).collect()


def test_advance_last_seen(spark):
    old = hubs(spark, ("a", "m", "s", None, T(2024, 1, 5)), ("b", "m", "s", None, None), ("c", "m", "s", None, T(2024, 1, 1)))
    seen = spark.createDataFrame([("a", "m", T(2024, 1, 4)), ("b", "m", T(2024, 1, 2)), ("b", "m", T(2024, 1, 3)), ("x", "m", T(2024, 1, 3))], "id string, macrozone_name string, time timestamp_ntz")
    got = {r.id: r.last_seen for r in devices.advance_last_seen(old, seen, KEY).collect()}
    assert got == {"a": T(2024, 1, 5), "b": T(2024, 1, 3), "c": T(2024, 1, 1)}
    touched = {r.id: r.last_seen for r in devices.touch(old, T(2024, 2, 1), id="b").collect()}
    assert touched["b"] == T(2024, 2, 1) and touched["a"] == T(2024, 1, 5)


def test_health(spark):
    now = T(2024, 1, 1, 12)
    ages = {"ok": 60, "edge": 300, "quiet": 301, "six": 6 * 3600, "gone": 6 * 3600 + 1}
    seen = spark.createDataFrame([(k, now - dt.timedelta(seconds=s)) for k, s in ages.items()], "sensor_id string, last_seen timestamp_ntz")
    known = sets.unique_union(seen.select("sensor_id"), spark.createDataFrame([("never",)], "sensor_id string"))
    got = {r.sensor_id: r.status for r in devices.health(known, seen, now, keys=["sensor_id"]).collect()}
    assert got == {"ok": "healthy", "edge": "healthy", "quiet": "unhealthy", "six": "unhealthy", "gone": "removed", "never": "removed"}
    live = endpoints.liveness(seen, now, 300).filter("active").collect()
    assert [r.sensor_id for r in live] == ["ok"]


def test_first_registrations(spark):
    msgs = spark.createDataFrame([("a", "m", T(2024, 1, 2)), ("a", "m0", T(2024, 1, 1)), ("b", "m", T(2024, 1, 1))], "sensor_id string, macrozone string, time timestamp_ntz")
    known = spark.createDataFrame([("b",)], "sensor_id string")
    assert [tuple(r) for r in devices.first_registrations(msgs, known, ["sensor_id"]).collect()] == [("a", "m0", T(2024, 1, 1))]


def test_outbox(spark):
    now = T(2024, 1, 3)
    df = spark.createDataFrame([(1, T(2024, 1, 1), "sent"), (2, T(2024, 1, 1), "pending"), (3, T(2024, 1, 2, 23), "sent")], "id int, time timestamp_ntz, status string")
    assert sorted(r.id for r in outbox.purge_sent(df, now).collect()) == [2, 3]
    assert [r.id for r in outbox.retain(df, now).collect()] == [3]


def test_guards_and_routing(spark):
    beats = spark.createDataFrame(
        [(10, "m", "z", "h"), (10, "m", "", "h"), (0, "m", "z", "h"), (-5, "m", "z", "h"), (10, "", "z", "h"), (10, "m", "z", ""), (None, "m", "z", "h")],
        "timestamp bigint, macrozone string, zone string, hub_id string",
    )
    good = filters.valid_heartbeats(beats, "timestamp")
    assert [r.grain for r in filters.with_grain(good).orderBy(F.desc("zone")).collect()] == ["zone", "macrozone"]
    none = spark.createDataFrame([("", "")], "zone string, macrozone string")
    assert filters.with_grain(none).count() == 0
    kinds = spark.createDataFrame([("new_sensor",), ("new_edge",), ("new_proximity",), ("x",), (None,)], "msg_type string")
    assert sorted(r.target for r in filters.with_target(kinds).collect()) == ["macrozone_hubs", "sensors", "zone_hubs"]


def test_time_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS time", "id").write.parquet(path)
    df = spark.read.parquet(path).filter(filters.in_days("time", dt.date(2024, 1, 3), dt.date(2024, 1, 4)))
    assert sorted(r.id for r in df.collect()) == [2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in plan and "LessThan(time" in plan


def test_nested_detail_pages(spark):
    parents = spark.createDataFrame([("p",), ("q",), ("empty",)], "name string")
    a = spark.range(95).select(F.when(F.col("id") < 90, "p").otherwise("q").alias("name"), F.col("id").alias("x"))
    b = spark.createDataFrame([("p", "one")], "name string, y string")
    got = catalog.nest(parents, ["name"], {"as": (a, ["x"]), "bs": (b, ["y"])}, pages=4).collect()
    assert sorted(x.x for r in got if r.name == "p" for x in r["as"]) == list(range(90))
    assert sorted(r.page for r in got if r.name == "p") == [0, 1, 2, 3] and {r.as_count for r in got if r.name == "p"} == {90}
    assert [y.y for r in got if r.name == "p" for y in r.bs] == ["one"]
    q = [r for r in got if r.name == "q"]
    assert len(q) == 4 and sorted(x.x for r in q for x in r["as"]) == [90, 91, 92, 93, 94] and {(len(r.bs), r.bs_count) for r in q} == {(0, 0)}
    assert [(r["as"], r.as_count) for r in got if r.name == "empty"] == [([], 0)] * 4
    whole = {r.name: [x.x for x in r["as"]] for r in catalog.nest(parents, ["name"], {"as": (a, ["x"])}).collect()}
    assert whole == {"p": list(range(90)), "q": [90, 91, 92, 93, 94], "empty": []}


def test_device_keys_hold_the_place(spark):
    rows = [("s1", "EU", "m", "z1", T(2024, 1, 1)), ("s1", "EU", "m", "z2", T(2024, 1, 2)), ("s1", "US", "m", "z1", T(2024, 1, 3))]
    batch = spark.createDataFrame(rows, "id string, region_name string, macrozone_name string, zone_name string, time timestamp_ntz")
    assert devices.first_and_last(batch, schemas.SENSOR_KEY).count() == 3
    seen = batch.withColumnRenamed("id", "sensor_id").withColumnRenamed("time", "last_seen")
    known = sets.known_sensors(batch, seen)
    assert {(r.region_name, r.zone_name): r.status for r in devices.health(known, seen, T(2024, 1, 3), 300, 86400).collect()} == {
        ("EU", "z1"): "removed", ("EU", "z2"): "unhealthy", ("US", "z1"): "healthy",
    }
