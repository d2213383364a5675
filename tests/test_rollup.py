import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterfold.operators import latest, rollup, sets

T = dt.datetime


def readings(spark, rows):
    return spark.createDataFrame(
        [("r", m, z, s, t, k, v) for m, z, s, t, k, v in rows],
        "region_name string, macrozone_name string, zone_name string, sensor_id string, time timestamp_ntz, type string, value double",
    )


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        (f"m{i % 3}", f"z{i % 2}", f"s{i % 7}", T(2024, 1, 1) + dt.timedelta(minutes=i * 7 % 200), "t" if i % 4 else "h", float(i * 37 % 101))
        for i in range(300)
    ]
    return readings(spark, rows).cache()


def values(df, *keys):
    return {tuple(r[k] for k in keys): (r.min_value, r.max_value, round(r.avg_value, 9), r.avg_sum, r.avg_count) for r in df.collect()}


def test_merging_partials_equals_direct_aggregation(some):
    macro = rollup.macrozone_stats(rollup.zone_stats(some))
    keys = ["region_name", "macrozone_name", "type"]
    direct = some.groupBy(F.window("time", "15 minutes").alias("w"), *keys).agg(*rollup.from_readings()).select(
        F.col("w.end").alias("time"), *keys, *rollup.STAT_COLUMNS
    )
    assert values(macro, "time", *keys) == values(direct, "time", *keys)


def test_region_takes_macrozone_rows_by_end_stamp(spark):
    rows = readings(spark, [("m", "z", "s", T(2024, 1, 1, 0, 1), "t", 1.0), ("m", "z", "s", T(2024, 1, 1, 0, 16), "t", 5.0)])
    zones = rollup.zone_stats(rows)
    assert sorted(r.time for r in zones.collect()) == [T(2024, 1, 1, 0, 15), T(2024, 1, 1, 0, 30)]
    regions = rollup.region_stats(rollup.macrozone_stats(zones)).orderBy("time").collect()
    # 00:15 belongs to [00:00, 00:30), 00:30 to the next interval
    assert [(r.time, r.avg_sum) for r in regions] == [(T(2024, 1, 1, 0, 30), 1.0), (T(2024, 1, 1, 1, 0), 5.0)]


def test_grouping_sets_equal_union(some):
    zones = rollup.zone_stats(some)
    keys = ["time", "region_name", "macrozone_name", "zone_name", "type"]
    one = values(rollup.zone_and_macrozone_stats(zones), *keys)
    assert one == values(sets.all_grains(zones, rollup.macrozone_stats(zones)), *keys)
    assert any(k[3] == "" for k in one)


def test_zero_counts(spark):
    stats = spark.createDataFrame(
        [("r", "m", "t", T(2024, 1, 1), 1.0, 2.0, 0.0, 0.0, 0)],
        "region_name string, macrozone_name string, type string, time timestamp_ntz, min_value double, max_value double, avg_value double, avg_sum double, avg_count long",
    )
    assert rollup.macrozone_calendar(stats, "day").first().avg_value is None
    ranged = rollup.region_range_stats(stats, T(2024, 1, 1), T(2024, 1, 2)).first()
    assert (ranged.avg_value, ranged.avg_count, ranged.total_count) == (0.0, 1, 0)
    assert rollup.region_range_stats(stats, T(2023, 1, 1), T(2024, 1, 1)).count() == 0


def test_coarser_calendar_equals_base(some):
    stats = rollup.macrozone_stats(rollup.zone_stats(some))
    daily = rollup.macrozone_calendar(stats, "day")
    keys = rollup.MACROZONE_KEYS
    a = {tuple(r) for r in rollup.coarser_calendar(daily, "day", "year", keys).collect()}
    assert a == {tuple(r) for r in rollup.macrozone_calendar(stats, "year").collect()}


def test_sensor_mean_takes_type_of_newest_reading(spark):
    rows = readings(spark, [("m1", "z1", "s", T(2024, 1, 1, 0, 0, 5), "a", 1.0), ("m1", "z1", "s", T(2024, 1, 1, 0, 0, 50), "b", 3.0)])
    r = rollup.sensor_means(rows).first()
    assert (r.time, r.macrozone_name, r.zone_name, r.type, r.value) == (T(2024, 1, 1), "m1", "z1", "b", 2.0)


def test_sensor_means_keep_places_apart_and_do_not_sort_readings(spark):
    rows = readings(spark, [("m", "z1", "s", T(2024, 1, 1), "a", 1.0), ("m", "z2", "s", T(2024, 1, 1), "a", 3.0), ("n", "z1", "s", T(2024, 1, 1), "a", 5.0)])
    means = rollup.sensor_means(rows)
    assert sorted((r.macrozone_name, r.zone_name, r.value) for r in means.collect()) == [("m", "z1", 1.0), ("m", "z2", 3.0), ("n", "z1", 5.0)]
    plan = means._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") > 0 and "SortAggregate" not in plan[plan.index("sum(value") :]


def test_intervals_and_catch_up(some, spark):
    last = spark.createDataFrame([("r", None)], "region_name string, last_time timestamp_ntz")
    now = T(2024, 1, 1, 3, 7)
    due = rollup.missing_intervals(last, now, look_back=3600).orderBy("start").collect()
    assert (due[0].start, due[-1].end) == (T(2024, 1, 1, 1, 30), T(2024, 1, 1, 2, 45))
    full = rollup.zone_stats(some)
    stored = full.filter(F.col("time") <= F.lit(T(2024, 1, 1, 1)).cast("timestamp_ntz"))
    new = rollup.catch_up_zone_stats(some, rollup.last_aggregated(stored), now)
    keys = ["time", "region_name", "macrozone_name", "zone_name", "type"]
    got, want = values(new, *keys), values(full, *keys)
    assert got == {k: v for k, v in want.items() if T(2024, 1, 1, 1) < k[0] <= T(2024, 1, 1, 2, 45)}


def test_latest(some):
    best = some.orderBy(F.desc("time"), "sensor_id", "type", "value").limit(5).collect()
    got = latest.latest(some, 5, ("sensor_id", "type", "value")).collect()
    assert got == best
    plan = latest.latest(some, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = latest.latest_per_key(some, ["sensor_id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    per_key = latest.latest_row(some, ["sensor_id"]).collect()
    assert len(per_key) == 7
    with pytest.raises(ValueError):
        latest.latest(some, 0)
