import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterfold.functions import geo
from meterfold.operators import analysis, series

D = dt.datetime


def daily(spark, rows):
    return spark.createDataFrame(
        [("r", m, "t", D(*d), 0.0, 0.0, v, v, 1) for m, d, v in rows],
        "region_name string, macrozone_name string, type string, day timestamp_ntz, min_value double, max_value double, avg_value double, total_sum double, total_count long",
    )


def variations(spark, rows, *span):
    return {(r.macrozone_name, r.day): (r.current, r.previous, r.delta_perc) for r in analysis.yearly_variation(daily(spark, rows), *span).collect()}


def test_yearly_variation_rules(spark):
    rows = [
        ("a", (2024, 2, 29), 12.0), ("a", (2023, 3, 1), 10.0),  # leap day is compared with 1 March
        ("b", (2023, 3, 1), 4.0),                               # no current value: -100 percent
        ("c", (2024, 2, 29), 4.0),                              # no previous value: no row
        ("d", (2024, 2, 29), 4.0), ("d", (2023, 3, 1), 0.0),    # previous 0: no row
        ("e", (2024, 2, 29), 4.0), ("e", (2023, 2, 28), 5.0),   # other day
    ]
    day = dt.date(2024, 2, 29)
    got = variations(spark, rows, day)
    assert got == {("a", day): (12.0, 10.0, pytest.approx(20.0)), ("b", day): (0.0, 4.0, -100.0)}


def test_all_days_at_once_equal_single_days(spark):
    rows = [(m, (y, mo, d), float(hash((m, y, mo, d)) % 50)) for m in "ab" for y in (2023, 2024, 2025) for mo, d in ((2, 27), (2, 28), (3, 1), (3, 2))]
    rows += [("a", (2024, 2, 29), 7.0), ("b", (2024, 2, 29), 9.0)]
    first, last = dt.date(2024, 2, 27), dt.date(2025, 3, 2)
    together = variations(spark, rows, first, last)
    for day in (dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2025, 2, 28), dt.date(2025, 3, 1)):
        assert {k: v for k, v in together.items() if k[1] == day} == variations(spark, rows, day)


def test_anomalies(spark):
    v = spark.createDataFrame(
        [("r", m, "t", dt.date(2024, 1, 1), 0.0, 1.0, d) for m, d in (("a", 10.0), ("b", 20.0), ("c", 40.0), ("lonely", 5.0))],
        "region_name string, macrozone_name string, type string, day date, current double, previous double, delta_perc double",
    )
    pairs = spark.createDataFrame(
        [("r", "a", "r", "b"), ("r", "a", "r", "c"), ("r", "b", "r", "a"), ("r", "c", "r", "nowhere")],
        "region_name string, name string, neighbour_region string, neighbour string",
    ).withColumn("distance_m", F.lit(1.0))
    got = {r.macrozone_name: r for r in analysis.anomalies(v, pairs, nested=True).collect()}
    assert set(got) == {"a", "b"}  # no row without neighbours' values
    assert (got["a"].neighbor_mean, got["a"].neighbor_std_dev, got["a"].abs_error, got["a"].z_score) == (30.0, 10.0, 20.0, -2.0)
    assert got["b"].neighbor_std_dev == 0.0 and got["b"].z_score == 0.0  # a single neighbour
    assert [x.neighbour for x in got["a"].neighbor_variation] == ["b", "c"]


def test_around_point(spark):
    at = dt.datetime(2024, 1, 1, 12)
    stats = spark.createDataFrame(
        [
            ("r", "here", "t", at, 1.0, 9.0, 5.0, 10.0, 2),
            ("r", "here", "t", at - dt.timedelta(minutes=15), 0.0, 99.0, 50.0, 100.0, 2),  # not the newest
            ("r", "near", "t", at, 2.0, 8.0, 6.0, 18.0, 3),
            ("r", "near", "old", at - dt.timedelta(hours=5), 2.0, 8.0, 6.0, 18.0, 3),        # too old
            ("r", "near", "none", at, 0.0, 0.0, 0.0, 0.0, 0),                                # no readings
            ("r", "far", "t", at, -5.0, 500.0, 100.0, 100.0, 1),
        ],
        "region_name string, macrozone_name string, type string, time timestamp_ntz, min_value double, max_value double, avg_value double, avg_sum double, avg_count long",
    )
    places = spark.createDataFrame([("r", "here", 9.99, 44.99), ("r", "near", 10.09, 44.99), ("r", "far", 20.0, 45.0)], "region_name string, name string, lon0 double, lat0 double")
    zones = places.withColumn("ring", geo.square(F.col("lon0"), F.col("lat0"), 0.02))
    c = zones.filter("name = 'here'").select(geo.centroid(F.col("ring")).alias("c")).first().c
    rows = analysis.around_point(stats, zones, c.lat, c.lon, 20_000, at + dt.timedelta(minutes=10)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.type, r.min_value, r.max_value, r.avg_value, r.avg_count) == ("t", 1.0, 9.0, 28.0 / 5, 5)
    # distance exactly 0 weighs 1 / 0.001 km
    d = 6371 * 2 * __import__("math").asin(__import__("math").sin(__import__("math").radians(0.05)) * __import__("math").cos(__import__("math").radians(45)))
    want = (5.0 * 1000 + 6.0 / d) / (1000 + 1 / d)
    assert r.weighted_avg == pytest.approx(want, rel=1e-6)


def line(spark, name, ys):
    return daily(spark, [(name, (2024, 1, 1 + i), float(y)) for i, y in enumerate(ys)])


def test_moving_average(spark):
    df = line(spark, "a", [1, 2, 3, 4, 8]).unionByName(line(spark, "b", [5, 7]))
    rows = series.moving_average(df, analysis.KEYS, "day", "avg_value", 3).orderBy("macrozone_name", "day").collect()
    assert [(r.macrozone_name, r.smoothed) for r in rows] == [("a", 2.0), ("a", 3.0), ("a", 5.0), ("b", 5.0), ("b", 7.0)]
    assert series.moving_average(df, analysis.KEYS, "day", "avg_value", 1).count() == 7


def test_slope_and_correlation(spark):
    df = line(spark, "up", [1, 3, 5]).unionByName(line(spark, "one", [4]))
    got = {r.macrozone_name: r.slope for r in series.slope(df, analysis.KEYS, "day", "avg_value").collect()}
    assert got == {"up": 2.0, "one": 0.0}
    flat = line(spark, "flat", [2, 2, 2]).withColumn("y", F.col("avg_value") * 0 + F.dayofmonth("day"))
    assert series.pearson(flat, analysis.KEYS, "avg_value", "y").first().correlation == 0.0
    rel = line(spark, "a", [1, 2, 3]).withColumn("b", F.when(F.dayofmonth("day") == 1, 0.0).otherwise(4.0))
    assert series.mean_relative_difference(rel, analysis.KEYS, "avg_value", "b").first().divergence == pytest.approx((0 + 0.5 + 0.25) / 3)


def test_trend_similarity(spark):
    macro = line(spark, "a", [1, 2, 3, 4, 5, 6]).unionByName(line(spark, "single", [3]))
    region = line(spark, "x", [2, 4, 6, 8, 10]).drop("macrozone_name")
    got = {r.macrozone_name: r for r in series.trend_similarity(macro, region, dt.date(2024, 1, 10), 10, series=True).collect()}
    a = got["a"]
    assert (a.correlation, a.slope_macro, a.slope_region, a.divergence) == (pytest.approx(1.0), 1.0, 2.0, 0.5)
    assert [s.avg_value for s in a.macrozone_series] == [1, 2, 3, 4, 5]  # only days in both, by day
    one = got["single"]
    assert (one.correlation, one.slope_macro, one.slope_region, one.divergence) == (0.0, 0.0, 0.0, 0.5)


def test_neighbours_days_travel_packed_and_equal_the_plain_join(spark):
    """Days far apart and before 1970, repeated and missing keys; own rows meet the pairs as bits of 64 days."""
    rng = __import__("random").Random(2)
    days = [dt.date(1969, 12, 30) + dt.timedelta(days=k) for k in (0, 1, 2, 3, 63, 64, 65, 66, 67, 128, 400)]
    rows = [("r", m, t, d, 1.0, 2.0, float(rng.randint(0, 99))) for m in "abcd" for t in "xy" for d in days if rng.random() < 0.7]
    rows += rows[:7] + rows[3:5] + [("r", "a", "x", None, 1.0, 2.0, 3.0), ("r", "b", None, days[0], 1.0, 2.0, 3.0), (None, "a", "x", days[0], 1.0, 2.0, 3.0)]
    v = spark.createDataFrame(rows, "region_name string, macrozone_name string, type string, day date, current double, previous double, delta_perc double")
    near = [(a, b) for a in "abcd" for b in "abcde" if a != b and (a, b) != ("c", "a")]
    pairs = spark.createDataFrame([("r", a, "r", b, 1.0) for a, b in near], "region_name string, name string, neighbour_region string, neighbour string, distance_m double")
    got = analysis.neighbour_variations(v, pairs)
    want = sorted(
        (o[1], w[1], o[2], o[3], w[6]) for o in rows for w in rows
        if None not in o[:4] and o[2:4] == w[2:4] and (o[1], w[1]) in near and w[0] == "r"
    )
    assert sorted((r.macrozone_name, r.neighbour, r.type, r.day, r.delta_perc) for r in got.collect()) == want
    assert "bit_or" in got._jdf.queryExecution().optimizedPlan().toString()
    found = analysis.anomalies(v, pairs, nested=True).collect()
    assert len(found) == len({o for o in rows if any(w[:3] == (o[1], w[1], o[2]) and w[3] == o[3] for w in want)})
    assert all(len(r.neighbor_variation) == sum(w[0] == r.macrozone_name and w[2:4] == (r.type, r.day) for w in want) // max(
        1, sum(o[:4] == (r.region_name, r.macrozone_name, r.type, r.day) for o in rows)) * sum(
        o == (r.region_name, r.macrozone_name, r.type, r.day, r.current, r.previous, r.delta_perc) for o in rows) for r in found)
