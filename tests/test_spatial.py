import math
import random

import pytest
from pyspark.sql import functions as F

from meterfold.functions import geo
from meterfold.operators import sets, spatial


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(scope="module")
def places():
    rng = random.Random(3)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    spots += [(rng.uniform(89, 90), rng.uniform(-180, 180)) for _ in range(15)]      # pole
    spots += [(rng.uniform(-1, 1), rng.choice((-1, 1)) * rng.uniform(179.5, 180)) for _ in range(25)]  # date line
    spots += [(45 + rng.uniform(0, 0.05), 9 + rng.uniform(0, 0.05)) for _ in range(40)]  # a third in one spot
    return [("r", f"m{i}", *s) for i, s in enumerate(spots)]


@pytest.mark.parametrize("radius_m", [0.0, 5_000.0, 80_000.0, 3_000_000.0, 10_000_000.0, 30_000_000.0])
def test_neighbours_equal_brute_force(spark, places, radius_m):
    df = spark.createDataFrame(places, "region_name string, name string, lat double, lon double")
    got = {(r.name, r.neighbour) for r in spatial.neighbours(df, radius_m, rows_per_block=7).collect()}
    want = {
        (a[1], b[1]) for a in places for b in places
        if a[1] != b[1] and km(a[2:], b[2:]) * 1000 <= radius_m
    }
    assert got == want
    rows = spatial.neighbours(df, radius_m, rows_per_block=7).count()
    assert rows == len(want)


def test_near_point_equals_exact_test(spark):
    rng = random.Random(5)
    corners = [(rng.uniform(-179.5, 179), rng.uniform(-88, 88)) for _ in range(150)]
    df = spark.createDataFrame([("r", f"m{i}", *c) for i, c in enumerate(corners)], "region_name string, name string, lon0 double, lat0 double")
    df = df.withColumn("ring", geo.square(F.col("lon0"), F.col("lat0"), 0.3)).cache()
    for lat, lon in ((10.0, 20.0), (85.0, 0.0), (-40.0, 179.9), (0.0, -179.99)):
        for radius in (0.0, 300_000.0, 2_000_000.0, 9_000_000.0):
            exact = df.filter(geo.distance_m(F.col("ring"), F.lit(lon), F.lit(lat)) <= radius)
            got = {r.name for r in spatial.near_point(df, lat, lon, radius).collect()}
            assert got == {r.name for r in exact.collect()}
    with pytest.raises(ValueError):
        spatial.near_point(df, 0, 0, -1)


def test_many_points_equal_one_by_one(spark):
    """Points and radii of every size, poles, the date line, a crowd of points in one place, large and odd polygons."""
    rng = random.Random(6)
    zones = [("r", f"m{i}", rng.uniform(-179.5, 179), rng.uniform(-89, 88), rng.choice([0.01, 0.3, 1.0])) for i in range(60)]
    zones += [("r", f"spot{i}", 9 + i / 1000, 45.0, 0.02) for i in range(30)] + [("r", "wide", -170.0, -20.0, 60.0), ("r", "pole", 10.0, 89.5, 0.5)]
    rings = spark.createDataFrame(zones, "region_name string, name string, lon0 double, lat0 double, side double")
    at = lambda dx, dy: F.struct((F.col("lon0") + F.col("side") * dx).alias("lon"), (F.col("lat0") + F.col("side") * dy).alias("lat"))
    rings = rings.withColumn("ring", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)))
    line = [(float(lon), float(lat)) for lon, lat in ((179, 1), (-179, 1), (-179, 3), (179, 3), (179, 1))]
    rings = rings.select("region_name", "name", "ring").unionByName(
        spark.createDataFrame([("r", "dateline", [{"lon": x, "lat": y} for x, y in line])], "region_name string, name string, ring array<struct<lon:double,lat:double>>")
    ).cache()
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([0.0, 100.0, 3e4, 4e5, 2e6, 2.5e7])) for i in range(80)]
    points += [(100 + i, 45.01, 9.01 + i / 10_000, rng.choice([0.0, 50.0, 2e3])) for i in range(60)]
    points += [(200, 89.99, 0.0, 1e5), (201, -89.99, 3.0, 2e6), (202, 2.0, 179.99, 1e3), (203, 2.0, -180.0, 3e5), (204, 2.0, 179.5, 5.0)]
    points += [(300, None, 1.0, 5.0), (301, 1.0, 1.0, None), (302, 1.0, 1.0, -1.0), (303, 1.0, 1.0, float("nan"))]
    asked = spark.createDataFrame(points, "point_id long, lat double, lon double, radius_m double").withColumn("name", F.lit("clash"))
    got = sorted((r.point_id, r.name) for r in spatial.near_points(asked, rings, rows_per_block=5).collect())
    every = asked.drop("name").join(rings, F.lit(True)).filter(geo.distance_m(F.col("ring"), F.col("lon"), F.col("lat")) <= F.col("radius_m"))
    assert got == sorted((r.point_id, r.name) for r in every.filter("radius_m >= 0 AND NOT isnan(radius_m)").collect())
    assert len(got) > 300 and any(name == "dateline" for _, name in got)
    assert spatial.near_points(asked.limit(0), rings).collect() == spatial.near_points(asked, rings.limit(0)).collect() == []


def test_far_pairs_get_no_exact_distance(spark):
    """Pairs of a join are told apart by their caps; the distance is worked out once for each that is left."""
    zones = spark.createDataFrame([("r", f"m{i}", i * 0.5, 45.0) for i in range(20)], "region_name string, name string, lon0 double, lat0 double")
    zones = zones.withColumn("ring", geo.square(F.col("lon0"), F.col("lat0"), 0.02))
    asked = spark.createDataFrame([(1, 45.01, 0.01, 60_000.0), (2, 45.01, 5.01, 100.0)], "point_id long, lat double, lon double, radius_m double")
    found = spatial.near_points(asked, zones)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tested = [x for x in lines if "Join" in x or "Filter" in x]
    assert not any("ATAN2" in x for x in tested) and sum("Join" in x and "chord" in x for x in tested) == 2
    assert sorted((r.point_id, r.name) for r in found.collect()) == [(1, "m0"), (1, "m1"), (2, "m10")]


def test_distance_of_odd_rings(spark):
    """Inside, on the border, across the date line, beside a ring of one point, without a ring."""
    ring = lambda *ps: [{"lon": float(x), "lat": float(y)} for x, y in ps]
    rows = [
        (0, ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), 1.0, 1.0), (1, ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), 2.0, 1.0),
        (2, ring((179, 0), (-179, 0), (-179, 1), (179, 1), (179, 0)), 180.0, -1.0), (3, ring((5, 5), (5, 5)), 5.0, 6.0), (4, None, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "id long, ring array<struct<lon:double,lat:double>>, lon double, lat double")
    got = {r.id: r.d for r in df.select("id", geo.distance_m(F.col("ring"), F.col("lon"), F.col("lat")).alias("d")).collect()}
    degree = math.radians(1) * 6_371_000
    assert got[0] == got[1] == 0.0 and got[4] is None
    assert got[2] == pytest.approx(degree) and got[3] == pytest.approx(degree)


def test_with_neighbours(spark):
    pairs = spark.createDataFrame([("r", "a", "q", "b"), ("q", "b", "r", "a"), ("r", "a", "r", "c")], "region_name string, name string, neighbour_region string, neighbour string")
    asked = spark.createDataFrame([("r", "a"), ("r", "c")], "region_name string, name string")
    got = sorted(tuple(r) for r in sets.with_neighbours(asked, pairs).collect())
    assert got == [("q", "b"), ("r", "a"), ("r", "c")]
