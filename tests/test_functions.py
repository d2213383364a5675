import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from meterfold.functions import geo, scalars, timeutil


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_year_before_and_after(spark):
    days = [dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2023, 2, 28), dt.date(2024, 2, 28), dt.date(2025, 3, 1)]
    got = {r.d: r.p for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", timeutil.year_before(F.col("d")).alias("p")).collect()}
    assert got[dt.date(2024, 2, 29)] == dt.date(2023, 3, 1)
    assert got[dt.date(2024, 3, 1)] == dt.date(2023, 3, 1)
    assert got[dt.date(2024, 2, 28)] == dt.date(2023, 2, 28)
    # year_after_candidates is the exact inverse over five years
    span = spark.sql("SELECT explode(sequence(DATE'2021-01-01', DATE'2027-12-31')) AS d")
    forward = span.select("d", timeutil.year_before(F.col("d")).alias("p")).collect()
    back = span.select("d", F.explode(timeutil.year_after_candidates(F.col("d"))).alias("n")).collect()
    inside = lambda d: dt.date(2022, 6, 1) <= d <= dt.date(2026, 6, 1)
    assert {(r.d, r.p) for r in forward if inside(r.d)} == {(r.n, r.d) for r in back if inside(r.n)}


def test_buckets(spark):
    when = dt.datetime(2024, 2, 29, 13, 5)
    want = {
        "day": (dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1)),
        "week": (dt.datetime(2024, 2, 26), dt.datetime(2024, 3, 4)),
        "month": (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)),
        "year": (dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)),
    }
    t = F.lit(when).cast("timestamp_ntz")
    for unit, bounds in want.items():
        assert timeutil.bucket_bounds(when, unit) == bounds
        r = one(spark, timeutil.bucket_start(t, unit).alias("a"), timeutil.bucket_end(t, unit).alias("b"))
        assert (r.a, r.b) == bounds
    with pytest.raises(ValueError):
        timeutil.bucket_start(t, "hour")


def test_truncation_and_cutoff(spark):
    when = dt.datetime(2024, 1, 10, 13, 59, 59)
    t = F.lit(when).cast("timestamp_ntz")
    for seconds in (60, 900, 7200, 7 * 86400):
        assert one(spark, timeutil.truncate(t, seconds).alias("x")).x == timeutil.truncate_instant(when, seconds)
    # rows up to almost twice the span old pass
    assert timeutil.freshness_cutoff(when, 7200) == dt.datetime(2024, 1, 10, 10)


def test_intervals(spark):
    a, b = (F.lit(dt.datetime(2024, 1, 1, 0, m)).cast("timestamp_ntz") for m in (0, 50))
    r = one(spark, timeutil.intervals(a, b, 900).alias("x"), timeutil.intervals(b, a, 900).alias("y"))
    assert [x.minute for x in r.x] == [0, 15, 30] and r.y == []


def test_scalars(spark):
    r = one(
        spark,
        scalars.percent_change(F.lit(0.0), F.lit(4.0)).alias("gone"), scalars.percent_change(F.lit(1.0), F.lit(0.0)).alias("none"),
        scalars.nan_to_zero(F.lit(float("nan"))).alias("nan"), scalars.direction(F.lit(1e-7)).alias("flat"),
        scalars.diverges(F.lit(0.2)).alias("limit"),
        scalars.is_alive(F.lit(None).cast("timestamp_ntz"), dt.datetime(2024, 1, 1)).alias("never"),
    )
    assert (r.gone, r.none, r.nan, r.flat, r.limit, r.never) == (-100.0, None, 0.0, "flat", False, False)


SQUARE = "POLYGON((12.45 41.85, 12.55 41.85, 12.55 41.95, 12.45 41.95, 12.45 41.85))"


def test_polygon(spark):
    ring = geo.parse_polygon(F.lit(SQUARE))
    at = lambda lon, lat: geo.contains(F.col("ring"), F.lit(lon), F.lit(lat))
    df = spark.range(1).select(ring.alias("ring"))
    c = df.select(geo.centroid(F.col("ring")).alias("c")).first().c
    assert (round(c.lon, 9), round(c.lat, 9)) == (12.5, 41.9)
    r = df.select(
        at(12.5, 41.9).alias("inside"), at(12.45, 41.85).alias("vertex"), at(12.5, 41.85).alias("edge"),
        at(12.56, 41.9).alias("right"), at(12.44, 41.85).alias("level_left"), at(12.5, 42.0).alias("above"),
    ).first()
    assert tuple(r) == (True, True, True, False, False, False)
    d = df.select(
        geo.distance_m(F.col("ring"), F.lit(12.5), F.lit(41.9)).alias("zero"),
        geo.distance_m(F.col("ring"), F.lit(12.5), F.lit(42.05)).alias("north"),
    ).first()
    assert d.zero == 0.0
    assert abs(d.north - math.radians(0.1) * 6371000) < 1e-3
    assert spark.range(1).select(geo.parse_polygon(F.lit("POINT(1 2)")).alias("x")).first().x is None


def test_distance_over_the_date_line(spark):
    ring = geo.square(F.lit(179.9), F.lit(10.0), 0.05)
    d = spark.range(1).select(geo.distance_m(ring, F.lit(-179.95), F.lit(10.02)).alias("d")).first().d
    assert abs(d - math.radians(0.1) * math.cos(math.radians(10.02)) * 6371000) < 5
