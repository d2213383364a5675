import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterfold.operators import analysis, series, spatial
from meterfold.plans import stored

NOW = dt.datetime(2024, 6, 1)
DAY = dt.date(2024, 5, 1)


@pytest.fixture
def daily(spark):
    rows = [
        (r, f"m{m}", kind, d + dt.timedelta(days=k), float(v), float(v), 10.0 + m + v * (kind == "a") + k, float(v), 1)
        for r, places in (("r1", range(6)), ("r2", range(6, 9))) for m in places for kind in ("a", "b")
        for k in range(-4, 2) for v, d in ((m % 4, DAY), (2, dt.date(2023, 5, 1)))
    ]
    stats = "min_value double, max_value double, avg_value double, total_sum double, total_count long"
    return spark.createDataFrame(rows, f"region_name string, macrozone_name string, type string, day date, {stats}").withColumn("day", F.col("day").cast("timestamp_ntz"))


@pytest.fixture
def places(spark):
    return spark.createDataFrame([("r1" if m < 6 else "r2", f"m{m}", 45.0, 9.0 + m / 100) for m in range(9)], "region_name string, name string, lat double, lon double")


def rows(df, *columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())


def test_anomalies_and_their_neighbours_survive_the_store(spark, tmp_path, daily, places, monkeypatch):
    path, days = str(tmp_path), [DAY, DAY + dt.timedelta(days=1)]
    variations = analysis.yearly_variation(daily, *days)
    pairs = spatial.neighbours(places, 100_000)
    want = analysis.anomalies(variations, pairs)
    columns = [c for c in want.columns]
    found, pages = stored.variation_against_neighbours(spark, path, daily, places, 100_000, days[:1], NOW, page=3)
    assert rows(found, *columns) == rows(want.filter(F.col("day") == F.lit(DAY)), *columns)
    found, pages = stored.variation_against_neighbours(spark, path, daily, places, 100_000, days, NOW, page=3)
    assert rows(found, *columns) == rows(want, *columns)
    assert pages.agg(F.max(F.size("neighbours")), F.max("page")).first() == (3, 2)  # eight neighbours each
    flat = pages.select(*analysis.KEYS, "day", F.explode("neighbours").alias("n")).select(*analysis.KEYS, "day", "n.*")
    around = analysis.neighbour_variations(variations, pairs)
    assert rows(flat, *sorted(flat.columns)) == rows(around, *sorted(flat.columns))

    def never(*args, **kw):
        raise AssertionError("computed again")

    monkeypatch.setattr(analysis, "anomalies", never)
    monkeypatch.setattr(analysis, "yearly_variation", never)
    again, _ = stored.variation_against_neighbours(spark, path, daily, places, 100_000, days, NOW)
    assert rows(again, *columns) == rows(want, *columns)
    assert stored.yearly_variation(spark, path, daily, days, NOW).count() == variations.count()  # stored on the way
    monkeypatch.undo()
    near, pages = stored.variation_against_neighbours(spark, path, daily, places, 100_000, [DAY], NOW, region="r2")
    assert {r.region_name for r in near.collect()} == {"r2"} and pages.count() == 6
    alone, none = stored.variation_against_neighbours(spark, str(tmp_path / "far"), daily, places, 1.0, [DAY], NOW)
    assert alone.collect() == [] and none.collect() == []


def test_trends_survive_the_store(spark, tmp_path, daily, monkeypatch):
    region = daily.groupBy("region_name", "type", "day").agg(*[F.avg(c).alias(c) for c in ("min_value", "max_value", "avg_value", "total_sum")], F.count("*").alias("total_count"))
    want = series.trend_similarity(daily, region, DAY, 4, series=True)
    first = stored.trend_similarity(spark, str(tmp_path), daily, region, [DAY], NOW, days=4)
    assert rows(first, *want.columns) == rows(want, *want.columns)
    monkeypatch.setattr(series, "trend_similarity", None)
    again = stored.trend_similarity(spark, str(tmp_path), daily, region, [DAY], NOW, days=4)
    assert rows(again, *want.columns) == rows(want, *want.columns)
    with pytest.raises(ValueError):
        stored.trend_similarity(spark, str(tmp_path), daily, region, [dt.date(2024, 5, 31)], NOW, days=4)
