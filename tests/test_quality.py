import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterfold.operators import quality


@pytest.mark.parametrize("enough", [10, 100_000])
def test_box_plot_equals_numpy(spark, enough):
    rng = random.Random(1)
    a = [7.0] * 400 + [rng.uniform(0, 10) for _ in range(333)]  # one value holds most rows
    b = [float(rng.randint(0, 5)) for _ in a]
    rng.shuffle(a)
    df = spark.createDataFrame([(x, y if i % 9 else None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    got = {r.metric: (r.min, r.q1, r.median, r.q3, r.max) for r in quality.box_plot(df, ["a", "b"], enough, 50).collect()}
    kept = [y for i, y in enumerate(b) if i % 9]
    assert got["a"] == pytest.approx(tuple(np.quantile(a, [0, 0.25, 0.5, 0.75, 1])))
    assert got["b"] == pytest.approx(tuple(np.quantile(kept, [0, 0.25, 0.5, 0.75, 1])))


def test_trimmed_mean(spark):
    xs = [10.0] * 20 + [11.0] * 20 + [200.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    bound = np.mean(xs) + 2 * np.std(xs, ddof=1)
    r = quality.trimmed_mean(df, "x").first()
    assert (r.bound, r.trimmed_mean, r.kept) == (pytest.approx(bound), 10.5, 40)
    assert quality.trimmed_mean(df.limit(1), "x").first().kept == 1


def test_loss_report(spark):
    sent = spark.range(100).withColumn("k", F.col("id"))
    got = spark.range(110)
    r = quality.loss_report(sent, got, F.col("k") < 10, F.lit(False), F.col("id") < 3).first()
    assert (r.sent, r.received, r.missed, r.missing_rate, r.missing_rate_adj, r.outlier_error) == (100, 110, 0, 0.0, -10.0, None)
    r = quality.loss_report(sent, got.limit(80), F.col("k") < 15, F.col("k") < 4, F.col("id") < 3).first()
    assert (r.missed, r.missing_rate, r.missing_rate_adj, r.outlier_error) == (20, 20.0, 5.0, 25.0)
    assert quality.loss_report(sent.limit(0), got, F.lit(True), F.lit(True), F.lit(True)).first().missing_rate is None


def test_delivery_quality(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(36)], "s string, i int")
    r = quality.delivery_quality(df, ["s"], 180, 5).first()
    assert (r.unique_sensors, r.expected, r.expected_adj, r.expected_missed, r.missing_rate_adj) == (2, 72, 61, 6, 0.0)
    assert r.missing_rate == pytest.approx(100 * 6 / 72)


def test_hourly_profile(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 05:30:00' AS time, cast(v AS double) AS value FROM VALUES (1), (3) t(v)")
    got = {r.hour: (r.mean, r.std) for r in quality.hourly_profile(df).collect()}
    assert len(got) == 24 and got[5] == (2.0, 1.0) and got[6] == (0.0, 0.0)


def test_throughput(spark):
    df = spark.range(20).select(F.lit("m").alias("m"), (F.col("id") % 4).alias("s"), F.when(F.col("id") > 0, F.col("id")).alias("lat"))
    r = quality.throughput(df, F.col("lat"), 10, ["m", "s"]).first()
    assert tuple(r) == (20, 4, 2.0, 20 / 600, 19, 10.0, 19)


def test_box_plot_of_repeated_and_odd_values(spark):
    rng = random.Random(4)
    rows = [(float(rng.choice([0, 0, 0, 1, 7, rng.gauss(0, 1)])), 5.0 if k % 10 else float(k), rng.choice([-1.0, 1.0]), None if k % 3 else -float(k)) for k in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("none", F.lit(None).cast("double")).repartition(3)
    for how in ({}, {"enough": 20, "accuracy": 100}, {"enough": 1, "accuracy": 1000}):
        got = {r.metric: [r["min"], r.q1, r.median, r.q3, r["max"]] for r in quality.box_plot(df, ["a", "b", "c", "d", "none"], **how).collect()}
        assert sorted(got) == ["a", "b", "c", "d"]
        for k, name in enumerate("abcd"):
            values = [r[k] for r in rows if r[k] is not None]
            assert got[name] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist(), abs=1e-12)
    assert quality.box_plot(df.limit(0), ["a"]).collect() == []


def test_trimmed_mean_of_a_large_group(spark):
    df = spark.createDataFrame([("hot", float(k % 50 + 900 * (k % 100 == 0))) for k in range(2000)] + [("one", 3.0)], "k string, v double")
    got = {r.k: (r.trimmed_mean, r.kept) for r in quality.trimmed_mean(df, "v", ["k"], salts=8).collect()}
    values = np.array([k % 50 + 900 * (k % 100 == 0) for k in range(2000)], float)
    kept = values[values <= values.mean() + 2 * values.std(ddof=1)]
    assert got == {"hot": (pytest.approx(kept.mean()), len(kept)), "one": (3.0, 1)}


def test_box_plot_repeats_no_row_for_a_rank(spark, monkeypatch):
    """Whole tables are scanned and added up; only the last, small pieces meet the ranks."""
    df = spark.range(5000).select((F.col("id") % 977).cast("double").alias("a"), F.sqrt("id").alias("b")).repartition(3)
    joined, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *a, **k: (joined.append(self.columns), join(self, *a, **k))[1])
    got = {r.metric: [r["min"], r.q1, r.median, r.q3, r["max"]] for r in quality.box_plot(df, ["a", "b"], 10, 100).collect()}
    ids = np.arange(5000)
    assert got["a"] == pytest.approx(np.quantile(ids % 977, [0, 0.25, 0.5, 0.75, 1]).tolist())
    assert got["b"] == pytest.approx(np.quantile(np.sqrt(ids), [0, 0.25, 0.5, 0.75, 1]).tolist())
    assert ["metric", "value"] not in joined


def test_box_plot_of_infinite_and_missing_numbers(spark):
    values = [float("nan")] * 300 + [float("inf")] * 200 + [-float("inf")] * 150 + [float(k % 90) for k in range(350)]
    random.Random(8).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(3)
    rows = [quality.box_plot(df, ["a"], enough, 100).first() for enough in (5, 100_000)]
    assert str(rows[0]) == str(rows[1])
    # 999 / 4 lies between the ranks 249 and 250; NaN is the largest
    finite = sorted(v for v in values if v == v)
    assert rows[0].q1 == pytest.approx(finite[249] + (finite[250] - finite[249]) * 0.75) and np.isnan(rows[0]["max"])
