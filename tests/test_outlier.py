import math
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterfold.operators.outlier import flag_outliers, judge


def naive(values, size, min_samples, factor):
    kept, flags = [], []
    for x in values:
        ok = True
        if len(kept) >= min_samples:
            s = q = 0.0
            for v in reversed(kept):
                s += v
                q += v * v
            mean = s / len(kept)
            sd = max(q / len(kept) - mean * mean, 0.0) ** 0.5
            ok = not (x < mean - factor * sd or x > mean + factor * sd)
        flags.append(ok)
        if ok:
            kept = [*kept, x][-size:]
    return flags


values = st.lists(st.one_of(st.integers(0, 40).map(lambda i: i / 4), st.floats(-1e6, 1e6)), max_size=120)


@settings(max_examples=150, deadline=None)
@given(values, st.integers(5, 20), st.integers(0, 120))
def test_judge_is_the_plain_rule_and_splits_anywhere(xs, size, cut):
    want = naive(xs, size, 5, 3.0)
    kept = deque()
    first = judge(xs[:cut], kept, size, 5, 3.0)
    second = judge(xs[cut:], kept, size, 5, 3.0)
    assert [*first, *second] == want


def test_constant_history_rejects_any_other_value():
    flags = judge([2.0] * 6 + [2.5, 2.0], deque(), 100, 5, 3.0)
    assert flags.tolist() == [True] * 6 + [False, True]


def test_fewer_than_min_samples_accepts_all():
    assert judge([1, 1000, -5, 7], deque(), 100, 5, 3.0).all()


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_hot_sensor_is_split_exactly(spark, partitions):
    rng = random.Random(7)
    rows = []
    for i in range(3000):  # one sensor holds most rows
        spike = 20.0 if rng.random() < 0.1 else 1.0
        rows.append(("hot", i, round(50 + 10 * math.sin(i / 50) + spike * rng.gauss(0, 1), 2)))
    for s in range(8):
        rows += [(f"s{s}", i, float(rng.randint(0, 9))) for i in range(s * 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sensor_id string, time long, value double")
    got = flag_outliers(df, size=30, keys=["sensor_id"], partitions=partitions).collect()
    for sensor in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == sensor)
        want = naive([v for _, v in mine], 30, 5, 3.0)
        have = [r.accepted for r in sorted((r for r in got if r.sensor_id == sensor), key=lambda r: r.time)]
        assert have == want, sensor
    assert len(got) == len(rows)


def test_paths_agree_and_nulls_are_dropped(spark):
    df = spark.range(500).select(
        F.lit("a").alias("sensor_id"), F.col("id").alias("time"),
        F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") * 7919 % 101).cast("double")).alias("value"),
    )
    one = {tuple(r) for r in flag_outliers(df, keys=["sensor_id"], split=False).collect()}
    two = {tuple(r) for r in flag_outliers(df, keys=["sensor_id"]).collect()}
    assert one == two and len(one) == 490


def test_equal_ids_of_different_places_have_histories_of_their_own(spark):
    rows = [("EU", "m", "z1", "s1", i, 10.0 + i % 3) for i in range(30)] + [("US", "m", "z1", "s1", 40, 500.0), ("EU", "m", "z2", "s1", 41, -500.0)]
    df = spark.createDataFrame(rows, "region_name string, macrozone_name string, zone_name string, sensor_id string, time long, value double")
    for split in (True, False):
        assert all(r.accepted for r in flag_outliers(df, split=split).collect())
    assert sum(not r.accepted for r in flag_outliers(df, keys=["sensor_id"]).collect()) == 2
