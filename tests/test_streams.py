import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterfold import schemas
from meterfold.operators import outlier, rollup
from meterfold.sources import files, keyed
from meterfold.streaming import ingest, state, windows

T = dt.datetime
READING = "region_name string, macrozone_name string, zone_name string, sensor_id string, time timestamp, type string, value double"


def reading(sensor, minute, value, zone="z", macro="m", second=0):
    return ("r", macro, zone, sensor, T(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second), "t", float(value))


@pytest.fixture
def feed(spark, tmp_path):
    """Drop files one by one; each becomes a micro-batch."""

    class Feed:
        path = str(tmp_path / "in")

        def drop(self, *rows, schema=READING):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self, schema=READING):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.path)

        def run(self, query, name="out"):
            out = str(tmp_path / name)
            ingest.append_files(query, out, f"{out}-checkpoint").awaitTermination()
            return spark.read.schema(query.schema).parquet(out)

    return Feed()


@pytest.fixture
def filtered(spark, feed, tmp_path):
    """Drains the stream through the filter; a name has its own checkpoint and histories."""

    def run(name="kept", stream=None, **how):
        out = str(tmp_path / name)
        save = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        state.filter_outliers(stream or feed.stream(), save, f"{out}-histories", f"{out}-checkpoint", **how).awaitTermination()
        return spark.read.schema(READING).parquet(out).select(*[c.split()[0] for c in READING.split(", ")])

    return run


@pytest.mark.parametrize("lots", [1, 3, 20])
def test_filter_keeps_its_history_between_batches(spark, feed, filtered, lots):
    rows = [reading(f"s{int(i % 10 == 0)}", i, 500 if i % 17 == 16 else 50 + i % 7) for i in range(240)]
    step = -(-len(rows) // lots)
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        random.Random(i).shuffle(part)
        feed.drop(*part)
        if lots == 3:
            filtered(size=20, forget_after=None)  # each run goes on from the checkpoint
    got = filtered(size=20, forget_after=None)
    want = outlier.accepted(spark.createDataFrame(rows, READING), size=20)
    assert sorted(got.collect()) == sorted(want.collect())
    assert 0 < got.count() < 240


def test_a_hot_sensor_spreads_over_tasks_and_arrow_batches(spark):
    rows = [reading(f"s{int(i % 50 == 0)}", i, 3 * i + (900 if i % 17 == 16 else i % 7)) for i in range(600)]
    random.Random(1).shuffle(rows)
    batch = spark.createDataFrame(rows, READING).repartition(3)
    none = spark.createDataFrame([], state.HISTORY)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        kept, after, _ = state.filter_batch(batch, none, (20, 5, 3.0), ["time", "value"], None, schemas.SENSOR)
        tasks = kept.filter("sensor_id = 's0'").select(F.spark_partition_id()).distinct().count()
        got, histories = sorted(kept.collect()), {r._sensor[-2:]: r for r in after.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = outlier.accepted(spark.createDataFrame(rows, READING), size=20)
    assert got == sorted(want.collect()) and tasks > 1
    last = {s: [r.value for r in sorted(want.collect(), key=lambda r: r.time) if r.sensor_id == s][-20:] for s in ("s0", "s1")}
    assert {s: r._seed for s, r in histories.items()} == last


def test_a_replayed_epoch_starts_from_the_same_histories(spark, feed, filtered, tmp_path):
    for lot in range(5):
        feed.drop(*[reading("a", 10 * lot + i, 400 if i == 7 else 10 + i % 3) for i in range(10)], reading(f"other{lot}", lot, lot))
    want = sorted(filtered(size=9).collect())
    path = str(tmp_path / "kept-histories")
    known = state.Histories(spark, path)
    assert len(files.matching(spark, f"{path}/epoch=*/bucket=*")) <= 5 + 2
    rows = lambda df: sorted((r._sensor, tuple(r._seed), r._last) for r in df.collect())
    newest = rows(known.before(9))
    batch = spark.createDataFrame([reading("a", 40 + i, 400 if i == 7 else 10 + i % 3) for i in range(10)] + [reading("other4", 4, 4)], READING)
    before = known.of(batch.select(outlier.sensor_name(schemas.SENSOR).alias("_sensor")), 4)
    assert {r._sensor[-1] for r in before.collect()} <= {"a", *"0123"} and before.count() < 5  # its buckets only
    kept, after, _ = state.filter_batch(batch, before, (9, 5, 3.0), ["time", "value"], 300, schemas.SENSOR)
    assert set(kept.collect()) <= set(want)
    known.write(after, before, 4)
    assert rows(known.before(9)) == newest


def test_windows_emit_once_and_leave_out_late_readings(spark, feed):
    feed.drop(reading("s", 1, 10), reading("s", 2, 20))
    feed.drop(reading("s", 40, 1))  # moves the watermark past the first window
    feed.drop(reading("s", 42, 6))  # the batch that emits it
    feed.drop(reading("s", 3, 1000), reading("s", 41, 3))  # 00:03 is late now
    feed.drop(reading("s", 90, 5))
    zones = feed.run(windows.zone_stats(feed.stream()))
    got = {r.time: (r.avg_sum, r.avg_count) for r in zones.collect()}
    assert got == {T(2024, 1, 1, 0, 15): (30.0, 2), T(2024, 1, 1, 0, 45): (10.0, 3)}


def test_stream_windows_equal_batch_on_time(spark, feed):
    rows = [reading(f"s{i % 3}", i, i % 11, zone=f"z{i % 2}", macro=f"m{i % 3}") for i in range(0, 300, 2)]
    for i in range(0, 150, 50):
        feed.drop(*rows[i : i + 50])
    batch = spark.createDataFrame(rows, READING).withColumn("time", F.col("time").cast("timestamp_ntz"))
    zones = rollup.zone_stats(batch)
    macro = rollup.macrozone_stats(zones)
    newest = T(2024, 1, 1) + dt.timedelta(minutes=298)
    for name, stream, want, closed in (
        ("zone", windows.zone_stats(feed.stream()), zones, newest - dt.timedelta(minutes=10)),
        ("macro", windows.macrozone_stats(feed.stream()), macro, newest - dt.timedelta(minutes=10)),
        ("region", windows.region_stats(feed.stream()), rollup.region_stats(macro), newest - dt.timedelta(minutes=5)),
    ):
        got = feed.run(stream, name).withColumn("time", F.col("time").cast("timestamp_ntz"))
        want = want.filter(F.col("time") <= F.lit(closed).cast("timestamp_ntz")).select(*got.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name


def test_health_changes(spark, feed):
    feed.drop(reading("a", 0, 1), reading("b", 0, 1))
    feed.drop(reading("b", 8, 1))
    feed.drop(reading("b", 9, 1))
    feed.drop(reading("a", 10, 1), reading("b", 10, 1))
    feed.drop(reading("b", 800, 1))
    feed.drop(reading("b", 801, 1))
    got = [(r.sensor_id, r.status, r.last_seen) for r in feed.run(state.health_changes(feed.stream())).collect()]
    a = [(s, t) for k, s, t in sorted(got, key=lambda r: r[2]) if k == "a"]
    assert ("healthy", T(2024, 1, 1)) in a and ("unhealthy", T(2024, 1, 1)) in a
    assert ("healthy", T(2024, 1, 1, 0, 10)) in a and ("unhealthy", T(2024, 1, 1, 0, 10)) in a
    assert ("removed", T(2024, 1, 1, 0, 10)) in a and len(a) == 5


def test_first_registration_and_deduplication(spark, feed):
    feed.drop(reading("a", 0, 1), reading("a", 0, 1), reading("b", 0, 1))
    feed.drop(reading("a", 0, 1), reading("b", 1, 1))
    first = feed.run(state.first_registrations(feed.stream()), "first")
    assert sorted(r.sensor_id for r in first.collect()) == ["a", "b"]
    keys = schemas.READING_KEY
    assert feed.run(ingest.deduplicated(feed.stream(), keys), "dedup").count() == 3


def test_readings_ingest_survives_a_replay(spark, feed, tmp_path):
    facts = str(tmp_path / "facts")
    sensors = keyed.KeyedTable(str(tmp_path / "sensors"), schemas.SENSOR_KEY, buckets=4)
    start = [("a", "r", "m", "z", T(2024, 1, 1), None), ("b", "r", "m", "z", T(2024, 1, 1), T(2025, 1, 1))]
    keyed.create(spark.createDataFrame(start, "id string, region_name string, macrozone_name string, zone_name string, registration_time timestamp_ntz, last_seen timestamp_ntz"), sensors)
    for i in range(6):
        feed.drop(reading("a", i, i), reading("a", i, i), reading("b", i, i), reading("new", i, i))
    stream = lambda: feed.stream().withColumn("time", F.col("time").cast("timestamp_ntz"))
    for attempt in range(2):  # the second checkpoint replays everything
        ingest.readings(stream(), facts, sensors, str(tmp_path / f"cp{attempt}"), writer=f"readings-{attempt}", compact_every=4).awaitTermination()
        now = keyed.read(spark, sensors)
        assert {r.id: r.last_seen for r in now.collect()} == {"a": T(2024, 1, 1, 0, 5), "b": T(2025, 1, 1)}
    assert spark.read.parquet(facts).count() == 18


def test_late_facts_are_kept(spark, feed, tmp_path):
    path = str(tmp_path / "facts")
    feed.drop(reading("a", 500, 1))
    feed.drop(reading("a", 1, 1))
    ingest.facts(feed.stream(), path, schemas.READING_KEY, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(path).count() == 2


def test_silence_forgets_the_history(feed, filtered):
    """After six minutes of silence a strange value starts a history of its own."""
    for minute in range(12):
        feed.drop(reading("a", minute, 10 + minute % 2))
    feed.drop(reading("a", 13, 500))
    assert {r.time.minute for r in filtered("never", forget_after=None).collect()} == set(range(12))
    feed.drop(reading("a", 30, 700), reading("a", 31, 10))
    feed.drop(reading("a", 40, 900), reading("a", 41, 900), reading("a", 50, -5))
    got = {r.time.minute for r in filtered("again").collect()}
    assert got == {*range(12), 30, 31, 40, 41, 50}
