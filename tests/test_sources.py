import datetime as dt

import pytest

from pyspark.sql import functions as F

from meterfold import schemas, session
from meterfold.operators import filters, rollup
from meterfold.plans import jobs
from meterfold.sources import messages, tables
from meterfold.sources.outbox import Outbox

T = dt.datetime


def payloads(spark, *values):
    return spark.createDataFrame([(None, v) for v in values], "key string, value string")


def test_decode_drops_garbage_and_fills_missing(spark):
    rows = payloads(
        spark,
        '{"macrozone":"m","zone":"z","sensor_id":"s","timestamp":5,"type":"t","data":1.5,"extra":[1]}',
        '{"sensor_id":"only"}', '{"sensor_id":"cut', "", None, "[1,2]", '{"sensor_id":"s","data":"word"}',
    )
    got = sorted(tuple(r) for r in messages.readings(rows).collect())
    assert got == [("", "", "only", 0, "", 0.0), ("m", "z", "s", 5, "t", 1.5)]


def test_control_messages_need_a_timestamp(spark):
    rows = payloads(spark, "{}", '{"timestamp":-1,"hub_id":"h"}', '{"timestamp":7,"hub_id":"h"}')
    assert [r.hub_id for r in messages.heartbeats(rows).collect()] == ["h"]
    assert [r.hub_id for r in messages.configurations(rows).collect()] == ["h"]


def test_heartbeat_key(spark):
    df = spark.createDataFrame([(1, "m", "", "h")], schemas.HEARTBEAT)
    assert messages.heartbeat_messages(df).first().key == "m--h"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pm10;timestamp;x\n1.5;2024-01-01T10:00:00;a\nn/a;2024-01-01T11:00:00;b\n2;never;c\n;2024-01-01T12:00:00;d\n3e1;2024-01-01T13:00:00;e\n")
    got = sorted(tuple(r) for r in tables.historical_csv(spark, str(tmp_path), "pm10").collect())
    assert got == [(T(2024, 1, 1, 10), 1.5), (T(2024, 1, 1, 13), 30.0)]


def test_append_absent(spark, tmp_path):
    path = str(tmp_path / "facts")
    make = lambda *rows: spark.createDataFrame(list(rows), "time timestamp_ntz, id string, v int, n int")
    tables.append_absent(make((T(2024, 1, 1), "a", 2, 2), (T(2024, 1, 1), "a", 1, 1)), path, ["time", "id"], arrival="n")
    tables.append_absent(make((T(2024, 1, 1), "a", 9, 3), (T(2024, 1, 2), "a", 3, 4)), path, ["time", "id"])
    tables.append_absent(make((T(2024, 1, 2), "a", 3, 4)), path, ["time", "id"])
    tables.append_absent(make((T(2024, 1, 2), "a", 3, 4)).limit(0), path, ["time", "id"])
    got = sorted((r.time, r.id, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(T(2024, 1, 1), "a", 1), (T(2024, 1, 2), "a", 3)]


def test_append_absent_reads_the_hours_it_touches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 30)"
    rows = spark.range(4000).selectExpr(f"{at} AS time", "cast(id % 7 AS string) AS id", "cast(id AS int) AS v")
    tables.append_absent(rows, path, ["time", "id"], index_hours=6)
    asked = []
    hashes, whole = tables.stored_hashes, tables.stored_keys

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def watched_hashes(spark, index, folders, hours):
        found = hashes(spark, index, folders, hours)
        asked.append((sorted(f.split("_keys/")[1] for f in folders), plan(found.select("hash"))))
        return found

    def watched_keys(spark, path, days, *rest):
        found = whole(spark, path, days, *rest)
        asked.append((days, plan(found)))
        return found

    monkeypatch.setattr(tables, "stored_hashes", watched_hashes)
    monkeypatch.setattr(tables, "stored_keys", watched_keys)
    one_hour = rows.filter("time >= timestamp_ntz'2024-01-02 03:10:00' AND time < timestamp_ntz'2024-01-02 03:50:00'")
    later = one_hour.withColumn("time", F.expr("time + make_dt_interval(0, 0, 0, 1)"))
    tables.append_absent(later, path, ["time", "id"], index_hours=6)
    assert [f for f, _ in asked] == [["day=2024-01-02/slot=0"]]  # nothing is known: no rows are read
    assert "GreaterThanOrEqual(hour,3)" in asked[0][1] and "ReadSchema: struct<hour:int,hash:bigint>" in asked[0][1]
    tables.append_absent(one_hour, path, ["time", "id"], index_hours=6)
    assert [f for f, _ in asked[1:]] == [["day=2024-01-02/slot=0"], ["2024-01-02"]]
    assert "GreaterThanOrEqual(time,2024-01-02T03:10" in asked[2][1] and "struct<time:timestamp_ntz,id:string>" in asked[2][1]
    assert spark.read.parquet(path).count() == 4000 + 80


def test_append_absent_after_failures_and_without_an_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    make = lambda *rows: spark.createDataFrame(list(rows), "time timestamp_ntz, id string, v int")
    first, second = (T(2024, 1, 1), "a", 1), (T(2024, 1, 1, 5), None, 2)
    tables.append_absent(make(first), path, ["time", "id"])
    write = tables._write_index
    monkeypatch.setattr(tables, "_write_index", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # rows are written, their keys are not
        tables.append_absent(make(first, second), path, ["time", "id"])
    monkeypatch.setattr(tables, "_write_index", write)
    tables.append_absent(make(first, second), path, ["time", "id"])
    assert spark.read.parquet(path).count() == 2
    older = str(tmp_path / "older")
    make(first, second).withColumn("day", F.to_date("time")).write.partitionBy("day").parquet(older)
    tables.append_absent(make(first, second, (T(2024, 1, 2), "a", 1), (None, "a", 1)), older, ["time", "id"])
    assert spark.read.parquet(older).count() == 3


def test_arrival_decides_within_and_between_batches(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [(T(2024, 1, 1), "a", v, offset) for v, offset in ((1, 30), (2, 10), (3, 20))]
    make = lambda rows: spark.createDataFrame(rows, "time timestamp_ntz, id string, v int, offset long")
    tables.append_absent(make(rows), path, ["time", "id"], arrival="offset")
    tables.append_absent(make([(T(2024, 1, 1), "a", 0, 40)]), path, ["time", "id"], arrival="offset")
    assert [r.v for r in spark.read.parquet(path).collect()] == [2]


def stats(spark, *rows):
    return spark.createDataFrame(
        [("r", "m", "t", t, v, v, v, v, 1) for t, v in rows],
        "region_name string, macrozone_name string, type string, time timestamp_ntz, min_value double, max_value double, avg_value double, avg_sum double, avg_count long",
    )


def totals(df, unit="day"):
    return {r[unit]: r.total_sum for r in df.collect()}


def test_refresh_missing_computes_only_missing_buckets(spark, tmp_path):
    path = str(tmp_path / "daily")
    days = [T(2024, 1, d) for d in (1, 2, 3)]
    jobs.refresh_missing(stats(spark, (days[0], 1.0), (days[1], 2.0)), path, "day", rollup.MACROZONE_KEYS, days[:2])
    changed = stats(spark, (days[0], 10.0), (days[1], 20.0), (days[2], 30.0))
    assert jobs.missing_buckets(spark, path, "day", days) == [days[2]]
    out = jobs.refresh_missing(changed, path, "day", rollup.MACROZONE_KEYS, days)
    assert totals(out) == {days[0]: 1.0, days[1]: 2.0, days[2]: 30.0}
    out = jobs.scheduled_refresh(changed, path, "day", rollup.MACROZONE_KEYS, T(2024, 1, 3, 5), back=1)
    assert totals(out) == {days[0]: 1.0, days[1]: 20.0, days[2]: 30.0}


def test_scheduled_refresh_by_month(spark, tmp_path):
    path = str(tmp_path / "monthly")
    rows = stats(spark, (T(2023, 12, 31), 1.0), (T(2024, 1, 31), 2.0), (T(2024, 2, 1), 4.0), (T(2024, 3, 9), 8.0))
    out = jobs.scheduled_refresh(rows, path, "month", rollup.MACROZONE_KEYS, T(2024, 3, 10))
    assert totals(out, "month") == {T(2024, 1, 1): 2.0, T(2024, 2, 1): 4.0, T(2024, 3, 1): 8.0}


def test_read_through(spark, tmp_path):
    path, asked, now = str(tmp_path / "results"), [], T(2024, 2, 1)
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]

    def compute(missing):
        asked.append(list(missing))
        rows = [(d, "m", float(d.day)) for d in missing if d.day != 2]  # the second day has no rows
        return spark.createDataFrame(rows, "day date, macrozone_name string, v double")

    def read(days, radius=5):
        return sorted(r.day for r in jobs.read_through(spark, path, days, {"radius": radius}, compute, now).collect())

    assert read(days[1:2]) == []
    assert read(days[:2]) == days[:1]
    assert read(days) == read(days) == [days[0], days[2]]
    assert read(days[:1], 6) == days[:1]
    assert [a for a in asked if a != days[1:2]] == [days[:1], [days[2]], days[:1]]
    asked.clear()
    assert read(days) == [days[0], days[2]] and asked == []  # the empty day too is known
    assert spark.read.parquet(path).filter(F.col("radius") == 5).count() == 2


def test_read_through_refuses_young_days_and_survives_a_failure(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "results"), dt.date(2024, 1, 5)
    calls = []

    def compute(missing):
        calls.append(missing)
        return spark.createDataFrame([(d, 1.0) for d in missing], "day date, v double")

    for now in (T(2024, 1, 5, 1), T(2024, 1, 6, 23, 59)):
        with pytest.raises(ValueError, match="2024-01-05"):
            jobs.read_through(spark, path, [dt.date(2024, 1, 1), day], {"span": 3}, compute, now)
    assert calls == [] and tables.read_or_none(spark, path) is None
    save = tables.save_analysis

    def fails(*args):
        save(*args)
        raise OSError("lost before the ledger")

    monkeypatch.setattr(tables, "save_analysis", fails)
    with pytest.raises(OSError):
        jobs.read_through(spark, path, [day], {"span": 3}, compute, T(2024, 1, 7))
    monkeypatch.setattr(tables, "save_analysis", save)
    assert jobs.read_through(spark, path, [day], {"span": 3}, compute, T(2024, 1, 7)).count() == 1
    assert jobs.read_through(spark, path, [day], {"span": 3}, compute, T(2024, 1, 7)).count() == 1 and len(calls) == 2


def test_ranges_of_time_prune_days(spark, tmp_path):
    path = str(tmp_path / "byday")
    rows = spark.range(10).selectExpr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id AS int)) AS time", "id")
    rows.withColumn("day", F.to_date("time")).write.partitionBy("day").parquet(path)
    df = spark.read.parquet(path)
    for found, want in (
        (filters.within(df, T(2024, 1, 3), T(2024, 1, 5)), [2, 3]), (filters.within_days(df, dt.date(2024, 1, 9), dt.date(2024, 1, 20)), [8, 9]),
        (filters.within_minute(df, T(2024, 1, 6, 12, 0, 30)), [5]),
    ):
        assert sorted(r.id for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "day" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert filters.within(df.drop("day"), T(2024, 1, 3), T(2024, 1, 5)).count() == 2


def test_newest_rows_of_a_key_read_few_days(spark, tmp_path):
    path = str(tmp_path / "byday")
    rows = spark.range(3000).selectExpr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id div 3 AS int)) AS time", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 300 = 1 THEN 'rare' ELSE 'b' END AS id", "cast(id AS int) AS v")
    rows.withColumn("day", F.to_date("time")).repartition(2).write.partitionBy("day").parquet(path)
    days = lambda df: len({f.split("day=")[1][:10] for f in df.inputFiles()})
    few = tables.newest(spark, path, 5, id="a")
    assert [r.v for r in few.collect()] == [2997 - 3 * k for k in range(5)] and days(few) <= 8
    rare = tables.newest(spark, path, 2, id="rare")
    assert [r.v for r in rare.collect()] == [2701, 2401] and days(rare) <= 256
    assert tables.newest(spark, path, 5, id="nobody").collect() == []
    limited = tables.newest(spark, path, 5, id="rare", most=10)
    assert limited.collect() == [] and days(limited) == 10


def test_an_outbox_keeps_no_message_twice_and_misses_none(spark, tmp_path):
    box, topic = Outbox(str(tmp_path / "box"), ["time", "id"]), str(tmp_path / "topic")
    make = lambda *rows: spark.createDataFrame(list(rows), "time timestamp_ntz, id string, v int")
    sent = lambda: sorted(str(r.id) for r in spark.read.json(topic).collect())
    box.add(make((T(2024, 1, 1), "a", 1), (T(2024, 1, 1), "b", 2)))
    box.add(make((T(2024, 1, 1), "old", 0)).withColumn("status", F.lit("sent")))
    calls = []

    def breaks_off(rows, number):
        calls.append(number)
        rows.limit(1).write.json(f"{topic}/batch={number}/_part{len(calls)}")
        raise OSError("down")

    with pytest.raises(OSError):
        box.dispatch(spark, breaks_off, attempts=2)
    assert calls == [0, 0]
    box.add(make((T(2024, 1, 2), "c", 3), (T(2024, 1, 2), None, 3), (T(2024, 1, 1), "a", 9)))  # two more, and one repeated
    assert {r.id: r.status for r in box.rows(spark).collect()} == {"a": "pending", "b": "pending", "c": "pending", None: "pending", "old": "sent"}
    once = lambda rows, number: messages.publish_once(rows, "json", topic, number)
    assert box.dispatch(spark, once) == 0 and sent() == ["a", "b"]  # the frozen batch, not the newcomer
    once(make((T(2024, 1, 1), "z", 0)), 0)
    assert sent() == ["a", "b"]  # the sink knows the number
    assert box.dispatch(spark, once) == 1 and box.dispatch(spark, once) is None
    assert sent() == ["None", "a", "b", "c"] and {r.status for r in box.rows(spark).collect()} == {"sent"}
    box.add(make((T(2024, 1, 3), "d", 4)))
    assert box.purge(spark, T(2024, 1, 3, 12)) == ["2024-01-01", "2024-01-02"]
    box.add(make((T(2024, 1, 1), "a", 9)))  # comes late once more
    assert {r.id: r.status for r in box.rows(spark).collect()} == {"a": "sent", "d": "pending"}


def test_scan_prunes_days(spark, tmp_path):
    path = str(tmp_path / "byday")
    rows = spark.range(10).selectExpr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(id AS int)) AS time", "id")
    tables.append_absent(rows, path, ["time", "id"])
    got = tables.scan(spark, path, start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 4, 13))
    assert sorted(r.id for r in got.collect()) == [2, 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "day" in filters and "2024-01-03" in filters and "2024-01-04" in filters


def test_conflicting_rows_of_a_key_are_decided_by_the_row(spark):
    rows = [("k", v) for v in (5, 3, 9)]
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        df = spark.createDataFrame(order, "id string, v int").repartition(3)
        assert [tuple(r) for r in tables.first_per_key(df, ["id"]).collect()] == [("k", 3)]
    late = spark.createDataFrame([("k", 3, 2), ("k", 9, 1)], "id string, v int, at int")
    assert [r.v for r in tables.first_per_key(late, ["id"], "at").collect()] == [9]


def test_region_by_name_or_by_macrozone(spark):
    rows = spark.createDataFrame([("m1",), ("m2",), ("twice",), ("unknown",)], "macrozone_name string")
    places = spark.createDataFrame([("EU", "m1"), ("US", "m2"), ("EU", "twice"), ("US", "twice"), ("EU", "m1")], "region_name string, name string")
    assert {r.region_name for r in messages.with_region(rows, "EU").collect()} == {"EU"}
    found = sorted((r.macrozone_name, r.region_name) for r in messages.with_region(rows, places).collect())
    assert found == [("m1", "EU"), ("m2", "US"), ("twice", None), ("unknown", None)]


def test_refresh_drops_buckets_that_came_out_empty(spark, tmp_path):
    path = str(tmp_path / "daily")
    make = lambda *days: spark.createDataFrame(
        [("r", "m", "t", T(2024, 1, d, 5), 1.0, 1.0, 1.0, 1.0, 1) for d in days],
        "region_name string, macrozone_name string, type string, time timestamp_ntz, min_value double, max_value double, avg_value double, avg_sum double, avg_count long",
    )
    days = lambda df: sorted(r.day.day for r in df.collect())
    assert days(jobs.scheduled_refresh(make(1, 2, 3), path, "day", rollup.MACROZONE_KEYS, T(2024, 1, 3, 12))) == [1, 2, 3]
    assert days(jobs.scheduled_refresh(make(1, 3, 4), path, "day", rollup.MACROZONE_KEYS, T(2024, 1, 4, 12))) == [1, 3, 4]


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    path = session.scratch_path(spark, "kept-for-a-while")
    spark.range(3).write.parquet(path)
    assert tables.read_or_none(spark, path).count() == 3
    session._scratch[:] = [path]  # other tests may still read theirs
    assert session.drop_scratch(spark) == 1 and session.drop_scratch(spark) == 0
    assert tables.read_or_none(spark, path) is None
