import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from meterfold.operators import devices
from meterfold.sources import files, keyed, tables

KEYS = ["id", "zone_name"]
MESSAGE = "id string, zone_name string, type string, time timestamp_ntz"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def table(tmp_path):
    return keyed.KeyedTable(str(tmp_path / "devices"), KEYS, ["type"], buckets=8)


def messages(spark, *rows):
    return spark.createDataFrame([(i, "z", a, at(m)) for i, a, m in rows], MESSAGE)


def found(spark, table, **key):
    return {r.id: (r.type, r.registration_time, r.last_seen) for r in keyed.read(spark, table, **key).collect()}


def start(spark, table, n=200):
    rows = spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("id"), F.lit("z").alias("zone_name"), F.lit("old").alias("type"),
        F.lit(at(0)).alias("registration_time"), F.lit(at(0)).alias("last_seen"),
    )
    keyed.create(rows, table)
    return rows


def test_log_and_base_agree_with_the_batch_operators(spark, table):
    now = start(spark, table)
    batches = [
        messages(spark, ("d1", "x", 5), ("d1", "y", 3), ("n1", "late", 9), ("n1", "first", 8)),
        messages(spark, ("n1", "other", 2), ("n2", "b", 7), ("n2", "a", 7)),
        messages(spark, ("d7", "x", 1)),
    ]
    for epoch, batch in enumerate(batches):
        keyed.register(batch, table, "configurations", epoch)
        now = devices.upsert(now, batch, KEYS, ["type"])
        if epoch == 1:
            assert keyed.compact(spark, table)
    seen = messages(spark, ("d7", None, 30), ("d7", None, 20), ("nobody", None, 99))
    keyed.touch(seen, table, "heartbeats", 0)
    now = devices.advance_last_seen(now, seen, KEYS)
    want = {r.id: (r.type, r.registration_time, r.last_seen) for r in now.collect()}
    assert found(spark, table) == want
    assert want["n1"] == ("first", at(8), at(9)) and want["d7"] == ("old", at(0), at(30)) and "nobody" not in want
    assert keyed.compact(spark, table) and not keyed.compact(spark, table)
    assert found(spark, table) == want


def test_an_epoch_writes_its_changes_and_compaction_its_buckets(spark, table):
    start(spark, table, 5000)
    whole = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(table.path + "/base") for f in fs)
    keyed.touch(messages(spark, ("d3", None, 4)), table, "heartbeats", 0)
    written = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(table.path + "/log/writer=heartbeats") for f in fs)
    assert written < whole / 10
    before = set(files.matching(spark, f"{table.path}/base/generation=*/bucket=*"))
    keyed.compact(spark, table)
    new = set(files.matching(spark, f"{table.path}/base/generation=*/bucket=*")) - before
    assert len(new) == 1
    assert found(spark, table, id="d3", zone_name="z") == {"d3": ("old", at(0), at(4))}
    plan = keyed.read(spark, table, id="d3", zone_name="z")._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan


def test_replays_and_failures(spark, table, monkeypatch):
    start(spark, table)
    batch = messages(spark, ("n1", "a", 5), ("d1", "x", 6))
    keyed.register(batch, table, "configurations", 0)
    keyed.register(batch, table, "configurations", 0)  # replayed before compaction
    want = found(spark, table)
    by_partition = tables.by_partition
    monkeypatch.setattr(keyed, "_clean", lambda *a: None)
    create = spark.createDataFrame

    def fails(*args, **kw):
        raise OSError("lost between base and manifest")

    monkeypatch.setattr(type(spark), "createDataFrame", fails)
    with pytest.raises(OSError):
        keyed.compact(spark, table)
    monkeypatch.undo()
    assert tables.by_partition is by_partition and spark.createDataFrame == create
    assert found(spark, table) == want
    assert keyed.compact(spark, table)
    keyed.register(batch, table, "configurations", 0)  # replayed after compaction
    assert found(spark, table) == want
    keyed.register(messages(spark, ("n1", "b", 1)), table, "configurations", 1)
    keyed.compact(spark, table)
    keyed.touch(messages(spark, ("n1", None, 50)), table, "heartbeats", 0)
    keyed.compact(spark, table)
    assert found(spark, table) == want | {"n1": ("a", at(5), at(50))}
    left = files.matching(spark, f"{table.path}/log/writer=configurations/epoch=*")
    assert left == []


def test_empty_batches_and_tables(spark, table):
    assert keyed.read(spark, table).collect() == []
    assert not keyed.compact(spark, table)
    keyed.touch(messages(spark), table, "heartbeats", 0)
    keyed.register(messages(spark, (None, "a", 1)), table, "configurations", 0)
    assert [tuple(r) for r in keyed.read(spark, table).collect()] == [(None, "z", "a", at(1), at(1))]
    keyed.compact(spark, table)
    assert [tuple(r) for r in keyed.read(spark, table).collect()] == [(None, "z", "a", at(1), at(1))]
