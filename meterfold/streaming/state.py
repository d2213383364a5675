"""Per-sensor stateful stream operators."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from meterfold import params, schemas
from meterfold.operators import outlier
from meterfold.session import checkpointed
from meterfold.sources import files, tables


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Histories:
    """Accepted values of every sensor, by version: what a sensor had before a micro-batch.

    ``path/bucket=b/epoch=n`` holds the sensors of a bucket as they are after micro-batch n. An
    epoch reads each bucket's newest version before its own and rewrites only the buckets its
    sensors fall into, so a replayed epoch starts from the same histories and replaces its own
    version. Versions that no replay can need are removed.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _versions(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for p in files.matching(self.spark, f"{self.path}/epoch=*/bucket=*"):
            found.setdefault(int(files.value(p, "bucket")), []).append(int(files.value(p, "epoch")))
        return {b: sorted(v) for b, v in found.items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("_sensor"), F.lit(self.buckets)).cast("int")

    def of(self, sensors: DataFrame, epoch: int) -> DataFrame:
        """Histories before an epoch, of the buckets that hold the sensors (``_sensor``) only."""
        touched = {r.bucket for r in sensors.select(self.bucket().alias("bucket")).distinct().collect()}  # at most ``buckets``
        return self.before(epoch, touched)

    def before(self, epoch: int, only: set[int] | None = None) -> DataFrame:
        done = {int(files.value(p, "epoch")) for p in files.matching(self.spark, f"{self.path}/epoch=*/_SUCCESS")}
        newest = {b: max((e for e in v if e < epoch and e in done), default=-1) for b, v in self._versions().items()}
        folders = [f"{self.path}/epoch={e}/bucket={b}" for b, e in sorted(newest.items()) if e >= 0 and (only is None or b in only)]
        if not folders:
            return self.spark.createDataFrame([], HISTORY + ", bucket int")
        return self.spark.read.schema(HISTORY + ", bucket int").option("basePath", self.path).parquet(*folders).select("_sensor", "_seed", "_last", "bucket")

    def write(self, changed: DataFrame, before: DataFrame, epoch: int) -> None:
        """The sensors of an epoch, and those beside them in their buckets (``before`` from ``of``)."""
        changed = changed.withColumn("bucket", self.bucket())
        kept = before.join(changed.select("_sensor"), "_sensor", "left_anti")
        rows = kept.select(*changed.columns).unionByName(changed)
        tables.by_partition(rows, ["bucket"], ["_sensor"]).mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        for b, versions in self._versions().items():
            for old in [v for v in versions if v <= epoch][: -self.KEPT]:
                files.delete(self.spark, f"{self.path}/epoch={old}/bucket={b}")


HISTORY = "_sensor string, _seed array<double>, _last long"
_STATE = ["_sensor", "_seed", "_last", "_pid"]


def _judged(entries: dict, rule: tuple, forget: int | None, columns: list[str]):
    """mapInPandas function: accepted readings, and one row with its history for each sensor that ends in the partition."""

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """With every column of the result; those it lacks are null."""
        missing = [c for c in [*columns, *_STATE] if c not in pdf]
        return pdf.assign(**{c: pd.Series([None] * len(pdf), dtype=object, index=pdf.index) for c in missing})[[*columns, *_STATE]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        history = outlier.History(rule, forget, entries.get(pid, ((), None)))

        def state() -> dict:
            return {"_sensor": history.current, "_seed": list(history.kept), "_last": history.last, "_pid": pid}

        for pdf in batches:
            if not len(pdf):
                continue
            ended, flags, names = [], [], pdf["_sensor"].to_numpy()
            taken = history.take(pdf)
            for at, _ in outlier.runs(names):
                if history.current is not None and names[at] != history.current:
                    ended.append(state())
                flags.append(next(taken)[2])
            yield rows_of(pdf[np.concatenate(flags)].drop(columns=["_seed", "_last"]).assign(_pid=-1))
            if ended:
                yield rows_of(pd.DataFrame(ended).astype({"_last": object}))
        if history.current is not None:
            yield rows_of(pd.DataFrame([state()]).astype({"_last": object}))

    return run


def filter_batch(
    batch: DataFrame, before: DataFrame, rule: tuple, order: list[str], forget_after: int | None, keys: list[str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted readings of a micro-batch, the histories of its sensors after it, and what to unpersist after both.

    ``before`` has histories (``_sensor``, ``_seed``, ``_last``). Readings are range-partitioned and
    sorted by sensor and time, so one sensor may fill many tasks; a sensor's history is a row that
    sorts before its readings, and histories are handed over the borders of partitions.
    """
    rows = batch.filter(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double")).withColumn("_sensor", outlier.sensor_name(keys))
    seeds = before.select("_sensor", "_seed", "_last").join(rows.select("_sensor").distinct(), "_sensor", "left_semi")
    dealt = rows.unionByName(seeds, allowMissingColumns=True).withColumn("_reading", F.col("_seed").isNull())
    place = ["_sensor", "_reading", *order]
    dealt = checkpointed(dealt.repartitionByRange(*place).sortWithinPartitions(*place).drop("_reading"))
    forget = None if forget_after is None else forget_after * 1000
    given = [T.StructField(f.name, T.DoubleType() if f.name == "value" else f.dataType) for f in batch.schema]  # null in histories
    schema = T.StructType([*given, *T.StructType.fromDDL(HISTORY + ", _pid int")])
    entries = outlier.entry_histories(dealt, rule, forget)
    both = dealt.mapInPandas(_judged(entries, rule, forget, batch.columns), schema).persist()
    newest = F.max_by(F.struct("_seed", "_last"), "_pid")  # a sensor's last partition has its final history
    after = both.filter("_pid >= 0").groupBy("_sensor").agg(newest.alias("_h")).select("_sensor", "_h._seed", "_h._last")
    return both.filter("_pid < 0").select(*batch.columns), after, both


def filter_outliers(
    readings: DataFrame, save: Callable[[DataFrame, int], None], histories: str, checkpoint: str, trigger: dict | None = None,
    size: int = params.HISTORY_SIZE, min_samples: int = params.MIN_SAMPLES, factor: float = params.SIGMA_FACTOR,
    order: tuple[str, ...] = ("time", "value"), forget_after: int | None = params.UNHEALTHY_AFTER, keys: list[str] = schemas.SENSOR,
) -> StreamingQuery:
    """Runs ``save(accepted, epoch)`` for every micro-batch of a stream of readings.

    A reading is judged by the last ``size`` accepted values of its sensor, over all micro-batches;
    within one, readings are taken in ``order``. The history is forgotten once a sensor was silent
    for more than ``forget_after`` seconds of event time (None: never). ``histories`` is a folder for
    what the query knows of the sensors; it belongs to the checkpoint. ``save`` must bear a repeated
    epoch. Rows with a null value are no readings and are left out.
    """
    rule = (size, min_samples, factor)

    def run(batch: DataFrame, epoch: int) -> None:
        known = Histories(batch.sparkSession, histories)
        held = [batch.persist()]
        try:
            before = known.of(batch.select(outlier.sensor_name(keys).alias("_sensor")), epoch)
            accepted, after, judged = filter_batch(batch, before, rule, list(order), forget_after, keys)
            held.append(judged)
            save(accepted, epoch)
            known.write(after, before, epoch)
        finally:
            for df in held:
                df.unpersist()

    writer = readings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class Liveness(StatefulProcessor):
    """A sensor's newest time and status, with one event-time timer for what silence makes of it next.

    A removed sensor leaves no state behind.
    """

    def __init__(self, keys: list[str], unhealthy_after: int, deregister_after: int):
        self.keys, self.waits = keys, {"healthy": unhealthy_after * 1000, "unhealthy": deregister_after * 1000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ms long, status string")

    def _become(self, status: str, last: int, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((last, status))
        self.handle.registerTimer(max(last + self.waits[status], watermark + 1))

    def _row(self, key, status: str, last: int) -> pd.DataFrame:
        place = {name: [value] for name, value in zip(self.keys, key)}
        return pd.DataFrame({**place, "status": [status], "last_seen": [pd.Timestamp(last, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, status = self.seen.get() if self.seen.exists() else (None, "")
        newest = max(int(pdf["time"].max().value // 1_000_000) for pdf in rows)
        if last is not None and newest <= last:
            return
        self._become("healthy", newest, timerValues.getCurrentWatermarkInMs())
        if status != "healthy":
            yield self._row(key, "healthy", newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, status = self.seen.get()
        if status == "healthy":
            self._become("unhealthy", last, timerValues.getCurrentWatermarkInMs())
            yield self._row(key, "unhealthy", last)
        else:
            self.seen.clear()
            yield self._row(key, "removed", last)

    def close(self) -> None:
        pass


def health_changes(
    readings: DataFrame, lateness: str = "1 minute", unhealthy_after: int = params.UNHEALTHY_AFTER,
    deregister_after: int = params.DEREGISTER_AFTER, keys: list[str] = schemas.SENSOR,
) -> DataFrame:
    """(the sensor's keys, status, last_seen) each time a sensor turns healthy, unhealthy or removed.

    Time is event time: a sensor is silent as long as the watermark says so. State lies in RocksDB,
    beyond the heap; queries of this session that start from now on use it too.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = ", ".join(f"{k} string" for k in keys) + ", status string, last_seen timestamp"
    return readings.withWatermark("time", lateness).select(*keys, "time").groupBy(*keys).transformWithStateInPandas(
        Liveness(list(keys), unhealthy_after, deregister_after), schema, "append", "EventTime"
    )


def first_registrations(messages: DataFrame, keys: list[str] = schemas.SENSOR) -> DataFrame:
    """A sensor's first configuration message only; later ones are dropped for good."""
    return messages.dropDuplicates(list(keys))
