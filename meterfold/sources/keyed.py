"""Device tables as a log: a micro-batch adds its changes, readers merge them.

A message either registers a device or says when it was seen. Both become rows of the same
shape, and merging is an aggregation that does not depend on the order of rows: the earliest
registration (by arrival, then time) gives attributes and registration time, the latest time is
last_seen, and a key without a registration is no device. So a micro-batch is written without
reading the table, a replay of it changes nothing, and several streams may write to one table.

Below ``path`` lie ``log/writer=w/epoch=n/bucket=b``, the changes of one micro-batch;
``base/generation=g/bucket=b``, merged rows; and ``manifest/generation=g``, which says for each
bucket which generation holds it and up to which epoch each writer's log is in it. Compaction
rewrites only the buckets that the log touched. It takes effect with its manifest: if it fails
before that, the log still counts, and the next one writes the same generation again. Log and
base of the manifest before last are removed, so running readers keep their files.

A writer is one stream with its checkpoint; a new checkpoint needs a new name. One process at a
time may compact a table.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold.sources import files, tables

IMPORT = "import"


@dataclass(frozen=True)
class KeyedTable:
    """Where a device table lies and what it holds; keys and attributes are strings."""

    path: str
    keys: list[str]
    attributes: list[str] = field(default_factory=list)
    buckets: int = 32

    @property
    def schema(self) -> T.StructType:
        out = T.StructType()
        for name in [*self.keys, *self.attributes]:
            out.add(name, T.StringType())
        for name in ("registration_time", "last_seen"):
            out.add(name, T.TimestampNTZType())
        return out.add("arrival", T.LongType())

    def bucket(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*(values or self.keys)), F.lit(self.buckets)).cast("int")


def _merged(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """One row for each key of rows of the table's schema; further columns ``bucket`` may lead the key."""
    keys = [*(c for c in ["bucket"] if c in rows.columns), *table.keys]
    found = F.when(F.col("registration_time").isNotNull(), F.struct("arrival", "registration_time", *table.attributes))
    first = rows.groupBy(*keys).agg(F.min(found).alias("_r"), F.max("last_seen").alias("last_seen"))
    columns = [F.col(f"_r.{c}").alias(c) for c in (*table.attributes, "registration_time")]
    return first.select(*keys, *columns, "last_seen", F.col("_r.arrival").alias("arrival"))


def _append(rows: DataFrame, table: KeyedTable, writer: str, epoch: int) -> None:
    """A micro-batch collapses to one row a key before it is written; writing it again replaces it."""
    changes = _merged(rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema]).withColumn("bucket", table.bucket()), table)
    tables.by_partition(changes, ["bucket"]).mode("overwrite").parquet(f"{table.path}/log/writer={writer}/epoch={epoch}")


def register(messages: DataFrame, table: KeyedTable, writer: str, epoch: int, time: str = "time") -> None:
    """Registration messages (keys, attributes, time) of a micro-batch."""
    at = F.col(time)
    rows = messages.select(*table.keys, *table.attributes, at.alias("registration_time"), at.alias("last_seen"), F.lit(epoch).alias("arrival"))
    _append(rows, table, writer, epoch)


def touch(seen: DataFrame, table: KeyedTable, writer: str, epoch: int, time: str = "time") -> None:
    """Signs of life (keys, time) of a micro-batch."""
    none = [F.lit(None).cast("string").alias(a) for a in table.attributes]
    rows = seen.select(*table.keys, *none, F.lit(None).alias("registration_time"), F.col(time).alias("last_seen"), F.lit(None).alias("arrival"))
    _append(rows, table, writer, epoch)


def create(devices: DataFrame, table: KeyedTable) -> None:
    """The devices a table starts with; they came before every message."""
    _append(devices.withColumn("arrival", F.lit(-1)), table, IMPORT, 0)
    compact(devices.sparkSession, table)


@dataclass(frozen=True)
class _State:
    generation: int  # -1: none
    holders: dict[int, int]  # bucket -> generation that holds it
    included: dict[str, int]  # writer -> last epoch that is in the base


def _generations(spark: SparkSession, table: KeyedTable) -> list[int]:
    return sorted(int(files.value(p, "generation")) for p in files.matching(spark, f"{table.path}/manifest/generation=*/_SUCCESS"))


def _state(spark: SparkSession, table: KeyedTable, generation: int | None = None) -> _State:
    """The manifest: at most one row for each bucket and each writer."""
    if generation is None:
        generation = max(_generations(spark, table), default=-1)
    if generation < 0:
        return _State(-1, {}, {})
    rows = spark.read.parquet(f"{table.path}/manifest/generation={generation}").collect()
    return _State(generation, {r.bucket: r.number for r in rows if r.writer is None}, {r.writer: r.number for r in rows if r.writer is not None})


def _log(spark: SparkSession, table: KeyedTable, state: _State) -> dict[str, list[int]]:
    """Completed epochs of each writer that are not in the base."""
    found: dict[str, list[int]] = {}
    for path in files.matching(spark, f"{table.path}/log/writer=*/epoch=*/_SUCCESS"):
        writer, epoch = files.value(path, "writer"), int(files.value(path, "epoch"))
        if epoch > state.included.get(writer, -1):
            found.setdefault(writer, []).append(epoch)
    return found


def _base_rows(spark: SparkSession, table: KeyedTable, holders: dict[int, int]) -> DataFrame:
    return _rows(spark, table, "base", [f"generation={g}/bucket={b}" for b, g in sorted(holders.items())])


def _log_rows(spark: SparkSession, table: KeyedTable, epochs: dict[str, list[int]]) -> DataFrame:
    return _rows(spark, table, "log", [f"writer={w}/epoch={e}" for w, found in sorted(epochs.items()) for e in found])


def _rows(spark: SparkSession, table: KeyedTable, part: str, folders: list[str]) -> DataFrame:
    schema = T.StructType([*table.schema.fields, T.StructField("bucket", T.IntegerType())])
    if not folders:
        return spark.createDataFrame([], schema)
    root = f"{table.path}/{part}"
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{f}" for f in folders]).select(*schema.names)


def read(spark: SparkSession, table: KeyedTable, **key: str) -> DataFrame:
    """The devices as of now; with a whole key only its bucket is read."""
    state = _state(spark, table)
    rows = _base_rows(spark, table, state.holders).unionByName(_log_rows(spark, table, _log(spark, table, state)))
    if key and not set(table.keys) - set(key):
        rows = rows.filter(F.col("bucket") == table.bucket(*[F.lit(key[k]) for k in table.keys]))
    for name, value in key.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return _merged(rows, table).filter(F.col("registration_time").isNotNull()).drop("bucket", "arrival")


def compact(spark: SparkSession, table: KeyedTable) -> bool:
    """Merges the log into the base, for the buckets it touched; False if there was nothing to do."""
    state = _state(spark, table)
    epochs = _log(spark, table, state)
    if not epochs:
        return False
    patterns = [f"{table.path}/log/writer={w}/epoch={{{','.join(map(str, e))}}}/bucket=*" for w, e in epochs.items()]
    touched = {int(files.value(p, "bucket")) for p in files.matching(spark, *patterns)}
    new = state.generation + 1
    if touched:
        old = _base_rows(spark, table, {b: g for b, g in state.holders.items() if b in touched})
        rows = _merged(old.unionByName(_log_rows(spark, table, epochs)), table)
        tables.by_partition(rows, ["bucket"], table.keys).mode("overwrite").parquet(f"{table.path}/base/generation={new}")
    holders = state.holders | {b: new for b in touched}
    included = state.included | {w: max(e) for w, e in epochs.items()}
    manifest = [(b, None, g) for b, g in holders.items()] + [(None, w, e) for w, e in included.items()]
    spark.createDataFrame(manifest, "bucket int, writer string, number long").coalesce(1).write.mode("overwrite").parquet(f"{table.path}/manifest/generation={new}")
    _clean(spark, table, state, holders)
    return True


def _clean(spark: SparkSession, table: KeyedTable, before: _State, holders: dict[int, int]) -> None:
    """Removes what neither the newest manifest nor the one before it needs."""
    for path in files.matching(spark, f"{table.path}/log/writer=*/epoch=*"):
        if int(files.value(path, "epoch")) <= before.included.get(files.value(path, "writer"), -1):
            files.delete(spark, path)
    used = {(b, g) for h in (before.holders, holders) for b, g in h.items()}
    for path in files.matching(spark, f"{table.path}/base/generation=*/bucket=*"):
        if (int(files.value(path, "bucket")), int(files.value(path, "generation"))) not in used:
            files.delete(spark, path)
    for generation in _generations(spark, table)[:-2]:
        files.delete(spark, f"{table.path}/manifest/generation={generation}")
