"""File scans, idempotent appends and partition overwrites on Parquet."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from meterfold.functions import geo
from meterfold.operators import latest
from meterfold.sources import files


def historical_csv(
    spark: SparkSession, path: str, value_column: str, timestamp_column: str = "timestamp",
    timestamp_format: str = "yyyy-MM-dd'T'HH:mm:ss", separator: str = ";",
) -> DataFrame:
    """(time, value) of a headed CSV; rows whose value or timestamp cannot be read are dropped."""
    raw = spark.read.option("sep", separator).option("header", True).csv(path)
    stamp = F.try_to_timestamp(F.col(f"`{timestamp_column}`"), F.lit(timestamp_format)).cast("timestamp_ntz")
    value = F.col(f"`{value_column}`").try_cast("double")
    return raw.select(stamp.alias("time"), value.alias("value")).filter("time IS NOT NULL AND value IS NOT NULL")


def scan(spark: SparkSession, path: str, start=None, end=None, time: str = "time", **partition) -> DataFrame:
    """A stored table; keyword arguments select partitions (region_name='...').

    ``[start, end)`` selects rows by time; in a table stored by day only the folders of those
    days are listed and read.
    """
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(time) < F.lit(end).cast("timestamp_ntz"))
    if "day" in df.columns and time != "day":
        if start is not None:
            df = df.filter(F.col("day") >= F.lit(start.date()))
        if end is not None:
            df = df.filter(F.col("day") <= F.lit(end.date()))
    for name, value in partition.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def newest(spark: SparkSession, path: str, limit: int, ties: tuple[str, ...] = (), time: str = "time", first: int = 1, most: int | None = None, **key) -> DataFrame:
    """The newest ``limit`` rows of a key in a table stored by day.

    Day folders are read from the newest one on, twice as many each time, until they hold
    enough rows of the key; rows are clustered by key, so most of a folder is skipped. At most about
    twice the needed days are read. A key with fewer rows takes all days, or the newest ``most``.
    """
    days = files.matching(spark, f"{path}/day=*")[::-1][:most]
    read = min(first, len(days))
    while True:
        rows = spark.read.option("basePath", path).parquet(*days[:read]) if days else spark.read.parquet(path).limit(0)
        for name, value in key.items():
            rows = rows.filter(F.col(name) == F.lit(value))
        if read >= len(days) or rows.limit(limit).count() >= limit:
            return latest.latest(rows, limit, ties, time)
        read = min(2 * read, len(days))


def locations(rows: DataFrame, wkt: str = "location") -> DataFrame:
    """Location rows with the WKT polygon parsed into ``ring``."""
    return rows.withColumn("ring", geo.parse_polygon(F.col(wkt))).drop(wkt)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def first_per_key(batch: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """One row per key, the earliest by ``arrival``, among equals the smallest row, so that a
    replay keeps the same one; repeated keys collapse before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    order = F.struct(*([arrival] if arrival else []), *[c for c in rest if c != arrival])
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def append_absent(
    batch: DataFrame, path: str, keys: list[str], time: str = "time", arrival: str | None = None, index_hours: int = 24,
) -> None:
    """Insert-if-absent into a table partitioned by day; rows without a time are dropped.

    Beside the rows lies an index: for each day, in folders of ``index_hours`` hours, a hash of
    every stored key, clustered by hour. A batch reads the hashes (8 bytes a key) of the
    folders and hours it touches, however long the history is; only where a hash is known
    already are whole keys compared, in the range of time of those. Streams that append often to one day keep fewer files in
    reach with narrow folders; the width is fixed for a table. Of several rows with one key in a
    batch the first by ``arrival`` is kept.

    A repeated batch adds nothing. A day is marked while rows and keys are being written; a mark that
    is left by a failure, or a day that has no index yet, gets its index anew from the stored rows.
    One writer at a time may append to a table. Files are clustered by the key columns before the
    time, so that a lookup of one device skips row groups.
    """
    spark = batch.sparkSession
    index = f"{path}/_keys"
    for marked in files.matching(spark, f"{index}/_pending/day=*"):
        _index_day(spark, path, keys, time, index_hours, files.value(marked, "day"))
        files.delete(spark, marked)
    columns = [*batch.columns, "day"]
    new = _slotted(first_per_key(batch, keys, arrival).withColumn("day", F.to_date(time)), keys, time, index_hours).filter("day IS NOT NULL").persist()
    try:
        ranges = new.groupBy("day", "_slot").agg(F.min("_hour").alias("lo"), F.max("_hour").alias("hi")).collect()  # some for each calendar day
        if not ranges:
            return
        days = sorted({str(r.day) for r in ranges})
        choice = "{" + ",".join(days) + "}"
        indexed = files.matching(spark, f"{index}/day={choice}/slot=*")
        stored = {files.value(f, "day") for f in files.matching(spark, f"{path}/day={choice}")}
        if missing := stored - {files.value(f, "day") for f in indexed}:
            for day in missing:
                _index_day(spark, path, keys, time, index_hours, day)
            indexed = files.matching(spark, f"{index}/day={choice}/slot=*")
        touched = {(str(r.day), r._slot) for r in ranges}
        folders = [f for f in indexed if (files.value(f, "day"), int(files.value(f, "slot"))) in touched]
        hours = min(r.lo for r in ranges), max(r.hi for r in ranges)
        fresh = (_not_indexed(new, path, folders, hours, keys, time) if folders else new).persist()
        try:
            for day in days:
                files.make_folder(spark, f"{index}/_pending/day={day}")
            cluster = [*[k for k in keys if k != time], time]
            by_partition(fresh.select(*columns), ["day"], cluster).mode("append").parquet(path)
            _write_index(fresh, index, "append")
            files.delete(spark, f"{index}/_pending")
        finally:
            fresh.unpersist()
    finally:
        new.unpersist()


def _slotted(rows: DataFrame, keys: list[str], time: str, index_hours: int) -> DataFrame:
    """Rows with hour, index folder and hash of their key."""
    hour = F.hour(time)
    return rows.withColumns({"_hour": hour, "_slot": F.floor(hour / index_hours).cast("int"), "_hash": F.xxhash64(*keys)})


def stored_hashes(spark: SparkSession, index: str, folders: list[str], hours: tuple[int, int]) -> DataFrame:
    """Index rows of the folders; the hours reach the scan."""
    return spark.read.option("basePath", index).parquet(*folders).filter(F.col("hour").between(*hours))


def stored_keys(spark: SparkSession, path: str, days: list[str], keys: list[str], time: str, first, last) -> DataFrame:
    """Whole keys of the rows of some days; the range of time reaches the scan."""
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/day={d}" for d in days])
    return rows.filter(F.col(time).between(F.lit(first).cast(rows.schema[time].dataType), F.lit(last).cast(rows.schema[time].dataType))).select(*keys)


def _not_indexed(new: DataFrame, path: str, folders: list[str], hours: tuple[int, int], keys: list[str], time: str) -> DataFrame:
    """Rows whose key is not stored; hashes are compared first, whole keys where a hash is known."""
    spark = new.sparkSession
    hashes = stored_hashes(spark, f"{path}/_keys", folders, hours).select(F.col("hash").alias("_known"))
    hits = new.join(hashes, F.col("_hash") == F.col("_known"), "left_semi")
    hit = hits.groupBy("day").agg(F.min(time).alias("first"), F.max(time).alias("last")).collect()  # one row for each calendar day
    if not hit:
        return new
    stored = stored_keys(spark, path, [str(r.day) for r in hit], keys, time, min(r.first for r in hit), max(r.last for r in hit))
    stored = stored.withColumn("_known", F.xxhash64(*keys)).withColumnsRenamed({k: f"_key_{n}" for n, k in enumerate(keys)})
    same = F.col("_hash") == F.col("_known")
    for n, k in enumerate(keys):
        same = same & new[k].eqNullSafe(F.col(f"_key_{n}"))
    return new.join(stored, same, "left_anti")


def _write_index(rows: DataFrame, index: str, mode: str) -> None:
    out = rows.select("day", F.col("_slot").alias("slot"), F.col("_hour").alias("hour"), F.col("_hash").alias("hash"))
    by_partition(out, ["day", "slot"], ["hour", "hash"]).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(index)


def _index_day(spark: SparkSession, path: str, keys: list[str], time: str, index_hours: int, day: str) -> None:
    """The index of one day from the rows stored for it."""
    if files.exists(spark, f"{path}/day={day}"):
        rows = spark.read.option("basePath", path).parquet(f"{path}/day={day}")
        _write_index(_slotted(rows, keys, time, index_hours), f"{path}/_keys", "overwrite")


def by_partition(df: DataFrame, partitions: list[str], cluster: list[str] = ()) -> DataFrameWriter:
    """Writer into partitions: rows gather by partition, small ones share a task, large ones are split."""
    df = df.hint("rebalance", *[F.col(c) for c in partitions])
    if cluster:
        df = df.sortWithinPartitions(*partitions, *cluster)
    return df.write.partitionBy(*partitions)


def overwrite_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace just the partitions that occur in ``df``."""
    by_partition(df, partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def drop_partition(spark: SparkSession, path: str, **partition) -> None:
    """Remove one partition's folder, if present."""
    files.delete(spark, "/".join([path, *(f"{k}={v}" for k, v in partition.items())]))


def save_analysis(result: DataFrame, path: str, params: dict | None = None, day: str = "day") -> None:
    """Store analysis rows by day (time truncated to the day) and by the parameters they depend on."""
    out = result.withColumn(day, F.to_date(day))
    for name, value in (params or {}).items():
        out = out.withColumn(name, F.lit(value))
    overwrite_partitions(out, path, [day, *(params or {})])


def append_csv(df: DataFrame, path: str) -> None:
    """Append metric rows with a header line per file."""
    df.write.mode("append").option("header", True).csv(path)
