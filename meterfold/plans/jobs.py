"""Maintenance of stored roll-ups and stored analysis results."""

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold import params
from meterfold.functions import timeutil
from meterfold.operators import filters, rollup
from meterfold.sources import tables


def _ranges(starts: list[dt.datetime], unit: str):
    """One time condition per run of adjacent buckets."""
    runs: list[list[dt.datetime]] = []
    for start in sorted(starts):
        lo, hi = timeutil.bucket_bounds(start, unit)
        if runs and runs[-1][1] == lo:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    cond = F.lit(False)
    for lo, hi in runs:
        cond = cond | filters.in_range("time", lo, hi)
    return cond


def missing_buckets(spark: SparkSession, path: str, unit: str, instants: list[dt.datetime]) -> list[dt.datetime]:
    """Buckets of the given instants that have no stored row."""
    wanted = sorted({timeutil.bucket_bounds(i, unit)[0] for i in instants})
    stored = tables.read_or_none(spark, path)
    if stored is None or not wanted:
        return wanted
    key = F.col("bucket")
    have = stored.filter(key.isin([w.date() for w in wanted])).select(key).distinct()
    have = {r.bucket for r in have.collect()}  # at most one row per wanted bucket
    return [w for w in wanted if w.date() not in have]


def _stored(df: DataFrame, unit: str) -> DataFrame:
    return df.withColumn("bucket", F.to_date(unit))


def refresh_missing(stats: DataFrame, path: str, unit: str, keys: list[str], instants: list[dt.datetime]) -> DataFrame:
    """Compute the roll-up only of the buckets that have no row yet; returns the stored roll-up."""
    spark = stats.sparkSession
    todo = missing_buckets(spark, path, unit, instants)
    if todo:
        fresh = rollup.calendar_rollup(stats.filter(_ranges(todo, unit)), unit, keys)
        tables.overwrite_partitions(_stored(fresh, unit), path, ["bucket"])
    return spark.read.parquet(path)


def scheduled_refresh(stats: DataFrame, path: str, unit: str, keys: list[str], now: dt.datetime, back: int = 2) -> DataFrame:
    """Recompute the bucket of ``now`` and the ``back`` ones before it; those without rows go."""
    start, end = timeutil.bucket_bounds(now, unit)
    for _ in range(back):
        start = timeutil.bucket_bounds(start - dt.timedelta(seconds=1), unit)[0]
    fresh = _stored(rollup.calendar_rollup(stats.filter(filters.in_range("time", start, end)), unit, keys), unit)
    tables.overwrite_partitions(fresh, path, ["bucket"])
    # A bucket that came out empty must not go on being served; at most ``back`` + 1 of them.
    spark = stats.sparkSession
    filled = {r.bucket for r in fresh.select("bucket").distinct().collect()}
    while start < end:
        if start.date() not in filled:
            tables.drop_partition(spark, path, bucket=start.date())
        start = timeutil.bucket_bounds(start, unit)[1]
    return spark.read.parquet(path)


def same_parameters(asked: dict) -> Column:
    same = F.lit(True)
    for name, value in asked.items():
        same = same & (F.col(name) == F.lit(value))
    return same


_COMPUTED = "asked string, day date"


def _days_to_compute(spark: SparkSession, ledger: str, days: list[dt.date], asked: str) -> list[dt.date]:
    """Those of the days that the ledger does not have."""
    wanted = spark.createDataFrame([(d,) for d in sorted(set(days))], "day date")
    done = tables.read_or_none(spark, ledger)
    if done is not None:
        span = F.col("day").between(F.lit(min(days)), F.lit(max(days)))
        wanted = wanted.join(done.filter((F.col("asked") == asked) & span), "day", "left_anti")
    return sorted(r.day for r in wanted.collect())  # at most the days asked for


def read_through(
    spark: SparkSession, path: str, days: list[dt.date], params: dict,
    compute: Callable[[list[dt.date]], DataFrame], now: dt.datetime, min_age: int = params.RESULT_MIN_AGE,
) -> DataFrame:
    """Stored results of the days and parameters; ``compute`` is asked only for the missing days.

    The parameters are part of the key, so another radius or span never gets these rows. A ledger
    beside the results says which days were computed, days without any row included, so nothing is
    computed twice. It is written after the results: a failure in between repeats the days, which
    replaces their rows. A day that began less than ``min_age`` seconds before ``now`` may still
    change and is refused, so that no unfinished day is ever stored.
    """
    if not days:
        raise ValueError("no day given")
    newest = now - dt.timedelta(seconds=min_age)
    if young := [d for d in days if dt.datetime(d.year, d.month, d.day) > newest]:
        raise ValueError(f"too recent: {min(young)}")
    ledger, asked = f"{path}/_computed", json.dumps(params, sort_keys=True)
    todo = _days_to_compute(spark, ledger, days, asked)
    if todo:
        tables.save_analysis(compute(todo), path, params)
        spark.createDataFrame([(asked, d) for d in todo], _COMPUTED).coalesce(1).write.mode("append").parquet(ledger)
    stored = tables.read_or_none(spark, path)
    if stored is None:  # nothing but empty days so far: no rows, but their columns
        stored = compute(days).limit(0).withColumns({name: F.lit(value) for name, value in params.items()})
    return stored.filter(same_parameters(params) & F.col("day").isin(days))
