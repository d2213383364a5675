"""Outbox tables: rows wait as pending, are published, then marked sent and purged."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold import params
from meterfold.operators import filters


def pending(outbox: DataFrame) -> DataFrame:
    return filters.with_status(outbox, params.PENDING)


def mark_sent(outbox: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Outbox with the status of the published keys set to sent."""
    hits = published.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (
        outbox.join(hits, keys, "left")
        .withColumn("status", F.when(F.col("_hit"), params.SENT).otherwise(F.col("status")))
        .drop("_hit")
    )


def purge_sent(outbox: DataFrame, now: dt.datetime, older_than: int = params.OUTBOX_PURGE_AFTER) -> DataFrame:
    """What remains after deleting sent rows older than the age."""
    cutoff = F.lit(now - dt.timedelta(seconds=older_than)).cast("timestamp_ntz")
    return outbox.filter(~((F.col("status") == params.SENT) & (F.col("time") < cutoff)))


def retain(outbox: DataFrame, now: dt.datetime, span: int = params.RAW_RETENTION) -> DataFrame:
    """Rows inside the retention span, whatever their status."""
    cutoff = F.lit(now - dt.timedelta(seconds=span)).cast("timestamp_ntz")
    return outbox.filter(F.col("time") >= cutoff)
