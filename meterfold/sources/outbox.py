"""Outbox tables on files: what waits is frozen under a number, published under it, then marked.

``path/rows`` has the rows by day, each key once. A dispatch writes the keys and rows that wait to
``path/batches/batch=n`` first; only what stands there is published, and ``path/done/batch=n`` says
that it was. A failure anywhere leaves a frozen batch that is not done: the next dispatch publishes
that very batch again under the same number, so a sink that knows numbers keeps no message twice
and misses none, whatever arrived in between. One process at a time dispatches.
"""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold import params
from meterfold.sources import files, tables


@dataclass(frozen=True)
class Outbox:
    """Where an outbox lies and by which columns its rows are known; any kind of row with a ``time``."""

    path: str
    keys: list[str]

    def add(self, rows: DataFrame) -> None:
        """Rows wait from now on; those with a status ``sent`` are only kept, those without a time are left out."""
        if "status" not in rows.columns:
            rows = rows.withColumn("status", F.lit(params.PENDING))
        tables.append_absent(rows, f"{self.path}/rows", self.keys)

    def _numbers(self, spark: SparkSession, folder: str) -> set[int]:
        return {int(files.value(p, "batch")) for p in files.matching(spark, f"{self.path}/{folder}")}

    def _frozen(self, spark: SparkSession, numbers: set[int]) -> DataFrame | None:
        if not numbers:
            return None
        root = f"{self.path}/batches"
        return spark.read.option("basePath", root).parquet(*[f"{root}/batch={n}" for n in sorted(numbers)]).drop("batch")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with their status as of now."""
        stored = spark.read.parquet(f"{self.path}/rows").drop("day")
        sent = self._frozen(spark, self._numbers(spark, "done/batch=*"))
        if sent is None:
            return stored
        names = {k: f"_key_{n}" for n, k in enumerate(self.keys)}
        sent = sent.select(*[F.col(k).alias(x) for k, x in names.items()]).distinct().withColumn("_sent", F.lit(True))
        same = F.lit(True)
        for k, x in names.items():
            same = same & stored[k].eqNullSafe(sent[x])
        status = F.when(F.col("_sent"), params.SENT).otherwise(F.col("status"))
        return stored.join(sent, same, "left").withColumn("status", status).select(*stored.columns)

    def dispatch(self, spark: SparkSession, publish: Callable[[DataFrame, int], None], attempts: int = params.OUTBOX_ATTEMPTS) -> int | None:
        """Publishes what waits; the number of the batch, or None if nothing does.

        ``publish(rows, number)`` is tried again after an error, up to ``attempts`` times, and must
        bear a repeated number (``messages.publish_once``).
        """
        frozen, done = self._numbers(spark, "batches/batch=*/_SUCCESS"), self._numbers(spark, "done/batch=*")
        open_batches = frozen - done
        number = min(open_batches, default=max(frozen, default=-1) + 1)
        if not open_batches:
            waiting = self.rows(spark).filter(F.col("status") == params.PENDING)
            if waiting.isEmpty():
                return None
            waiting.write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        rows = self._frozen(spark, {number})
        for attempt in range(1, attempts + 1):
            try:
                publish(rows, number)
                break
            except Exception:
                if attempt == attempts:
                    raise
        files.make_folder(spark, f"{self.path}/done/batch={number}")
        return number

    def purge(self, spark: SparkSession, now: dt.datetime, older_than: int = params.OUTBOX_PURGE_AFTER) -> list[str]:
        """Removes the days whose rows are all sent and older than the age; returns them.

        Batches stay: they tell a late repetition of a row that it was sent.
        """
        cutoff = now - dt.timedelta(seconds=older_than)
        waiting = self.rows(spark).filter(F.col("status") == params.PENDING).select(F.to_date("time").cast("string").alias("day")).distinct()
        kept = {r.day for r in waiting.collect()}  # calendar days
        gone = []
        for path in files.matching(spark, f"{self.path}/rows/day=*"):
            day = files.value(path, "day")
            if day not in kept and dt.datetime.fromisoformat(day) + dt.timedelta(days=1) <= cutoff:
                files.delete(spark, path)
                files.delete(spark, f"{self.path}/rows/_keys/day={day}")
                gone.append(day)
        return gone
