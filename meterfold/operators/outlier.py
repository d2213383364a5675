"""Recursive per-sensor outlier filter over complete histories.

A reading is accepted while the sensor has fewer than ``min_samples`` accepted
readings, else iff it lies inside mean +- ``factor`` population deviations of the last
``size`` accepted ones. Acceptance feeds back into the history, so this is no window
function; each task walks its sorted rows once with at most ``size`` values of state.
"""

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold import params, schemas
from meterfold.session import checkpointed


def judge(values, kept: deque, size: int, min_samples: int, factor: float) -> np.ndarray:
    """Acceptance flags of consecutive readings of one sensor; ``kept`` is updated.

    Running sums decide clear cases. Where the bound is near, or the deviation tiny
    against the mean, the sums are taken again over the history, newest first, so that
    the result does not depend on where a history was split.
    """
    flags = np.empty(len(values), dtype=bool)
    total = math.fsum(kept)
    squares = math.fsum(v * v for v in kept)
    added = 0
    for i, x in enumerate(values):
        n = len(kept)
        ok = True
        if n >= min_samples:
            mean = total / n
            var = squares / n - mean * mean
            band = factor * math.sqrt(var) if var > 0 else 0.0
            if abs(abs(x - mean) - band) <= 1e-6 * (abs(mean) + band) or var <= 1e-9 * mean * mean:
                total = squares = 0.0
                for v in reversed(kept):
                    total += v
                    squares += v * v
                mean = total / n
                var = squares / n - mean * mean
                band = factor * math.sqrt(var) if var > 0 else 0.0
            ok = not (x < mean - band or x > mean + band)
        flags[i] = ok
        if ok:
            if n == size:
                old = kept.popleft()
                total -= old
                squares -= old * old
            kept.append(x)
            total += x
            squares += x * x
            added += 1
            if added == size:
                added = 0
                total = math.fsum(kept)
                squares = math.fsum(v * v for v in kept)
    return flags


def runs(keys: np.ndarray):
    """(start, end) of runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip([0, *cuts], [*cuts, len(keys)])


class History:
    """What a task knows of the sensor it walks: accepted values and the time of its newest reading.

    A sensor's first row may be a seed: it has the history that the sensor had before (``_seed``,
    ``_last`` in milliseconds) and is no reading. With ``forget`` a history ends when the sensor was
    silent for more than so many milliseconds.
    """

    def __init__(self, rule: tuple, forget: int | None = None, entry: tuple = ((), None)):
        self.rule, self.forget, self.current, self.first = rule, forget, None, None
        self.begin(*entry)

    def begin(self, kept=(), last: int | None = None) -> None:
        self.kept, self.last = deque(kept), last

    def take(self, pdf: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, accepted) of each run of rows of one sensor."""
        keys = pdf["_sensor"].to_numpy()
        values = pdf["value"].tolist()
        at = pdf["time"].to_numpy().astype("datetime64[ms]").astype("int64") if self.forget is not None else None
        for a, b in runs(keys):
            if keys[a] != self.current:
                if self.current is not None:
                    self.begin()
                else:
                    self.first = keys[a]
                self.current = keys[a]
            flags, begin = np.zeros(b - a, dtype=bool), a
            if "_seed" in pdf and pdf["_seed"].iloc[a] is not None:
                last = pdf["_last"].iloc[a]
                self.begin(pdf["_seed"].iloc[a], None if pd.isna(last) else int(last))
                begin += 1
            if self.forget is None:
                flags[begin - a :] = judge(values[begin:b], self.kept, *self.rule)
            elif begin < b:
                before = np.concatenate([[at[begin] if self.last is None else self.last], at[begin : b - 1]])
                newest = np.maximum.accumulate(before)
                for c in [*(np.flatnonzero(at[begin:b] - newest > self.forget) + begin).tolist(), b]:
                    flags[begin - a : c - a] = judge(values[begin:c], self.kept, *self.rule)
                    if c < b:
                        self.kept = deque()
                    begin = c
                self.last = int(max(newest[-1], at[b - 1]))
            yield a, b, flags


def _walk(entries: dict, rule: tuple):
    """mapInPandas function: rows sorted by sensor -> rows with ``accepted``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        history = History(rule, entry=entries.get(TaskContext.get().partitionId(), ((), None)))
        for pdf in batches:
            if len(pdf):
                flags = np.concatenate([f for _, _, f in history.take(pdf)])
                yield pdf.drop(columns="_sensor").assign(accepted=flags)

    return run


def _boundary(entries: dict, only: set | None, rule: tuple, forget: int | None):
    """mapInPandas function: one row per partition with its first and last sensor and the
    last sensor's final history."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        if only is not None and pid not in only:
            return
        history = History(rule, forget, entries.get(pid, ((), None)))
        for pdf in batches:
            if len(pdf):
                for _ in history.take(pdf):
                    pass
        if history.current is not None:
            yield pd.DataFrame({"pid": [pid], "head": [history.first], "tail": [history.current], "kept": [list(history.kept)], "last": [history.last]})

    return run


_BOUNDARY = "pid int, head string, tail string, kept array<double>, last long"


def entry_histories(parts: DataFrame, rule: tuple, forget: int | None = None) -> dict:
    """History with which each partition starts, keyed by partition id.

    Only bounded summaries (one row per partition) reach the driver. A partition that
    holds several sensors ends with an exact history after the first pass. For sensors
    that fill whole partitions the passes repeat over just those partitions until every
    partition was walked with the history its predecessor really ends with.
    """
    rows = parts.mapInPandas(_boundary({}, None, rule, forget), _BOUNDARY).collect()
    rows = {r.pid: r for r in rows}
    order = sorted(rows)
    none = ((), None)
    used: dict[int, tuple] = {p: none for p in order}
    ends = {p: (tuple(rows[p].kept), rows[p].last) for p in order}
    while True:
        starts = {}
        for before, p in zip(order, order[1:]):
            if rows[before].tail == rows[p].head:
                starts[p] = ends[before]
        # the end of a partition depends on its start only if one sensor fills it
        stale = {
            p for p in order
            if rows[p].head == rows[p].tail and starts.get(p, none) != used[p]
        }
        if not stale:
            return starts
        again = {p: starts[p] for p in stale}
        for r in parts.mapInPandas(_boundary(again, stale, rule, forget), _BOUNDARY).collect():
            ends[r.pid] = (tuple(r.kept), r.last)
            used[r.pid] = again[r.pid]


def sensor_name(keys: list[str]):
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def flag_outliers(
    readings: DataFrame, size: int = params.HISTORY_SIZE, min_samples: int = params.MIN_SAMPLES,
    factor: float = params.SIGMA_FACTOR, order: tuple[str, ...] = ("time", "value"),
    keys: list[str] = schemas.SENSOR, partitions: int | None = None, split: bool = True,
) -> DataFrame:
    """Readings with a column ``accepted``; a sensor is known by ``keys``, its place included.

    Rows are range-partitioned by (sensor, order), which spreads a sensor with many rows over
    many tasks, and the histories are handed over the partition borders exactly (see
    ``entry_histories``). With ``split=False`` a sensor stays in one task, which saves the
    checkpoint where the caller knows that no sensor is large. Either way rows stream through a
    task in Arrow batches; no sensor is held in memory. ``partitions`` is left to Spark if not
    given. Rows with a null value are no readings and are left out.
    """
    rule = (size, min_samples, factor)
    rows = readings.filter(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    rows = rows.withColumn("_sensor", sensor_name(keys))
    out = T.StructType([*rows.drop("_sensor").schema.fields, T.StructField("accepted", T.BooleanType())])
    number = [partitions] if partitions else []
    if not split:
        return rows.repartition(*number, "_sensor").sortWithinPartitions("_sensor", *order).mapInPandas(_walk({}, rule), out)
    dealt = checkpointed(rows.repartitionByRange(*number, "_sensor", *order).sortWithinPartitions("_sensor", *order))
    return dealt.mapInPandas(_walk(entry_histories(dealt, rule), rule), out)


def accepted(readings: DataFrame, **rule) -> DataFrame:
    return flag_outliers(readings, **rule).filter("accepted").drop("accepted")
