"""Delivery, outlier and latency reports, profiles and summaries."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold import params


def hourly_profile(values: DataFrame, time: str = "time", value: str = "value") -> DataFrame:
    """Mean and population deviation for each of 24 hours, (0, 0) where there is no value."""
    hours = values.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    v = F.col(value).cast("double")
    stats = values.groupBy(F.hour(F.col(time)).alias("hour")).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return hours.join(stats, "hour", "left").fillna(0.0, ["mean", "std"])


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def delivery_quality(
    received: DataFrame, sensor_keys: list[str], window_seconds: int, interval_seconds: int,
    miss_probability: float = params.MISS_PROBABILITY,
) -> DataFrame:
    """Received messages against what the observed sensors should have sent in the window."""
    samples = window_seconds // interval_seconds
    return (
        received.agg(F.count_distinct(*sensor_keys).alias("unique_sensors"), F.count(F.lit(1)).alias("received"))
        .withColumn("expected", F.col("unique_sensors") * F.lit(samples).cast("long"))
        .withColumn("expected_adj", F.round(F.col("expected") * (1 - miss_probability)).cast("long"))
        .withColumn("expected_missed", F.greatest(F.col("expected") - F.col("received"), F.lit(0)))
        .withColumn("missing_rate", F.greatest(_percent(F.col("expected") - F.col("received"), F.col("expected")), F.lit(0.0)))
        .withColumn("missing_rate_adj", F.greatest(_percent(F.col("expected_adj") - F.col("received"), F.col("expected_adj")), F.lit(0.0)))
    )


def loss_report(sent: DataFrame, received: DataFrame, is_missing: Column, is_outlier: Column, is_rejected: Column) -> DataFrame:
    """Loss against the sender's log.

    ``sent`` is the log: rows with ``is_missing`` were withheld on purpose and rows with
    ``is_outlier`` sent as outliers. ``is_rejected`` marks received rows the filter rejected.
    """
    left = sent.agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(is_missing).alias("sent_missing"),
        F.count_if(is_outlier).alias("sent_outliers"),
    )
    right = received.agg(F.count(F.lit(1)).alias("received"), F.count_if(is_rejected).alias("rejected"))
    names = [*left.columns, *right.columns]
    both = left.unionByName(right, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])
    missed = F.greatest(F.col("sent") - F.col("received"), F.lit(0))
    return (
        both.withColumn("missed", missed)
        .withColumn("missing_rate", _percent(F.col("missed"), F.col("sent")))
        .withColumn("missing_rate_adj", _percent(F.col("missed") - F.col("sent_missing"), F.col("sent")))
        .withColumn("outlier_error", _percent(F.abs(F.col("rejected") - F.col("sent_outliers")), F.col("sent_outliers")))
    )


def throughput(messages: DataFrame, latency_seconds: Column, window_minutes: float, sensor_keys: list[str]) -> DataFrame:
    """Messages per minute and second, latency and distinct sensors of one observation window."""
    n = F.count(F.lit(1))
    return messages.agg(
        n.alias("received"),
        F.count_distinct(*sensor_keys).alias("unique_sensors"),
        (n / window_minutes).alias("msg_per_min"),
        (n / (window_minutes * 60)).alias("msg_per_sec"),
        F.count(latency_seconds).alias("lat_count"),
        F.avg(latency_seconds).alias("lat_avg_s"),
        F.max(latency_seconds).alias("lat_max_s"),
    )


def trimmed_mean(df: DataFrame, value: str, keys: list[str] = (), sigmas: float = 2.0, salts: int = 64) -> DataFrame:
    """Mean without the values above mean + ``sigmas`` sample deviations; ``kept`` counts the rest.

    A group's rows meet its bound under ``salts`` keys, so a large group is many join keys.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v"))
    limit = (F.avg(v) + sigmas * F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("bound")
    bound = df.groupBy(*keys).agg(limit)
    if keys:
        bound = bound.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)).cast("int")).join(bound, [*keys, "_salt"])
    else:
        rows = rows.withColumn("bound", bound.scalar())
    return (
        rows.filter(F.col("_v") <= F.col("bound"))
        .groupBy(*keys, "bound").agg(F.avg("_v").alias("trimmed_mean"), F.count(F.lit(1)).alias("kept"))
    )


_QUANTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def _ordered(values) -> list[float]:
    """Distinct values in Spark's order: NaN is the largest."""
    found = {(math.isnan(v), 0.0 if math.isnan(v) else v): v for v in values}
    return [found[k] for k in sorted(found)]


def _piece(cuts: dict[str, list[float]]) -> Column:
    """Where a value lies among the ordered cuts of its metric: 2 i before cut i, 2 i + 1 on it."""
    out = F.lit(0)
    for metric, values in cuts.items():
        at = F.lit(0)
        for c in values:
            at = at + (F.col("value") >= c).cast("int") + (F.col("value") > c).cast("int")
        out = F.when(F.col("metric") == metric, at).otherwise(out)
    return out


def _in_pieces(long: DataFrame, cuts: dict[str, list[float]], pieces: list[tuple[str, int]]) -> DataFrame:
    """Values of the given pieces, which are at most ten a metric."""
    inside = F.lit(False)
    for metric in {m for m, _ in pieces}:
        inside = inside | ((F.col("metric") == metric) & F.col("piece").isin([p for m, p in pieces if m == metric]))
    return long.withColumn("piece", _piece(cuts)).filter(inside)


def _sketched(long: DataFrame, cuts: dict[str, list[float]], wide: dict[tuple, tuple], accuracy: int) -> dict[str, list[float]]:
    """More cuts: two values around each rank of the wide pieces, proposed by one sketch a piece."""
    step = 2.0 / accuracy

    def around(rank: int, below: int, n: int) -> tuple[float, float]:
        q = (rank - below + 0.5) / n
        return round(max(0.0, q - step), 12), round(min(1.0, q + step), 12)

    wanted = {key: {s for r in ranks for s in around(r, below, n)} for key, (below, n, ranks) in wide.items()}
    shares = sorted(set().union(*wanted.values()))
    sketch = _in_pieces(long, cuts, list(wide)).groupBy("metric", "piece").agg(F.percentile_approx("value", shares, accuracy).alias("at"))
    out = dict(cuts)
    for row in sketch.collect():
        m = row["metric"]
        out[m] = _ordered([*out[m], *(row["at"][shares.index(s)] for s in wanted[m, row["piece"]])])
    return out


def _located(long: DataFrame, cuts: dict[str, list[float]], ranks: list[tuple[str, int]]) -> tuple[list[tuple], dict[tuple, tuple]]:
    """Ranks whose value is a cut, with it, and for each piece that holds others (rows before it, its rows, ranks)."""
    counted = long.groupBy("metric", _piece(cuts).alias("piece")).agg(F.count("*").alias("n")).collect()
    sizes = {(r["metric"], r["piece"]): r["n"] for r in counted}
    below, total = {}, dict.fromkeys(cuts, 0)
    for m, p in sorted(sizes):
        below[m, p] = total[m]
        total[m] += sizes[m, p]
    done, left = [], {}
    for m, rank in ranks:
        key = next(k for k in below if k[0] == m and below[k] <= rank < below[k] + sizes[k])
        if key[1] % 2:
            done.append((m, rank, cuts[m][key[1] // 2]))
        else:
            left.setdefault(key, (below[key], sizes[key], []))[2].append(rank)
    return done, left


def _needed(cuts: dict[str, list[float]], left: dict[tuple, tuple]) -> tuple[dict[str, list[float]], dict[tuple, tuple]]:
    """Only the cuts beside the pieces that are left, and the pieces under their new numbers."""
    kept = {m: sorted({i for n, p in left if n == m for i in (p // 2 - 1, p // 2) if 0 <= i < len(values)}) for m, values in cuts.items()}
    moved = {(m, 2 * sum(i < p // 2 for i in kept[m])): found for (m, p), found in left.items()}
    return {m: [cuts[m][i] for i in at] for m, at in kept.items()}, moved


def box_plot(df: DataFrame, columns: list[str], enough: int = 100_000, accuracy: int = 10_000) -> DataFrame:
    """min, q1, median, q3, max (linear interpolation) of each column, exact at any size.

    Cuts divide the values of a column into pieces, and into those equal to a cut. A mergeable sketch
    proposes two cuts around each wanted rank, counting the rows of all pieces says where the rank
    lies: on a cut, which is then its value, or in a piece, which is about 1 / 2,500 of the rows. Pieces of
    more than ``enough`` rows are divided again, so two rounds do for any table; a cut is a value
    of its piece, so every round leaves less. The values of the last pieces are counted and ranked.
    Every step is one scan with a partial aggregation, and no row is repeated for a rank.
    Only some numbers for each column reach the driver.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "value")
    long = long.filter(F.col("value").isNotNull())
    totals = {r["metric"]: r["n"] for r in long.groupBy("metric").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return df.sparkSession.createDataFrame([], "metric string, " + ", ".join(f"{n} double" for n in _QUANTILES))
    wanted = [(m, name, q * (n - 1)) for m, n in totals.items() for name, q in _QUANTILES.items()]
    ranks: dict[str, set[int]] = {m: set() for m in totals}
    for m, _, h in wanted:
        ranks[m] |= {math.floor(h), math.ceil(h)}
    cuts: dict[str, list[float]] = {m: [] for m in totals}
    left = {(m, 0): (0, n, sorted(ranks[m])) for m, n in totals.items()}
    values: list[tuple] = []
    while wide := {key: found for key, found in left.items() if found[1] > enough}:
        cuts = _sketched(long, cuts, wide, accuracy)
        done, left = _located(long, cuts, [(m, r) for (m, _), (_, _, held) in left.items() for r in held])
        values += done
        cuts, left = _needed(cuts, left)
    found = df.sparkSession.createDataFrame(values, "metric string, rank long, value double")
    if left:
        sought = df.sparkSession.createDataFrame([(m, p, below, r) for (m, p), (below, _, held) in left.items() for r in held], "metric string, piece int, below long, rank long")
        counted = _in_pieces(long, cuts, list(left)).groupBy("metric", "piece", "value").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("metric", "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        last = counted.withColumn("upto", upto).join(sought, ["metric", "piece"]).withColumn("at", F.col("rank") - F.col("below"))
        found = found.unionByName(last.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("metric", "rank", "value"))
    asked = df.sparkSession.createDataFrame(
        [(m, name, r, h - math.floor(h)) for m, name, h in wanted for r in {math.floor(h), math.ceil(h)}], "metric string, name string, rank long, part double"
    )
    ends = found.select("metric", "rank", "value").join(asked, ["metric", "rank"]).groupBy("metric", "name", "part").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return ends.groupBy("metric").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in _QUANTILES])
