"""Latest rows and top-N."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold import params


def _check(limit: int) -> int:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return int(limit)


def latest(df: DataFrame, limit: int = params.ROW_LIMIT, ties: tuple[str, ...] = (), time: str = "time") -> DataFrame:
    """Newest rows of the whole frame: a per-task top-N, no full sort."""
    return df.orderBy(F.col(time).desc(), *ties).limit(_check(limit))


def latest_per_key(
    df: DataFrame, keys: list[str], limit: int = params.ROW_LIMIT, ties: tuple[str, ...] = (), time: str = "time"
) -> DataFrame:
    """Newest rows of every key."""
    return ranked(df, keys, limit, ties, time).drop("rank")


def latest_row(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """The newest row per key by aggregation: no sort, partial before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order: Column = F.struct(time, *[c for c in rest if c != time])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def ranked(
    df: DataFrame, keys: list[str], limit: int | None = params.ROW_LIMIT, ties: tuple[str, ...] = (), time: str = "time"
) -> DataFrame:
    """Recency rank per key, 1 = newest, of the newest ``limit`` rows (None: of all).

    The rank filter is also applied before the shuffle, so a hot key sends at most
    ``limit`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), *ties)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("rank") <= _check(limit))


def oldest_pending(outbox: DataFrame, limit: int = params.OUTBOX_PAGE, ties: tuple[str, ...] = ()) -> DataFrame:
    return (
        outbox.filter(F.col("status") == params.PENDING).orderBy("time", *ties).limit(_check(limit))
    )
