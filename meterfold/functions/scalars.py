"""Small column expressions used by the operators."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterfold import params


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent; null when there is nothing to compare with (null or 0)."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def ratio_or_null(total: Column, n: Column) -> Column:
    return F.try_divide(total, n)


def ratio_or_zero(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def nan_to_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def direction(slope: Column, epsilon: float = params.SLOPE_EPSILON) -> Column:
    return F.when(slope > epsilon, "up").when(slope < -epsilon, "down").otherwise("flat")


def sign_label(delta: Column) -> Column:
    return F.when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("stable")


def diverges(divergence: Column, limit: float = params.DIVERGENCE_LIMIT) -> Column:
    return F.coalesce(divergence > limit, F.lit(False))


def is_alive(last_seen: Column, now: dt.datetime, within_seconds: int = params.CARD_ALIVE_WITHIN) -> Column:
    oldest = F.lit(now - dt.timedelta(seconds=within_seconds)).cast("timestamp_ntz")
    return F.coalesce(last_seen > oldest, F.lit(False))


def contains_text(query: str, *cols: str) -> Column:
    """Case-insensitive substring over all given columns joined by one space."""
    joined = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))
    return joined.contains(query.lower())
