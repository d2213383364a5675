"""Series analysis per key over daily rows.

A key's series has one row per day, so the windows below hold a calendar's worth of
rows however large the facts are.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold import params
from meterfold.functions.scalars import nan_to_zero
from meterfold.operators import filters


def _smooth(keys: list[str], order: str, width: int):
    """(n, position, function to smooth a column, keep flag) for full windows only."""
    per_key = Window.partitionBy(*keys)
    ordered = per_key.orderBy(order)
    n, pos = F.count(F.lit(1)).over(per_key), F.row_number().over(ordered)
    if width <= 1:
        return n, pos, lambda c: c, F.lit(True)
    frame = ordered.rowsBetween(0, width - 1)
    # A series shorter than the window stays as it is.
    smooth = lambda c: F.when(F.col("_n") < width, c).otherwise(F.avg(c).over(frame))
    keep = (F.col("_n") < width) | (F.col("_pos") <= F.col("_n") - width + 1)
    return n, pos, smooth, keep


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int = params.TREND_WIDTH) -> DataFrame:
    """Mean of each full window, at the position of its first row (n - width + 1 rows per key)."""
    n, pos, smooth, keep = _smooth(keys, order, width)
    out = df.withColumn("_n", n).withColumn("_pos", pos).withColumn("smoothed", smooth(F.col(value)))
    return out.filter(keep).drop("_n", "_pos")


def _slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    return F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))


def _pearson(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.coalesce(F.try_divide(n * sxy - sx * sy, den), F.lit(0.0))


def slope(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Least-squares slope of the series against 0..n-1; 0 where undefined."""
    i, y = F.col("_i"), F.col(value).cast("double")
    pos = (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("double")
    return df.withColumn("_i", pos).groupBy(*keys).agg(
        _slope(F.count(y), F.sum(i), F.sum(y), F.sum(i * y), F.sum(i * i)).alias("slope")
    )


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation; 0 for a constant series."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        _pearson(F.count(F.lit(1)), F.sum(a), F.sum(b), F.sum(a * b), F.sum(a * a), F.sum(b * b)).alias("correlation")
    )


def _relative(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.abs(a - b) / F.abs(b)).otherwise(F.lit(0.0))


def mean_relative_difference(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean of |a-b|/|b|; rows with b = 0 add nothing but count."""
    return df.groupBy(*keys).agg(
        (F.sum(_relative(F.col(a), F.col(b))) / F.count(F.lit(1))).alias("divergence")
    )


def aligned_days(macro_daily: DataFrame, region_daily: DataFrame) -> DataFrame:
    """Days present in both the macrozone's and its region's daily series."""
    stats = ["min_value", "max_value", "avg_value", "total_sum", "total_count"]
    region = region_daily.select("region_name", "type", "day", F.struct(*stats).alias("r"))
    return macro_daily.select(
        "region_name", "macrozone_name", "type", "day", F.struct(*stats).alias("m")
    ).join(region, ["region_name", "type", "day"])


def trend_similarity(
    macro_daily: DataFrame, region_daily: DataFrame, date: dt.date, days: int = params.TREND_DAYS,
    width: int = params.TREND_WIDTH, series: bool = False,
) -> DataFrame:
    """Macrozone trend against region trend over the last ``days`` days up to ``date``.

    ``series=True`` adds the aligned daily rows as sorted arrays of at most ``days`` elements.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    span = filters.in_days("day", date - dt.timedelta(days=days - 1), date)
    keys = ["region_name", "macrozone_name", "type"]
    n, pos, smooth, keep = _smooth(keys, "day", width)
    rows = (
        aligned_days(macro_daily.filter(span), region_daily.filter(span))
        .withColumn("_n", n).withColumn("_pos", pos)
        .withColumn("_x", smooth(F.col("m.avg_value"))).withColumn("_y", smooth(F.col("r.avg_value")))
        .withColumn("_keep", keep)
    )
    # Positions restart at 0; dropped tail rows become null and leave every sum.
    x, y = F.when(F.col("_keep"), F.col("_x")), F.when(F.col("_keep"), F.col("_y"))
    i = F.when(F.col("_keep"), (F.col("_pos") - 1).cast("double"))
    cnt, si, sii = F.count(x), F.sum(i), F.sum(i * i)
    relative = F.when(F.col("_keep"), _relative(F.col("_x"), F.col("_y")))
    aggs = [
        nan_to_zero(_pearson(cnt, F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x), F.sum(y * y))).alias("correlation"),
        nan_to_zero(_slope(cnt, si, F.sum(x), F.sum(i * x), sii)).alias("slope_macro"),
        nan_to_zero(_slope(cnt, si, F.sum(y), F.sum(i * y), sii)).alias("slope_region"),
        nan_to_zero(F.sum(relative) / cnt).alias("divergence"),
    ]
    if series:
        aggs += [
            F.sort_array(F.collect_list(F.struct("day", "m.*"))).alias("macrozone_series"),
            F.sort_array(F.collect_list(F.struct("day", "r.*"))).alias("region_series"),
        ]
    return rows.groupBy(*keys).agg(*aggs).withColumn("day", F.lit(date))
