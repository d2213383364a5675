"""Daily analyses that are computed once: variation, anomalies with their neighbours, trends.

Each reads stored rows and computes only the days that were never asked for with the same
parameters (``jobs.read_through``). Anomalies build on the stored variation. What belongs to one
anomaly, its neighbours, is stored in pages of bounded size beside it; the series of a trend have at
most as many days as asked for and stay in its row.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterfold import params
from meterfold.operators import analysis, filters, series, spatial
from meterfold.plans import jobs
from meterfold.sources import tables

ALL_REGIONS = "(all)"
PAGE = 1000


def yearly_variation(spark: SparkSession, path: str, macro_daily: DataFrame, days: list[dt.date], now: dt.datetime, region: str | None = None) -> DataFrame:
    rows = macro_daily if region is None else filters.by_key(macro_daily, region_name=region)

    def compute(todo: list[dt.date]) -> DataFrame:
        return analysis.yearly_variation(rows, min(todo), max(todo)).filter(F.col("day").isin(todo))

    return jobs.read_through(spark, f"{path}/variation", days, {"region": region or ALL_REGIONS}, compute, now)


def neighbour_pages(around: DataFrame, size: int = PAGE) -> DataFrame:
    """The rows of ``analysis.neighbour_variations`` as arrays of at most ``size``, numbered from 0."""
    keys = [*analysis.KEYS, "day"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("neighbour_region", "neighbour"))
    item = F.struct("neighbour_region", "neighbour", "current", "previous", "delta_perc")
    paged = around.withColumn("page", F.floor((place - 1) / size).cast("int"))
    return paged.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias("neighbours"))


def variation_against_neighbours(
    spark: SparkSession, path: str, macro_daily: DataFrame, places: DataFrame, radius_m: float, days: list[dt.date], now: dt.datetime,
    region: str | None = None, page: int = PAGE,
) -> tuple[DataFrame, DataFrame]:
    """Anomalies, and their neighbours by page; ``region`` limits the judged macrozones, not the neighbours."""
    asked = {"radius_m": radius_m, "region": region or ALL_REGIONS}

    def compute(todo: list[dt.date]) -> DataFrame:
        variations = yearly_variation(spark, path, macro_daily, todo, now).drop("region")
        pairs = spatial.neighbours(places, radius_m)
        if region is not None:
            pairs = filters.by_key(pairs, region_name=region)
        tables.save_analysis(neighbour_pages(analysis.neighbour_variations(variations, pairs), page), f"{path}/anomaly_neighbours", asked)
        return analysis.anomalies(variations, pairs)

    found = jobs.read_through(spark, f"{path}/anomalies", days, asked, compute, now)
    pages = tables.read_or_none(spark, f"{path}/anomaly_neighbours")
    if pages is None:  # no day has a neighbour yet
        pages = neighbour_pages(analysis.neighbour_variations(yearly_variation(spark, path, macro_daily, days, now).drop("region"), spatial.neighbours(places, radius_m))).limit(0)
        pages = pages.withColumns({name: F.lit(value) for name, value in asked.items()})
    return found, pages.filter(jobs.same_parameters(asked) & F.col("day").isin(days))


def trend_similarity(
    spark: SparkSession, path: str, macro_daily: DataFrame, region_daily: DataFrame, dates: list[dt.date], now: dt.datetime,
    days: int = params.TREND_DAYS, region: str | None = None,
) -> DataFrame:
    """Trends up to each of the dates, with their series."""
    if region is not None:
        macro_daily, region_daily = (filters.by_key(d, region_name=region) for d in (macro_daily, region_daily))

    def compute(todo: list[dt.date]) -> DataFrame:
        found = [series.trend_similarity(macro_daily, region_daily, date, days, series=True) for date in todo]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    return jobs.read_through(spark, f"{path}/trends", dates, {"days": days, "region": region or ALL_REGIONS}, compute, now)
