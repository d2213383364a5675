"""Connected components of an edge list, by alternating star contractions.

Each round points every node's larger neighbours, then its smaller ones, at the smallest of
them; about log(n) rounds leave each node tied to the smallest node of its component. Rounds
are written to the shared folder, so lineage stays short. Minima are aggregated before the
shuffle; the joins are left to Spark, which splits hot keys.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterfold.llm.common import stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none of its own: nothing is left to do."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long) that is not the smallest of its component."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(ordered, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.unionByName(now.join(lowest, "a").select("a", F.col("_m").alias("b"))).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lowest, "a").filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        turned = small.unionByName(lowest.select("a", F.col("_m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = stored(turned.distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
