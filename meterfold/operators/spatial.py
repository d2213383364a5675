"""Spatial searches."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterfold import params
from meterfold.functions import geo

_ROWS_PER_BLOCK = 2_000
#: Smaller where each pair within reach costs an exact distance.
_POINTS_PER_BLOCK = 500


def near_point(macrozones: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Macrozones whose polygon contains the point or lies within the radius, with ``distance_m``.

    A box test on the vertices skips the exact geometry of far polygons; it is used
    only where the box wraps neither a pole nor the date line.
    """
    if radius_m < 0:
        raise ValueError("radius must not be negative")
    reach = math.degrees(radius_m / 1000 / params.EARTH_RADIUS_KM) * 1.001 + 1e-9
    la, lo = F.lit(float(lat)), F.lit(float(lon))
    out = macrozones
    if abs(lat) + reach < 89:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(reach, 90))) / math.cos(math.radians(lat)))))
        wide = wide * 1.001 + 1e-9
        lats, lons = F.col("ring.lat"), F.col("ring.lon")
        out = out.filter((F.array_max(lats) >= lat - reach) & (F.array_min(lats) <= lat + reach))
        if abs(lon) + wide < 180:
            out = out.filter((F.array_max(lons) >= lon - wide) & (F.array_min(lons) <= lon + wide))
    out = out.withColumn("distance_m", geo.distance_m(F.col("ring"), lo, la))
    return out.filter(F.col("distance_m") <= radius_m)


def _touches_sphere(cells: list[str], side: float | Column) -> Column:
    """Whether a cube can hold a point of the unit sphere; skips most of the 27 cubes around a place."""
    nearest, farthest = F.lit(0.0), F.lit(0.0)
    for c in cells:
        lo = F.col(c) * side - 1
        hi = lo + side
        lo2, hi2 = lo * lo, hi * hi
        nearest = nearest + F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(lo2, hi2))
        farthest = farthest + F.greatest(lo2, hi2)
    return (nearest <= 1 + 1e-9) & (farthest >= 1 - 1e-9)


def _blocked_join(probe: DataFrame, build: DataFrame, cells: list[str], rows_per_block: int) -> DataFrame:
    """Equi-join on cells whose crowded ones are cut into blocks on both sides; both have a hash ``_h``.

    Every pair of blocks of a cell meets once, so no join key holds more than about
    ``rows_per_block`` rows of a side.
    """
    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*cells).agg(F.ceil(F.count("*") / rows_per_block).alias(name))

    blocks = counted(probe, "_probes").join(counted(build, "_builds"), cells)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    probe = probe.join(blocks, cells).withColumn("_p", F.pmod("_h", "_probes")).withColumn("_b", every("_builds"))
    build = build.join(blocks, cells).withColumn("_b", F.pmod("_h", "_builds")).withColumn("_p", every("_probes"))
    extra = ["_h", "_probes", "_builds"]
    return probe.drop(*extra).join(build.drop(*extra), [*cells, "_p", "_b"]).drop("_p", "_b")


#: Cubes of level n are 4 / 2**n wide; level 0 holds the whole sphere.
_LEVELS = 30
_CELL = ["_level", "_cx", "_cy", "_cz"]


def _ball(lat: Column, lon: Column, radians: Column) -> list[Column]:
    """A cap of the sphere: its centre as a unit vector, its reach as a chord and the level whose cubes are twice as wide."""
    chord = 2 * F.sin(F.least(radians, F.lit(math.pi)) / 2) * (1 + 1e-9) + 1e-9
    x, y, z = geo.unit_vector(lat, lon)
    level = F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.floor(F.log2(2 / chord)))).cast("int")
    return [x.alias("_x"), y.alias("_y"), z.alias("_z"), chord.alias("_chord"), level.alias("_own")]


def _caps_meet(left: str, right: str) -> Column:
    """Whether two caps can share a point: chords add up to at least that of the summed angles."""
    apart = F.lit(0.0)
    for c in ("_x", "_y", "_z"):
        d = F.col(left + c) - F.col(right + c)
        apart = apart + d * d
    both = F.col(left + "_chord") + F.col(right + "_chord")
    return F.nanvl(apart, F.lit(0.0)) <= both * both


def _in_cubes(df: DataFrame) -> DataFrame:
    df = df.withColumn("_side", 4 / F.pow(F.lit(2.0), F.col("_level")))
    return df.withColumns({c: F.floor((F.col(v) + 1) / F.col("_side")).cast("long") for c, v in zip(_CELL[1:], ("_x", "_y", "_z"))})


def _with_touching(df: DataFrame) -> DataFrame:
    """Every row for its cube and those around it that the sphere passes."""
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for c in _CELL[1:]:
        df = df.withColumn("_d", F.explode(around)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    return df.filter(_touches_sphere(_CELL[1:], F.col("_side")))


def near_points(points: DataFrame, macrozones: DataFrame, rows_per_block: int = _POINTS_PER_BLOCK) -> DataFrame:
    """For many points at once the macrozones that contain them or lie within their radius.

    ``points`` has point_id, lat, lon, radius_m; the result has point_id, region_name, name and
    distance_m, 0 inside. Points without a place or a radius that is no distance find nothing.

    Points and polygons are put into caps of the unit sphere, which knows no pole and no date line.
    A cap belongs to cubes at least twice as wide as its reach; a pair meets at the coarser level of
    its two sides, in the same or a touching cube. So a small radius costs little beside a large one,
    and every pair is tested once. Crowded cubes are cut into blocks. Most pairs of a cube and those around
    it are too far apart; their caps say so, and only the rest get the exact distance, once.
    """
    given = points.select("point_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("radius_m").cast("double").alias("radius_m"))
    given = given.filter("lat IS NOT NULL AND lon IS NOT NULL AND radius_m >= 0 AND NOT isnan(radius_m)")
    # A point is a short row with much to do: a small file of them is dealt out first.
    given = given.repartition("point_id", "lat", "lon")
    reach = F.col("radius_m") / 1000 / params.EARTH_RADIUS_KM
    asking = given.select("*", *_ball(F.col("lat"), F.col("lon"), reach), F.xxhash64("point_id", "lat", "lon").alias("_h"))

    lats, lons = F.col("ring.lat"), F.col("ring.lon")
    south, north, west, east = F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons)
    mid = (south + north) / 2
    # From the middle along its parallel, then along a meridian: no point of the box is farther. Edges
    # that pass the date line leave the box, so such a polygon may lie anywhere on its parallels.
    wide = F.when(east - west > 180, F.lit(360.0)).otherwise(east - west)
    covered = F.radians((north - south) / 2) + F.radians(wide / 2) * F.cos(F.radians(mid)) + 1e-6
    zones = macrozones.filter("ring IS NOT NULL").select(
        "region_name", "name", "ring", *_ball(mid, (west + east) / 2, covered), F.xxhash64("region_name", "name").alias("_h")
    )

    def levels(df: DataFrame) -> list[int]:
        return sorted(r._own for r in df.select("_own").distinct().collect())  # at most 31

    def coarser(df: DataFrame, found: list[int], strictly: bool) -> DataFrame:
        """Rows at every level of the other side that is not finer than their own."""
        at = F.filter(F.array(*[F.lit(n) for n in found]), lambda n: (n < F.col("_own")) if strictly else (n <= F.col("_own")))
        return _in_cubes(df.withColumn("_level", F.explode(at)))

    def at_own(df: DataFrame) -> DataFrame:
        return _with_touching(_in_cubes(df.withColumn("_level", F.col("_own"))))

    def sided(df: DataFrame, prefix: str) -> DataFrame:
        return df.drop("_own", "_side").withColumnsRenamed({c: prefix + c for c in ("_x", "_y", "_z", "_chord")})

    wider = _blocked_join(sided(at_own(asking), "p"), sided(coarser(zones, levels(asking), False), "z"), _CELL, rows_per_block)
    finer = _blocked_join(sided(at_own(zones), "z"), sided(coarser(asking, levels(zones), True), "p"), _CELL, rows_per_block)
    met = wider.filter(_caps_meet("p", "z")).unionByName(finer.filter(_caps_meet("p", "z")))
    # An exploded array of one value instead of a filter, which would take the distance twice.
    near = F.filter(F.array(geo.distance_m(F.col("ring"), F.col("lon"), F.col("lat"))), lambda d: d <= F.col("radius_m"))
    return met.select("point_id", "region_name", "name", F.explode(near).alias("distance_m"))


def neighbours(places: DataFrame, radius_m: float, rows_per_block: int = _ROWS_PER_BLOCK) -> DataFrame:
    """Ordered pairs of differently named places whose centres are within the radius.

    ``places`` has region_name, name, lat, lon. Positions become points on the unit
    sphere and are put into cubes as wide as the chord of the radius, so partners lie in
    the same or a touching cube: one equi-join with an exact test, for every radius and
    without special cases at the poles or the date line. Cubes are cut into blocks of about
    ``rows_per_block`` places on both sides, so no join key holds more than about that many
    rows of a side.
    """
    if radius_m < 0:
        raise ValueError("radius must not be negative")
    angle = min(radius_m / 1000 / params.EARTH_RADIUS_KM, math.pi)
    side = max(2 * math.sin(angle / 2), 1e-9) * (1 + 1e-9) + 1e-12
    x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
    # Shifting by 1 keeps the cube numbers non-negative.
    cube = [F.floor((c + 1) / side).cast("long") for c in (x, y, z)]
    at = places.select(
        "region_name", "name", "lat", "lon", *[c.alias(n) for c, n in zip(cube, ("cx", "cy", "cz"))],
        F.xxhash64("region_name", "name").alias("h"),
    )
    cells = ["cx", "cy", "cz"]
    build = at.withColumnsRenamed({"region_name": "neighbour_region", "name": "neighbour", "lat": "lat2", "lon": "lon2"})
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    probe = at
    for c in cells:
        probe = probe.withColumn("_d", F.explode(around)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    probe = probe.filter(_touches_sphere(cells, side))

    counts = at.groupBy(*cells).count()
    blocks = counts.select(*cells, F.ceil(F.col("count") / rows_per_block).alias("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    mine = F.pmod("h", "blocks")
    build = build.join(blocks, cells).withColumn("b", mine).withColumn("p", every).drop("blocks")
    probe = probe.join(blocks, cells).withColumn("p", mine).withColumn("b", every).drop("blocks")
    on = [*cells, "p", "b"]
    probe, build = probe.drop("h"), build.drop("h")
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) * 1000
    return (
        probe.join(build, on)
        .filter(F.col("name") != F.col("neighbour"))
        .withColumn("distance_m", d)
        .filter(F.col("distance_m") <= radius_m)
        .select("region_name", "name", "neighbour_region", "neighbour", "distance_m")
    )
