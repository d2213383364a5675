"""Geometry on WGS84 degrees as column expressions; a ring is array<struct<lon,lat>>."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterfold import params

_R_KM = params.EARTH_RADIUS_KM


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value taken once; lambdas run without common subexpressions."""
    return F.get(F.transform(F.array(value), body), 0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    # rounding can push a beyond 1 for antipodal points
    a = F.least(a, F.lit(1.0))
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * _R_KM)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def parse_polygon(wkt: Column) -> Column:
    """Outer ring of ``POLYGON((lon lat, ...))``."""
    body = F.regexp_extract(wkt, r"(?i)POLYGON\s*\(\s*\(([^)]*)\)", 1)
    pairs = F.split(F.trim(body), r"\s*,\s*")

    def to_point(p: Column) -> Column:
        xy = F.split(F.trim(p), r"\s+")
        return point(F.get(xy, 0), F.get(xy, 1))

    return F.when(F.length(body) > 0, F.transform(pairs, to_point))


def square(lon0: Column, lat0: Column, side: float) -> Column:
    """Closed ring of an axis-parallel square from its south-west corner."""
    s = F.lit(side)
    return F.array(
        point(lon0, lat0), point(lon0 + s, lat0), point(lon0 + s, lat0 + s),
        point(lon0, lat0 + s), point(lon0, lat0),
    )


def _edges(ring: Column) -> Column:
    """array<struct<a,b>> of consecutive vertices."""
    n = F.size(ring)
    return F.arrays_zip(
        F.slice(ring, F.lit(1), n - 1).alias("a"), F.slice(ring, F.lit(2), n - 1).alias("b")
    )


def centroid(ring: Column) -> Column:
    """Area centroid; offsets from the first vertex keep the digits of small polygons."""
    o = ring[0]
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, e: Column) -> Column:
        ax, ay = e["a"]["lon"] - o["lon"], e["a"]["lat"] - o["lat"]
        bx, by = e["b"]["lon"] - o["lon"], e["b"]["lat"] - o["lat"]
        c = ax * by - bx * ay
        return F.struct(
            (acc["s"] + c).alias("s"),
            (acc["x"] + (ax + bx) * c).alias("x"),
            (acc["y"] + (ay + by) * c).alias("y"),
        )

    def done(acc: Column) -> Column:
        return F.struct(
            (o["lon"] + F.coalesce(F.try_divide(acc["x"], acc["s"] * 3), F.lit(0.0))).alias("lon"),
            (o["lat"] + F.coalesce(F.try_divide(acc["y"], acc["s"] * 3), F.lit(0.0))).alias("lat"),
        )

    return F.aggregate(_edges(ring), zero, step, done)


def _contains(edges: Column, lon: Column, lat: Column) -> Column:
    def on_edge(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        cross = (bx - ax) * (lat - ay) - (by - ay) * (lon - ax)
        return (
            (cross == 0)
            & lon.between(F.least(ax, bx), F.greatest(ax, bx))
            & lat.between(F.least(ay, by), F.greatest(ay, by))
        )

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        at = ax + F.try_divide((lat - ay) * (bx - ax), by - ay)
        return ((ay > lat) != (by > lat)) & F.coalesce(lon < at, F.lit(False))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.exists(edges, on_edge) | odd


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test; the boundary counts as inside."""
    return _contains(_edges(ring), lon, lat)


def distance_m(ring: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to a polygon, 0 inside.

    The nearest point of each edge is found in a projection centred at the query
    point, its distance is measured on the sphere. Each step keeps what the next ones use
    more than once, and only the nearest edge's angle becomes a distance.
    """

    def wrap(d: Column) -> Column:
        return F.pmod(d + 180, F.lit(360.0)) - 180

    def from_point(e: Column, shrink: Column) -> Column:
        east = wrap(e["a"]["lon"] - lon)
        bx = wrap(e["b"]["lon"] - lon) * shrink
        return F.struct(
            east.alias("east"), (east * shrink).alias("ax"), (e["a"]["lat"] - lat).alias("ay"), bx.alias("bx"),
            (e["b"]["lat"] - lat).alias("by"), wrap(e["b"]["lon"] - e["a"]["lon"]).alias("span"),
        )

    def with_course(e: Column) -> Column:
        return F.struct(e["east"].alias("east"), e["ax"].alias("ax"), e["ay"].alias("ay"), e["span"].alias("span"),
                        (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy"))

    def with_foot(e: Column) -> Column:
        t = F.coalesce(F.try_divide(-(e["ax"] * e["dx"] + e["ay"] * e["dy"]), e["dx"] * e["dx"] + e["dy"] * e["dy"]), F.lit(0.0))
        return F.struct(e.alias("e"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)).alias("t"))

    def nearest_point(f: Column) -> Column:
        e, t = f["e"], f["t"]
        return F.struct((lat + e["ay"] + t * e["dy"]).alias("lat"), (lon + e["east"] + t * e["span"]).alias("lon"))

    def half_sines(p: Column) -> Column:
        return F.struct(
            F.sin(F.radians(p["lat"] - lat) / 2).alias("dlat"), F.sin(F.radians(p["lon"] - lon) / 2).alias("dlon"), F.cos(F.radians(p["lat"])).alias("shrink")
        )

    def nearest(edges: Column, shrink: Column) -> Column:
        points = F.transform(F.transform(F.transform(F.transform(edges, lambda e: from_point(e, shrink)), with_course), with_foot), nearest_point)
        # rounding can push the value beyond 1 for antipodal points
        chords = F.transform(F.transform(points, half_sines), lambda h: F.least(h["dlat"] * h["dlat"] + shrink * h["shrink"] * h["dlon"] * h["dlon"], F.lit(1.0)))
        return _let(F.array_min(chords), lambda a: F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * _R_KM) * 1000)

    def from_edges(known: Column) -> Column:
        edges, shrink = known["edges"], known["shrink"]
        return F.when(_contains(edges, lon, lat), F.lit(0.0)).otherwise(nearest(edges, shrink))

    return _let(F.struct(_edges(ring).alias("edges"), F.cos(F.radians(lat)).alias("shrink")), from_edges)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Position on the unit sphere; free of pole and date-line special cases."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
