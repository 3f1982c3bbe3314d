"""Geometry and geodesy as Column expressions; angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two mean Earth radii, metres per degree of latitude, a trace box (lon, lat, lon, lat).
EARTH_RADIUS_M = 6371008.8
EARTH_RADIUS_ROUND_M = 6371000.0
METERS_PER_DEGREE_LAT = 111320.0
VIETNAM_BBOX = (102.0, 8.0, 110.0, 24.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * F.lit(radius) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    """Difference of two bearings without direction, in [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    folded = F.least(d, 360 - d)
    return F.least(folded, 180 - folded)


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    """Equirectangular metres about an origin."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * F.lit(radius), F.radians(lat - lat0) * F.lit(radius)


def heading_change(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed turn from leg a to leg b; null if a leg is shorter than a metre."""
    long_enough = (F.hypot(ax, ay) >= 1) & (F.hypot(bx, by) >= 1)
    return F.when(long_enough, F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def in_bbox(lat: Column, lon: Column, box=VIETNAM_BBOX) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment, and where its foot lies on it (0 to 1)."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / squared))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy)), t


def signed_offset(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to the line through a segment, positive on its left."""
    dx, dy = bx - ax, by - ay
    return (dx * (py - ay) - dy * (px - ax)) / F.hypot(dx, dy)


def ring_area(xs: Column, ys: Column) -> Column:
    """Absolute shoelace area of a ring given as two arrays (closed or not)."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, F.pmod(i + 1, n)) - F.get(xs, F.pmod(i + 1, n)) * F.get(ys, i))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2)


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against an array of (lat, lon) structs; the last place joins the first."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def segments_cross(a, b, c, d) -> Column:
    """Whether two segments of (x, y) pairs of Columns cross within both."""

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
