"""Ellipsoidal geodesics, transverse Mercator, and the encodings of lines and colours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM projection.
A, FLAT = 6378137.0, 1 / 298.257223563
K0, FALSE_EAST, FALSE_SOUTH = 0.9996, 500000.0, 10000000.0
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))
SPIRAL_STEP = 80.0

_B = A * (1 - FLAT)
_N = FLAT / (2 - FLAT)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def inverse(lat1, lon1, lat2, lon2):
    """Arrays of the distance in metres and the azimuth at the start, in [0, 360). Iterated until it
    settles; nearly antipodal points, where it does not, get NaN. Equal points: 0 and 0."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2, big_l = np.arctan((1 - FLAT) * np.tan(lat1)), np.arctan((1 - FLAT) * np.tan(lat2)), lon2 - lon1
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = big_l.copy() if hasattr(big_l, "copy") else big_l
    with np.errstate(all="ignore"):
        for _ in range(200):
            x, y = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
            ss, cs = np.hypot(x, y), s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * np.sin(lam) / ss, 0.0)
            c2a = 1 - sa**2
            c2m = np.where(c2a > 1e-15, cs - 2 * s1 * s2 / c2a, 0.0)
            c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
            new = big_l + (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            moved = np.abs(new - lam)
            lam = new
            if not (moved > 1e-13).any():
                break
        a, b = _series(c2a)
        distance = _B * a * (sigma - _bend(b, ss, cs, c2m))
        azimuth = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))) % 360
    settled = moved <= 1e-9
    return np.where(settled, np.where(ss > 0, distance, 0.0), np.nan), np.where(settled, np.where(ss > 0, azimuth, 0.0), np.nan)


def direct(lat, lon, azimuth, metres):
    """Arrays of the latitude and longitude ``metres`` away at ``azimuth`` degrees."""
    lat, azimuth, metres = (np.asarray(x, float) for x in (lat, azimuth, metres))
    a1, u = np.radians(azimuth), np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    su, cu, sa1, ca1 = np.sin(u), np.cos(u), np.sin(a1), np.cos(a1)
    first, sa = np.arctan2(np.tan(u), ca1), cu * sa1
    c2a = 1 - sa**2
    a, b = _series(c2a)
    base = metres / (_B * a)
    sigma = base
    for _ in range(50):
        c2m = np.cos(2 * first + sigma)
        sigma = base + _bend(b, np.sin(sigma), np.cos(sigma), c2m)
    c2m, ss, cs = np.cos(2 * first + sigma), np.sin(sigma), np.cos(sigma)
    lat2 = np.arctan2(su * cs + cu * ss * ca1, (1 - FLAT) * np.hypot(sa, su * ss - cu * cs * ca1))
    lam = np.arctan2(ss * sa1, cu * cs - su * ss * ca1)
    c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
    big_l = lam - (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return np.degrees(lat2), (np.asarray(lon, float) + np.degrees(big_l) + 540) % 360 - 180


def _series(c2a):
    u = c2a * (A**2 - _B**2) / _B**2
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _bend(b, ss, cs, c2m):
    return b * ss * (c2m + b / 4 * (cs * (2 * c2m**2 - 1) - b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))


def _pair(fn, schema: str):
    @F.arrow_udf(schema)
    def run(a, b, c, d):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.removeprefix("struct<").removesuffix(">").replace(":", " ").split(",")]
        values = fn(*(x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (a, b, c, d)))
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), from_pandas=True) for v in values], names)

    return run


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct of metres and azimuth; null fields where a coordinate is null or the points are antipodal."""
    return _pair(inverse, "struct<metres:double,azimuth:double>")(lat1, lon1, lat2, lon2)


def destination(lat: Column, lon: Column, azimuth: Column, metres: Column) -> Column:
    """Struct of lat and lon."""
    return _pair(direct, "struct<lat:double,lon:double>")(lat, lon, azimuth, metres)


def circle(lat: float, lon: float, metres: float, n: int = 32) -> list[tuple[float, float]]:
    """(lat, lon) of a ring of ``n`` places at a distance, closed."""
    la, lo = direct(np.full(n, lat), np.full(n, lon), np.arange(n) * 360 / n, np.full(n, metres))
    ring = list(zip(la.tolist(), lo.tolist(), strict=True))
    return [*ring, ring[0]]


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6) + 1


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone, by series of the third order: whole-stage code, no Python."""
    e = math.sqrt(FLAT * (2 - FLAT))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(s) - F.lit(e) * atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = K0 * _RECT
    return F.lit(FALSE_EAST) + F.lit(k) * east, F.when(lat < 0, FALSE_SOUTH).otherwise(0.0) + F.lit(k) * north


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a zone's easting and northing."""
    k = K0 * _RECT
    xi0, eta0 = (north - F.when(south, FALSE_SOUTH).otherwise(0.0)) / F.lit(k), (east - FALSE_EAST) / F.lit(k)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(b) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(phi), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def utm_arrays(lat, lon, zone=None):
    """``to_utm`` of arrays, in the zone of the first point unless one is given."""
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    zone = math.floor((lon[0] + 180) / 6) + 1 if zone is None else zone
    e = math.sqrt(FLAT * (2 - FLAT))
    s, lam = np.sin(np.radians(lat)), np.radians(lon - (zone * 6 - 183))
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return np.stack([FALSE_EAST + K0 * _RECT * east, np.where(lat < 0, FALSE_SOUTH, 0.0) + K0 * _RECT * north], 1)


def decoded(line: str, precision: int = 5) -> list[tuple[float, float]]:
    """(lat, lon) of an encoded polyline; raises if it breaks off."""
    out, at, total = [], 0, [0, 0]
    while at < len(line):
        for axis in (0, 1):
            value = shift = 0
            while True:
                if at >= len(line):
                    raise ValueError("a polyline breaks off")
                c = ord(line[at]) - 63
                at += 1
                value |= (c & 31) << shift
                shift += 5
                if c < 32:
                    break
            total[axis] += ~(value >> 1) if value & 1 else value >> 1
        out.append((total[0] / 10**precision, total[1] / 10**precision))
    return out


def polyline(text: Column, precision: int = 5) -> Column:
    """Array of lat, lon structs of an encoded polyline; null stays null."""

    @F.arrow_udf("array<struct<lat:double,lon:double>>")
    def decode(column):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
        return pa.array([None if t is None else [{"lat": a, "lon": b} for a, b in decoded(t, precision)] for t in column.to_pylist()], kind)

    return decode(text)


def spiral(i: Column) -> tuple[Column, Column]:
    """Offset of the i-th of a spiral's places; the first is the origin."""
    r = F.lit(SPIRAL_STEP) * F.sqrt(i.cast("double"))
    return r * F.cos(i * F.lit(GOLDEN_ANGLE)), r * F.sin(i * F.lit(GOLDEN_ANGLE))


def map_colour(rgb: Column, alpha: str = "ff") -> Column:
    """``aabbggrr`` of ``#rrggbb``."""
    h = F.lower(F.regexp_replace(rgb, "^#", ""))
    return F.concat(F.lit(alpha), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def name_colour(name: Column) -> Column:
    """A colour that follows from the name."""
    return F.concat(F.lit("#"), F.substring(F.md5(name.cast("binary")), 1, 6))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half to even on the exact binary value, where ``F.round`` goes by the decimal text."""

    @F.arrow_udf("double")
    def run(column):
        import pyarrow as pa

        return pa.array([None if v is None else round(v, digits) for v in column.to_pylist()], pa.float64())

    return run(x)


def retry_size(n: Column, ratio: float = 0.85) -> Column:
    """Points of the next try: fewer by a ratio, one less at least, two at least."""
    return F.greatest(F.lit(2), F.least(n - 1, F.floor(n * F.lit(ratio)))).cast("long")


def even_indices(n: Column, wanted: Column) -> Column:
    """Distinct indices of ``wanted`` places spread evenly over n, first and last included."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(wanted - 1, F.lit(1))).cast("long"))
    return F.when(n <= wanted, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).when(wanted <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(steps))
