"""Parsing of coordinates, elevations and labels as Column expressions; null where malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Decimal degrees, negative in the south and west."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def lat_lon(text: Column) -> tuple[Column, Column]:
    """The numbers of ``lat,lon``; both null unless there are two."""
    parts = F.split(text, ",")
    lat, lon = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(good, lat), F.when(good, lon)


def elevation(tags: Column) -> Column:
    """First token of ``ele``, else of ``elevation``, that is a number."""
    return F.coalesce(*[F.get(F.split(F.trim(F.get(F.array(tags[k]), F.lit(0))), r"\s+"), F.lit(0)).try_cast("double") for k in ("ele", "elevation")])


def collapsed(text: Column, default: str) -> Column:
    """White space as single spaces, none at the ends; ``default`` for null and empty."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")), F.lit(default))


def endpoint_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", F.round(lat, 6), F.round(lon, 6))


def is_crossing(tags: Column) -> Column:
    """A footway that is a crossing or an island, or any ``crossing`` but ``no``."""
    return F.coalesce(tags["footway"].isin("crossing", "traffic_island"), F.lit(False)) | F.coalesce(tags["crossing"] != "no", F.lit(False))


def is_park(tags: Column) -> Column:
    return F.coalesce(tags["leisure"].isin("park", "garden"), F.lit(False)) | F.coalesce(tags["landuse"] == "recreation_ground", F.lit(False))
