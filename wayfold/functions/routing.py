"""A walking profile over tags as Column expressions: where and how fast one may walk, and what turns cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.tags import tag

# Fixed values of the profile: kilometres an hour, seconds, tag values.
WALK, FERRY, SIGNAL_S, U_TURN_S = 5.0, 5.0, 2.0, 2.0
SPEEDS = {
    "highway": ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "road", "living_street", "service", "track", "path", "steps", "pedestrian", "platform", "footway", "pier"),
    "railway": ("platform",), "amenity": ("parking", "parking_entrance"), "man_made": ("pier",), "leisure": ("track",),
}
SURFACES = {"fine_gravel": 0.75, "gravel": 0.75, "pebblestone": 0.75, "mud": 0.5, "sand": 0.5}
ALLOWED, FORBIDDEN = ("yes", "foot", "permissive", "designated"), ("no", "agricultural", "forestry", "private", "delivery")
BARRIERS, AVOIDED = ("yes", "wall", "fence"), ("impassable", "proposed")
ACCESS = ("foot", "access")


def first_value(tags: Column, keys) -> Column:
    """The value of the first key that has one."""
    return F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in keys])


def directed(tags: Column, key: str) -> tuple[Column, Column]:
    """``key:forward`` and ``key:backward``, each else ``key``."""
    plain = F.nullif(tag(tags, key), F.lit(""))
    return tuple(F.coalesce(F.nullif(tag(tags, f"{key}:{way}"), F.lit("")), plain) for way in ("forward", "backward"))


def by_table(tags: Column, table: dict) -> Column:
    """The constant of the first key whose value is in its table."""
    out = F.lit(None).cast("double")
    for key, values in reversed(table.items()):
        out = F.when(tag(tags, key).isin(*values), F.lit(WALK)).otherwise(out)
    return out


def barrier(tags: Column) -> Column:
    """A node that stops: forbidden, or a blocking barrier without an access tag, but no rising bollard."""
    access = first_value(tags, ACCESS)
    stops = tag(tags, "barrier").isin(*BARRIERS) & (tag(tags, "bollard") != "rising")
    return F.when(access.isNotNull(), access.isin(*FORBIDDEN)).otherwise(stops)


def traffic_light(tags: Column) -> Column:
    return tag(tags, "highway") == "traffic_signals"


def turn_seconds(u_turn: Column, light: Column) -> Column:
    """A light's penalty stands instead of a turn's."""
    return F.when(light, SIGNAL_S).when(u_turn, U_TURN_S).otherwise(0.0)


def metres(text: Column) -> Column:
    """Metres of ``4``, ``4.5 m``, ``12 ft`` or ``10'6"``; null for anything else."""
    t = F.lower(F.trim(text))
    feet, inches = F.regexp_extract(t, r"^(\d+)\s*'", 1), F.regexp_extract(t, r"'\s*(\d+)\s*\"", 1)
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    by_feet = F.coalesce(feet.try_cast("double"), F.lit(0.0)) * 0.3048 + F.coalesce(inches.try_cast("double"), F.lit(0.0)) * 0.0254
    return F.when(feet != "", by_feet).when(F.endswith(t, F.lit("ft")), n * 0.3048).otherwise(n)


def kilograms(text: Column) -> Column:
    """Kilograms of ``3.5`` or ``3.5 t`` (tonnes), ``7000 lbs`` or ``7500 kg``."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.endswith(t, F.lit("kg")), n).when(F.endswith(t, F.lit("lbs")), n * 0.45359237).otherwise(n * 1000)


def kmh(text: Column) -> Column:
    """Kilometres an hour of ``50``, ``50 km/h`` or ``30 mph``."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.contains(t, F.lit("mph")), n * 1.609344).otherwise(n)


def profile(tags: Column) -> Column:
    """Struct of a way: forward and backward (whether it may be walked that way), kmh, name, roundabout,
    startpoint. Null where the way is not for walking: no tag that says so, blocked, avoided or forbidden."""
    access = first_value(tags, ACCESS)
    ferry, movable = tag(tags, "route") == "ferry", tag(tags, "bridge") == "movable"
    known = by_table(tags, SPEEDS)
    blocked = (tag(tags, "highway").isin(*AVOIDED) | tag(tags, "impassable").isin("yes") | (tag(tags, "status") == "impassable") | (tag(tags, "area") == "yes") & known.isNull()) | (tag(tags, "oneway") == "reversible")
    base = F.when(ferry, FERRY).when(movable & known.isNull(), WALK).otherwise(F.coalesce(known, F.when(access.isin(*ALLOWED), WALK)))
    surface = F.lit(1.0)
    for value, share in SURFACES.items():
        surface = F.when(tag(tags, "surface") == value, share).otherwise(surface)
    way = tag(tags, "oneway:foot")
    forward, backward = way != "-1", ~way.isin("yes", "1", "true")
    usable = base.isNotNull() & ~blocked & ~F.coalesce(access.isin(*FORBIDDEN), F.lit(False))
    out = F.struct(
        forward.alias("forward"), backward.alias("backward"), F.least(base, base * surface).alias("kmh"), F.concat_ws(" / ", F.nullif(tag(tags, "name"), F.lit("")), F.nullif(tag(tags, "ref"), F.lit(""))).alias("name"),
        tag(tags, "junction").isin("roundabout", "circular").alias("roundabout"), (~(ferry | movable)).alias("startpoint"),
    )
    return F.when(usable, out)
