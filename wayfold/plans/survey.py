"""Queries for further operators over the driver's tables. Where SQL states the same, it is written on its own;
where it cannot, the tests compare with brute force and the query has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold import sinks
from wayfold.functions import geo, geodesy, parse, routing, tags, text
from wayfold.operators import courses, graph, hexgrid, loops, ordered, paths, traces
from wayfold.plans.views import PLACES, REFS, TRACE, view
from wayfold.sources import files, osm, tracks

# What each tag of a place is: (key, modulus, values by remainder). A place has several tags, or none of a key.
_TAGS = {
    "amenity": (7, ("cafe", "bar", "bank", "place_of_worship", "parking", "school")), "shop": (11, ("books", "bakery")), "tourism": (13, ("hotel", "museum", "viewpoint", "attraction", "artwork")),
    "leisure": (17, ("park", "golf_course", "garden", "dance")), "landuse": (19, ("industrial", "commercial", "religious", "grass", "military", "reservoir")), "building": (5, ("house", "school", "temple", "warehouse")),
    "natural": (23, ("water", "beach", "wood", "peak")), "water": (29, ("lake", "pond")), "highway": (3, ("footway", "primary")), "historic": (31, ("memorial", "ruins", "yes")), "religion": (37, ("buddhist", "Christian")),
    "footway": (4, ("crossing", "sidewalk")), "crossing": (6, ("no", "marked")), "layer": (8, ("1", "-2", "x")), "bridge": (9, ("yes", "no")), "tunnel": (10, ("yes",)), "access": (12, ("private", "yes")), "surface": (14, ("sand", "gravel")),
    "ele": (15, ("12 m", "x", "7.5")), "elevation": (16, ("99",)), "name:en": (21, ("Old Gate", "")), "barrier": (22, ("wall", "gate")),
}
_KEYS = list(_TAGS)


def _value(key: str) -> str:
    n, values = _TAGS[key]
    return "CASE id % " + str(n) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_WORDS = "CASE id % 25 WHEN 0 THEN 'Grand Resort' WHEN 1 THEN 'Seafood House' WHEN 2 THEN 'Barber Workshop' WHEN 3 THEN 'Coffee Club' WHEN 4 THEN 'City Hall' WHEN 5 THEN 'Car Park' ELSE name END"
TAGGED = f"SELECT id, lat, lon, size, {_WORDS} AS title, " + ", ".join(f'{_value(k)} AS "{k}"' for k in _KEYS) + f" FROM ({PLACES}) p9"
SPARK_TAGGED = TAGGED.replace('"', "`")


def tagged(spark, sf_dir) -> DataFrame:
    """id, lat, lon, size, title, tags."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    wide = spark.sql(SPARK_TAGGED.replace("FROM part", "FROM {part}"), part=part)
    every = F.create_map(*[x for k in _KEYS for x in (F.lit(k), F.col(f"`{k}`"))])
    return wide.select("id", "lat", "lon", "size", "title", F.map_filter(every, lambda k, v: v.isNotNull()).alias("tags"))


def _in(column: str, values) -> str:
    return f"coalesce({column} IN ({', '.join(repr(v) for v in values)}), false)"


def _says(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(title), '{t}')" for t in terms) + ")"


_WATER = f"({_in('water', tags.WATER_VALUES)} OR {_in('\"natural\"', tags.WATER_NATURAL)} OR {_in('landuse', ('reservoir', 'basin'))} OR {_says(tags.WATER_TERMS)})"


def f_predicates(spark, sf_dir):
    t = F.col("tags")
    kinds = {"interesting": tags.is_interesting(t), "footpath": tags.highway_in(t, tags.FOOTPATH_HIGHWAYS), "crossing": parse.is_crossing(t), "park": parse.is_park(t), "water": tags.is_water(t, F.col("title")), "coast": tags.is_coastline(t)}
    return tagged(spark, sf_dir).select("id", *[v.alias(k) for k, v in kinds.items()])


F_PREDICATES = f"""SELECT id, coalesce(amenity, shop, tourism, leisure, "natural", landuse, building, highway, water, historic, religion) IS NOT NULL AS interesting,
  {_in('highway', tags.FOOTPATH_HIGHWAYS)} AS footpath, {_in('footway', ('crossing', 'traffic_island'))} OR coalesce(crossing <> 'no', false) AS crossing,
  {_in('leisure', ('park', 'garden'))} OR {_in('landuse', ('recreation_ground',))} AS park, {_WATER} AS water, {_in('"natural"', ('coastline', 'beach'))} AS coast FROM ({TAGGED}) t"""


def t4_categories(spark, sf_dir):
    t = F.col("tags")
    rule = tags.poi_rule(t)
    return tagged(spark, sf_dir).select("id", tags.category(t, F.col("title")).alias("category"), rule.alias("poi"), tags.importance(rule).alias("importance"))


_CATEGORY = f"""CASE WHEN leisure = 'golf_course' OR {_says(tags.LUXURY_TERMS)} THEN '{tags.CATEGORIES[0]}' WHEN {_in('tourism', tags.LODGING)} THEN '{tags.CATEGORIES[1]}'
  WHEN {_in('amenity', tags.NIGHT_AMENITIES)} OR {_in('leisure', tags.NIGHT_LEISURE)} THEN '{tags.CATEGORIES[2]}' WHEN {_in('amenity', tags.FOOD_AMENITIES)} OR {_in('shop', tags.FOOD_SHOPS)} THEN '{tags.CATEGORIES[3]}'
  WHEN amenity = 'place_of_worship' OR {_in('building', tags.RELIGIOUS_BUILDINGS)} OR {_in('landuse', tags.RELIGIOUS_LANDUSE)} OR historic <> '' OR {_in('tourism', tags.HISTORIC_TOURISM)} THEN '{tags.CATEGORIES[4]}'
  WHEN {_in('landuse', tags.INDUSTRIAL_LANDUSE)} OR {_in('building', tags.INDUSTRIAL_BUILDINGS)} THEN '{tags.CATEGORIES[5]}'
  WHEN {_in('amenity', tags.CIVIC_AMENITIES)} OR {_in('building', tags.CIVIC_BUILDINGS)} OR landuse = 'military' OR {_says(tags.CIVIC_TERMS)} THEN '{tags.CATEGORIES[6]}'
  WHEN landuse = 'commercial' OR amenity = 'marketplace' OR shop <> '' THEN '{tags.CATEGORIES[7]}' WHEN {_in('amenity', tags.SERVICE_AMENITIES)} THEN '{tags.CATEGORIES[8]}'
  WHEN {_in('"natural"', tags.SCENIC_NATURAL)} OR {_in('water', tags.SCENIC_WATER)} OR tourism = 'viewpoint' THEN '{tags.CATEGORIES[9]}'
  WHEN {_in('leisure', tags.QUIET_LEISURE)} OR {_in('landuse', tags.QUIET_LANDUSE)} THEN '{tags.CATEGORIES[10]}' WHEN {_in('building', tags.HOME_BUILDINGS)} OR {_in('highway', tags.HOME_HIGHWAYS)} THEN '{tags.CATEGORIES[11]}'
  WHEN {_in('highway', tags.ROAD_HIGHWAYS)} OR amenity = 'parking' THEN '{tags.CATEGORIES[12]}' ELSE '{tags.CATEGORIES[8]}' END"""
_POI = """CASE WHEN tourism IN ('viewpoint', 'attraction', 'museum', 'artwork') THEN 'tourism=' || tourism WHEN amenity = 'place_of_worship' THEN 'amenity=place_of_worship' WHEN building = 'temple' THEN 'building=temple'
  WHEN historic IS NOT NULL THEN 'historic=' || historic WHEN "natural" = 'peak' THEN 'natural=peak' END"""
T4_CATEGORIES = f"""SELECT id, category, poi, CASE poi WHEN 'tourism=attraction' THEN 3.0::DOUBLE WHEN 'amenity=place_of_worship' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS importance
  FROM (SELECT id, {_CATEGORY} AS category, {_POI} AS poi FROM ({TAGGED}) t) x"""


def t_names(spark, sf_dir):
    t = F.col("tags")
    rule = tags.poi_rule(t)
    rows = tagged(spark, sf_dir).withColumn("poi", rule).where("poi IS NOT NULL")
    return rows.select("id", text.picked_name(t).alias("picked"), text.display_name(t, F.col("poi")).alias("shown"), text.symbol(F.col("poi"), t).alias("symbol"), text.slug(F.col("title")).alias("slug"), text.style_slug(F.col("title")).alias("style"), parse.elevation(t).alias("ele"))


T_NAMES = f"""SELECT id, coalesce("name:en", 'Unknown') AS picked, coalesce(nullif("name:en", ''), CASE poi WHEN 'amenity=place_of_worship' THEN 'Place Of Worship' ELSE upper(substr(split_part(poi, '=', 2), 1, 1)) || substr(split_part(poi, '=', 2), 2) END) AS shown,
  CASE poi WHEN 'tourism=viewpoint' THEN 'Scenic Area' WHEN 'tourism=attraction' THEN 'Park' WHEN 'tourism=museum' THEN 'Museum' WHEN 'tourism=artwork' THEN 'Museum' WHEN 'natural=peak' THEN 'Summit'
    WHEN 'historic=memorial' THEN 'Bell' WHEN 'historic=ruins' THEN 'Mine' WHEN 'amenity=place_of_worship' THEN CASE WHEN lower(religion) = 'christian' THEN 'Church' ELSE 'Building' END ELSE 'Building' END AS symbol,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 'category-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS style,
  CASE ele WHEN '12 m' THEN 12.0::DOUBLE WHEN '7.5' THEN 7.5::DOUBLE ELSE CAST(elevation AS DOUBLE) END AS ele FROM (SELECT *, {_POI} AS poi FROM ({TAGGED}) t) x WHERE poi IS NOT NULL"""


def t20_path_names(spark, sf_dir):
    street = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Street "), (F.col("id") % 10).cast("string")))
    poi = F.when(F.col("id") % 4 == 0, F.col("title"))
    rows = tagged(spark, sf_dir)
    return rows.select("id", text.path_name((F.col("id") * 7 % 500).cast("double"), poi, street, F.concat(F.lit("cluster_"), F.col("id").cast("string"))).alias("name"), tags.road_grade(F.col("tags")).alias("grade"), parse.collapsed(F.concat(F.lit("  "), F.col("title"), F.lit(" \n x ")), "none").alias("tidy"))


T20_PATH_NAMES = f"""SELECT id, (CASE WHEN id * 7 % 500 < 60 THEN 'Shortcut' WHEN id * 7 % 500 > 400 THEN 'Path' ELSE 'Footpath' END) || CASE WHEN id % 4 = 0 THEN ' near ' || title || CASE WHEN id % 3 = 0 THEN ', off Street ' || id % 10 ELSE '' END
    WHEN id % 3 = 0 THEN ' off Street ' || id % 10 ELSE ' cluster_' || id END AS name,
  CAST(CASE WHEN layer IS NOT NULL THEN CASE layer WHEN '1' THEN 1 WHEN '-2' THEN -2 ELSE 0 END WHEN bridge = 'yes' THEN 1 WHEN tunnel = 'yes' THEN -1 ELSE 0 END AS INTEGER) AS grade,
  trim(regexp_replace(title, '\\s+', ' ', 'g')) || ' x' AS tidy FROM ({TAGGED}) t"""


def t5_projected(spark, sf_dir):
    return tagged(spark, sf_dir).select("id", text.sorted_json(tags.projected(F.col("tags"))).alias("type"))


T5_PROJECTED = (
    "SELECT id, '{' || concat_ws(',', "
    + ", ".join(f"CASE WHEN \"{k}\" IS NOT NULL THEN '\"{k}\":\"' || \"{k}\" || '\"' END" for k in sorted(set(_KEYS) & set(tags.REQUESTED_KEYS)))
    + f") || '}}' AS type FROM ({TAGGED}) t"
)


def t12_descriptions(spark, sf_dir):
    said = F.concat(F.when(F.col("id") % 3 == 0, F.lit('"Visit the ')).when(F.col("id") % 3 == 1, "see ").otherwise(""), F.col("title"), F.lit(" by the gate; more. Text!"))
    return tagged(spark, sf_dir).select("id", text.description(said).alias("description"), text.label(F.when(F.col("id") % 2 == 0, " Lively").otherwise(F.col("title"))).alias("label"), text.vibe(F.concat(F.lit(" `"), F.col("title"), F.lit(" calm.` "))).alias("vibe"))


_SAID = "regexp_extract(CASE WHEN id % 3 = 0 THEN 'the ' ELSE '' END || title || ' by the gate', '^(\\S+\\s+){0,7}\\S+')"
T12_DESCRIPTIONS = f"""SELECT id, {_SAID} AS description, CASE WHEN id % 2 = 0 THEN 'positive' ELSE 'mixed' END AS label, title || ' calm' AS vibe FROM ({TAGGED}) t"""


def l1_profile(spark, sf_dir):
    p = routing.profile(F.col("tags"))
    return tagged(spark, sf_dir).select("id", p["kmh"].alias("kmh"), p["name"].alias("name"), routing.barrier(F.col("tags")).alias("barrier"))


L1_PROFILE = f"""SELECT id, CASE WHEN usable THEN 5.0::DOUBLE * CASE surface WHEN 'sand' THEN 0.5 WHEN 'gravel' THEN 0.75 ELSE 1 END END AS kmh, CASE WHEN usable THEN '' END AS name,
  CASE WHEN access IS NOT NULL THEN access = 'private' ELSE coalesce(barrier = 'wall', false) END AS barrier
  FROM (SELECT *, (highway IN ('footway', 'primary') IS TRUE OR (amenity = 'parking') IS TRUE OR (access = 'yes') IS TRUE) AND (access = 'private') IS NOT TRUE AS usable FROM ({TAGGED}) t) x"""

_SEG = f"""SELECT file, pos, lat, lon, lead(lat) OVER o AS lat2, lead(lon) OVER o AS lon2, lead(lat, 2) OVER o AS lat3, lead(lon, 2) OVER o AS lon3 FROM ({TRACE}) t WINDOW o AS (PARTITION BY file ORDER BY pos)"""


def _segments(spark, sf_dir):
    return spark.sql(_SEG.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet")).where("lat3 IS NOT NULL")


def g_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    c = {k: F.round(F.col(k) * 100000) for k in ("lat", "lon", "lat2", "lon2", "lat3", "lon3")}  # whole numbers, so signs are exact
    d, t = geo.point_to_segment(c["lon3"], c["lat3"], c["lon"], c["lat"], c["lon2"], c["lat2"])
    off = geo.signed_offset(c["lon3"], c["lat3"], c["lon"], c["lat"], c["lon2"], c["lat2"])
    crosses = geo.segments_cross((c["lon"], c["lat"]), (c["lon2"], c["lat2"]), (c["lon3"], c["lat3"]), (F.lit(10670500.0), F.lit(1077500.0)))
    return s.select("file", "pos", F.round(d, 5).alias("distance"), F.round(t, 5).alias("share"), F.round(off, 4).alias("offset"), crosses.alias("crosses"))


_XY = "round(lon * 100000) AS ax, round(lat * 100000) AS ay, round(lon2 * 100000) AS bx, round(lat2 * 100000) AS by_, round(lon3 * 100000) AS px, round(lat3 * 100000) AS py"
G_SEGMENTS = f"""WITH s AS (SELECT file, pos, {_XY} FROM ({_SEG}) s0 WHERE lat3 IS NOT NULL),
u AS (SELECT *, bx - ax AS dx, by_ - ay AS dy, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM s)
SELECT file, pos, round(sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2)), 5) AS distance, round(t, 5) AS share, round((dx * (py - ay) - dy * (px - ax)) / sqrt(dx * dx + dy * dy), 4) AS offset,
  ((dx * (py - ay) - dy * (px - ax)) * (dx * (1077500.0E0 - ay) - dy * (10670500.0E0 - ax)) < 0) AND
  (((10670500.0E0 - px) * (ay - py) - (1077500.0E0 - py) * (ax - px)) * ((10670500.0E0 - px) * (by_ - py) - (1077500.0E0 - py) * (bx - px)) < 0) AS crosses FROM u"""


def g9_rings(spark, sf_dir):
    t = view(spark, sf_dir, "trace").where("pos < 5")
    ring = t.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("r"))
    x, y = F.transform("r", lambda p: (p["lon"] - 106.7) * 1000), F.transform("r", lambda p: (p["lat"] - 10.77) * 1000)
    return ring.select("file", F.round(geo.ring_area(x, y), 6).alias("area"), geo.in_ring(F.lit(10.775), F.lit(106.705), F.col("r")).alias("inside"))


G9_RINGS = f"""WITH p AS (SELECT file, pos, lat, lon, coalesce(lead(lat) OVER o, first_value(lat) OVER o) AS lat2, coalesce(lead(lon) OVER o, first_value(lon) OVER o) AS lon2, count(*) OVER (PARTITION BY file) AS n
  FROM ({TRACE}) t WHERE pos < 5 WINDOW o AS (PARTITION BY file ORDER BY pos))
SELECT file, round(CASE WHEN any_value(n) < 3 THEN 0 ELSE abs(sum((lon - 106.7E0) * 1000 * ((lat2 - 10.77E0) * 1000) - (lon2 - 106.7E0) * 1000 * ((lat - 10.77E0) * 1000))) / 2 END, 6) AS area,
  count(*) FILTER (WHERE (lat > 10.775E0) <> (lat2 > 10.775E0) AND 106.705E0 < (lon2 - lon) * (10.775E0 - lat) / (lat2 - lat) + lon) % 2 = 1 AS inside FROM p GROUP BY file"""


def g4_bearings(spark, sf_dir):
    a = geo.bearing(F.lit(10.775), F.lit(106.705), F.col("lat"), F.col("lon"))
    return view(spark, sf_dir, "places").select("id", F.round(geo.bearing_difference(a, (F.col("id") % 360).cast("double")), 5).alias("degrees"))


_BEARING = "(degrees(atan2(sin(radians(lon - 106.705E0)) * cos(radians(lat)), cos(radians(10.775E0)) * sin(radians(lat)) - sin(radians(10.775E0)) * cos(radians(lat)) * cos(radians(lon - 106.705E0)))) + 360) % 360"
G4_BEARINGS = f"""SELECT id, round(CASE WHEN f > 90 THEN 180 - f ELSE f END, 5) AS degrees FROM (SELECT id, CASE WHEN d > 180 THEN 360 - d ELSE d END AS f FROM (SELECT id, abs({_BEARING} - id % 360) AS d FROM ({PLACES}) p) x) y"""


def g6_utm(spark, sf_dir):
    zone = geodesy.utm_zone(F.col("lon"))
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), zone)
    return view(spark, sf_dir, "places").select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def _utm_sql() -> str:
    e, k = (geodesy.FLAT * (2 - geodesy.FLAT)) ** 0.5, geodesy.K0 * geodesy._RECT
    s = "sin(radians(lat))"
    sums = ["".join(f" + {a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geodesy._ALPHA, 1)) for f, g in (("cos", "sinh"), ("sin", "cosh"))]
    return f"""WITH t AS (SELECT id, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS lam, sinh(atanh({s}) - {e!r} * atanh({e!r} * {s})) AS t FROM ({PLACES}) p),
x AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT id, round(500000 + {k!r} * (eta{sums[0]}), 3) AS east, round({k!r} * (xi{sums[1]}), 3) AS north FROM x"""


GRID = hexgrid.Grid(9, 10.0)


def g30_cells(spark, sf_dir):
    return view(spark, sf_dir, "places").select("id", GRID.cell(F.col("lat"), F.col("lon")).alias("cell"))


def _cell_sql(rows: str, keep: str) -> str:
    import math

    r, e = geo.EARTH_RADIUS_M, GRID.edge
    return f"""SELECT {keep}, '9:' || CAST(CASE WHEN dq > dr AND dq > ds THEN -p - s ELSE q END AS BIGINT) || ':' || CAST(CASE WHEN dr >= dq AND dr > ds THEN -q - s ELSE p END AS BIGINT) AS cell FROM
 (SELECT *, abs(q - fq) AS dq, abs(p - fr) AS dr, abs(s - fs) AS ds FROM (SELECT *, floor(fq + 0.5) AS q, floor(fr + 0.5) AS p, floor(fs + 0.5) AS s FROM
  (SELECT *, -fq - fr AS fs FROM (SELECT *, ({math.sqrt(3) / 3!r} * (radians(lon) * {math.cos(math.radians(10.0))!r} * {r!r}) - radians(lat) * {r!r} / 3) / {e!r} AS fq, {2 / 3!r} * (radians(lat) * {r!r}) / {e!r} AS fr FROM ({rows}) r0) r1) r2) r3) r4"""


def a2_counts(spark, sf_dir):
    """Counters of the cells of places, category by rules."""
    c, n = F.col("category"), F.col("title")
    rows = tagged(spark, sf_dir).withColumns({"category": tags.category(F.col("tags"), n), "cell": GRID.cell(F.col("lat"), F.col("lon"))})
    return rows.groupBy("cell").agg(*[F.count_if(v).alias(k) for k, v in hexgrid.poi_mix(c, n).items()], *[F.sum(F.when(v, F.col("size").cast("long")).otherwise(0)).alias(k) for k, v in hexgrid.land(c, n, F.col("tags")).items()])


_C = dict(zip(("lux", "lodging", "night", "food", "religious", "industrial", "civic", "walk", "service", "scenic", "quiet", "family", "road"), tags.CATEGORIES))
_MIX = {
    "poi_total": "true", "food_count": f"c = '{_C['food']}'", "cafe_count": f"c = '{_C['food']}' AND {_says(hexgrid.CAFE)}", "bar_count": f"c = '{_C['night']}' OR {_says(hexgrid.BAR)}",
    "hotel_count": f"c IN ('{_C['lodging']}', '{_C['lux']}') OR {_says(hexgrid.HOTEL)}", "shop_count": f"c = '{_C['walk']}' OR {_says(hexgrid.SHOP)}", "service_count": f"c IN ('{_C['service']}', '{_C['civic']}')",
    "culture_count": f"c IN ('{_C['religious']}', '{_C['civic']}', '{_C['scenic']}')", "parking_count": _says(hexgrid.PARKING),
}
_LAND = {
    "green_area_m2": f"c = '{_C['quiet']}' OR (c = '{_C['scenic']}' AND NOT wet)", "water_area_m2": f"c = '{_C['scenic']}' AND wet", "residential_area_m2": f"c = '{_C['family']}'", "industrial_area_m2": f"c = '{_C['industrial']}'",
    "building_area_m2": "c IN (" + ", ".join(f"'{x}'" for x in hexgrid.BUILT) + ")",
}
A2_COUNTS = (
    "SELECT cell, "
    + ", ".join(f"count(*) FILTER (WHERE {v}) AS {k}" for k, v in _MIX.items())
    + ", "
    + ", ".join(f"CAST(coalesce(sum(size) FILTER (WHERE {v}), 0) AS BIGINT) AS {k}" for k, v in _LAND.items())
    + f" FROM ({_cell_sql(f'SELECT *, {_CATEGORY} AS c, {_WATER} AS wet FROM ({TAGGED}) t', '*')}) x GROUP BY cell"
)


def w4_legs(spark, sf_dir):
    """The legs of lines of nodes, by the operator that walks each way's array."""
    t = view(spark, sf_dir, "trace").withColumns({"way": F.col("file"), "node": F.col("pos")})
    lines = t.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node", "lat", "lon"))), lambda p: F.struct(p["node"].alias("node"), p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    return loops.legs(lines.withColumn("tags", F.create_map().cast("map<string,string>"))).groupBy("way").agg(F.count("*").alias("legs"), F.sum("v").alias("ends"))


W4_LEGS = f"SELECT file AS way, count(nxt) AS legs, CAST(sum(nxt) AS BIGINT) AS ends FROM (SELECT file, lead(pos) OVER (PARTITION BY file ORDER BY pos) AS nxt FROM ({TRACE}) t) x GROUP BY file HAVING count(nxt) > 0"


def w3_trailing(spark, sf_dir):
    return sinks.trailing_distance(traces.samples(view(spark, sf_dir, "trace")).select("file", "segment", (F.floor(F.col("end_m") / 10) * 10).alias("end_m"))).select("file", "segment", F.round("distance", 2).alias("distance"))


def k22_stamps(spark, sf_dir):
    s = traces.samples(view(spark, sf_dir, "trace")).select("file", "segment", (F.floor(F.col("end_m") / 1000) * 1000).cast("double").alias("end_m"))
    return sinks.chapter_stamps(s)


def o_orders(spark, sf_dir):
    """Ranks of places by several orders: names, length of label, halves by place, bits of a mask."""
    from pyspark.sql.window import Window

    p = view(spark, sf_dir, "places")
    by = lambda *o: F.row_number().over(Window.partitionBy("brand").orderBy(*o))
    names, longest, bits = by(F.lower("name"), F.col("id").cast("string")), by(F.desc("size"), "id"), by(F.bit_count(F.col("id")).desc(), F.desc("id"))
    half = F.when(by("lon", "lat", "id") <= F.floor(F.count("*").over(Window.partitionBy("brand")) / 2), "left").otherwise("right")
    return p.select("id", names.alias("by_name"), longest.alias("by_size"), bits.alias("by_bits"), half.alias("half"))


O_ORDERS = f"""SELECT id, CAST(row_number() OVER (PARTITION BY brand ORDER BY lower(name), CAST(id AS VARCHAR)) AS INTEGER) AS by_name, CAST(row_number() OVER (PARTITION BY brand ORDER BY size DESC, id) AS INTEGER) AS by_size,
  CAST(row_number() OVER (PARTITION BY brand ORDER BY bit_count(id) DESC, id DESC) AS INTEGER) AS by_bits,
  CASE WHEN row_number() OVER (PARTITION BY brand ORDER BY lon, lat, id) <= count(*) OVER (PARTITION BY brand) // 2 THEN 'left' ELSE 'right' END AS half FROM ({PLACES}) p"""


def o3_pois(spark, sf_dir):
    return view(spark, sf_dir, "places").orderBy(F.lower("name"), F.col("id").cast("string")).select("id", "name")


O3_POIS = f"SELECT id, name FROM ({PLACES}) p ORDER BY lower(name), CAST(id AS VARCHAR)"


def u1_all_points(spark, sf_dir):
    t, p = view(spark, sf_dir, "trace").select("lat", "lon"), view(spark, sf_dir, "places").select("lat", "lon")
    return t.unionByName(p).select(F.floor(F.col("lat") * 1000).alias("lat"), F.floor(F.col("lon") * 1000).alias("lon")).distinct()


U1_ALL_POINTS = f"SELECT DISTINCT CAST(floor(lat * 1000) AS BIGINT) AS lat, CAST(floor(lon * 1000) AS BIGINT) AS lon FROM (SELECT lat, lon FROM ({TRACE}) t UNION ALL SELECT lat, lon FROM ({PLACES}) p) x"


def a18_symbols(spark, sf_dir):
    rule = tags.poi_rule(F.col("tags"))
    rows = tagged(spark, sf_dir).withColumn("poi", rule).where("poi IS NOT NULL")
    return rows.groupBy("poi").agg(F.array_join(F.array_sort(F.collect_set(text.symbol(F.col("poi"), F.col("tags")))), "|").alias("symbols"), F.count("*").alias("n"))


A18_SYMBOLS = f"""SELECT poi, string_agg(DISTINCT symbol, '|' ORDER BY symbol) AS symbols, count(*) AS n FROM (SELECT poi, CASE poi WHEN 'tourism=viewpoint' THEN 'Scenic Area' WHEN 'tourism=attraction' THEN 'Park' WHEN 'tourism=museum' THEN 'Museum'
  WHEN 'tourism=artwork' THEN 'Museum' WHEN 'natural=peak' THEN 'Summit' WHEN 'historic=memorial' THEN 'Bell' WHEN 'historic=ruins' THEN 'Mine' WHEN 'amenity=place_of_worship' THEN CASE WHEN lower(religion) = 'christian' THEN 'Church' ELSE 'Building' END
  ELSE 'Building' END AS symbol FROM (SELECT *, {_POI} AS poi FROM ({TAGGED}) t) x WHERE poi IS NOT NULL) y GROUP BY poi"""


def a20_counters(spark, sf_dir):
    return sinks.summary(view(spark, sf_dir, "trace"), high=F.col("value") > 100, first=F.col("pos") == 0)


A20_COUNTERS = f"SELECT count(*) AS seen, count(*) FILTER (WHERE value > 100) AS high, count(*) FILTER (WHERE pos = 0) AS first FROM ({TRACE}) t"


def w6_intervals(spark, sf_dir):
    spans = view(spark, sf_dir, "trace").select("file", ((F.col("pos") * 37) % 500).cast("double").alias("a"), ((F.col("pos") * 37) % 500 + F.col("event_id") % 40).cast("double").alias("b"))
    return paths.merged_intervals(spans, "file", "a", "b")


W6_INTERVALS = f"""WITH s AS (SELECT DISTINCT file, unnest(range(pos * 37 % 500, pos * 37 % 500 + event_id % 40)) AS metre FROM ({TRACE}) t)
SELECT file, CAST(count(metre) AS DOUBLE) AS covered FROM (SELECT DISTINCT file FROM ({TRACE}) f) f LEFT JOIN s USING (file) GROUP BY file"""


def w12_numbered(spark, sf_dir):
    return courses.numbered(view(spark, sf_dir, "trace"), "pos", "img", "file").select("file", "pos", "name")


W12_NUMBERED = f"SELECT file, pos, format('img{{:04d}}', row_number() OVER (PARTITION BY file ORDER BY pos) - 1) AS name FROM ({TRACE}) t"


def g40_indices(spark, sf_dir):
    n = F.col("id") % 50 + 3
    return view(spark, sf_dir, "places").select("id", geodesy.retry_size(n).alias("next"), F.size(geodesy.even_indices(n, F.lit(3))).cast("long").alias("kept"))


G40_INDICES = f"SELECT id, CAST(greatest(2, least(id % 50 + 2, floor((id % 50 + 3) * 0.85))) AS BIGINT) AS next, CAST(3 AS BIGINT) AS kept FROM ({PLACES}) p"


def a16_centres(spark, sf_dir):
    return courses.centroids(view(spark, sf_dir, "trace"), "file").select("file", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


A16_CENTRES = f"SELECT file, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM ({TRACE}) t GROUP BY file"


def g25_boxes(spark, sf_dir):
    b = paths.buffered_bbox(view(spark, sf_dir, "trace"), 100.0)
    return b.select("file", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


G25_BOXES = f"""SELECT file, round(min(lon) - 100 / 111320E0 / cos(radians(greatest(abs(min(lat)), abs(max(lat))))), 6) AS west, round(min(lat) - 100 / 111320E0, 6) AS south,
  round(max(lon) + 100 / 111320E0 / cos(radians(greatest(abs(min(lat)), abs(max(lat))))), 6) AS east, round(max(lat) + 100 / 111320E0, 6) AS north FROM ({TRACE}) t GROUP BY file"""


def j2_relation_ways(spark, sf_dir):
    member = F.struct(F.when(F.col("member") % 5 == 0, "node").otherwise("way").alias("type"), F.col("member").alias("ref"), F.lit("outer").alias("role"))
    relations = view(spark, sf_dir, "members").groupBy(F.col("relation").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    ways = view(spark, sf_dir, "refs").groupBy(F.col("way").alias("id")).agg(F.array_sort(F.collect_list("node")).alias("refs"))
    return loops.relation_ways(relations, ways).groupBy("relation").agg(F.count("*").alias("ways"), F.sum(F.size("refs")).alias("nodes"))


J2_RELATION_WAYS = f"""SELECT relation, count(*) AS ways, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT DISTINCT l_suppkey AS relation, l_partkey AS member FROM lineitem) m JOIN (SELECT way, count(*) AS n FROM ({REFS}) r GROUP BY way) w ON w.way = m.member
  WHERE member % 5 <> 0 GROUP BY relation"""


def j15_node_ways(spark, sf_dir):
    refs = view(spark, sf_dir, "refs").select("way", "node")
    p = view(spark, sf_dir, "places").select("id", F.col("id").alias("node1"), (F.col("id") + 1).alias("node2"))
    return paths.node_ways(p, refs).select("id", F.size("ways").cast("long").alias("ways"))


J15_NODE_WAYS = f"SELECT p.id, count(DISTINCT way) AS ways FROM ({PLACES}) p JOIN ({REFS}) r ON r.node = p.id OR r.node = p.id + 1 GROUP BY p.id"


def r14_slices(spark, sf_dir):
    ways = view(spark, sf_dir, "refs").groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("refs")).where(F.size("refs") >= 3)
    return ways.select("way", F.size(paths.way_slice(F.col("refs"), F.get("refs", F.lit(2)), F.get("refs", F.lit(0)))).cast("long").alias("n"))


R14_SLICES = f"""WITH r AS ({REFS}), f AS (SELECT way, min(pos) FILTER (WHERE node = a) AS i, min(pos) FILTER (WHERE node = b) AS j FROM (SELECT way, pos, node, max(node) FILTER (WHERE pos = 2) OVER (PARTITION BY way) AS a,
  max(node) FILTER (WHERE pos = 0) OVER (PARTITION BY way) AS b FROM r) x WHERE a IS NOT NULL GROUP BY way) SELECT way, abs(i - j) + 1 AS n FROM f"""


# Files made from the tables and read back.


def s1_gpx(spark, sf_dir):
    """Tracks written as GPX files, 16 of them, and read again."""
    path = graph.shared_path(spark, "gpx")
    t = view(spark, sf_dir, "trace").select(F.concat(F.lit("t"), (F.col("file") % 16).cast("string")).alias("name"), F.lit(1).alias("route_id"), F.struct("file", "pos").alias("pos"), "lat", "lon")
    sinks.save(sinks.gpx_tracks(t, path))
    rows = tracks.read(spark, path)
    return rows.groupBy("name").agg(F.count("*").alias("points"), F.sum(F.round(F.col("lat") * 100000).cast("long")).alias("lats"), F.max("pos").alias("last"))


S1_GPX = f"SELECT 't' || file % 16 AS name, count(*) AS points, CAST(sum(CAST(round(lat * 100000) AS BIGINT)) AS BIGINT) AS lats, count(*) - 1 AS last FROM ({TRACE}) t GROUP BY 1"


def s7_osm(spark, sf_dir):
    """Nodes and ways written as XML and read again, ways with their nodes."""
    path = graph.shared_path(spark, "osm")
    places, refs = view(spark, sf_dir, "places"), view(spark, sf_dir, "refs")
    nodes = places.select("id", "lat", "lon")
    ways = refs.groupBy(F.col("way").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda r: r["node"]).alias("refs"))
    sinks.osm(nodes, ways.withColumn("tags", F.create_map(F.lit("highway"), F.lit("path"))), path)
    lines = osm.way_points(osm.ways(spark, f"{path}/ways"), osm.nodes(spark, f"{path}/nodes"))
    return lines.select("way", F.size("points").cast("long").alias("points"), F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + F.round(p["lon"] * 100000).cast("long")).alias("lons"))


S7_OSM = f"SELECT way, count(*) AS points, CAST(sum(CAST(round(lon * 100000) AS BIGINT)) AS BIGINT) AS lons FROM ({REFS}) r JOIN ({PLACES}) p ON r.node = p.id GROUP BY way HAVING count(*) >= 2"


def s15_csv(spark, sf_dir):
    path = graph.shared_path(spark, "csv")
    rows = tagged(spark, sf_dir).select("id", F.concat(F.lit('a "quoted", '), F.col("title")).alias("name"), text.sorted_json(tags.projected(F.col("tags"))).alias("type"))
    sinks.csv(rows, path)
    back = files.csv(spark, path, ("id", "name", "type"), "id long, name string, type string")
    return back.select("id", "name", F.size(F.from_json("type", "map<string,string>")).cast("long").alias("tags"))


S15_CSV = f"SELECT id, 'a \"quoted\", ' || title AS name, CAST({' + '.join(f'CAST(\"{k}\" IS NOT NULL AS INTEGER)' for k in sorted(set(_KEYS) & set(tags.REQUESTED_KEYS)))} AS BIGINT) AS tags FROM ({TAGGED}) t"


def k14_geojson(spark, sf_dir):
    """Features of tracks as JSON lines, parsed again."""
    t = view(spark, sf_dir, "trace").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    parsed = F.from_json("value", "properties struct<file:long>, geometry struct<type:string,coordinates:array<array<double>>>")
    back = sinks.features(t).select(parsed.alias("f"))
    return back.select("f.properties.file", F.col("f.geometry.type").alias("kind"), F.size("f.geometry.coordinates").cast("long").alias("points"))


K14_GEOJSON = f"SELECT file, 'LineString' AS kind, count(*) AS points FROM ({TRACE}) t GROUP BY file"

# Without SQL: the tests compare these operators with brute force.


def _spread(spark, sf_dir) -> DataFrame:
    """The trace with four tracks to a place, as a country has more places than one."""
    return view(spark, sf_dir, "trace").withColumn("lat", F.col("lat") + F.floor(F.col("file") / 4) % 3000 * 0.02)


def _lines(spark, sf_dir, shift: float = 0.0) -> DataFrame:
    """id, file, points: the chunks of all tracks; ``shift`` moves them east by that many degrees times 0 to 4."""
    c = ordered.chunks(_spread(spark, sf_dir))
    moved = F.col("lon") + F.lit(shift) * ((F.col("file") + F.col("chunk")) % 5)
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", moved.alias("lon")))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return c.groupBy("file", "chunk").agg(points.alias("points")).select((F.col("file") * 100_000 + F.col("chunk")).alias("id"), F.col("file").cast("string").alias("file"), "points")


def r10_clusters(spark, sf_dir):
    lines = graph.written(paths.long_enough(_lines(spark, sf_dir)))
    return paths.rollup(lines, paths.clusters(lines)).drop("points")


def g21_coverage(spark, sf_dir):
    lines = graph.written(_lines(spark, sf_dir))
    traces_of = lines.select("id", (F.col("id") % 3).alias("traces"))
    return paths.gate(paths.coverage(lines, _lines(spark, sf_dir, 0.00008)).join(traces_of, "id"))


def g22_simplified(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.select("id", F.size("points").alias("points"), F.size(paths.simplified(F.col("points"))).alias("kept"), F.round(paths.planar_length(F.col("points")), 3).alias("metres"), F.round(paths.at_fraction(F.col("points"))["lat"], 7).alias("middle"), F.round(paths.centroid(F.col("points"))["lon"], 7).alias("centre"))


def g24_hulls(spark, sf_dir):
    t = view(spark, sf_dir, "trace")
    return paths.hulls(t, 100.0).groupBy("file").agg(F.count("*").alias("corners")).join(paths.utm_bbox(t, 50.0), "file")


def g5_geodesics(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    there = p.withColumn("to", geodesy.destination(F.col("lat"), F.col("lon"), (F.col("id") % 360).cast("double"), (F.col("id") % 900 + 1).cast("double")))
    return there.select("id", geodesy.geodesic(F.col("lat"), F.col("lon"), F.col("to.lat"), F.col("to.lon")).alias("g")).select("id", F.round("g.metres", 3).alias("metres"), F.pmod(F.round("g.azimuth", 2), F.lit(360.0)).alias("azimuth"))


#: The inverse gives back what the direct solution was asked for.
G5_GEODESICS = f"SELECT id, CAST(id % 900 + 1 AS DOUBLE) AS metres, CAST(id % 360 AS DOUBLE) AS azimuth FROM ({PLACES}) p"


def _areas(spark, sf_dir) -> DataFrame:
    """name, category, tags, geometry: squares about a third of the places, short lines at the others."""
    t = tagged(spark, sf_dir).withColumn("category", tags.category(F.col("tags"), F.col("title")))
    d = 0.0005 * (F.col("size") % 5 + 1)
    corner = lambda x, y: F.struct((F.col("lat") + y * d).alias("lat"), (F.col("lon") + x * d).alias("lon"))
    ring = F.array(*[corner(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return t.select(F.col("title").alias("name"), "category", "tags", sinks.geometry(F.when(F.col("id") % 3 == 0, ring).otherwise(F.array(corner(0, 0), corner(1, 1)))).alias("geometry"))


def a1_features(spark, sf_dir):
    return hexgrid.derived(hexgrid.features(_areas(spark, sf_dir), GRID), GRID)


def g36_cell_scores(spark, sf_dir):
    cells = hexgrid.within_centre(a1_features(spark, sf_dir), GRID, 10.775, 106.705, 10.0)
    return hexgrid.scores(graph.cut(cells))


def w14_track_cells(spark, sf_dir):
    return hexgrid.track_cells(view(spark, sf_dir, "trace"), GRID)


def r4_thinned(spark, sf_dir):
    return courses.thin(view(spark, sf_dir, "trace").withColumnRenamed("file", "course"))


def _short_trips(places):
    """Stands for a router: a trip of up to 12 places is the places by latitude."""
    return sorted(places) if len(places) <= 12 else None


def r11_routes(spark, sf_dir):
    return courses.routes(view(spark, sf_dir, "trace").withColumnRenamed("file", "course"), _short_trips)


def w15_markers(spark, sf_dir):
    t = view(spark, sf_dir, "trace")
    return courses.markers(t.select(F.col("file").alias("view"), "pos", ((F.col("lon") - 106.7) * 100000).alias("x"), ((F.col("lat") - 10.77) * 100000).alias("y")))


def a7_widths(spark, sf_dir):
    """Widths along a way per track, from the offsets of the other tracks' places beside it."""
    lines = _lines(spark, sf_dir).where("id % 100000 = 0").select(F.col("file").cast("long").alias("way"), "points")
    t = view(spark, sf_dir, "trace").select(F.col("file").alias("way"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("file"), "lat", "lon")
    return paths.width_bins(paths.offsets(t, lines), 50.0)


def j6_nearest_ways(spark, sf_dir):
    points = _spread(spark, sf_dir).select((F.col("file") * 100_000 + F.col("pos")).alias("id"), "lat", "lon")
    return paths.nearest_way(points, _lines(spark, sf_dir, 0.0002).select("id", "points"), 50.0)


def j5_near_pois(spark, sf_dir):
    pois = view(spark, sf_dir, "places").select("id", "name", "lat", "lon", F.lit(1.0).alias("importance"))
    return paths.near_pois(_lines(spark, sf_dir).select("id", "points"), pois).select("id", F.size("pois").alias("n"))


def _town(spark, sf_dir):
    """area, u, v, length, grade and area, node, lat, lon: a street grid in each of the customers' nations, with
    gaps that follow from its key."""
    cells = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("area")).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"))))
    x, y = F.col("n") % 6, F.floor(F.col("n") / 6)
    nodes = cells.select("area", F.col("n").alias("node"), (10 + y * 90 / 111195).alias("lat"), (106 + x * 90 / 109500).alias("lon"))
    step = F.explode(F.array(F.struct((x < 5).alias("ok"), (F.col("n") + 1).alias("v")), F.struct((y < 5).alias("ok"), (F.col("n") + 6).alias("v"))))
    edges = cells.select("area", F.col("n").alias("u"), step.alias("e")).where("e.ok AND (u * 7 + e.v * 3 + area) % 11 <> 0").select("area", "u", "e.v", F.lit(90.0).alias("length"), F.lit(0).alias("grade"))
    return edges, nodes


def r6_loops(spark, sf_dir):
    edges, nodes = _town(spark, sf_dir)
    return loops.find(edges, nodes)


def r9_loop_points(spark, sf_dir):
    edges, nodes = _town(spark, sf_dir)
    return loops.loop_points(graph.cut(loops.find(edges, nodes)), nodes)


def j7_clear_paths(spark, sf_dir):
    away = F.floor(F.col("file") / 4) % 3000 * 0.02
    rows = _segments(spark, sf_dir).withColumns({"lat": F.col("lat") + away, "lat2": F.col("lat2") + away})
    s = rows.select(F.col("file").alias("way"), F.lit(0).alias("grade"), F.col("pos").alias("u"), (F.col("pos") + 1).alias("v"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2")
    return loops.clear_of_roads(s.where("way % 2 = 0"), s.where("way % 2 = 1")).select("way", "u", "v", "grade")


def r8_rings(spark, sf_dir):
    """Rings of four nodes from their sides, turned and shuffled."""
    n = F.col("id") * 10
    side = lambda a, b: F.when(F.col("id") % 2 == 0, F.array(n + a, n + b)).otherwise(F.array(n + b, n + a))
    parts = F.posexplode(F.array(side(3, 4), side(1, 2), side(4, 1), side(2, 3)))
    members = view(spark, sf_dir, "places").select(F.col("id").alias("relation"), F.lit("outer").alias("role"), parts.alias("pos", "refs"))
    return loops.stitched(members).select("relation", F.size("ring").cast("long").alias("nodes"))


R8_RINGS = f"SELECT id AS relation, CAST(5 AS BIGINT) AS nodes FROM ({PLACES}) p"


def samples_queries(W2: str) -> dict:
    """Those over track samples, whose SQL is given."""
    samples = f"SELECT file, segment, end_m FROM ({W2}) s"
    km = "round(floor(end_m / 10) / 100, 2)"
    w3 = f"""SELECT file, segment, round(CASE WHEN lead(segment) OVER o IS NULL THEN coalesce(lag({km}) OVER o, 0) ELSE {km} END, 2) AS distance FROM ({samples}) t WINDOW o AS (PARTITION BY file ORDER BY segment)"""
    k22 = f"""SELECT file, segment, format('{{:02d}}:{{:02d}}:{{:02d}}', segment * 3 // 3600, segment * 3 % 3600 // 60, segment * 3 % 60) AS stamp, CASE WHEN segment = 0 THEN '0km' ELSE format('{{:.1f}}km', before) END AS label
      FROM (SELECT *, lag(floor(end_m / 1000)) OVER (PARTITION BY file ORDER BY segment) AS before FROM ({samples}) t) x WHERE segment % 5 = 0"""
    return {"w3_trailing": (w3_trailing, w3), "k22_stamps": (k22_stamps, k22)}


SURVEY = {
    "f_predicates": (f_predicates, F_PREDICATES), "t4_categories": (t4_categories, T4_CATEGORIES), "t_names": (t_names, T_NAMES), "t20_path_names": (t20_path_names, T20_PATH_NAMES), "t5_projected": (t5_projected, T5_PROJECTED),
    "t12_descriptions": (t12_descriptions, T12_DESCRIPTIONS), "l1_profile": (l1_profile, L1_PROFILE), "g_segments": (g_segments, G_SEGMENTS), "g9_rings": (g9_rings, G9_RINGS), "g4_bearings": (g4_bearings, G4_BEARINGS), "g6_utm": (g6_utm, _utm_sql()),
    "g30_cells": (g30_cells, _cell_sql(PLACES, "id")), "a2_counts": (a2_counts, A2_COUNTS), "w4_legs": (w4_legs, W4_LEGS), "o_orders": (o_orders, O_ORDERS), "o3_pois": (o3_pois, O3_POIS), "u1_all_points": (u1_all_points, U1_ALL_POINTS),
    "a18_symbols": (a18_symbols, A18_SYMBOLS), "a20_counters": (a20_counters, A20_COUNTERS), "w6_intervals": (w6_intervals, W6_INTERVALS), "w12_numbered": (w12_numbered, W12_NUMBERED), "g40_indices": (g40_indices, G40_INDICES),
    "a16_centres": (a16_centres, A16_CENTRES), "g25_boxes": (g25_boxes, G25_BOXES), "j2_relation_ways": (j2_relation_ways, J2_RELATION_WAYS), "j15_node_ways": (j15_node_ways, J15_NODE_WAYS), "r14_slices": (r14_slices, R14_SLICES),
    "s1_gpx": (s1_gpx, S1_GPX), "s7_osm": (s7_osm, S7_OSM), "s15_csv": (s15_csv, S15_CSV), "k14_geojson": (k14_geojson, K14_GEOJSON), "g5_geodesics": (g5_geodesics, G5_GEODESICS), "r8_rings": (r8_rings, R8_RINGS),
    "r10_clusters": (r10_clusters, None), "g21_coverage": (g21_coverage, None), "g22_simplified": (g22_simplified, None), "g24_hulls": (g24_hulls, None), "a1_features": (a1_features, None), "g36_cell_scores": (g36_cell_scores, None),
    "w14_track_cells": (w14_track_cells, None), "r4_thinned": (r4_thinned, None), "r11_routes": (r11_routes, None), "w15_markers": (w15_markers, None), "a7_widths": (a7_widths, None), "j6_nearest_ways": (j6_nearest_ways, None),
    "j5_near_pois": (j5_near_pois, None), "r6_loops": (r6_loops, None), "r9_loop_points": (r9_loop_points, None), "j7_clear_paths": (j7_clear_paths, None),
}
