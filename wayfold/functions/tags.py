"""Rules over map tags (MAP<STRING, STRING>) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
FOOD_AMENITIES = ("restaurant", "cafe", "fast_food", "food_court", "ice_cream", "biergarten", "bbq")
FOOD_SHOPS = ("bakery", "coffee", "confectionery", "deli", "pastry", "tea", "wine")
NIGHT_AMENITIES = ("bar", "pub", "nightclub", "stripclub", "casino")
NIGHT_LEISURE = ("adult_gaming_centre", "dance")
LODGING = ("hotel", "guest_house", "hostel", "motel", "apartment", "resort", "chalet", "camp_site", "caravan_site")
LUXURY_TERMS = ("luxury", "resort", "golf", "country club", "boutique")
CIVIC_AMENITIES = ("school", "hospital", "university", "college", "kindergarten", "police", "courthouse", "library", "townhall", "community_centre", "prison", "theatre", "arts_centre")
CIVIC_BUILDINGS = ("school", "hospital", "university", "public", "civic")
CIVIC_TERMS = ("ubnd", "office", "ministry", "department", "city hall")
RELIGIOUS_BUILDINGS = ("temple", "church", "cathedral", "mosque", "shrine", "synagogue", "monastery")
RELIGIOUS_LANDUSE = ("religious", "cemetery")
HISTORIC_TOURISM = ("museum", "memorial", "monument")
INDUSTRIAL_LANDUSE = ("industrial", "harbour", "port", "railway")
INDUSTRIAL_BUILDINGS = ("industrial", "warehouse", "factory")
SERVICE_AMENITIES = ("bank", "atm", "post_office", "social_facility", "pharmacy", "doctors", "clinic", "dentist", "veterinary", "bus_station", "fuel", "car_wash", "bureau_de_change", "charging_station")
SCENIC_NATURAL = ("water", "coastline", "beach", "wood", "wetland", "bay", "cliff", "peak", "sand", "heath", "scrub")
SCENIC_WATER = ("lake", "river", "canal", "reservoir", "pond", "stream", "basin")
QUIET_LEISURE = ("park", "garden", "nature_reserve")
QUIET_LANDUSE = ("recreation_ground", "grass", "farmyard")
HOME_BUILDINGS = ("house", "residential", "apartments", "dormitory")
HOME_HIGHWAYS = ("residential", "living_street")
ROAD_HIGHWAYS = ("service", "tertiary", "secondary", "primary", "trunk", "unclassified", "construction", "services", "track", "motorway", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
PATH_HIGHWAYS = ("footway", "path", "steps", "pedestrian", "cycleway", "bridleway", "residential", "service", "living_street", "track", "unclassified")
FOOTPATH_HIGHWAYS = ("footway", "path", "steps", "pedestrian")
DEDICATED_FOOTWAYS = ("footway", "pedestrian", "steps")
REQUESTED_KEYS = ("amenity", "shop", "tourism", "leisure", "natural", "landuse", "building", "highway", "water", "historic", "cultural")
ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "road", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
PARK_LEISURE, PARK_LANDUSE = ("park", "garden", "nature_reserve"), ("recreation_ground", "grass")
LAKES = ("lake", "pond", "reservoir")
CULTURE_TOURISM = ("museum", "gallery", "artwork", "attraction", "viewpoint", "information")
CULTURE_HISTORIC = ("monument", "memorial", "archaeological_site", "castle", "ruins")
CULTURE_AMENITIES = ("theatre", "arts_centre", "cinema")
WATER_TERMS = ("lake", "river", "sea", "ocean", "bay", "reservoir", "pond", "canal", "stream", "hồ", "biển", "vịnh", "sông")
WATER_NATURAL = ("water", "coastline", "beach")
WATER_VALUES = ("lake", "river", "canal", "reservoir", "pond", "stream", "basin", "lagoon", "bay", "sea")
POI_RULES = (("tourism", "viewpoint"), ("tourism", "attraction"), ("tourism", "museum"), ("tourism", "artwork"), ("tourism", "picnic_site"), ("amenity", "place_of_worship"), ("building", "temple"), ("building", "church"), ("building", "cathedral"), ("building", "chapel"), ("building", "mosque"), ("building", "pagoda"), ("historic", None), ("natural", "peak"), ("natural", "cave_entrance"), ("man_made", "tower"), ("man_made", "water_well"))
IMPORTANCE = {"leisure=park": 3.0, "tourism=attraction": 3.0, "amenity=place_of_worship": 2.5, "amenity=university": 2.5, "amenity=school": 2.0, "amenity=hospital": 2.0, "amenity=marketplace": 2.0}
CATEGORIES = ("Luxury / high-end", "Tourist lodging", "Nightlife", "Food & café", "Religious / historic", "Industrial / logistics", "Civic / institutional", "Walkable commercial", "Local services", "Scenic / water / forest", "Nature / quiet", "Family / residential", "Road-heavy / car-oriented")


def tag(tags: Column, key: str) -> Column:
    """The tag's value, empty if it is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def _has(name: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(t)) for t in terms])


def parse_tags(text: Column) -> Column:
    """A map of a JSON object with lower-case keys and values; empty for anything else."""
    parsed = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    present = F.map_filter(parsed, lambda k, v: v.isNotNull())
    return F.map_from_entries(F.transform(F.map_entries(present), lambda e: F.struct(F.lower(e["key"]), F.lower(e["value"]))))


def category(tags: Column, name: Column) -> Column:
    """The first of thirteen categories whose rule holds, in order; the last kind otherwise."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    v = {k: tag(tags, k) for k in ("amenity", "shop", "leisure", "tourism", "building", "landuse", "natural", "water", "highway", "historic")}
    c = CATEGORIES
    return (
        F.when((v["leisure"] == "golf_course") | _has(lower, LUXURY_TERMS), c[0])
        .when(v["tourism"].isin(*LODGING), c[1])
        .when(v["amenity"].isin(*NIGHT_AMENITIES) | v["leisure"].isin(*NIGHT_LEISURE), c[2])
        .when(v["amenity"].isin(*FOOD_AMENITIES) | v["shop"].isin(*FOOD_SHOPS), c[3])
        .when((v["amenity"] == "place_of_worship") | v["building"].isin(*RELIGIOUS_BUILDINGS) | v["landuse"].isin(*RELIGIOUS_LANDUSE) | (v["historic"] != "") | v["tourism"].isin(*HISTORIC_TOURISM), c[4])
        .when(v["landuse"].isin(*INDUSTRIAL_LANDUSE) | v["building"].isin(*INDUSTRIAL_BUILDINGS), c[5])
        .when(v["amenity"].isin(*CIVIC_AMENITIES) | v["building"].isin(*CIVIC_BUILDINGS) | (v["landuse"] == "military") | _has(lower, CIVIC_TERMS), c[6])
        .when((v["landuse"] == "commercial") | (v["amenity"] == "marketplace") | (v["shop"] != ""), c[7])
        .when(v["amenity"].isin(*SERVICE_AMENITIES), c[8])
        .when(v["natural"].isin(*SCENIC_NATURAL) | v["water"].isin(*SCENIC_WATER) | (v["tourism"] == "viewpoint"), c[9])
        .when(v["leisure"].isin(*QUIET_LEISURE) | v["landuse"].isin(*QUIET_LANDUSE), c[10])
        .when(v["building"].isin(*HOME_BUILDINGS) | v["highway"].isin(*HOME_HIGHWAYS), c[11])
        .when(v["highway"].isin(*ROAD_HIGHWAYS) | (v["amenity"] == "parking"), c[12])
        .otherwise(c[8])
    )


def is_interesting(tags: Column) -> Column:
    """Any of the requested keys, or a temple, park, lake, attraction or cultural site."""
    there = lambda k: F.try_element_at(tags, F.lit(k)).isNotNull()
    temple = (tag(tags, "landuse") == "religious") | (tag(tags, "building") == "temple") | (tag(tags, "amenity") == "place_of_worship") | there("religion")
    park = tag(tags, "leisure").isin(*PARK_LEISURE) | tag(tags, "landuse").isin(*PARK_LANDUSE) | (tag(tags, "boundary") == "national_park")
    culture = tag(tags, "tourism").isin(*CULTURE_TOURISM) | tag(tags, "historic").isin(*CULTURE_HISTORIC) | tag(tags, "amenity").isin(*CULTURE_AMENITIES) | there("cultural")
    return reduce(lambda a, b: a | b, [there(k) for k in REQUESTED_KEYS]) | temple | park | tag(tags, "water").isin(*LAKES) | culture


def projected(tags: Column) -> Column:
    """The tags of the requested keys."""
    return F.map_filter(tags, lambda k, v: k.isin(*REQUESTED_KEYS))


def is_water(tags: Column, name: Column) -> Column:
    """By tags, else by a term anywhere in the name."""
    by_tag = tag(tags, "water").isin(*WATER_VALUES) | tag(tags, "natural").isin(*WATER_NATURAL) | tag(tags, "waterway").isin(*WATER_VALUES) | tag(tags, "landuse").isin("reservoir", "basin")
    return by_tag | _has(F.lower(F.coalesce(name, F.lit(""))), WATER_TERMS)


def is_coastline(tags: Column) -> Column:
    return tag(tags, "natural").isin("coastline", "beach")


def highway_in(tags: Column, values) -> Column:
    """Whether the highway is one of ``values``: footpaths, roads, paths or dedicated footways."""
    return tag(tags, "highway").isin(*values)


def from_pairs(pairs: Column) -> Column:
    """A map of an array of structs with k and v, the last of a repeated key."""
    entries = F.transform(pairs, lambda t: F.struct(t["k"].alias("key"), t["v"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def poi_rule(tags: Column) -> Column:
    """``key=value`` of the first rule that the tags meet, else null."""
    return F.coalesce(*[F.when((tag(tags, k) == v) if v else F.try_element_at(tags, F.lit(k)).isNotNull(), F.concat(F.lit(f"{k}="), tag(tags, k))) for k, v in POI_RULES])


def importance(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in IMPORTANCE.items() for x in item])
    return F.coalesce(F.try_element_at(table, label), F.lit(1.0))


def road_grade(tags: Column) -> Column:
    """Layer if there is one (0 if it is no number), else 1 on bridges, -1 in tunnels."""
    layer = F.try_element_at(tags, F.lit("layer"))
    yes = lambda k: ~tag(tags, k).isin("", "no")
    return F.when(layer.isNotNull(), F.coalesce(layer.try_cast("int"), F.lit(0))).when(yes("bridge"), 1).when(yes("tunnel"), -1).otherwise(0)


def length_word(metres: Column) -> Column:
    return F.when(metres < 60, "Shortcut").when(metres > 400, "Path").otherwise("Footpath")
