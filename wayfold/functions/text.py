"""Names, slugs, descriptions, labels and prompts as Column expressions; null is empty unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.tags import length_word, tag

# Fixed values of the rules.
SYMBOLS = {"tourism=viewpoint": "Scenic Area", "natural=peak": "Summit", "tourism=museum": "Museum", "tourism=artwork": "Museum", "tourism=picnic_site": "Picnic Area", "tourism=attraction": "Park", "building=church": "Church", "building=cathedral": "Church", "building=chapel": "Church", "building=mosque": "Building", "building=temple": "Building", "building=pagoda": "Building", "natural=cave_entrance": "Tunnel", "man_made=tower": "Short Tower", "man_made=water_well": "Drinking Water"}
HISTORIC_SYMBOLS = {"memorial": "Bell", "monument": "Bell", "castle": "Building", "ruins": "Mine", "archaeological_site": "Mine", "fort": "Building", "battlefield": "Flag, Red", "tomb": "Cemetery", "wayside_cross": "Crossing", "wayside_shrine": "Building", "city_gate": "Building", "tower": "Short Tower", "mine": "Mine", "building": "Building", "church": "Church", "yes": "Building"}
CHRISTIAN = ("christian", "catholic", "protestant", "orthodox", "anglican", "evangelical", "baptist", "lutheran", "methodist")
SYMBOL_TERMS = ((("peak", "summit"), "Summit"), (("viewpoint", "scenic"), "Scenic Area"), (("museum",), "Museum"), (("picnic",), "Picnic Area"), (("cave",), "Tunnel"), (("church", "worship"), "Church"))
BANNED_PREFIXES = ("walk ", "walk to ", "visit ", "visit the ", "turn ", "turn to ", "see ", "see the ", "go to ", "head to ", "stop at ", "hike to ", "climb to ")
DIRECT_TAGS = ("name:en", "name", "alt_name", "official_name", "loc_name", "short_name", "old_name", "description", "description:en", "note", "wikipedia", "wikipedia:en", "wikidata", "tourism", "historic", "natural", "amenity", "building", "man_made", "leisure", "place", "religion", "denomination", "sect", "heritage", "heritage:operator", "heritage:website", "inscription", "subject", "artist_name", "architect", "start_date", "end_date", "year_built", "opened", "ruins", "ele", "elevation", "height", "direction", "material", "operator", "operator:type", "access", "fee", "addr:place", "addr:hamlet", "addr:suburb", "addr:city", "addr:street", "information", "board_type", "artwork_type", "castle_type", "memorial", "memorial:conflict", "tower:type", "cave_entrance")
TAG_PREFIXES = ("name:", "heritage:", "addr:")
LABELS = ("positive", "mixed", "negative")
GOOD, BAD = ("good", "pleasant", "upbeat", "vibrant", "safe", "lively"), ("bad", "harsh", "unpleasant", "unsafe", "bleak")
VIETNAMESE_D = ("Đđ", "Dd")


def picked_name(tags: Column) -> Column:
    """``name:en``, else ``name``, else Unknown; a tag that is there but empty counts."""
    return F.coalesce(F.try_element_at(tags, F.lit("name:en")), F.try_element_at(tags, F.lit("name")), F.lit("Unknown"))


def category_label(category: Column) -> Column:
    """The value of ``key=value`` in title case: a letter after anything but a letter is upper case."""
    value = F.translate(F.element_at(F.split(category, "=", 2), -1), "_", " ")
    letters = F.split(F.lower(value), "")
    before = F.concat(F.array(F.lit(" ")), F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))))
    return F.array_join(F.zip_with(letters, before, lambda c, b: F.when(F.lower(b) == F.upper(b), F.upper(c)).otherwise(c)), "")


def display_name(tags: Column, category: Column) -> Column:
    """The first name tag that is not empty, else the label of the category."""
    return F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in ("name:en", "name", "alt_name", "official_name")], category_label(category))


def symbol(category: Column, tags: Column) -> Column:
    """Waypoint symbol: by category, by kind of historic place, for worship, by words, else a flag."""
    lookup = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)
    has = lambda *terms: reduce(lambda a, b: a | b, [F.contains(category, F.lit(t)) for t in terms])
    historic = F.coalesce(F.try_element_at(tags, F.lit("historic")), F.element_at(F.split(category, "=", 2), -1))
    worship = F.lower(tag(tags, "religion")).isin(*CHRISTIAN) | F.lower(tag(tags, "building")).isin("church", "cathedral", "chapel")
    out = (
        F.when(lookup(SYMBOLS, category).isNotNull(), lookup(SYMBOLS, category))
        .when(F.startswith(category, F.lit("historic=")), F.coalesce(lookup(HISTORIC_SYMBOLS, historic), F.lit("Building")))
        .when(category == "amenity=place_of_worship", F.when(worship, "Church").otherwise("Building"))
        .when(has("tower"), F.when(tag(tags, "man_made") == "tower", "Tall Tower").otherwise("Short Tower"))
    )
    for terms, name in SYMBOL_TERMS:
        out = out.when(has(*terms), name)
    return out.otherwise("Flag, Blue")


def ascii_text(text: Column) -> Column:
    """Letters without their marks, đ as d, anything else beyond ASCII left out; trimmed. Null stays."""

    @F.arrow_udf("string")
    def plain(column):
        import unicodedata

        import pyarrow as pa

        return pa.array([None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in column.to_pylist()], pa.string())

    return F.trim(plain(F.translate(text, *VIETNAMESE_D)))


def slug(text: Column, most: int = 80) -> Column:
    """ASCII in lower case with underscores, ``most`` characters at most; ``path`` if nothing is left."""
    joined = F.btrim(F.regexp_replace(F.lower(ascii_text(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.btrim(F.substring(joined, 1, most), F.lit("_")), F.lit("")), F.lit("path"))


def style_slug(category: Column) -> Column:
    """``category-`` and the lower-case name with hyphens."""
    return F.concat(F.lit("category-"), F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(category), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("uncategorized")))


def description(text: Column) -> Column:
    """A short phrase: ASCII, no quotes around, up to the first full stop or semicolon, without leading
    verbs (each tried once, in their order), eight words and 128 characters at most."""
    cleaned = F.regexp_replace(F.btrim(F.trim(ascii_text(F.coalesce(text, F.lit("")))), F.lit("\"'")), r"[.!?]+$", "")
    phrase = F.trim(F.element_at(F.split(F.element_at(F.split(cleaned, r"\.", 2), 1), ";", 2), 1))

    def without(prefix: str):
        return lambda p: F.when(F.startswith(F.lower(p), F.lit(prefix)), F.trim(F.substr(p, F.lit(len(prefix) + 1)))).otherwise(p)

    for prefix in BANNED_PREFIXES:
        phrase = F.transform(F.array(phrase), without(prefix))[0]
    words = F.filter(F.split(phrase, r"\s+"), lambda w: w != "")
    return F.substring(F.when(F.size(words) > 8, F.array_join(F.slice(words, 1, 8), " ")).otherwise(phrase), 1, 128)


def context(category: Column, name: Column, lat: Column, lon: Column, elevation: Column, tags: Column) -> Column:
    """Map of what a description may use: category, display_name, elevation_m, coordinates, direct tags,
    and then the tags with one of the prefixes in order of their keys; empty ones are left out."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    head = F.array(entry("category", F.coalesce(category, F.lit(""))), entry("display_name", F.coalesce(name, F.lit(""))), entry("elevation_m", elevation.cast("string")), entry("coordinates", F.format_string("%.5f, %.5f", lat, lon)))
    known = F.when((lat.isNull() | lon.isNull()), F.slice(head, 1, 3)).otherwise(head)
    direct = F.array(*[entry(k, F.trim(tag(tags, k))) for k in DIRECT_TAGS])
    more = F.array_sort(F.filter(F.map_entries(tags), lambda e: ~e["key"].isin(*DIRECT_TAGS) & reduce(lambda a, b: a | b, [F.startswith(e["key"], F.lit(p)) for p in TAG_PREFIXES])))
    every = F.concat(known, direct, F.transform(more, lambda e: F.struct(e["key"].alias("key"), F.trim(e["value"]).alias("value"))))
    return F.map_from_entries(F.filter(every, lambda e: e["value"].isNotNull() & ((e["value"] != "") | e["key"].isin("category", "display_name"))))


def vibe(text: Column) -> Column:
    """One line without quotes around or a full stop at its end, 240 characters at most."""
    cleaned = F.btrim(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("`\"' "))
    cleaned = F.trim(F.regexp_replace(cleaned, r"\.$", ""))
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("Unclassified vibe")), 1, 240)


def label(text: Column) -> Column:
    """positive, mixed or negative; some synonyms; mixed for anything else."""
    cleaned = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(cleaned.isin(*LABELS), cleaned).when(cleaned.isin(*GOOD), "positive").when(cleaned.isin(*BAD), "negative").otherwise("mixed")


def reply(text: Column) -> Column:
    """Struct of vibe and label from a model's reply: a JSON object, fenced or not, else its first line."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    lines = F.split(trimmed, r"\r?\n")
    inner = F.when(F.startswith(trimmed, F.lit("```")), F.array_join(F.filter(lines, lambda x: ~F.startswith(x, F.lit("```"))), "\n")).otherwise(trimmed)
    parsed = F.from_json(inner, "vibe string, description string, label string")
    is_object = F.startswith(F.trim(inner), F.lit("{")) & F.from_json(inner, "map<string,string>").isNotNull()
    first = F.get(F.filter(F.split(inner, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0))
    said = F.struct(vibe(F.coalesce(parsed["vibe"], parsed["description"])).alias("vibe"), label(parsed["label"]).alias("label"))
    return F.when(F.coalesce(is_object, F.lit(False)), said).otherwise(F.struct(vibe(first).alias("vibe"), F.lit("mixed").alias("label")))


def strict_object(cell: Column, column: str, text: Column) -> Column:
    """The map of a JSON object; raises with the cell's id and the column for anything else."""
    parsed = F.from_json(text, "map<string,string>")
    good = parsed.isNotNull() & F.startswith(F.trim(text), F.lit("{"))
    return F.when(F.coalesce(good, F.lit(False)), parsed).otherwise(F.raise_error(F.format_string(f"Cell %s: expected JSON object in {column}", cell.cast("string"))).cast("map<string,string>"))


def prompt(features: Column, scores: Column, template: str = "cell_features={cell_features}\nscores={scores}") -> Column:
    """``template`` with two maps as JSON, their keys in order."""
    out = F.lit(template)
    for name, value in (("{cell_features}", features), ("{scores}", scores)):
        out = F.replace(out, F.lit(name), sorted_json(value))
    return out


def sorted_json(value: Column) -> Column:
    """JSON of a map with its keys in order, without spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def path_name(metres: Column, poi: Column, street: Column, cluster: Column) -> Column:
    """A word by length, then ``near`` the place and ``off`` the street, as far as there are such; the
    cluster's id if there is neither. A street of the same name as the place is not said twice."""
    word = length_word(metres)
    off = F.when(street.isNotNull() & ~street.eqNullSafe(poi), F.concat(F.lit(", off "), street)).otherwise("")
    return F.when(poi.isNotNull(), F.concat(word, F.lit(" near "), poi, off)).when(street.isNotNull(), F.concat(word, F.lit(" off "), street)).otherwise(F.concat_ws(" ", word, cluster))


def position(row: Column, text: Column) -> Column:
    """(lon, lat) of a JSON array of two numbers; raises with the row number, the header being row 1."""
    p = F.from_json(text, "array<double>")
    good = (F.size(p) >= 2) & F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90)
    return F.when(F.coalesce(good, F.lit(False)), F.slice(p, 1, 2)).otherwise(F.raise_error(F.format_string("Row %d: invalid position", (row + 1).cast("long"))).cast("array<double>"))
