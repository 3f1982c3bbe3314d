"""Map extracts as XML: nodes, ways and relations by Spark's XML reader, which streams a file in one task, so
a large extract is read in parallel as far as it is cut into files (``sinks.osm`` writes one for each task).

Schemas are given, so nothing is read twice. Tags become a map. Missing children give empty arrays and maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import tags as rules
from wayfold.operators import graph, tables

TAG = "tag array<struct<_k string, _v string>>"
SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {TAG}",
    "way": f"_id long, nd array<struct<_ref long>>, {TAG}",
    "relation": f"_id long, member array<struct<_type string, _ref long, _role string>>, {TAG}",
}


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", kind).option("mode", "FAILFAST").schema(SCHEMAS[kind].replace("struct<_k string, _v string>", "struct<_k:string,_v:string>")).load(path)
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))
    return rows.withColumn("tags", rules.from_pairs(pairs))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon, tags."""
    return _rows(spark, path, "node").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "tags")


def ways(spark: SparkSession, path: str) -> DataFrame:
    """id, refs (node ids in order), tags."""
    return _rows(spark, path, "way").select(F.col("_id").alias("id"), F.coalesce(F.col("nd._ref"), F.array().cast("array<long>")).alias("refs"), "tags")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """id, members (type, ref, role), tags; a member without a role is outer."""
    empty = F.array().cast("array<struct<type:string,ref:long,role:string>>")
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(F.nullif(m["_role"], F.lit("")), F.lit("outer")).alias("role")))
    return _rows(spark, path, "relation").select(F.col("_id").alias("id"), F.coalesce(members, empty).alias("members"), "tags")


def refs(way_rows: DataFrame) -> DataFrame:
    """way, pos, node of ways."""
    return way_rows.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "node"))


def way_points(way_rows: DataFrame, node_rows: DataFrame, missing: str = "skip") -> DataFrame:
    """way, points (pos, lat, lon in order). Nodes that are not there are skipped, drop their way, or raise
    (``skip``, ``drop``, ``raise``); ways left with fewer than two points are dropped."""
    places = node_rows.select(F.col("id").alias("node"), "lat", "lon")
    if missing == "skip":
        return tables.way_lines(refs(way_rows), places)
    joined = refs(way_rows).join(places, "node", "left")
    if missing == "raise":
        gone = F.raise_error(F.format_string("way %d lacks node %d", "way", "node")).cast("double")
        joined = joined.withColumn("lat", F.when(F.col("lat").isNull(), gone).otherwise(F.col("lat")))
    whole = joined.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("points"), F.bool_and(F.col("lat").isNotNull()).alias("all"))
    return whole.where(F.col("all") & (F.size("points") >= 2)).drop("all")


def one_way(spark: SparkSession, path: str, way: int) -> DataFrame:
    """way, points of one way: only its nodes are joined. Raises if the way or a node is not there."""
    wanted = ways(spark, path).where(F.col("id") == way)
    if not wanted.head(1):
        raise ValueError(f"no way {way}")
    needed = refs(wanted).select(F.col("node").alias("id")).distinct()
    return way_points(wanted, nodes(spark, path).join(F.broadcast(needed), "id", "left_semi"), "raise")


def path_ways(way_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Ways that can be walked, with all their points; ways that lack a node are dropped."""
    return way_points(way_rows.where(rules.highway_in(F.col("tags"), rules.PATH_HIGHWAYS)), node_rows, "drop")


def named_highways(way_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """way, points, name of highways with a name."""
    named = way_rows.where((rules.tag(F.col("tags"), "name") != "") & F.try_element_at("tags", F.lit("highway")).isNotNull())
    return way_points(named, node_rows, "drop").join(named.select(F.col("id").alias("way"), F.col("tags")["name"].alias("name")), "way")


def interesting(way_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """way, points, name, tags of ways with an interesting tag and two known nodes or more."""
    from wayfold.functions import text

    kept = way_rows.where(rules.is_interesting(F.col("tags")))
    more = kept.select(F.col("id").alias("way"), text.picked_name(F.col("tags")).alias("name"), rules.projected(F.col("tags")).alias("tags"))
    return way_points(kept, node_rows).join(more, "way")


def pois(way_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """id (``node/…`` or ``way/…``), name, category, lat, lon, ele, tags of what meets a rule, in the order of
    names and ids. A way stands at the mean of its known nodes, its closing one counted twice; equal ids
    give one row."""
    from wayfold.functions import parse, text

    category = rules.poi_rule(F.col("tags"))
    own = node_rows.withColumn("category", category).where("category IS NOT NULL").select(F.concat(F.lit("node/"), F.col("id").cast("string")).alias("id"), "lat", "lon", "category", "tags")
    kept = way_rows.withColumn("category", category).where("category IS NOT NULL")
    centre = refs(kept).join(node_rows.select(F.col("id").alias("node"), "lat", "lon"), "node").groupBy("way").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    far = kept.join(centre, F.col("id") == F.col("way")).select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("id"), "lat", "lon", "category", "tags")
    every = own.unionByName(far).dropDuplicates(["id"])
    named = every.withColumns({"name": text.display_name(F.col("tags"), F.col("category")), "ele": parse.elevation(F.col("tags"))})
    return named.select("id", "name", "category", "lat", "lon", "ele", "tags").orderBy(F.lower("name"), "id")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """nodes, ways, relations: one row."""
    parts = [f(spark, path).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, f in (("nodes", nodes), ("ways", ways), ("relations", relations))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy().pivot("kind", ["nodes", "ways", "relations"]).agg(F.first("n"))


def clipped(node_rows: DataFrame, way_rows: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes for which ``inside`` holds and the ways that have one, with all nodes of those ways."""
    near = node_rows.where(inside).select(F.col("id").alias("node"))
    touched = refs(way_rows).join(near, "node", "left_semi").select(F.col("way").alias("id")).distinct()
    kept = way_rows.join(touched, "id", "left_semi")
    wanted = refs(kept).select(F.col("node").alias("id")).unionByName(near.select(F.col("node").alias("id"))).distinct()
    return node_rows.join(wanted, "id", "left_semi"), kept


def complete(relation_rows: DataFrame, node_rows: DataFrame, way_rows: DataFrame, most: int = 50) -> DataFrame:
    """Relations all of whose members are there; those that lack one go, then those that lack those, until
    none goes."""
    there = node_rows.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(way_rows.select(F.lit("way").alias("type"), F.col("id").alias("ref")))
    members = relation_rows.select("id", F.inline("members")).select("id", "type", "ref")
    lacking = members.where("type <> 'relation'").join(there, ["type", "ref"], "left_anti").select("id").distinct()
    kept = graph.cut(relation_rows.join(lacking, "id", "left_anti"))
    n = kept.count()
    for _ in range(most):
        ids = kept.select(F.lit("relation").alias("type"), F.col("id").alias("ref"))
        gone = kept.select("id", F.inline("members")).where("type = 'relation'").join(ids, ["type", "ref"], "left_anti").select("id").distinct()
        kept = graph.cut(kept.join(gone, "id", "left_anti"))
        n, before = kept.count(), n
        if n == before:
            return kept
    raise RuntimeError(f"relations did not settle in {most} rounds")
