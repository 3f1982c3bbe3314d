"""Writers: tables, GeoJSON, GPX, KML, polygon files and small map extracts.

A document is one row with its ``path`` and ``text``, made by expressions from the rows that belong to it, and
``save`` writes each to its path from the task that holds it. Tables are written by Spark as folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import sorted_json, style_slug


def escaped(text: Column) -> Column:
    """Text for XML."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def csv(rows: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """A folder of CSV files with a header, quotes doubled; in the order of ``order`` over its files."""
    out = rows.select(*columns) if columns else rows
    out = out.orderBy(*order) if order else out
    out.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def points_csv(points: DataFrame, path: str) -> None:
    csv(points, path, ["lat", "lon"])


def area_points(rows: DataFrame) -> DataFrame:
    """name, geometry, type of ways (name, tags, points): GeoJSON and the tags as JSON with keys in order."""
    return rows.select("name", geometry(F.col("points")).alias("geometry"), sorted_json(F.col("tags")).alias("type"))


def normalised(rows: DataFrame) -> DataFrame:
    """name, geometry, category, type."""
    return rows.select("name", "geometry", "category", "type")


def cells(features: DataFrame, scores: DataFrame, grid) -> DataFrame:
    """cell_id, cell_features, scores, cell_boundary as JSON texts, in the order of ids; numbers to six places."""

    @F.arrow_udf("string")
    def boundary(column):
        import json

        import pyarrow as pa

        def ring(cell):
            corners = [[round(lon, 9), round(lat, 9)] for lat, lon in grid.boundary(cell).tolist()]
            return json.dumps({"type": "Polygon", "coordinates": [[*corners, corners[0]]]}, separators=(",", ":"))

        return pa.array([ring(c) for c in column.to_pylist()], pa.string())

    def packed(df):
        return F.to_json(F.struct(*[(F.round(c, 6) if t == "double" else F.col(c)).alias(c) for c, t in sorted(df.dtypes) if c != "cell"]))

    one = features.select(F.col("cell").alias("cell_id"), packed(features).alias("cell_features"))
    two = scores.select(F.col("cell").alias("cell_id"), packed(scores).alias("scores"))
    return one.join(two, "cell_id").withColumn("cell_boundary", boundary("cell_id")).orderBy("cell_id")


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key is not saved yet are appended; each task's rows survive a later failure of others, and a
    restart makes only what is missing. Returns all that is saved."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def geometry(points: Column) -> Column:
    """GeoJSON of an array of lat, lon structs: a polygon of a closed ring of four places or more, else a line."""
    c = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    n = F.size(c)
    polygon = (n >= 4) & (F.get(c, F.lit(0)) == F.get(c, n - 1))
    return F.when(polygon, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(c).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), c.alias("coordinates"))))


def features(rows: DataFrame, points: str = "points") -> DataFrame:
    """value: one GeoJSON feature a line, with the other columns as its properties."""
    more = F.to_json(F.struct(*[c for c in rows.columns if c != points]))
    return rows.select(F.concat(F.lit('{"type":"Feature","properties":'), more, F.lit(',"geometry":'), geometry(F.col(points)), F.lit("}")).alias("value"))


def collection(rows: DataFrame, path: str, points: str = "points", by: str | None = None) -> DataFrame:
    """path, text: feature collections, one for each value of ``by`` or one of all."""
    lines = rows.select(*([by] if by else []), features_of(rows, points).alias("value"))
    whole = lines.groupBy(*([by] if by else [])).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("all"))
    at = F.concat(F.lit(f"{path}/"), F.col(by).cast("string"), F.lit(".geojson")) if by else F.lit(path)
    return whole.select(at.alias("path"), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("all"), F.lit("]}")).alias("text"))


def features_of(rows: DataFrame, points: str) -> Column:
    more = F.to_json(F.struct(*[c for c in rows.columns if c != points]))
    return F.concat(F.lit('{"type":"Feature","properties":'), more, F.lit(',"geometry":'), geometry(F.col(points)), F.lit("}"))


GPX = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="wayfold" xmlns="http://www.topografix.com/GPX/1/1">\n'


def gpx_tracks(rows: DataFrame, path: str) -> DataFrame:
    """path, text of track files from points (name, route_id, pos, lat, lon): a file for each route; with one route
    it is named by ``path`` alone, else ``-route-01`` and so on."""
    place = F.format_string('<trkpt lat="%.7f" lon="%.7f"/>', "lat", "lon")
    files = rows.groupBy("name", "route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("p")))), lambda x: x["p"]), "\n").alias("points"))
    many = files.groupBy("name").agg(F.count("*").alias("n"))
    base = F.concat(F.lit(f"{path}/"), F.col("name"))
    at = F.when(F.col("n") == 1, F.concat(base, F.lit(".gpx"))).otherwise(F.concat(base, F.format_string("-route-%02d.gpx", "route_id")))
    text = F.concat(F.lit(GPX + "<trk><name>"), escaped(F.col("name")), F.lit("</name><trkseg>\n"), F.col("points"), F.lit("\n</trkseg></trk>\n</gpx>\n"))
    return files.join(many, "name").select(at.alias("path"), text.alias("text"))


def gpx_waypoints(rows: DataFrame, path: str) -> DataFrame:
    """path, text of one file of waypoints (id, name, lat, lon, ele, symbol, description) in the order of names."""
    ele = F.coalesce(F.format_string("<ele>%.1f</ele>", "ele"), F.lit(""))
    ele = F.when(F.col("ele").isNotNull(), ele).otherwise("")
    said = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("<desc>"), escaped(F.col("description")), F.lit("</desc>"))).otherwise("")
    one = F.concat(F.format_string('<wpt lat="%.7f" lon="%.7f">', "lat", "lon"), ele, F.lit("<name>"), escaped(F.col("name")), F.lit("</name>"), said, F.lit("<sym>"), escaped(F.col("symbol")), F.lit("</sym></wpt>"))
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("n"), "id", one.alias("w")))), lambda x: x["w"]), "\n").alias("all"))
    return whole.select(F.lit(path).alias("path"), F.concat(F.lit(GPX), F.col("all"), F.lit("\n</gpx>\n")).alias("text"))


def coordinates(points: Column) -> Column:
    """``lon,lat,0`` of each place, blanks between."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.7f,%.7f,0", p["lon"], p["lat"])), " ")


def kml_fragment(points: Column) -> Column:
    """A point, line or polygon by the number of places and whether they close."""
    c, n = coordinates(points), F.size(points)
    wrap = lambda a, b: F.concat(F.lit(f"{a}<coordinates>"), c, F.lit(f"</coordinates>{b}"))
    closed = (n >= 4) & (F.get(points, F.lit(0)) == F.get(points, n - 1))
    return F.when(n == 1, wrap("<Point>", "</Point>")).when(closed, wrap("<Polygon><outerBoundaryIs><LinearRing>", "</LinearRing></outerBoundaryIs></Polygon>")).otherwise(wrap("<LineString><tessellate>1</tessellate>", "</LineString>"))


def kml(rows: DataFrame, path: str, colour: Column, title: str = "") -> DataFrame:
    """path, text of one file of placemarks (id, name, category, points) with a style for each category. Categories
    whose style names clash get a digest of theirs."""
    from pyspark.sql.window import Window

    kinds = rows.select("category", colour.alias("_colour")).groupBy("category").agg(F.min("_colour").alias("_colour")).withColumn("_slug", style_slug(F.col("category")))
    clash = F.count("*").over(Window.partitionBy("_slug")) > 1
    styled = kinds.withColumn("_style", F.when(clash, F.concat("_slug", F.lit("-"), F.substring(F.md5(F.col("category").cast("binary")), 1, 8))).otherwise(F.col("_slug")))
    style = F.concat(F.lit('<Style id="'), F.col("_style"), F.lit('"><LineStyle><color>'), F.col("_colour"), F.lit("</color><width>3</width></LineStyle><PolyStyle><color>"), F.col("_colour"), F.lit("</color></PolyStyle></Style>"))
    styles = styled.agg(F.array_join(F.array_sort(F.collect_list(style)), "\n").alias("styles"))
    mark = F.concat(F.lit("<Placemark><name>"), escaped(F.col("name")), F.lit("</name><styleUrl>#"), F.col("_style"), F.lit("</styleUrl>"), kml_fragment(F.col("points")), F.lit("</Placemark>"))
    marks = rows.join(styled.select("category", "_style"), "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", mark.alias("m")))), lambda x: x["m"]), "\n").alias("marks"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{title}</name>\n'
    # one row each
    return styles.crossJoin(marks).select(F.lit(path).alias("path"), F.concat(F.lit(head), "styles", F.lit("\n"), "marks", F.lit("\n</Document></kml>\n")).alias("text"))


def poly(rows: DataFrame, path: str, key: str = "name") -> DataFrame:
    """path, text of polygon files from ring places (key, pos, lat, lon)."""
    line = F.format_string("   %.6f   %.6f", "lon", "lat")
    rings = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("p")))), lambda x: x["p"]), "\n").alias("ring"))
    name = F.col(key).cast("string")
    return rings.select(F.concat(F.lit(f"{path}/"), name, F.lit(".poly")).alias("path"), F.concat(name, F.lit("\n1\n"), F.col("ring"), F.lit("\nEND\nEND\n")).alias("text"))


def box_ring(boxes: DataFrame, key: str = "name") -> DataFrame:
    """key, pos, lat, lon of the closed rings of boxes (west, south, east, north)."""
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    return boxes.select(key, F.posexplode(F.array(*[F.struct(F.col(y).alias("lat"), F.col(x).alias("lon")) for x, y in corners])).alias("pos", "p")).select(key, "pos", "p.lat", "p.lon")


def samples_json(rows: DataFrame, path: str) -> None:
    """name, lat, lon, azimuth, distance, a line each."""
    rows.select("name", "lat", "lon", "azimuth", "distance").write.mode("overwrite").json(path)


def trip_csv(rows: DataFrame, path: str) -> None:
    csv(rows, path, ["lat", "lon", "route_id"], ["route_id", "pos"])


def summary(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counters: all rows, and those for which each condition holds."""
    return rows.agg(F.count("*").alias("seen"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])


def small_extract(way_row: DataFrame, node_rows: DataFrame, path: str) -> DataFrame:
    """path, text of an extract with one way (id, refs, tags) and its nodes (id, lat, lon)."""
    node = F.format_string('<node id="%d" lat="%.7f" lon="%.7f"/>', "id", "lat", "lon")
    used = node_rows.join(way_row.select(F.explode("refs").alias("id")).distinct(), "id", "left_semi")
    nodes = used.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", node.alias("n")))), lambda x: x["n"]), "\n").alias("nodes"))
    refs = F.array_join(F.transform("refs", lambda r: F.format_string('<nd ref="%d"/>', r)), "\n")
    marks = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('<tag k="'), escaped(e["key"]), F.lit('" v="'), escaped(e["value"]), F.lit('"/>'))), "\n")
    way = way_row.select(F.concat(F.format_string('<way id="%d">\n', "id"), refs, F.lit("\n"), marks, F.lit("\n</way>")).alias("way"))
    return nodes.crossJoin(way).select(F.lit(path).alias("path"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">\n'), "nodes", F.lit("\n"), "way", F.lit("\n</osm>\n")).alias("text"))


def osm(nodes: DataFrame, ways: DataFrame, path: str) -> None:
    """Folders ``nodes`` and ``ways`` of map extracts as XML, a file for each task: nodes (id, lat, lon), ways (id,
    refs, tags)."""
    marks = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v")))
    out = {"node": nodes.select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "way": ways.select(F.col("id").alias("_id"), F.transform("refs", lambda r: F.struct(r.alias("_ref"))).alias("nd"), marks.alias("tag"))}
    for kind, rows in out.items():
        rows.write.format("xml").option("rowTag", kind).option("rootTag", "osm").save(f"{path}/{kind}s")


def save(documents: DataFrame) -> list[str]:
    """Writes each document (path, text) whole or not at all: to a name of its own first, then renamed. Returns the
    paths. The tasks write them, so no text goes through the driver, which gets the paths alone."""
    from wayfold.operators import graph

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                path, text = path.as_py(), text.as_py()
                # a local path is no URI: its blanks and signs stand for themselves
                local = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:") if path.startswith("file:/") else path if "://" not in path else None
                system, name = (fs.LocalFileSystem(), os.path.abspath(local)) if local is not None else fs.FileSystem.from_uri(path)
                system.create_dir(os.path.dirname(name), recursive=True)
                part = f"{name}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(text.encode())
                if local is not None:  # Hadoop's checksum of a file that was there before
                    sum_of = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
                    if os.path.exists(sum_of):
                        os.remove(sum_of)
                system.move(part, name)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    texts = graph.dealt(documents.select("path", "text"), "path")
    return [row["path"] for row in texts.mapInArrow(write, "path string").collect()]


def bundles(cluster_rows: DataFrame, path: str) -> DataFrame:
    """path, text of two documents for each cluster (slug, name, points, ids, traces): its line and its record."""
    line = cluster_rows.select(F.concat(F.lit(f"{path}/"), "slug", F.lit("/path.geojson")).alias("path"), F.concat(F.lit('{"type":"FeatureCollection","features":['), features_of(cluster_rows, "points"), F.lit("]}")).alias("text"))
    record = cluster_rows.select(F.concat(F.lit(f"{path}/"), "slug", F.lit("/meta.json")).alias("path"), F.to_json(F.struct("slug", "name", "ids", "traces")).alias("text"))
    return line.unionByName(record)


def photos_json(photos: DataFrame, path: str) -> DataFrame:
    """path, text of one JSON list of photos (path, lat, lon), in the order of paths."""
    one = F.to_json(F.struct(F.col("path").alias("photo"), "lat", "lon"))
    return photos.agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("all")).select(F.lit(path).alias("path"), F.concat(F.lit("["), F.col("all"), F.lit("]")).alias("text"))


def chapter_stamps(samples: DataFrame, every: int = 5, seconds: int = 3) -> DataFrame:
    """file, stamp, label: of samples (file, segment, end_m) every fifth, at three seconds a frame; the first is
    ``0km``, the others the kilometres at the end of the sample before."""
    from pyspark.sql.window import Window

    before = F.lag("end_m").over(Window.partitionBy("file").orderBy("segment"))
    s = F.col("segment") * seconds
    rows = samples.withColumn("_km", before / 1000).where(F.col("segment") % every == 0)
    label = F.when(F.col("segment") == 0, "0km").otherwise(F.format_string("%.1fkm", "_km"))
    return rows.select("file", "segment", F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("stamp"), label.alias("label"))


def trailing_distance(samples: DataFrame) -> DataFrame:
    """file, segment, distance: kilometres to the end of each sample in two places, but the last sample of a file
    repeats the one before it, 0 if there is none."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("file").orderBy("segment")
    km = F.round(F.col("end_m") / 1000, 2)
    last = F.lead("segment").over(by).isNull()
    return samples.select("file", "segment", F.when(last, F.coalesce(F.lag(km).over(by), F.lit(0.0))).otherwise(km).alias("distance"))
