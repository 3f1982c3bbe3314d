"""Readers over files written here, and writers read back."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from wayfold import sinks
from wayfold.operators import hexgrid, tables
from wayfold.sources import files, osm, tracks

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/{v}"><wpt lat="1" lon="2"><name>w</name></wpt><rte><rtept lat="3" lon="4"/></rte>
<trk><name>t</name><trkseg><trkpt lat="10.0" lon="106.0"><ele>5</ele><time>2024-01-01T07:00:00+07:00</time></trkpt><trkpt lat="10.1" lon="106.1"/></trkseg><trkseg><trkpt lat="10.2" lon="106.2"/></trkseg></trk></gpx>"""
OSM = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="10.0" lon="106.0"><tag k="tourism" v="viewpoint"/><tag k="name" v="Look"/></node><node id="2" lat="10.0" lon="106.001"/><node id="3" lat="10.001" lon="106.001"/><node id="4" lat="10.001" lon="106.0"><tag k="shop" v="x"/></node>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="amenity" v="place_of_worship"/></way>
<way id="11"><nd ref="2"/><nd ref="3"/><nd ref="99"/><tag k="highway" v="path"/><tag k="name" v="P"/></way><way id="12"><nd ref="3"/><nd ref="4"/><tag k="highway" v="footway"/></way>
<relation id="20"><member type="way" ref="10" role=""/><member type="node" ref="1" role="x"/></relation><relation id="21"><member type="way" ref="77" role="outer"/></relation><relation id="22"><member type="relation" ref="21" role=""/></relation><relation id="23"><member type="relation" ref="22" role=""/></relation>
</osm>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.gpx").write_text(GPX.format(v="1/1"))
    (tmp_path / "in" / "deep" / "b.gpx.gz").write_bytes(gzip.compress(GPX.format(v="1/0").encode() + b" "))
    (tmp_path / "in" / "no.txt").write_text("x")
    rows = tracks.read(spark, str(tmp_path / "in")).orderBy("file", "pos").collect()
    assert [(r.track, r.segment, r.pos, r.lat, r.name) for r in rows] == [(0, 0, 0, 10.0, "t"), (0, 0, 1, 10.1, "t"), (0, 1, 2, 10.2, "t")] * 2
    assert rows[0].ele == 5 and rows[0].time.isoformat() == "2024-01-01T00:00:00" and rows[1].time is None
    assert tracks.read(spark, str(tmp_path / "in"), recursive=False).count() == 3
    assert sorted((r.kind, r.lat) for r in tracks.any_points(spark, f"{tmp_path}/in/a.gpx").collect()) == [("rte", 3.0), ("trk", 10.0), ("trk", 10.1), ("trk", 10.2), ("wpt", 1.0)]
    (tmp_path / "empty.gpx").write_text("<gpx/>")
    (tmp_path / "bad.gpx").write_text("<gpx>")
    assert tracks.read(spark, f"{tmp_path}/empty.gpx").count() == 0
    with pytest.raises(ValueError, match="no points"):
        tracks.any_points(spark, f"{tmp_path}/empty.gpx")
    with pytest.raises(Exception, match=r"bad\.gpx"):
        tracks.read(spark, f"{tmp_path}/bad.gpx").count()


def test_geoparquet(spark, tmp_path):
    line = struct.pack("<BII4d", 1, 2, 2, 106.0, 10.0, 106.5, 10.5)
    empty = struct.pack(">BII", 0, 2, 0)
    spark.createDataFrame([("a", "hcm", bytearray(line)), ("b", "hcm", None), ("c", "hcm", bytearray(empty))], "name string, city string, geometry binary").coalesce(1).write.parquet(f"{tmp_path}/src/city")
    rows = tracks.geoparquet(spark, f"{tmp_path}/src").collect()
    assert [(r.source, r.row, r.name, [tuple(p) for p in r.points]) for r in rows] == [("city", 0, "a", [(10.0, 106.0), (10.5, 106.5)])]


def test_osm(spark, tmp_path):
    path = f"{tmp_path}/x.osm"
    (tmp_path / "x.osm").write_text(OSM)
    nodes, ways, relations = osm.nodes(spark, path), osm.ways(spark, path), osm.relations(spark, path)
    assert tuple(osm.counts(spark, path).first()) == (4, 3, 4)
    assert {r.id: r.tags for r in nodes.collect()}[1] == {"tourism": "viewpoint", "name": "Look"} and {r.id: r.refs for r in ways.collect()}[11] == [2, 3, 99]
    points = lambda how: {r.way: len(r.points) for r in osm.way_points(ways, nodes, how).collect()}
    assert points("skip") == {10: 4, 11: 2, 12: 2} and points("drop") == {10: 4, 12: 2}
    with pytest.raises(Exception, match="way 11 lacks node 99"):
        points("raise")
    assert [p.lat for p in osm.one_way(spark, path, 12).first().points] == [10.001, 10.001]
    with pytest.raises(ValueError, match="no way 5"):
        osm.one_way(spark, path, 5)
    pois = [(r.id, r.name, r.lat) for r in osm.pois(ways, nodes).collect()]
    assert pois == [("node/1", "Look", 10.0), ("way/10", "Place Of Worship", pytest.approx((10.0 * 3 + 10.001) / 4))]
    assert [r.way for r in osm.path_ways(ways, nodes).collect()] == [12] and osm.named_highways(ways, nodes).count() == 0
    assert {r.way: r.name for r in osm.interesting(ways, nodes).collect()} == {10: "Unknown", 11: "P", 12: "Unknown"}
    near, kept = osm.clipped(nodes, ways, F.col("lat") > 10.0005)
    assert sorted(r.id for r in kept.collect()) == [10, 11, 12] and sorted(r.id for r in near.collect()) == [1, 2, 3, 4]
    assert [r.id for r in osm.complete(relations, nodes, ways).collect()] == [20]
    members = {r.id: r.members for r in relations.collect()}
    assert members[20][0].role == "outer" and members[20][1].role == "x"


def test_tables_and_payloads(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,type\n"a ""q"", b","{""x"":1}"\n"two\nlines",\n')
    rows = files.csv(spark, f"{tmp_path}/a.csv", ("name",)).collect()
    assert [r.name for r in rows] == ['a "q", b', "two\nlines"] and rows[0].type == '{"x":1}'
    with pytest.raises(ValueError, match="lacks the columns cell, z"):
        files.csv(spark, f"{tmp_path}/a.csv", ("z", "cell", "name"))
    (tmp_path / "l.json").write_text(json.dumps(["_p~iF~ps|U_ulLnnqC", "_p~iF~ps|U"]))
    assert [(r.line, len(r.points)) for r in files.polylines(spark, f"{tmp_path}/l.json").orderBy("line").collect()] == [(0, 2), (1, 1)]
    (tmp_path / "w.json").write_text(json.dumps({"source": "s", "count": 3, "waypoints": [{"id": "a", "lat": 1, "lon": 2, "tags": {"k": "v"}}, {"id": "b", "valid": False}, {"id": "c", "valid": True}]}))
    assert [r.id for r in files.waypoints(spark, f"{tmp_path}/none.json", f"{tmp_path}/w.json").collect()] == ["a", "c"]
    with pytest.raises(FileNotFoundError):
        files.waypoints(spark, f"{tmp_path}/none.json")
    (tmp_path / "c.json").write_text('["9:1:2","9:1:2","9:0:0"]')
    assert sorted(r.cell for r in files.cell_ids(spark, f"{tmp_path}/c.json").collect()) == ["9:0:0", "9:1:2"]
    (tmp_path / "p.poly").write_text("name\n1\n   106.0   10.0\n   106.1   10.0\n   106.1   10.1\nEND\n2\n 1 1\nEND\nEND\n")
    ring = files.poly(spark, f"{tmp_path}/p.poly").orderBy("pos").collect()
    assert [(r.lon, r.lat) for r in ring] == [(106.0, 10.0), (106.1, 10.0), (106.1, 10.1), (106.0, 10.0)]
    with pytest.raises(ValueError, match="three"):
        files.ring("n\n1\n1 1\n2 2\nEND\nEND")
    made = []
    make = lambda s, p: made.append(p) or s.read.text(p)
    for _ in range(2):
        assert files.cached(spark, f"{tmp_path}/l.json", f"{tmp_path}/cache", make).count() == 1
    assert len(made) == 1 and len(files.located(spark, str(tmp_path), (".json",))) == 3
    with pytest.raises(FileNotFoundError):
        files.located(spark, f"{tmp_path}/cache", (".gpx",))
    assert files.resolved(None, "city", "land", lambda p: p == "land") == "land" and files.resolved("x", "city", None, lambda p: True) == "x"
    with pytest.raises(FileNotFoundError):
        files.resolved(None, "city", "land", lambda p: False)
    rows = files.service(spark.range(3), lambda r: [(r["id"], "ok")] if r["id"] else [], "id long, code string")
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    pairs = spark.createDataFrame([("Ok", [1]), ("NoMatch", [1]), ("Ok", []), (None, None)], "code string, ways array<int>")
    assert files.unsnappable(pairs, F.col("code"), F.col("ways")).count() == 1


def exif(order, south, west):
    e = {"<": b"II*\0", ">": b"MM\0*"}[order]
    rational = lambda *v: struct.pack(order + "6I", *[x for p in v for x in p])
    entry = lambda tag, kind, n, value: struct.pack(order + "HHI", tag, kind, n) + value
    first = struct.pack(order + "H", 1) + entry(0x8825, 4, 1, struct.pack(order + "I", 26)) + b"\0" * 4
    gps = struct.pack(order + "H", 4) + entry(1, 2, 2, (b"S" if south else b"N") + b"\0\0\0") + entry(2, 5, 3, struct.pack(order + "I", 80)) + entry(3, 2, 2, (b"W" if west else b"E") + b"\0\0\0") + entry(4, 5, 3, struct.pack(order + "I", 104)) + b"\0" * 4
    return e + struct.pack(order + "I", 8) + first + gps + rational((37, 1), (48, 1), (0, 1)) + rational((122, 1), (240, 10), (0, 1))


def test_photos(spark, tmp_path):
    tiff = exif("<", False, True)
    assert files.gps(tiff) == (pytest.approx(37.8), pytest.approx(-122.4)) and files.gps(exif(">", True, False)) == (pytest.approx(-37.8), pytest.approx(122.4))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"
    (tmp_path / "B.JPG").write_bytes(jpeg)
    (tmp_path / "a.tif").write_bytes(tiff)
    (tmp_path / "none.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    (tmp_path / "broken.jpg").write_bytes(jpeg[:40])
    rows = files.photos(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["B.JPG", "a.tif"] and rows[0].lon == pytest.approx(-122.4)
    assert sinks.photos_json(spark.createDataFrame(rows), "x").first().text.count('"photo"') == 2


def test_written_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'q "x", y', {"b": "2", "a": "1"}, [(10.0, 106.0), (10.1, 106.1)])], "id long, name string, tags map<string,string>, points array<struct<lat:double,lon:double>>")
    sinks.csv(sinks.area_points(rows), f"{tmp_path}/areas")
    got = files.csv(spark, f"{tmp_path}/areas", ("name", "geometry", "type")).first()
    assert (got.name, got.type, json.loads(got.geometry)) == ('q "x", y', '{"a":"1","b":"2"}', {"type": "LineString", "coordinates": [[106.0, 10.0], [106.1, 10.1]]})
    first = spark.createDataFrame([("c1", "calm"), ("c2", "loud")], "cell_id string, vibe string")
    assert sinks.append_new(first.limit(1), f"{tmp_path}/vibes", "cell_id").count() == 1 and sinks.append_new(first, f"{tmp_path}/vibes", "cell_id").count() == 2
    grid = hexgrid.Grid(9, 10.0)
    cells = spark.createDataFrame([(grid.name(0, 0), 1, 0.12345678)], "cell string, poi_total long, green_share double")
    out = sinks.cells(cells, cells.select("cell", F.col("green_share").alias("busy")), grid).first()
    assert json.loads(out.cell_features) == {"green_share": 0.123457, "poi_total": 1} and len(json.loads(out.cell_boundary)["coordinates"][0]) == 7
    sinks.trip_csv(spark.createDataFrame([(1, 0, 1.0, 2.0)], "route_id int, pos long, lat double, lon double"), f"{tmp_path}/trip")
    sinks.samples_json(spark.createDataFrame([("img0000", 1.0, 2.0, 3.0, 0.0)], "name string, lat double, lon double, azimuth double, distance double"), f"{tmp_path}/samples")
    assert spark.read.json(f"{tmp_path}/samples").first().azimuth == 3.0 and files.csv(spark, f"{tmp_path}/trip").columns == ["lat", "lon", "route_id"]


def test_written_documents(spark, tmp_path):
    points = spark.createDataFrame([("run & fun", r, i, 10.0 + i / 100, 106.0) for r in (1, 2) for i in range(3)], "name string, route_id int, pos long, lat double, lon double")
    done = sinks.save(sinks.gpx_tracks(points, f"{tmp_path}/out"))
    assert sorted(p.rsplit("/", 1)[1] for p in done) == ["run & fun-route-01.gpx", "run & fun-route-02.gpx"]
    assert [r.lat for r in tracks.read(spark, f"{tmp_path}/out").where("file like '%01.gpx'").orderBy("pos").collect()] == [10.0, 10.01, 10.02]
    assert sinks.gpx_tracks(points.where("route_id = 1"), "x").first().path == "x/run & fun.gpx"
    pois = spark.createDataFrame([("b", "Zoo", 1.0, 2.0, 5.0, "Park", "nice"), ("a", "abc", 3.0, 4.0, None, "Museum", None)], "id string, name string, lat double, lon double, ele double, symbol string, description string")
    sinks.save(sinks.gpx_waypoints(pois, f"{tmp_path}/w.gpx"))
    assert [r.name for r in tracks.read(spark, f"{tmp_path}/w.gpx", ("wpt",)).orderBy("pos").collect()] == ["abc", "Zoo"]
    lines = spark.createDataFrame([(1, "p", "A b", [(1.0, 2.0)]), (2, "l", "A-b", [(1.0, 2.0), (2.0, 3.0)]), (3, "r", "C", [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)])], "id long, name string, category string, points array<struct<lat:double,lon:double>>")
    doc = sinks.kml(lines, "x.kml", F.lit("ff00ff00")).first().text
    assert doc.count("<Placemark>") == doc.count("<Style id=") == 3 and doc.count("<Polygon>") == doc.count("<Point>") == 1 and "category-a-b-" in doc and "category-c\"" in doc
    boxes = spark.createDataFrame([("box", 1.0, 2.0, 3.0, 4.0)], "name string, west double, south double, east double, north double")
    sinks.save(sinks.poly(sinks.box_ring(boxes), str(tmp_path)))
    assert [(r.lon, r.lat) for r in files.poly(spark, f"{tmp_path}/box.poly").orderBy("pos").collect()] == [(1, 2), (3, 2), (3, 4), (1, 4), (1, 2)]
    both = json.loads(sinks.collection(lines.select("id", "points"), "x").first().text)
    assert [f["geometry"]["type"] for f in both["features"]] == ["LineString", "LineString", "Polygon"] and sinks.features(lines).count() == 3
    way = spark.createDataFrame([(5, [1, 2], {"highway": "path", "name": 'a<"b'})], "id long, refs array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(1, 10.0, 106.0), (2, 10.1, 106.0), (3, 0.0, 0.0)], "id long, lat double, lon double")
    sinks.save(sinks.small_extract(way, nodes, f"{tmp_path}/small.osm"))
    assert len(osm.one_way(spark, f"{tmp_path}/small.osm", 5).first().points) == 2 and osm.ways(spark, f"{tmp_path}/small.osm").first().tags["name"] == 'a<"b'
    clusters = spark.createDataFrame([("s1", "n", [1, 2], 2, [(1.0, 2.0), (2.0, 3.0)])], "slug string, name string, ids array<long>, traces int, points array<struct<lat:double,lon:double>>")
    assert sorted(p[len(str(tmp_path)) :] for p in sinks.save(sinks.bundles(clusters, f"{tmp_path}/b"))) == ["/b/s1/meta.json", "/b/s1/path.geojson"]
    counters = sinks.summary(pois, named=F.col("description").isNotNull(), high=F.col("ele") > 9).first()
    assert tuple(counters) == (2, 1, 0)
    samples = spark.createDataFrame([(1, i, 300.0 * (i + 1)) for i in range(7)], "file long, segment long, end_m double")
    assert [(r.stamp, r.label) for r in sinks.chapter_stamps(samples).orderBy("segment").collect()] == [("00:00:00", "0km"), ("00:00:15", "1.5km")]
    assert [r.distance for r in sinks.trailing_distance(samples).orderBy("segment").collect()] == [0.3, 0.6, 0.9, 1.2, 1.5, 1.8, 1.8]
    assert tables.minmax(samples.limit(0), ["end_m"]).count() == 0
