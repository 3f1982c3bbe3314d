"""Geodesics, planar geometry, cells, loops and courses against brute force and known cases."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, geodesy, planar, routing, tags, text
from wayfold.operators import courses, graph, hexgrid, loops, paths, spatial, tables


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def tag_map(**kv):
    return F.create_map(*[F.lit(x) for p in kv.items() for x in p]) if kv else F.create_map().cast("map<string,string>")


def test_geodesic_round_trip_and_known_lengths(spark):
    rng = np.random.default_rng(2)
    lat, lon, az, m = rng.uniform(-80, 80, 500), rng.uniform(-180, 180, 500), rng.uniform(0, 360, 500), rng.uniform(1, 2e6, 500)
    la, lo = geodesy.direct(lat, lon, az, m)
    back, azimuth = geodesy.inverse(lat, lon, la, lo)
    assert back == pytest.approx(m, abs=1e-4) and np.abs((azimuth - az + 180) % 360 - 180).max() < 1e-4
    assert geodesy.inverse([0.0], [0.0], [0.0], [1.0])[0][0] == pytest.approx(math.pi / 180 * geodesy.A)
    assert geodesy.inverse([1.0], [1.0], [1.0], [1.0])[0][0] == 0 and np.isnan(geodesy.inverse([0.0], [0.0], [0.0], [180.0])[0][0])
    row = one(spark, g=geodesy.geodesic(F.lit(10.0), F.lit(106.0), F.lit(None).cast("double"), F.lit(106.0)), d=geodesy.destination(F.lit(10.0), F.lit(106.0), F.lit(90.0), F.lit(100.0)))
    assert row.g.metres is None and row.d.lat == pytest.approx(10, abs=1e-8)
    ring = geodesy.circle(10.0, 106.0, 500.0)
    assert len(ring) == 33 and geodesy.inverse([10.0] * 33, [106.0] * 33, *zip(*ring))[0] == pytest.approx(500.0)


def test_utm_round_trip_and_scale(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-79, 79), rng.uniform(-179, 179)) for _ in range(200)]
    zone = geodesy.utm_zone(F.col("lon"))
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), zone)
    df = spark.createDataFrame(rows, "lat double, lon double").withColumns({"z": zone, "e": east, "n": north})
    la, lo = geodesy.from_utm(F.col("e"), F.col("n"), F.col("z"), F.col("lat") < 0)
    for r in df.withColumns({"la": la, "lo": lo}).collect():
        assert (r.la, r.lo) == pytest.approx((r.lat, r.lon), abs=1e-8)
        assert geodesy.utm_arrays([r.lat], [r.lon])[0] == pytest.approx((r.e, r.n))
    p = geodesy.utm_arrays([10.0, 10.0], [105.0, 105.01], 48)  # on the central meridian lengths shrink by the scale
    assert np.hypot(*(p[1] - p[0])) == pytest.approx(geodesy.inverse([10.0], [105.0], [10.0], [105.01])[0][0] * geodesy.K0, rel=1e-6)
    assert one(spark, z=geo.utm_epsg(F.lit(55.0), F.lit(12.05))).z == 32633


def test_polyline_spiral_colours_and_indices(spark):
    row = one(spark, p=geodesy.polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")), c=geodesy.map_colour(F.lit("#AABB01")), r=geodesy.rounded(F.lit(0.285), 2), s=geodesy.retry_size(F.lit(10)), e=geodesy.even_indices(F.lit(5), F.lit(3)), o=geodesy.spiral(F.lit(0))[0], x=F.hypot(*geodesy.spiral(F.lit(4))))
    assert [(a, b) for a, b in row.p] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert (row.c, row.r, row.s, row.e, row.o, row.x) == ("ff01bbaa", 0.28, 8, [0, 2, 4], 0.0, pytest.approx(160.0))
    with pytest.raises(ValueError, match="breaks off"):
        geodesy.decoded("_p~iF~ps|U_ulLnnq")


def test_lines_against_sampling():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = (np.cumsum(rng.normal(size=(rng.integers(2, 7), 2)) * 20, 0) for _ in range(2))
        r = rng.uniform(2, 30)
        many = planar.interpolate(a, np.linspace(0, planar.lengths(a)[-1], 20001))
        share = (planar.feet(many, b)[0] <= r).mean()
        assert planar.covered(a, b, r) / planar.lengths(a)[-1] == pytest.approx(share, abs=2e-3)
        distance, along, _ = planar.feet(many[::500], b)
        dense = planar.interpolate(b, np.linspace(0, planar.lengths(b)[-1], 20001))
        for p, d in zip(many[::500], distance):
            assert d == pytest.approx(np.hypot(*(dense - p).T).min(), abs=0.02)
    line = np.array([(0.0, 0.0), (10.0, 0.0)])
    for tangent in (None, 1.0):
        s, along = planar.signed(np.array([(5.0, 1.0), (5.0, -2.0), (5.0, 0.0)]), line, tangent)
        assert s.tolist() == [1, -2, 0] and along.tolist() == [5, 5, 5]
    assert planar.simplified(np.array([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0.0)]), 1.0).tolist() == [0, 2, 3, 4]
    assert planar.merged(np.array([0, 5, 1.0]), np.array([2, 6, 3.0])) == 4 and planar.overlap(line, np.zeros((0, 2)), 1) == 0


def test_rings():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0.0)])
    assert planar.area([square, square * 0.5]) == 12 and planar.ring_centroid(square).tolist() == [2, 2]
    assert abs(planar.signed_area(planar.clipped(square, square + 2))) == 4 and len(planar.clipped(square, square + 9)) == 0
    assert len(planar.hull(np.array([(0, 0), (1, 1), (2, 0), (1, 0.2), (1, 3.0)]))) == 3
    assert abs(planar.signed_area(planar.buffered_hull(square, 1.0))) == pytest.approx(16 + 16 + math.pi, rel=0.005)
    assert planar.in_rings((1, 1), [square]) and not planar.in_rings((1, 1), [square], [square * 0.5]) and planar.on_edge((4, 2), square)
    assert len(planar.open_ring(square)) == 4 and len(planar.closed_ring(square[:-1])) == 5


def test_within_at_poles_and_across_the_meridian(spark):
    rng = random.Random(6)
    rows = [(i, lat + rng.uniform(-0.003, 0.003), ((lon + rng.uniform(-0.02, 0.02) + 180) % 360) - 180) for i, (lat, lon) in enumerate([(80, 10), (0, 180), (-75, -180), (89.99, 0), (59.999, 30), (10, 0)] * 12)]
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, lat double, lon double")
    from wayfold.operators.ordered import metres

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if metres(*a[1:], *b[1:]) <= 300}
    assert {(r.a, r.b) for r in spatial.within(df, df, 300, once=True).collect()} == want and len(want) > 20


def square_of(lon, lat, size):
    return [[lon, lat], [lon + size, lat], [lon + size, lat + size], [lon, lat + size], [lon, lat]]


def test_cells_tile_and_conserve(spark):
    grid = hexgrid.Grid(9, 10.0)
    ring = square_of(106.70, 10.77, 0.018)
    shares = hexgrid.polygon_shares([ring], grid)
    assert len(shares) > 1 and sum(shares.values()) == pytest.approx(hexgrid.ring_area_m2(ring))
    inside = [c for c in shares if shares[c] > 0.999 * grid.area(c)]
    assert inside and all(shares[c] == pytest.approx(grid.area(c), rel=0.01) for c in inside)
    line = [[106.70, 10.77], [106.72, 10.775], [106.73, 10.76]]
    assert sum(hexgrid.line_shares(line, grid).values()) == pytest.approx(hexgrid.line_length_m(line), rel=1e-9)
    rng = random.Random(3)
    rows = [(rng.uniform(10, 11), rng.uniform(106, 107)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1.0)], "lat double, lon double").withColumn("c", grid.cell(F.col("lat"), F.col("lon")))
    for r in df.collect():
        if r.lat is None:
            assert r.c is None
            continue
        assert r.c == grid.name(*grid.axial(r.lat, r.lon))
        q, k = grid.parts(r.c)
        p = np.array(grid.xy(r.lat, r.lon))
        others = [np.hypot(*(grid.centre_xy(q + a, k + b) - p)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert np.hypot(*(grid.centre_xy(q, k) - p)) == pytest.approx(min(others))
    a, b = grid.name(0, 0), grid.name(4, -7)
    path = [grid.parts(c) for c in grid.path(a, b)]
    assert len(path) == 8 and all(max(abs(x[0] - y[0]), abs(x[1] - y[1]), abs(sum(x) - sum(y))) == 1 for x, y in zip(path, path[1:]))
    track = spark.createDataFrame([(1, i, 10.77 + i / 200, 106.7) for i in range(5)], "file long, pos long, lat double, lon double")
    found = {r.cell for r in hexgrid.track_cells(track, grid).collect()}
    assert {grid.name(*grid.axial(10.77 + i / 200, 106.7)) for i in range(5)} <= found


def test_cell_features_and_scores(spark):
    grid = hexgrid.Grid(9, 10.0)
    lat, lon = grid.centre(grid.name(*grid.axial(10.77, 106.7)))
    near = lambda dx, dy: [lon + dx, lat + dy]
    line = lambda *p: json.dumps({"type": "LineString", "coordinates": list(p)})
    polygon = json.dumps({"type": "Polygon", "coordinates": [square_of(lon, lat, 0.0002)]})
    rows = [
        ("a", tags.CATEGORIES[12], {"highway": "primary"}, line(near(0, 0), near(0.0005, 0))),
        ("b", tags.CATEGORIES[12], {"highway": "primary"}, line(near(0, 0), near(0, 0.0005))),
        ("c", tags.CATEGORIES[8], {"highway": "footway"}, line(near(0, 0.0001), near(0.0003, 0.0001))),
        ("Parking bar", tags.CATEGORIES[12], {"amenity": "parking"}, polygon),
        ("lake", tags.CATEGORIES[9], {}, polygon),
        ("x", tags.CATEGORIES[3], {}, json.dumps({"type": "Point", "coordinates": [lon, lat]})),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, category string, tags map<string,string>, geometry string")
    out = hexgrid.derived(hexgrid.features(df, grid), grid).collect()
    assert len(out) == 1
    r = out[0]
    foot = hexgrid.line_length_m([near(0, 0.0001), near(0.0003, 0.0001)])
    assert (r.poi_total, r.parking_count, r.bar_count, r.intersection_count) == (5, 1, 1, 1)
    assert r.footway_length_m == pytest.approx(foot) and r.walkability_proxy == pytest.approx(1 + foot / 100)
    assert r.water_area_m2 == pytest.approx(hexgrid.ring_area_m2(square_of(lon, lat, 0.0002))) and r.road_length_m > r.major_road_length_m
    flat = hexgrid.scores(hexgrid.derived(hexgrid.features(df, grid), grid)).first()
    assert all(flat[n] == 0 for n in hexgrid.SCORES)
    assert hexgrid.features(df.limit(0), grid).count() == 0
    cells = hexgrid.features(df, grid)
    assert hexgrid.within_centre(cells, grid, lat, lon, 0.1).count() == 1 and hexgrid.within_centre(cells, grid, lat + 1, lon, 0.1).count() == 0
    assert hexgrid.on_track(cells, cells.limit(0)).count() == 0
    with pytest.raises(ValueError, match="negative"):
        hexgrid.within_centre(cells, grid, lat, lon, -1)
    coast = spark.createDataFrame([("sea", tags.CATEGORIES[9], {"natural": "coastline"}, line(near(0, 0), near(0.01, 0.005), near(0.02, 0)))], df.schema)
    total = hexgrid.features(coast, hexgrid.Grid(8, 10.0)).agg(F.sum("water_area_m2"), F.count("*")).first()
    assert total[0] == pytest.approx(300 * hexgrid.line_length_m([near(0, 0), near(0.01, 0.005), near(0.02, 0)]), rel=1e-6) and total[1] >= 2


def test_minmax_of_nearly_flat_field_and_unnamed_rows(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,)], "x double")
    assert {r.n_x for r in tables.minmax(df, ["x"]).collect()} == {0.0}
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "Unknown"), (6, "Unknown"), (7, "b")], "id long, n string")
    assert sorted(r.id for r in tables.drop_repeated(rows, "n").collect()) == [3, 4, 5, 6, 7]


def lines_frame(spark, rows):
    return spark.createDataFrame([(i, f, [{"lat": a, "lon": b} for a, b in p]) for i, f, p in rows], "id long, file string, points array<struct<lat:double,lon:double>>")


def north(lat, lon, metres, n=6):
    return [(lat + metres * k / (n - 1) / 111000, float(lon)) for k in range(n)]


def test_clusters_coverage_and_rollup(spark):
    d = 8 / 109000
    df = lines_frame(spark, [(1, "a", north(10, 106, 100)), (2, "b", north(10, 106 + d, 100)), (3, "c", north(10.5, 106, 90)), (4, "a", north(10, 106, 100)), (5, "z", [])])
    got = {r.id: r.cluster for r in paths.clusters(df).collect()}
    assert got[1] == got[2] == got[4] != got[3] and sorted(set(got.values())) == ["cluster_0001", "cluster_0002", "cluster_0003"]
    roll = {r.cluster: r for r in paths.rollup(df.where("id < 5"), paths.clusters(df)).collect()}
    assert (roll["cluster_0001"].traces, roll["cluster_0001"].segments, roll["cluster_0001"].ids) == (2, 3, [1, 2, 4]) and roll["cluster_0002"].traces == 1
    ways = lines_frame(spark, [(10, "w", north(10, 106 + d, 50)), (11, "w", north(10.0002, 106, 30)), (12, "w", north(12, 106, 30))])
    share = {r.id: r.coverage for r in paths.coverage(df.where("id < 5"), ways).collect()}
    line = paths._flat(np.array(north(10, 106, 100)), np.array(north(10, 106, 100)))
    many = planar.interpolate(line, np.linspace(0, planar.lengths(line)[-1], 20001))
    near = np.min([planar.feet(many, paths._flat(np.array(w), np.array(north(10, 106, 100))))[0] for w in (north(10, 106 + d, 50), north(10.0002, 106, 30))], 0) <= paths.COVER_M
    assert share[1] == pytest.approx(near.mean(), abs=1e-3) and share[3] == 0
    gated = {r.coverage: r.state for r in paths.gate(spark.createDataFrame([(0.5, 1), (0.1, 2), (0.2, 1)], "coverage double, traces int")).collect()}
    assert gated == {0.5: "covered", 0.1: "missing", 0.2: "noise"}
    assert paths.long_enough(df).count() == 4 and paths.within_radius(df, 10.0, 106.0, 1.0).count() == 3


def test_near_places_and_ways(spark):
    df = lines_frame(spark, [(1, "a", north(10, 106, 100)), (2, "b", north(11, 106, 100))])
    pois = spark.createDataFrame([(7, "p", 10.0, 106.0001, 1.0), (8, "q", 10.0, 106.0002, 3.0), (9, "far", 10.0, 106.01, 9.0)], "id long, name string, lat double, lon double, importance double")
    assert [(r.id, [p.other for p in r.pois]) for r in paths.near_pois(df, pois).collect()] == [(1, [8, 7])]
    ways = lines_frame(spark, [(21, "w", north(10, 106.0001, 50)), (22, "w", north(10, 106.0001, 50)), (23, "w", north(10, 106.001, 50))])
    at = spark.createDataFrame([(1, 10.0002, 106.0), (2, 50.0, 50.0)], "id long, lat double, lon double")
    assert [(r.id, r.way) for r in paths.nearest_way(at, ways, 50.0).collect()] == [(1, 22)]
    refs = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "way long, node long")
    assert paths.node_ways(spark.createDataFrame([(1, 5, 6)], "id long, node1 long, node2 long"), refs).first().ways == [1, 2]


def test_widths_along_a_way(spark):
    ways = lines_frame(spark, [(1, "w", north(10, 106, 100, 2))]).select(F.col("id").alias("way"), "points")
    rng = random.Random(5)
    rows = [(1, f"f{k % 3}", 10 + rng.uniform(0.00001, 0.00088), 106 + rng.uniform(-5, 5) / 109600) for k in range(300)]
    pts = spark.createDataFrame(rows, "way long, file string, lat double, lon double")
    off = paths.offsets(pts, ways)
    r = off.agg(F.min("signed"), F.max("signed"), F.max("along"), F.max("length")).first()
    assert -5.1 < r[0] < -4 and 4 < r[1] < 5.1 and r[2] < r[3]
    bins = paths.width_bins(off).orderBy("bin").collect()
    assert [b.bin for b in bins] == list(range(math.ceil(r[3] / 10))) and sum(b.points for b in bins) == 300 and bins[-1].end_m == pytest.approx(r[3])
    total = paths.width_summary(off).first()
    assert total.files == 3 and total.low <= total.median <= total.high and 4 < total.mean < 5.5
    assert paths.median_width(paths.width_bins(off)).first().width > 3
    assert paths.offsets(pts, ways, tangent=True).agg(F.max(F.abs("signed"))).first()[0] == pytest.approx(max(abs(r[0]), abs(r[1])), abs=1e-6)
    cut = one(spark, a=paths.way_slice(F.array(*map(F.lit, (4, 5, 6, 7))), F.lit(7), F.lit(5)), b=paths.way_slice(F.array(F.lit(4)), F.lit(4), F.lit(9)))
    assert cut.a == [5, 6, 7] and cut.b is None


def test_boxes_and_hulls(spark):
    pts = spark.createDataFrame([(1, i, 10.0 + a, 106.0 + b) for i, (a, b) in enumerate([(0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0), (0.005, 0.005)])], "file long, pos long, lat double, lon double")
    box, utm = paths.buffered_bbox(pts, 100).first(), paths.utm_bbox(pts, 100).first()
    assert box.south == pytest.approx(10 - 100 / geo.METERS_PER_DEGREE_LAT) and utm.south == pytest.approx(box.south, abs=1e-4) and utm.east == pytest.approx(box.east, abs=1e-4)
    ring = paths.hulls(pts, 100).orderBy("pos").collect()
    assert (ring[0].lat, ring[0].lon) == pytest.approx((ring[-1].lat, ring[-1].lon)) and min(p.lat for p in ring) == pytest.approx(box.south, abs=1e-4)


def grid_network(n, step, skip=()):
    net = loops.Network({i: (10 + i // n * step / 111195, 106 + i % n * step / 109500) for i in range(n * n)})
    for i in range(n * n):
        for j in ([i + 1] if i % n < n - 1 else []) + ([i + n] if i < n * n - n else []):
            if (i, j) not in skip:
                net.add(i, j, float(step))
    return net


def all_cycles(net, least, most):
    found = set()

    def walk(start, at, seen, length):
        for n, (far, _) in net.near[at].items():
            if n == start and len(seen) > 2 and least <= length + far <= most:
                found.add(frozenset(frozenset(e) for e in zip(seen, [*seen[1:], start])))
            elif n > start and n not in seen and length + far <= most:
                walk(start, n, [*seen, n], length + far)

    for s in net.near:
        walk(s, s, [s], 0.0)
    return found


def test_loops_of_grids(spark):
    net = grid_network(3, 100)
    assert [len(loops.cycles(loops.chains(net), t - 1, t + 1)) for t in (400, 600)] == [4, 4]
    net = grid_network(4, 100)
    runs = loops.chains(net)
    got = {frozenset(frozenset(e) for e in zip(w, w[1:])) for w in (loops.walked(runs, s) for _, s in loops.cycles(runs, 800, 1000))}
    assert got == all_cycles(net, 800, 1000) and len(got) > 10
    ring = loops.Network({i: (10 + math.cos(i / 10 * 2 * math.pi) / 1000, 106 + math.sin(i / 10 * 2 * math.pi) / 1000) for i in range(10)})
    for i in range(10):
        ring.add(i, (i + 1) % 10, 90.0)
    assert [(c[0], c[1], c[2]) for c in loops.chains(ring)] == [(0, 0, 900.0)] and len(loops.best(ring, 900)) == 1
    edges = spark.createDataFrame([(1, u, v, d, g) for u, near in net.near.items() for v, (d, g) in near.items() if u < v], "area long, u long, v long, length double, grade int")
    nodes = spark.createDataFrame([(1, n, *p) for n, p in net.at.items()], "area long, node long, lat double, lon double")
    found = loops.find(edges, nodes, 800.0).orderBy("rank").collect()
    assert [r.turns for r in found] == sorted(r.turns for r in found) and all(750 <= r.length <= 850 and r.nodes[0] == r.nodes[-1] for r in found)
    for a, b in itertools.combinations(found, 2):
        ea, eb = ({frozenset(e) for e in zip(x.nodes, x.nodes[1:])} for x in (a, b))
        assert 100 * len(ea & eb) <= 0.5 * b.length
    assert loops.loop_points(spark.createDataFrame(found), nodes).count() == sum(len(r.nodes) for r in found)
    assert loops.find(edges.limit(0), nodes.limit(0)).count() == 0


def test_turns_and_road_sides():
    net = grid_network(2, 100)
    square = [0, 1, 3, 2, 0]
    assert loops.turn_count(net, square) == 4 and not loops.sharp_turns_meet(net, square) and loops.turn_count(net, [0, 1, 0]) == 0
    assert loops.sharp_turns_meet(grid_network(2, 10), square)
    line = loops.Network({0: (10.0, 106.0), 1: (10.0, 106.001), 2: (10.0, 106.002), 3: (10.001, 106.001)})
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        line.add(a, b, 100.0)
    arms = {1: [(10.001, 106.001, 0)]}
    assert loops.crosses_road(line, [0, 1, 2, 3, 0], arms) and not loops.crosses_road(line, [0, 1, 2, 3, 0], {1: [(10.001, 106.001, 1)]})
    assert loops.park_share(net, square, [([np.array([(105.9, 9.9), (106.0005, 9.9), (106.0005, 10.1), (105.9, 10.1)])], [])]) == 0.5
    assert loops.rings([[1, 2, 3], [5, 4, 3], [5, 6, 1], [9, 8]])[0][0] == loops.rings([[1, 2, 3], [5, 4, 3], [5, 6, 1]])[0][-1]


def test_footpath_network(spark):
    at = {1: (10.0, 106.0), 2: (10.0, 106.001), 3: (10.0, 106.002), 4: (9.9995, 106.0005), 5: (10.0005, 106.0005), 6: (10.5, 106.0)}
    ways = [(1, {"highway": "footway"}, [1, 2, 3]), (2, {"highway": "primary"}, [4, 5]), (3, {"highway": "footway", "footway": "crossing"}, [3, 4]), (4, {"highway": "path"}, [3, 6]), (5, {"highway": "path", "layer": "1"}, [1, 2])]
    df = spark.createDataFrame([(w, t, [{"node": n, "lat": at[n][0], "lon": at[n][1]} for n in p]) for w, t, p in ways], "way long, tags map<string,string>, points array<struct<node:long,lat:double,lon:double>>")
    got = sorted((r.u, r.v, r.grade) for r in loops.footpaths(df, 10.0, 106.0).collect())
    assert got == [(1, 2, 1), (2, 3, 0)]  # the road cuts way 1 at its own grade, not the bridge beside it
    arms = loops.road_arms(loops.legs(df.where("way = 2"))).collect()
    assert {r.node for r in arms} == {4, 5}


def test_components_and_peel(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "u long, v long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert graph.peel(edges).count() == 0 and graph.peel(edges.limit(0)).count() == 0 and graph.components(edges.limit(0)).count() == 0


def test_thinning_and_courses(spark):
    line = [(10.0, 106.0 + x) for x in (0.010, 0.005, 0.0, -0.005, -0.010)]
    assert courses.thinned(line, 0, 2) == [0, 4] and courses.thinned([(10, 106), (10, 106), (10, 107)], 0) == [0, 2] and courses.thinned([]) == []
    assert len(courses.thinned([(10, 106), (10, 106.0005), (10, 106.01)], 100)) == 2
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(line)], "course long, pos long, lat double, lon double")
    assert sorted(r.pos for r in courses.thin(df, most=2).collect()) == [0, 4]
    calls = []

    def never(places):
        calls.append(places)

    parts = courses.merged(courses.solved(line[:4], never), never)
    assert sorted(x for p, _ in parts for x in p) == sorted((float(a), float(b)) for a, b in line[:4]) and len(parts) == 2
    small = lambda places: places if len(places) <= 3 else None
    assert sorted(len(p) for p, _ in courses.merged([([(0, i)], [(0, i)]) for i in range(7)], small)) == [1, 3, 3]
    assert sum(len(p) for p, _ in courses.merged([([(0, i)], [(0, i)]) for i in range(14)], small)) == 14
    out = courses.routes(df, small).collect()
    assert len(out) == 5 and {r.route_id for r in out} == {1, 2}
    left, right = courses.halves(line)
    assert len(left) == 2 and max(b for _, b in left) <= min(b for _, b in right)
    marks = spark.createDataFrame([("v", i, float(x), 0.0) for i, x in enumerate([100, 150, 600])], "view string, pos long, x double, y double")
    assert [r.cluster for r in courses.markers(marks).orderBy("pos").collect()] == [0, 0, 1]
    near = courses.chunk_pairs(spark.createDataFrame([(1, i, 0.0, float(i * i)) for i in range(4)], "course long, chunk int, lat double, lon double"))
    assert near.count() == 6 and near.orderBy("degrees").first()[1:3] == (0, 1)
    shots = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [courses.download(shots.limit(n), shots).first().plan for n in (0, 1, 2)] == ["none", "single", "multi"]


def test_text_rules(spark):
    row = one(
        spark, label=text.category_label(F.lit("tourism=picnic_site")), slug=text.slug(F.lit("Đường Nguyễn Huệ!! 2")), empty=text.slug(F.lit("!!")), said=text.description(F.lit('"Walk to the old  temple of nine words and more here. It is"')),
        sym=text.symbol(F.lit("historic=ruins"), tag_map(historic="castle")), worship=text.symbol(F.lit("amenity=place_of_worship"), tag_map(religion="Christian")), flag=text.symbol(F.lit("x=y"), tag_map()),
        fenced=text.reply(F.lit('```json\n{"vibe":"calm.","label":"good"}\n```')), plain=text.reply(F.lit("\nhello\nx")), none=text.reply(F.lit(None).cast("string")),
        name=text.path_name(F.lit(50.0), F.lit("A"), F.lit("B"), F.lit("c1")), same=text.path_name(F.lit(500.0), F.lit("A"), F.lit("A"), F.lit("c1")), bare=text.path_name(F.lit(100.0), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("c1")),
        picked=text.picked_name(tag_map(name="x")), shown=text.display_name(tag_map(name="", alt_name="y"), F.lit("a=b")), fallback=text.display_name(tag_map(), F.lit("natural=cave_entrance")), style=text.style_slug(F.lit("Food & café")),
        ctx=text.context(F.lit("c"), F.lit("n"), F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.create_map(F.lit("name:vi"), F.lit("a "), F.lit("ele"), F.lit("5"), F.lit("zzz"), F.lit("q"))), p=text.prompt(tag_map(b="1", a="2"), tag_map(z="3")),
    )
    assert (row.label, row.slug, row.empty, row.sym, row.worship, row.flag) == ("Picnic Site", "duong_nguyen_hue_2", "path", "Building", "Church", "Flag, Blue")
    assert row.said == "to the old temple of nine words and" and tuple(row.fenced) == ("calm", "positive") and tuple(row.plain) == ("hello", "mixed") and tuple(row.none) == ("Unclassified vibe", "mixed")
    assert (row.name, row.same, row.bare) == ("Shortcut near A, off B", "Path near A", "Footpath c1")
    assert (row.picked, row.shown, row.fallback, row.style) == ("x", "y", "Cave Entrance", "category-food-caf")
    assert row.ctx == {"category": "c", "display_name": "n", "coordinates": "1.00000, 2.00000", "ele": "5", "name:vi": "a"} and row.p == 'cell_features={"a":"2","b":"1"}\nscores={"z":"3"}'
    labels = spark.createDataFrame([(" Good ",), ("bleak",), ("mixed",), ("x",), (None,)], "t string").select(text.label(F.col("t")).alias("l")).collect()
    assert [r.l for r in labels] == ["positive", "negative", "mixed", "mixed", "mixed"]
    assert one(spark, p=text.position(F.lit(1), F.lit("[106.7,10.7]"))).p == [106.7, 10.7]
    for bad, message in ((text.position(F.lit(1), F.lit("[1]")), "Row 2"), (text.strict_object(F.lit("c9"), "scores", F.lit("[1]")), "Cell c9")):
        with pytest.raises(Exception, match=message):
            one(spark, x=bad)


def test_tag_predicates_and_profile(spark):
    cases = [({"historic": "x"}, True), ({"religion": "y"}, True), ({"boundary": "national_park"}, True), ({"name": "z"}, False), ({}, False)]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t map<string,string>").select(tags.is_interesting(F.col("t")).alias("i")).collect()
    assert [r.i for r in got] == [w for _, w in cases]
    row = one(spark, water=tags.is_water(tag_map(), F.lit("Seafood")), dry=tags.is_water(tag_map(natural="wood"), F.lit("x")), coast=tags.is_coastline(tag_map(natural="beach")), road=tags.highway_in(tag_map(highway="service"), tags.ROADS), kept=tags.projected(tag_map(shop="a", x="b")), grade=tags.road_grade(tag_map(layer="x", bridge="yes")), tunnel=tags.road_grade(tag_map(tunnel="yes")))
    assert (row.water, row.dry, row.coast, row.road, row.kept, row.grade, row.tunnel) == (True, False, True, True, {"shop": "a"}, 0, -1)
    ways = [{"highway": "footway", "surface": "sand"}, {"highway": "motorway"}, {"highway": "motorway", "foot": "yes"}, {"highway": "path", "access": "private"}, {"highway": "path", "access": "private", "foot": "yes"}, {"route": "ferry"}, {"highway": "steps", "oneway:foot": "yes", "name": "S"}, {"highway": "proposed"}]
    out = [r.p for r in spark.createDataFrame([(w,) for w in ways], "t map<string,string>").select(routing.profile(F.col("t")).alias("p")).collect()]
    assert [p and p.kmh for p in out] == [2.5, None, 5.0, None, 5.0, 5.0, 5.0, None] and (out[6].forward, out[6].backward, out[6].name) == (True, False, "S") and not out[5].startpoint
    nodes = spark.createDataFrame([({"barrier": "wall"},), ({"barrier": "wall", "access": "yes"},), ({"access": "no"},), ({"barrier": "yes", "bollard": "rising"},), ({},)], "t map<string,string>")
    assert [r.b for r in nodes.select(routing.barrier(F.col("t")).alias("b")).collect()] == [True, False, True, False, False]
    row = one(spark, a=routing.metres(F.lit("12 ft")), b=routing.metres(F.lit("10'6\"")), c=routing.kilograms(F.lit("3.5 t")), d=routing.kmh(F.lit("30 mph")), e=routing.metres(F.lit("x")), t=routing.turn_seconds(F.lit(True), F.lit(False)), f=routing.directed(tag_map(**{"maxspeed:forward": "5", "maxspeed": "7"}), "maxspeed")[1])
    assert (row.a, row.b, row.c, row.d, row.e, row.t, row.f) == (pytest.approx(3.6576), pytest.approx(3.2004), 3500.0, pytest.approx(48.28032), None, 2.0, "7")
