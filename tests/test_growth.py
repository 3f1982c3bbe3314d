"""Steps that have to stay small in the driver, or linear, where tables grow: their plans and what they compare."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold import sinks
from wayfold.functions import geodesy, planar
from wayfold.operators import courses, hexgrid, loops, paths, spatial
from wayfold.operators.ordered import metres


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_within_broadcasts_nothing_and_keeps_its_partitions(spark):
    df = spark.createDataFrame([(i, 10 + i / 5000, 106.0) for i in range(50)], "id long, lat double, lon double")
    pairs = spatial.within(df, df, 100.0, once=True)
    assert "Broadcast" not in plan(pairs) and plan(pairs).count("REPARTITION_BY_NUM") == 2
    assert pairs.count() == 4 * 50 - 10


def test_nearest_looks_no_farther_than_it_has_to(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, 10 + rng.uniform(0, 0.005), 106 + rng.uniform(0, 0.005)) for i in range(150)]
    rows += [(i, 10.02, 106.02) for i in range(200, 230)] + [(300, 10.03, 106.03), (301, 10.035, 106.03), (400, 11.0, 107.0)]
    df = spark.createDataFrame([*rows, (500, None, 1.0)], "id long, lat double, lon double")
    tried, own = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, b, m, once=False: tried.append((a.count(), m)) or own(a, b, m, once))
    got = {r.a: (r.b, round(r.metres, 6)) for r in spatial.nearest(df, df, 1500.0).collect()}
    want = {}
    for a, b in itertools.permutations(rows, 2):
        d = metres(*a[1:], *b[1:])
        if d <= 1500 and (a[0] not in want or (d, -b[0]) < want[a[0]]):
            want[a[0]] = (d, -b[0])
    assert got == {a: (-b, round(d, 6)) for a, (d, b) in want.items()} and len(got) == 182
    assert tried[0][1] < 400 and tried[-1] == (min(n for n, _ in tried), 1500.0) and tried[-1][0] < 10


def lines_of(rng, n):
    return [np.cumsum(rng.normal(size=(rng.integers(1, 12), 2)) * 20, 0) for _ in range(n)]


def padded(lines, width=16):
    return np.array([np.concatenate([x, np.repeat(x[-1:], width - len(x), 0)]) for x in lines])


def test_many_pairs_of_lines_at_once_equal_one_by_one():
    rng = np.random.default_rng(3)
    a, b = lines_of(rng, 200), lines_of(rng, 200)
    a[5] = np.repeat(a[5][:1], 3, 0)
    x, y = padded(a), padded(b)
    assert planar.mean_distance_each(x, y) == pytest.approx([planar.mean_distance(p, q) for p, q in zip(a, b)], abs=1e-9)
    for radius in (2.0, 10.0, 30.0):
        assert planar.overlap_each(x, y, radius) == pytest.approx([planar.overlap(p, q, radius) for p, q in zip(a, b)], abs=1e-9)
    points = rng.normal(size=(200, 2)) * 40
    signed, along = planar.signed_each(points, y, np.array([len(q) for q in b]))
    want = [planar.signed(p[None], q) for p, q in zip(points, b)]
    assert signed == pytest.approx([s[0] for s, _ in want], abs=1e-9) and along == pytest.approx([t[0] for _, t in want], abs=1e-9)


def line_frame(spark, lats):
    rows = [(i, "f", [(lat, 106.0), (lat + 0.001, 106.0)]) for i, lat in enumerate(lats)]
    return spark.createDataFrame(rows, "id long, file string, points array<struct<lat:double,lon:double>>")


def test_pairs_come_from_one_join(spark):
    lines, ways = line_frame(spark, (10.0, 10.0095, 10.5)), line_frame(spark, (10.0, 10.0095, 10.02))
    met = paths.touching(lines, ways, 12.0)
    assert "Broadcast" not in plan(met) and "Aggregate" not in plan(met)
    assert sorted(met.collect()) == [(0, 0), (1, 1)]
    at = spark.createDataFrame([(7, 10.0, 106.0001)], "id long, lat double, lon double")
    near = paths.nearest_way(at, ways, 50.0)
    assert plan(near).count("Join") == 1 and [(r.id, r.way) for r in near.collect()] == [(7, 0)]
    pois = at.withColumns({"name": F.lit("x"), "importance": F.lit(1.0)})
    few = paths.near_pois(lines, pois)
    assert plan(few).count("Join") == 1 and [(r.id, len(r.pois)) for r in few.collect()] == [(0, 1)]
    assert {r.id: round(r.coverage, 9) for r in paths.coverage(lines, ways).collect()} == {0: 1, 1: 1, 2: 0}


def test_bins_measure_their_offsets_once(spark):
    ways = line_frame(spark, (10.0, 10.5)).select(F.col("id").alias("way"), "points")
    pts = spark.createDataFrame([(0, "f", 10.0005, 106.0001), (0, "g", 10.0002, 105.9999)], "way long, file string, lat double, lon double")
    off = paths.offsets(pts, ways)
    assert "Broadcast" not in plan(off) and sorted(round(r.signed) for r in off.collect()) == [-11, 11]
    bins = paths.width_bins(off, 50.0)
    assert "Python" not in plan(bins) and bins.agg(F.sum("points")).first()[0] == 2


def test_rings_need_no_frame_a_relation(spark):
    members = spark.createDataFrame([(r, "outer", i, p) for r in (1, 2) for i, p in enumerate([[1, 2], [3, 2], [3, 1]])] + [(3, "outer", 0, [1, 2])], "relation long, role string, pos int, refs array<long>")
    out = loops.stitched(members)
    assert "InPandas" not in plan(out) and sorted((r.relation, len(r.ring)) for r in out.collect()) == [(1, 4), (2, 4)]


def test_thinning_solves_only_distances_about_the_spacing(monkeypatch):
    rng = np.random.default_rng(1)
    places = list(zip(10 + rng.uniform(0, 0.01, 300), 106 + rng.uniform(0, 0.01, 300)))
    solved, own = [], geodesy.inverse
    kept = courses.thinned(places)
    monkeypatch.setattr(geodesy, "inverse", lambda *x: solved.append(len(x[0])) or own(*x))
    assert courses.thinned(places) == kept and sum(solved[1:]) < 300
    p = np.array(places)
    middle, want = np.median(p, 0), []
    far = own(p[:, 0], p[:, 1], np.full(300, middle[0]), np.full(300, middle[1]))[0]
    for i in np.argsort(-far, kind="stable"):
        if all(own([p[i, 0]], [p[i, 1]], [p[j, 0]], [p[j, 1]])[0][0] > 100 for j in want):
            want.append(i)
    assert kept == sorted(want)


def test_cells_clip_only_where_bounds_meet_and_are_measured_once(spark, monkeypatch):
    grid, clips, own = hexgrid.Grid(9, 10.0), [], planar.clipped
    monkeypatch.setattr(planar, "clipped", lambda *x: clips.append(1) or own(*x))
    ring = np.array([(10.0, 106.0), (10.0, 106.0005), (10.0005, 106.0005), (10.0005, 106.0), (10.0, 106.0)])
    size = abs(planar.signed_area(np.stack(grid.xy(*ring.T), 1)))
    assert sum(grid.cover([ring]).values()) == pytest.approx(size) and len(clips) <= 4
    rows = spark.createDataFrame([("a", "x", {"k": "v"}, '{"type":"LineString","coordinates":[[106,10],[106.001,10]]}')], "name string, category string, tags map<string,string>, geometry string")
    out = hexgrid.features(rows, grid)
    assert "Python" not in plan(out) and out.first().poi_total == 1


def test_documents_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(f"{tmp_path}/d/{i} %41.gpx", "é" * i) for i in range(4)], "path string, text string")
    spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(f"{tmp_path}/d")
    monkeypatch.setattr(type(docs), "toLocalIterator", lambda *a: pytest.fail("texts came to the driver"))
    for _ in range(2):
        assert len(sinks.save(docs)) == 4
    assert sorted(p.name for p in (tmp_path / "d").glob("*.gpx*")) == [f"{i} %41.gpx" for i in range(4)] and (tmp_path / "d/3 %41.gpx").read_text() == "ééé"
