import collections
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold import plans
from wayfold.functions import geo, parse, tags
from wayfold.operators import graph, ordered, spatial, tables, traces

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    if name not in plans.oracle_sql():
        assert df.count() > 0
        return
    want = c.sql(plans.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


def test_haversine_and_null(spark):
    row = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert row[0] == pytest.approx(math.radians(1) * geo.EARTH_RADIUS_M) and row[1] is None


def test_signed_offset_and_foot(spark):
    at = [F.lit(float(x)) for x in (5, 1, 0, 0, 10, 0)]
    d, t = geo.point_to_segment(*at)
    assert tuple(spark.range(1).select(geo.signed_offset(*at), d, t).first()) == (1.0, 1.0, 0.5)


def test_within_equals_brute_force(spark):
    rng = random.Random(1)
    points = [(i, 10 + rng.random() / 100, 106 + rng.random() / 100) for i in range(150)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {(r.a, r.b) for r in spatial.within(df, df, 150).where("a < b").collect()}

    def far(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(a))

    assert got == {(p[0], q[0]) for p, q in itertools.combinations(points, 2) if far(p, q) <= 150}


def test_peel_ring_with_tail(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)], "u long, v long")
    assert sorted(map(tuple, graph.peel(edges).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert [tuple(r) for r in graph.triangles(edges).collect()] == [(1, 2, 3)]


def test_core_equals_brute_force(spark, tmp_path):
    # orders of two lines are edges: a long tail that takes a round a node, a ring, and all of the smallest table
    pairs = [(i, i + 1) for i in range(900_000, 900_012)] + [(900_012, 900_010), (900_020, 900_021)]
    rows = [(10_000_000 + i, n + 1, p) for i, pair in enumerate(pairs) for n, p in enumerate(pair)]
    old = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    for name, table in (("all", old.unionByName(spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long"))), ("tail", spark.createDataFrame(rows[:24], "l_orderkey long, l_linenumber long, l_partkey long"))):
        table.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        e = {tuple(r) for r in plans.views.view(spark, f"{tmp_path}/{name}", "edges").collect()}
        while True:
            ends = [n for pair in e for n in pair]
            few = {n for n, k in collections.Counter(ends).items() if k < 2}
            if not few:
                break
            e = {pair for pair in e if not few & set(pair)}
        c = duckdb.connect()
        c.sql(f"create view lineitem as select * from '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
        got = sorted(map(tuple, plans.queries()["r2_core"](spark, f"{tmp_path}/{name}").collect()))
        assert got == sorted(e) == sorted(c.sql(plans.oracle_sql()["r2_core"]).fetchall())
        assert bool(got) == (name == "all")


def test_all_triangles_equal_brute_force(spark):
    e = {tuple(r) for r in plans.views.view(spark, SF, "edges").collect()}
    after = {}
    for u, v in e:
        after.setdefault(u, set()).add(v)
    want = {(x, y, z) for x, y in e for z in after[x] & after.get(y, set())}
    got = [tuple(r) for r in plans.queries()["r6_all_triangles"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(any(n % 4 for n in t) for t in got)


def test_robust_width_and_flat(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 9)] + [("b", 3.0)] * 3, "k string, x double")
    got = {r.k: r for r in tables.robust_width(df, "k", "x").collect()}
    assert got["b"].kept == 3 and got["b"].width == 0 and got["a"].median == 3


def test_samples_of_short_and_empty_tracks(spark):
    schema = "file long, pos long, lat double, lon double"
    assert traces.samples(spark.createDataFrame([], schema)).count() == 0
    assert [r.points for r in traces.samples(spark.createDataFrame([(1, 0, 10.0, 106.0)], schema)).collect()] == [1]


def test_tags(spark):
    df = spark.createDataFrame([('{"Amenity": "CAFE", "x": null}',), ("[]",), ("{bad",), (None,)], "t string")
    got = [(r.m, r.c) for r in df.select(tags.parse_tags(F.col("t")).alias("m")).withColumn("c", tags.category(F.col("m"), F.lit(None).cast("string"))).collect()]
    assert got[0] == ({"amenity": "cafe"}, "Food & café") and all(m == {} and c == "Local services" for m, c in got[1:])


def test_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 4), (4, 4), (4, 0))])
    row = spark.range(1).select(geo.in_ring(F.lit(2.0), F.lit(2.0), ring), geo.in_ring(F.lit(5.0), F.lit(2.0), ring)).first()
    assert tuple(row) == (True, False)


def test_parse(spark):
    rows = spark.createDataFrame([("1, 2", " a \n b "), ("1", ""), ("1,x", None), (None, "c")], "p string, t string")
    lat, lon = parse.lat_lon(F.col("p"))
    assert [tuple(r) for r in rows.select(lat, lon, parse.collapsed(F.col("t"), "none")).collect()] == [(1.0, 2.0, "a b"), (None, None, "none"), (None, None, "none"), (None, None, "c")]
    kinds = [{"ele": "x", "elevation": "12 m"}, {"ele": "7.5 m"}, {}, None]
    tag = spark.createDataFrame([(k,) for k in kinds], "t map<string,string>").select(parse.elevation(F.col("t")).alias("e"), parse.is_crossing(F.col("t")).alias("c"))
    assert [tuple(r) for r in tag.collect()] == [(12.0, False), (7.5, False), (None, False), (None, False)]


def test_ordered_on_empty_null_and_short_tracks(spark):
    schema = "file long, pos long, lat double, lon double"
    empty = spark.createDataFrame([], schema)
    for f in (ordered.without_near, ordered.chunks, lambda x: ordered.binned(x, 10.0), ordered.ring_turns, ordered.following):
        assert f(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, 10.0, 106.0), (1, 1, 10.0, 106.0), (1, 2, None, 106.0), (2, 0, 10.0, 106.0), (2, 1, 10.01, 106.0), (2, 2, 10.02, 106.0)], schema)
    assert sorted((r.file, r.pos) for r in ordered.without_near(rows).collect()) == [(1, 0), (2, 0), (2, 1), (2, 2)]
    assert sorted((r.file, r.chunk, r.pos) for r in ordered.chunks(rows).collect()) == [(1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 0, 1), (2, 1, 1), (2, 1, 2)]
