"""More registered queries: ordered operators, rollups, parsing and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo, parse
from wayfold.operators import ordered, traces
from wayfold.plans.views import PLACES, REFS, TRACE, view

NEAR_M, BIN_M = 100.0, 500.0


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371008.8E0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
    )


_STEPS = f"""SELECT file, pos, lat, lon, coalesce(round({_hav('lag(lat) OVER o', 'lag(lon) OVER o', 'lat', 'lon')}, 6), 0) AS step_m
  FROM ({TRACE}) t WINDOW o AS (PARTITION BY file ORDER BY pos)"""


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def g2_length(spark, sf_dir):
    return traces.with_steps(view(spark, sf_dir, "trace")).groupBy("file").agg(F.round(F.sum("step_m"), 3).alias("metres"))


G2 = f"SELECT file, round(sum(step_m), 3) AS metres FROM ({_STEPS}) s GROUP BY file"


def w7_without_near(spark, sf_dir):
    return ordered.without_near(view(spark, sf_dir, "trace"), NEAR_M).select("file", "pos")


W7 = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT file, pos, lat, lon FROM ({TRACE}) x),
  k AS (SELECT file, pos, lat, lon, TRUE AS kept FROM t WHERE pos = 0 UNION ALL
    SELECT t.file, t.pos, CASE WHEN d >= {NEAR_M} THEN t.lat ELSE t.klat END, CASE WHEN d >= {NEAR_M} THEN t.lon ELSE t.klon END, d >= {NEAR_M} FROM
      (SELECT t.*, k.lat AS klat, k.lon AS klon, {_hav('k.lat', 'k.lon', 't.lat', 't.lon')} AS d FROM k JOIN t ON t.file = k.file AND t.pos = k.pos + 1) t)
  SELECT file, pos FROM k WHERE kept"""


def w8_chunks(spark, sf_dir):
    return ordered.chunks(view(spark, sf_dir, "trace")).groupBy("file", "chunk").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("points"))


W8 = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT file, pos, step_m FROM ({_STEPS}) x),
  k AS (SELECT file, pos, CAST(0 AS BIGINT) AS chunk, 0E0 AS run FROM t WHERE pos = 0 UNION ALL
    SELECT t.file, t.pos, k.chunk + CASE WHEN k.run + step_m >= 750 THEN 1 ELSE 0 END, CASE WHEN k.run + step_m >= 750 THEN 0 ELSE k.run + step_m END
    FROM k JOIN t ON t.file = k.file AND t.pos = k.pos + 1),
  e AS (SELECT file, pos, chunk FROM k UNION SELECT file, pos, lag(chunk) OVER (PARTITION BY file ORDER BY pos) FROM k)
  SELECT file, chunk, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS points FROM e WHERE chunk IS NOT NULL GROUP BY file, chunk HAVING count(*) > 1"""


def w9_ends(spark, sf_dir):
    v = F.when(F.col("value") > 100, F.col("value"))
    first, last = (f("value", F.when(v.isNotNull(), F.col("pos"))) for f in (F.min_by, F.max_by))
    return view(spark, sf_dir, "trace").groupBy("file").agg(first.alias("first_value"), last.alias("last_value"))


W9 = f"""SELECT file, arg_min(value, pos) FILTER (WHERE value > 100) AS first_value, arg_max(value, pos) FILTER (WHERE value > 100) AS last_value
  FROM ({TRACE}) t GROUP BY file"""


def w10_bins(spark, sf_dir):
    return ordered.binned(view(spark, sf_dir, "trace"), BIN_M)


W10 = f"""WITH c AS (SELECT file, sum(step_m) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum_m FROM ({_STEPS}) s),
  n AS (SELECT file, CAST(greatest(1, ceil(max(cum_m) / {BIN_M})) AS BIGINT) AS n FROM c GROUP BY file),
  e AS (SELECT file, unnest(range(0, n)) AS bin FROM n),
  b AS (SELECT file, least(CAST(floor(cum_m / {BIN_M}) AS BIGINT), n - 1) AS bin, count(*) AS points FROM c JOIN n USING (file) GROUP BY ALL)
  SELECT file, bin, coalesce(points, 0) AS points FROM e LEFT JOIN b USING (file, bin)"""


def r7_ring_turns(spark, sf_dir):
    return ordered.ring_turns(view(spark, sf_dir, "trace"))


R7 = f"""WITH f AS (SELECT file, pos, radians(lon - first_value(lon) OVER w) * cos(radians(first_value(lat) OVER w)) * 6371008.8E0 AS x,
    radians(lat - first_value(lat) OVER w) * 6371008.8E0 AS y FROM ({TRACE}) t WINDOW w AS (PARTITION BY file ORDER BY pos)),
  n AS (SELECT file, x - coalesce(lag(x) OVER o, last_value(x) OVER w) AS ax, y - coalesce(lag(y) OVER o, last_value(y) OVER w) AS ay,
    coalesce(lead(x) OVER o, first_value(x) OVER w) - x AS bx, coalesce(lead(y) OVER o, first_value(y) OVER w) - y AS by_ FROM f
    WINDOW o AS (PARTITION BY file ORDER BY pos), w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT file, CASE WHEN count(*) < 3 THEN 0 ELSE count(*) FILTER (WHERE sqrt(ax * ax + ay * ay) >= 1 AND sqrt(bx * bx + by_ * by_) >= 1 AND abs(degrees(atan2(ax * by_ - ay * bx, ax * bx + ay * by_))) >= 30) END AS turns
  FROM n GROUP BY file"""


def j14_following(spark, sf_dir):
    return ordered.following(view(spark, sf_dir, "trace")).where("next_pos is not null")


J14 = f"""SELECT * FROM (SELECT file, pos, lead(file) OVER o AS next_file, lead(pos) OVER o AS next_pos FROM ({TRACE}) t WINDOW o AS (ORDER BY file, pos)) x
  WHERE next_pos IS NOT NULL"""


def g10_vertex_mean(spark, sf_dir):
    nodes = view(spark, sf_dir, "places").select(F.col("id").alias("node"), "lat", "lon")
    mean = [F.round(F.avg(c), 8).alias(c) for c in ("lat", "lon")]
    return view(spark, sf_dir, "refs").join(nodes, "node").groupBy("way").agg(*mean)


G10 = f"SELECT way, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM ({REFS}) r JOIN ({PLACES}) p ON r.node = p.id GROUP BY way"


def g14_kind(spark, sf_dir):
    ways = view(spark, sf_dir, "refs").withColumn("node", F.col("node") % 5).groupBy("way")
    ends = ways.agg(F.count("*").alias("n"), F.min_by("node", "pos").alias("a"), F.max_by("node", "pos").alias("b"))
    return ends.select("way", F.when((F.col("n") >= 4) & (F.col("a") == F.col("b")), "Polygon").otherwise("LineString").alias("kind"))


G14 = f"""SELECT way, CASE WHEN count(*) >= 4 AND arg_min(node % 5, pos) = arg_max(node % 5, pos) THEN 'Polygon' ELSE 'LineString' END AS kind
  FROM ({REFS}) r GROUP BY way"""


def a5_endpoints(spark, sf_dir):
    t = view(spark, sf_dir, "trace")
    ends = t.groupBy("file").agg(*[f(F.struct("lat", "lon"), "pos").alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))])
    flat = ends.select(F.explode(F.array("a", "b")).alias("e")).select(F.floor(F.col("e.lon") * 1000).alias("cell"), parse.endpoint_key(F.col("e.lat"), F.col("e.lon")).alias("key"))
    return flat.groupBy("cell", "key").agg(F.count("*").alias("n")).groupBy("cell").agg(F.count_if(F.col("n") >= 2).alias("shared"), F.min("key").alias("first_key"))


A5 = f"""WITH e AS (SELECT file, arg_min(lat, pos) AS lat, arg_min(lon, pos) AS lon FROM ({TRACE}) t GROUP BY file UNION ALL
    SELECT file, arg_max(lat, pos), arg_max(lon, pos) FROM ({TRACE}) t GROUP BY file),
  k AS (SELECT CAST(floor(lon * 1000) AS BIGINT) AS cell, format('{{:.6f}},{{:.6f}}', round(lat, 6), round(lon, 6)) AS key, count(*) AS n FROM e GROUP BY ALL)
  SELECT cell, count(*) FILTER (WHERE n >= 2) AS shared, min(key) AS first_key FROM k GROUP BY cell"""


def a9_rollup(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").withColumn("m", F.col("o_totalprice").cast("double"))
    longest = F.max_by("o_orderkey", F.struct("m", -F.col("o_orderkey"))).alias("longest")
    sums = [f("m").alias(n) for n, f in (("least", F.min), ("most", F.max))] + [(F.sum(F.round(F.col("m") * 100).cast("long")) / F.count("*")).alias("mean_cents")]
    files = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("files")
    return o.groupBy(F.col("o_custkey").alias("cluster")).agg(*sums, longest, files, F.count("*").alias("segments"))


A9 = """SELECT o_custkey AS cluster, min(m) AS least, max(m) AS most, CAST(sum(CAST(round(m * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean_cents, arg_max(o_orderkey, (m, -o_orderkey)) AS longest,
  string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS files, count(*) AS segments
  FROM (SELECT *, CAST(o_totalprice AS DOUBLE) AS m FROM orders) o GROUP BY o_custkey"""


def a10_summary(spark, sf_dir):
    n = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("files"), F.count("*").alias("segments"))
    return n.agg(F.count("*").alias("clusters"), F.max("segments").alias("largest"), F.count_if(F.col("files") > 1).alias("multi"), F.count_if(F.col("files") == 1).alias("singleton"))


A10 = """SELECT count(*) AS clusters, max(segments) AS largest, count(*) FILTER (WHERE files > 1) AS multi, count(*) FILTER (WHERE files = 1) AS singleton
  FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS files, count(*) AS segments FROM orders GROUP BY o_custkey) n"""

_LEGS = f"""SELECT way, pos, least(node, nxt) AS u, greatest(node, nxt) AS v, (way * 31 + pos * 17) % 100 AS metres FROM
  (SELECT way, pos, node % 200 AS node, lead(node % 200) OVER (PARTITION BY way ORDER BY pos) AS nxt FROM ({REFS}) r) l WHERE nxt IS NOT NULL AND nxt <> node"""


def a11_shortest(spark, sf_dir):
    legs = spark.sql(_LEGS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_read(spark, sf_dir, "lineitem"))
    return legs.groupBy("u", "v").agg(F.min(F.struct("metres", "way", "pos")).alias("m")).select("u", "v", "m.*")


A11 = f"SELECT u, v, metres, way, pos FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY metres, way, pos) AS i FROM ({_LEGS}) l) x WHERE i = 1"


def g28_bbox(spark, sf_dir):
    lat = F.degrees(F.lit(500.0 / geo.EARTH_RADIUS_M))
    lon = lat / F.cos(F.radians("lat"))
    ends = {"south": F.col("lat") - lat, "north": F.col("lat") + lat, "west": F.col("lon") - lon, "east": F.col("lon") + lon}
    return view(spark, sf_dir, "places").select("id", *[F.round(v, 6).alias(k) for k, v in ends.items()])


_DLAT = "degrees(500E0 / 6371008.8E0)"
G28 = f"""SELECT id, round(lat - {_DLAT}, 6) AS south, round(lat + {_DLAT}, 6) AS north, round(lon - {_DLAT} / cos(radians(lat)), 6) AS west,
  round(lon + {_DLAT} / cos(radians(lat)), 6) AS east FROM ({PLACES}) p"""


def g32_dms(spark, sf_dir):
    i = F.col("id")
    side = F.when(i % 3 == 0, "S").otherwise("N")
    return view(spark, sf_dir, "places").select("id", F.round(parse.dms(i % 90, i % 60, i % 7, side), 6).alias("degrees"))


G32 = f"""SELECT id, round(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END * (id % 90 + (id % 60) / 60E0 + (id % 7) / 3600E0), 6) + 0 AS degrees FROM ({PLACES}) p"""


def t23_lat_lon(spark, sf_dir):
    i = F.col("id").cast("string")
    text = F.when(F.col("id") % 4 == 0, F.concat(i, F.lit(",x"))).when(F.col("id") % 4 == 1, i).otherwise(F.concat(i, F.lit(",-"), i, F.lit(".5")))
    lat, lon = parse.lat_lon(text)
    return view(spark, sf_dir, "places").select("id", lat.alias("lat"), lon.alias("lon"))


T23 = f"SELECT id, CASE WHEN id % 4 > 1 THEN CAST(id AS DOUBLE) END AS lat, CASE WHEN id % 4 > 1 THEN -id - 0.5E0 END AS lon FROM ({PLACES}) p"


def j18_referenced(spark, sf_dir):
    used = _read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return view(spark, sf_dir, "places").join(used, "id", "left_semi").select("id")


J18 = f"SELECT id FROM ({PLACES}) p WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"


def u4_sets(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    a, b = (rows.where(F.col("l_suppkey") % 2 == k).select(F.col("l_partkey").alias("node")) for k in (0, 1))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


_SIDE = "SELECT l_partkey AS node FROM lineitem WHERE l_suppkey % 2 = "
U4 = f"SELECT node, 'both' AS side FROM ({_SIDE}0 INTERSECT {_SIDE}1) b UNION ALL SELECT node, 'first' FROM ({_SIDE}0 EXCEPT {_SIDE}1) f"

MORE = {
    "g2_length": (g2_length, G2), "w7_without_near": (w7_without_near, W7), "w8_chunks": (w8_chunks, W8), "w9_ends": (w9_ends, W9), "w10_bins": (w10_bins, W10),
    "r7_ring_turns": (r7_ring_turns, R7), "j14_following": (j14_following, J14), "g10_vertex_mean": (g10_vertex_mean, G10), "g14_kind": (g14_kind, G14),
    "a5_endpoints": (a5_endpoints, A5), "a9_rollup": (a9_rollup, A9), "a10_summary": (a10_summary, A10), "a11_shortest": (a11_shortest, A11), "g28_bbox": (g28_bbox, G28),
    "g32_dms": (g32_dms, G32), "t23_lat_lon": (t23_lat_lon, T23), "j18_referenced": (j18_referenced, J18), "u4_sets": (u4_sets, U4),
}
