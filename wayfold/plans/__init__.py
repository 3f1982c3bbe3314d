"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, spatial, tables, traces
from wayfold.plans.more import MORE
from wayfold.plans.survey import SURVEY, samples_queries
from wayfold.plans.views import EDGES, MEMBERS, PLACES, REFS, TRACE, view

CENTRE = (10.775, 106.705)
_HAV = "2 * 6371008.8E0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


def f1_bbox(spark, sf_dir):
    t = view(spark, sf_dir, "trace")
    return t.where(geo.in_bbox(F.col("lat"), F.col("lon"), (106.7, 10.77, 106.705, 10.775))).select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


F1 = f"SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({TRACE}) t WHERE lon BETWEEN 106.7 AND 106.705 AND lat BETWEEN 10.77 AND 10.775"


def f2_radius(spark, sf_dir):
    d = geo.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon"))
    return view(spark, sf_dir, "places").select("id", F.round(d, 3).alias("metres")).where("metres <= 4000")


F2 = f"SELECT * FROM (SELECT id, round({_hav('10.775E0', '106.705E0', 'lat', 'lon')}, 3) AS metres FROM ({PLACES}) p) WHERE metres <= 4000"


def g3_bearing(spark, sf_dir):
    b = geo.bearing(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon"))
    return view(spark, sf_dir, "places").select("id", F.round(b, 6).alias("bearing"), geo.utm_epsg(F.col("lat"), F.col("lon")).cast("long").alias("epsg"))


G3 = f"""SELECT id, round(((degrees(atan2(sin(radians(lon - 106.705E0)) * cos(radians(lat)),
  cos(radians(10.775E0)) * sin(radians(lat)) - sin(radians(10.775E0)) * cos(radians(lat)) * cos(radians(lon - 106.705E0)))) + 360) % 360), 6) AS bearing,
  CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS BIGINT) AS epsg FROM ({PLACES}) p"""


def w1_steps(spark, sf_dir):
    out = traces.with_steps(view(spark, sf_dir, "trace"))
    return out.select("file", "pos", "step_m", F.round("cum_m", 6).alias("cum_m"))


_STEPS = f"""SELECT file, pos, lat, lon, coalesce(round({_hav('lag(lat) OVER o', 'lag(lon) OVER o', 'lat', 'lon')}, 6), 0) AS step_m
  FROM ({TRACE}) t WINDOW o AS (PARTITION BY file ORDER BY pos)"""
_CUM = f"SELECT *, sum(step_m) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum_m FROM ({_STEPS}) s"
W1 = f"SELECT file, pos, step_m, round(cum_m, 6) AS cum_m FROM ({_CUM}) c"


def w2_track_samples(spark, sf_dir):
    out = traces.samples(view(spark, sf_dir, "trace"))
    return out.select("file", "segment", "points", "first_pos", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("end_m", 6).alias("end_m"))


W2 = f"""WITH c AS (SELECT *, CAST(floor(cum_m / 300) AS BIGINT) AS bucket FROM ({_CUM}) c0),
m AS (SELECT *, CASE WHEN bucket > coalesce(max(bucket) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS closes FROM c),
s AS (SELECT *, CAST(coalesce(sum(closes) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY file, segment ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY file, segment) AS n FROM s)
SELECT file, segment, count(*) AS points, min(pos) AS first_pos, round(max(CASE WHEN i = n // 2 THEN lat END), 6) AS lat,
  round(max(CASE WHEN i = n // 2 THEN lon END), 6) AS lon, round(max(cum_m), 6) AS end_m FROM r GROUP BY file, segment"""


def a16_spans(spark, sf_dir):
    out = traces.spans(view(spark, sf_dir, "trace"))
    return out.select("file", "points", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("file", "points")])


A16 = f"SELECT file, count(*) AS points, {', '.join(f'round({f}({c}), 6) AS {f}_{c}' for c in ('lat', 'lon') for f in ('min', 'max', 'median'))} FROM ({TRACE}) t GROUP BY file"


def a6_width(spark, sf_dir):
    t = view(spark, sf_dir, "trace").withColumn("off", F.col("value") - 100)
    out = tables.robust_width(t.select("event_type", F.col("off").alias("x")), "event_type", "x")
    return out.select("event_type", "points", "kept", *[F.round(c, 4).alias(c) for c in ("median", "mad", "width")])


A6 = """WITH v AS (SELECT event_type, value - 100 AS x FROM events),
m AS (SELECT event_type, median(x) AS median, count(*) AS points FROM v GROUP BY event_type),
o AS (SELECT v.event_type, x, m.median, points, abs(x - m.median) AS off FROM v JOIN m USING (event_type)),
d AS (SELECT event_type, median(off) AS mad FROM o GROUP BY event_type)
SELECT o.event_type, any_value(points) AS points, count(*) AS kept, round(any_value(o.median), 4) AS median, round(any_value(mad), 4) AS mad,
  round(quantile_cont(abs(x), 0.95) - quantile_cont(abs(x), 0.05), 4) AS width FROM o JOIN d USING (event_type)
WHERE mad = 0 OR off <= 3 * mad GROUP BY o.event_type"""


def a13_drop_repeated(spark, sf_dir):
    p = view(spark, sf_dir, "places").withColumn("label", F.when(F.col("size") == 1, "Unknown").otherwise(F.concat_ws(" ", "brand", "type", "size")))
    return tables.drop_repeated(p, "label").select("id", "label")


A13 = f"""WITH p AS (SELECT id, CASE WHEN size = 1 THEN 'Unknown' ELSE concat_ws(' ', brand, type, size) END AS label FROM ({PLACES}) p0)
SELECT id, label FROM p WHERE label = 'Unknown' OR label IN (SELECT label FROM p GROUP BY label HAVING count(*) = 1)"""


def a14_first_of(spark, sf_dir):
    return tables.first_of(view(spark, sf_dir, "trace"), ["file", "event_type"], "pos").select("file", "event_type", "pos", "event_id")


A14 = f"SELECT file, event_type, min(pos) AS pos, min_by(event_id, pos) AS event_id FROM ({TRACE}) t GROUP BY file, event_type"


def w11_slugs(spark, sf_dir):
    p = view(spark, sf_dir, "places").withColumn("base", F.regexp_replace(F.lower(F.concat_ws(" ", "brand", "type")), "[^a-z0-9]+", "_"))
    return tables.numbered_slugs(p, "base", "id").select("id", "slug")


W11 = f"""WITH p AS (SELECT id, regexp_replace(lower(concat_ws(' ', brand, type)), '[^a-z0-9]+', '_', 'g') AS base FROM ({PLACES}) p0),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM p)
SELECT id, CASE WHEN n = 1 THEN base ELSE format('{{}}_{{:02d}}', base, n) END AS slug FROM n"""


def j1_way_lines(spark, sf_dir):
    nodes = view(spark, sf_dir, "places").select(F.col("id").alias("node"), "lat", "lon").where("node % 7 <> 0")
    lines = tables.way_lines(view(spark, sf_dir, "refs"), nodes)
    first, last = F.col("points")[0], F.element_at("points", -1)
    return lines.select("way", F.size("points").cast("long").alias("points"), F.round(first["lat"], 6).alias("lat1"), F.round(first["lon"], 6).alias("lon1"), F.round(last["lat"], 6).alias("lat2"), F.round(last["lon"], 6).alias("lon2"))


J1 = f"""SELECT way, count(*) AS points, round(min_by(lat, pos), 6) AS lat1, round(min_by(lon, pos), 6) AS lon1, round(max_by(lat, pos), 6) AS lat2, round(max_by(lon, pos), 6) AS lon2
FROM ({REFS}) r JOIN ({PLACES}) p ON r.node = p.id WHERE node % 7 <> 0 GROUP BY way HAVING count(*) >= 2"""


def j3_within(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    return spatial.within(p, p, 900, once=True).select("a", "b", F.round("metres", 3).alias("metres"))


J3 = f"""SELECT a.id AS a, b.id AS b, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS metres FROM ({PLACES}) a JOIN ({PLACES}) b ON a.id < b.id
WHERE abs(a.lat - b.lat) < 0.01 AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 900"""


def j6_nearest(spark, sf_dir):
    p = view(spark, sf_dir, "places")
    return spatial.nearest(p, p, 1500).select("a", "b", F.round("metres", 3).alias("metres"))


J6 = f"""WITH x AS (SELECT a.id AS a, b.id AS b, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM ({PLACES}) a JOIN ({PLACES}) b ON a.id <> b.id
WHERE abs(a.lat - b.lat) < 0.02)
SELECT a, b, round(m, 3) AS metres FROM x WHERE m <= 1500 QUALIFY row_number() OVER (PARTITION BY a ORDER BY m, b DESC) = 1"""


def j19_relations(spark, sf_dir):
    present = view(spark, sf_dir, "places").where("id % 997 <> 0").select(F.col("id").alias("member"))
    return tables.complete_relations(view(spark, sf_dir, "members"), present)


J19 = f"SELECT DISTINCT relation FROM ({MEMBERS}) m WHERE relation NOT IN (SELECT relation FROM ({MEMBERS}) x WHERE member NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 997 <> 0))"


def r1_degrees(spark, sf_dir):
    return graph.degrees(view(spark, sf_dir, "edges"))


_DEG = "SELECT node, count(*) AS degree FROM (SELECT u AS node FROM ({e}) UNION ALL SELECT v FROM ({e})) GROUP BY node"
R1 = _DEG.format(e=EDGES)


def r2_core(spark, sf_dir):
    return graph.peel(view(spark, sf_dir, "edges"), 2)


# both ways of each edge, so that the degrees of a row's ends are counts over it; the last round is the fixpoint, or has only edges that go
R2_CORE = f"""WITH RECURSIVE r AS (SELECT 0 AS i, x.* FROM (SELECT u AS a, v AS b FROM ({EDGES}) e1 UNION ALL SELECT v, u FROM ({EDGES}) e2) x
UNION ALL SELECT i + 1, a, b FROM (SELECT *, min(least(da, db)) OVER () AS m FROM (SELECT *, count(*) OVER (PARTITION BY a) AS da, count(*) OVER (PARTITION BY b) AS db FROM r) c) d
WHERE m < 2 AND da >= 2 AND db >= 2),
z AS (SELECT *, count(*) OVER (PARTITION BY a) AS da, count(*) OVER (PARTITION BY b) AS db FROM r WHERE i = (SELECT max(i) FROM r))
SELECT a AS u, b AS v FROM z WHERE a < b AND da >= 2 AND db >= 2"""

def r6_all_triangles(spark, sf_dir):
    return graph.triangles(view(spark, sf_dir, "edges"))


R6_ALL = f"WITH e AS (SELECT * FROM ({EDGES}) e1) SELECT a.u AS x, a.v AS y, b.v AS z FROM e a JOIN e b ON a.v = b.u JOIN e c ON c.u = a.u AND c.v = b.v"

_KIND = "CASE WHEN size % 3 = 0 THEN 'food' WHEN size % 3 = 1 THEN 'road' ELSE 'quiet' END"


def _cells(spark, sf_dir):
    return tables.cells(view(spark, sf_dir, "places").withColumn("kind", F.expr(_KIND)), 0.02)


def a1_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


A1 = f"""SELECT CAST(floor(lon / 0.02) AS BIGINT) AS cx, CAST(floor(lat / 0.02) AS BIGINT) AS cy, count(*) AS places, count(*) FILTER (k = 'food') AS food,
count(*) FILTER (k = 'road') AS road, count(*) FILTER (k = 'quiet') AS quiet, CAST(max(CAST(k = 'food' AS BIGINT)) + max(CAST(k = 'road' AS BIGINT)) + max(CAST(k = 'quiet' AS BIGINT)) AS BIGINT) AS diversity
FROM (SELECT *, {_KIND} AS k FROM ({PLACES}) p) q GROUP BY 1, 2"""


def g36_scores(spark, sf_dir):
    out = tables.minmax(_cells(spark, sf_dir), ["food", "road"])
    return out.select("cx", "cy", F.round("n_food", 6).alias("n_food"), F.round("n_road", 6).alias("n_road"))


G36 = f"""SELECT cx, cy, {', '.join(f'round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) AS n_{c}' for c in ('food', 'road'))} FROM ({A1}) c"""


def f16_gate(spark, sf_dir):
    t = view(spark, sf_dir, "trace").groupBy("file").agg(F.avg((F.col("value") > 100).cast("double")).alias("coverage"), F.countDistinct("event_type").alias("n"))
    kind = F.when(F.col("coverage") >= 0.45, "covered").when(F.col("n") >= 5, "missing").otherwise("noise")
    return t.select("file", kind.alias("state"))


F16 = f"""SELECT file, CASE WHEN coverage >= 0.45 THEN 'covered' WHEN n >= 5 THEN 'missing' ELSE 'noise' END AS state
FROM (SELECT file, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS coverage, count(DISTINCT event_type) AS n FROM ({TRACE}) t GROUP BY file) x"""


def k22_timestamps(spark, sf_dir):
    t = traces.samples(view(spark, sf_dir, "trace")).where("segment % 5 = 0")
    s = F.col("segment") * 3
    return t.select("file", "segment", F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("stamp"))


K22 = f"SELECT file, segment, format('{{:02d}}:{{:02d}}:{{:02d}}', segment * 3 // 3600, segment * 3 % 3600 // 60, segment * 3 % 60) AS stamp FROM ({W2}) s WHERE segment % 5 = 0"

_ALL = {
    "f1_bbox": (f1_bbox, F1), "f2_radius": (f2_radius, F2), "f16_gate": (f16_gate, F16), "g3_bearing": (g3_bearing, G3), "g36_scores": (g36_scores, G36),
    "j1_way_lines": (j1_way_lines, J1), "j3_within": (j3_within, J3), "j6_nearest": (j6_nearest, J6), "j19_relations": (j19_relations, J19),
    "a1_cells": (a1_cells, A1), "a6_width": (a6_width, A6), "a13_drop_repeated": (a13_drop_repeated, A13), "a14_first_of": (a14_first_of, A14), "a16_spans": (a16_spans, A16),
    "w1_steps": (w1_steps, W1), "w2_track_samples": (w2_track_samples, W2), "w11_slugs": (w11_slugs, W11), "r1_degrees": (r1_degrees, R1), "r2_core": (r2_core, R2_CORE),
    "r6_all_triangles": (r6_all_triangles, R6_ALL), "k22_timestamps": (k22_timestamps, K22),
} | MORE | SURVEY | samples_queries(W2)


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
