"""Lines and points in metres: simplification, widths, coverage, clustering, and what lies near a line.

Lines are arrays of structs (lat, lon). A line is projected to the UTM zone of its first place, and what it
is compared with to that same zone. Null and empty lines match nothing and give null measures.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from wayfold.functions import geo, geodesy, planar
from wayfold.operators import graph, spatial, tables

LINE = "array<struct<lat:double,lon:double>>"
# Tolerances and thresholds in metres, shares and factors.
SIMPLIFY_M, SHORTEST_M, MIDPOINT_M, OVERLAP_M, OVERLAP_SHARE, MEAN_M, COVER_M, COVERED_SHARE, POI_M, SAMPLES = 4.0, 25.0, 200.0, 20.0, 0.45, 20.0, 12.0, 0.45, 50.0, 11


def _arrays(column) -> list:
    """Arrays of (lat, lon) of a column of lines; none for null."""
    return [None if x is None else np.array([(p["lat"], p["lon"]) for p in x], float).reshape(-1, 2) for x in column.to_pylist()]


def _flat(line: np.ndarray, like: np.ndarray) -> np.ndarray:
    """A line in the zone of another's first place."""
    zone = math.floor((like[0, 1] + 180) / 6) + 1
    return geodesy.utm_arrays(line[:, 0], line[:, 1], zone)


def _measure(fn, kind: str = "double"):
    """A Column function of lines from one of arrays; null if a line is null or empty."""

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(*columns):
        import pyarrow as pa

        rows = zip(*(_arrays(c) for c in columns), strict=True)
        return pa.array([None if any(x is None or not len(x) for x in row) else fn(*row) for row in rows], arrow)

    return run


def _ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """All places (n, 2) of a column of lines and the number of each line's; none for null."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(int)
    lat, lon = column.flatten().flatten()
    return np.stack([lat.to_numpy(zero_copy_only=False), lon.to_numpy(zero_copy_only=False)], 1).astype(float), sizes


def _zones(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The zone of each line's first place; 0 for no line."""
    out = np.zeros(len(sizes), int)
    out[sizes > 0] = np.floor((flat[(np.cumsum(sizes) - sizes)[sizes > 0], 1] + 180) / 6) + 1
    return out


class _Flat:
    """Lines in zones, each different one projected once."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, zones: np.ndarray):
        ends = np.cumsum(sizes)
        data, seen, codes, kept = np.ascontiguousarray(flat).tobytes(), {}, [], []
        for i, (a, b, z) in enumerate(zip(((ends - sizes) * 16).tolist(), (ends * 16).tolist(), zones.tolist(), strict=True)):
            code = seen.setdefault((data[a:b], z), len(seen))
            codes.append(code)
            if code == len(kept):
                kept.append(i)
        self.codes, kept = np.array(codes, int), np.array(kept, int)
        self.sizes = sizes[kept]
        self.first = np.cumsum(self.sizes) - self.sizes
        at = np.repeat((ends - sizes)[kept] - self.first, self.sizes) + np.arange(self.sizes.sum())
        self.xy = geodesy.utm_arrays(flat[at, 0], flat[at, 1], np.repeat(zones[kept], self.sizes)) if len(at) else np.zeros((0, 2))
        self.raw = flat[at]

    def padded(self, rows: np.ndarray, width: int, raw: bool = False) -> np.ndarray:
        c = self.codes[rows]
        return (self.raw if raw else self.xy)[self.first[c][:, None] + np.minimum(np.arange(width), self.sizes[c][:, None] - 1)]


def _blocks(*sizes: np.ndarray, most: int = 1 << 19):
    """Rows that have all lines, by widths (powers of two) to which these are padded, in blocks of limited size."""
    rows = np.flatnonzero(np.all([s > 0 for s in sizes], 0))
    widths = np.stack([2 ** np.ceil(np.log2(np.maximum(s[rows], 2))).astype(int) for s in sizes], 1)
    for w in np.unique(widths, axis=0):
        some = rows[(widths == w).all(1)]
        step = max(1, most // int(np.prod(w)))
        for i in range(0, len(some), step):
            yield some[i : i + step], w.tolist()


def _each_line(fn, kind: str = "double"):
    """``_measure`` of one line for whole batches: ``fn`` gets padded lines in metres and in degrees, and gives an array
    with a column for each field."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(column):
        flat, sizes = _ragged(column)
        lines = _Flat(flat, sizes, _zones(flat, sizes))
        return _filled(len(sizes), arrow, ((rows, fn(lines.padded(rows, w), lines.padded(rows, w, True))) for rows, (w,) in _blocks(sizes)))

    return run


def _each_pair(fn, kind: str = "double", like: int = 0):
    """``_measure`` of two lines for whole batches, both in the zone of the one that ``like`` says; ``fn`` gets padded
    lines and their sizes."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(*columns):
        both = [_ragged(c) for c in columns]
        zones = _zones(*both[like])
        p, q = (_Flat(*x, zones) for x in both)
        m, n = (s for _, s in both)
        return _filled(len(m), arrow, ((rows, fn(p.padded(rows, v), q.padded(rows, w), m[rows], n[rows])) for rows, (v, w) in _blocks(m, n)))

    return run


def _filled(n: int, arrow, parts):
    """An Arrow array of numbers or of structs of numbers from the parts' rows, null elsewhere."""
    import pyarrow as pa

    fields = [arrow.field(i) for i in range(arrow.num_fields)] if pa.types.is_struct(arrow) else None
    values, missing = np.zeros((n, len(fields or [0]))), np.ones(n, bool)
    for rows, made in parts:
        values[rows], missing[rows] = np.asarray(made, float).reshape(len(rows), -1), False
    if fields is None:
        return pa.array(values[:, 0], mask=missing).cast(arrow)
    return pa.StructArray.from_arrays([pa.array(v) for v in values.T], fields=fields, mask=pa.array(missing))


def simplified(line: Column, tolerance: float = SIMPLIFY_M) -> Column:
    """Without places that lie within a tolerance of the rest, by Douglas and Peucker's method in UTM."""
    points = lambda p: [{"lat": a, "lon": b} for a, b in p[planar.simplified(_flat(p, p), tolerance)].tolist()]
    return _measure(points, LINE)(line)


def cross_track_simplified(line: Column, tolerance_km: float = 0.01) -> Column:
    """The same with a tolerance in kilometres, as track compressors take it."""
    return simplified(line, tolerance_km * 1000)


def planar_length(line: Column) -> Column:
    return _each_line(lambda p, raw: planar.lengths_each(p)[:, -1])(line)


def at_fraction(line: Column, share: float = 0.5) -> Column:
    """Struct of the place that lies a share of the length along."""

    def place(p, raw):
        at = planar.lengths_each(p)
        return planar.interpolate_each(raw, at, share * at[:, -1:])[:, 0]

    return _each_line(place, "struct<lat:double,lon:double>")(line)


def centroid(line: Column) -> Column:
    """Struct of the centroid by length, or by area of a closed ring of four places or more."""

    def place(p):
        closed = len(p) >= 4 and (p[0] == p[-1]).all()
        c = planar.ring_centroid(p) if closed else planar.line_centroid(p) if len(p) > 1 else p[0]
        return {"lat": float(c[0]), "lon": float(c[1])}

    return _measure(place, "struct<lat:double,lon:double>")(line)


def mean_distance(a: Column, b: Column) -> Column:
    return _each_pair(lambda x, y, m, n: planar.mean_distance_each(x, y, SAMPLES))(a, b)


def overlap(a: Column, b: Column, metres: float = OVERLAP_M) -> Column:
    def share(x, y, m, n):
        w = max(x.shape[1], y.shape[1])
        return planar.overlap_each(*(np.concatenate([z, np.repeat(z[:, -1:], w - z.shape[1], 1)], 1) for z in (x, y)), metres)

    return _each_pair(share)(a, b)


def distance(point: Column, line: Column) -> Column:
    """Metres of a line's first place to another line."""
    return _each_pair(lambda p, q, m, n: planar.feet_each(p[:, :1], q)[0][:, 0])(point, line)


def long_enough(lines: DataFrame, line: str = "points", least: float = SHORTEST_M) -> DataFrame:
    """Lines of two places or more and of ``least`` metres or more."""
    return lines.where((F.size(line) >= 2) & (planar_length(F.col(line)) >= least))


def within_radius(lines: DataFrame, lat: float, lon: float, km: float, line: str = "points") -> DataFrame:
    """Lines that come within ``km`` of a place."""
    centre = F.array(F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon")))
    return lines.where(distance(centre, F.col(line)) <= km * 1000)


def buffered_bbox(points: DataFrame, metres: float, track: str = "file") -> DataFrame:
    """west, south, east, north of each track with a margin in degrees, wider from east to west by the latitude
    farthest from the equator."""
    d = metres / geo.METERS_PER_DEGREE_LAT
    b = points.groupBy(track).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    wide = F.lit(d) / F.cos(F.radians(F.greatest(F.abs("s"), F.abs("n"))))
    return b.select(track, (F.col("w") - wide).alias("west"), (F.col("s") - d).alias("south"), (F.col("e") + wide).alias("east"), (F.col("n") + d).alias("north"))


def utm_bbox(points: DataFrame, metres: float, track: str = "file") -> DataFrame:
    """The same with a margin in UTM: the four corners go back to degrees, and their bounds hold."""
    zone = points.groupBy(track).agg(geodesy.utm_zone(F.min_by("lon", "pos")).alias("zone"), (F.min_by("lat", "pos") < 0).alias("south_side"))
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    flat = points.join(zone, track).select(track, "zone", "south_side", east.alias("x"), north.alias("y"))
    b = flat.groupBy(track, "zone", "south_side").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corners = [geodesy.from_utm(x, y, F.col("zone"), F.col("south_side")) for x in (F.col("x0") - metres, F.col("x1") + metres) for y in (F.col("y0") - metres, F.col("y1") + metres)]
    lats, lons = [c[0] for c in corners], [c[1] for c in corners]
    return b.select(track, F.least(*lons).alias("west"), F.least(*lats).alias("south"), F.greatest(*lons).alias("east"), F.greatest(*lats).alias("north"))


def hulls(points: DataFrame, metres: float, track: str = "file") -> DataFrame:
    """track and the buffered convex hull of its points as a closed ring. Points are reduced to the hull of
    each batch before they meet, so a large track fills no task."""
    kind = points.schema[track].dataType.simpleString()

    def part(batches):
        for b in batches:
            for key, g in b.groupby(track):
                for lat, lon in planar.hull(g[["lat", "lon"]].to_numpy()).tolist():
                    yield _frame([(key, lat, lon)], [track, "lat", "lon"])

    def whole(key, g):
        p = g[["lat", "lon"]].to_numpy()
        zone = math.floor((p[0, 1] + 180) / 6) + 1
        ring = planar.closed_ring(planar.buffered_hull(geodesy.utm_arrays(p[:, 0], p[:, 1], zone), metres))
        south = bool(p[0, 0] < 0)
        return _frame([(key[0], i, x, y, zone, south) for i, (x, y) in enumerate(ring.tolist())], [track, "pos", "x", "y", "zone", "south"])

    few = points.select(track, "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").mapInPandas(part, f"{track} {kind}, lat double, lon double")
    flat = few.groupBy(track).applyInPandas(whole, f"{track} {kind}, pos int, x double, y double, zone int, south boolean")
    lat, lon = geodesy.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return flat.select(track, "pos", lat.alias("lat"), lon.alias("lon"))


def _frame(rows, names):
    import pandas as pd

    return pd.DataFrame(rows, columns=names)


def _tiles(lines: DataFrame, key: str, line: str, metres: float, size: float, *also: str) -> DataFrame:
    """A row, with the bounds (w, s, e, n), for each tile of ``size`` degrees that a line's bounds with a margin touch."""
    lats, lons = F.transform(line, lambda p: p["lat"]), F.transform(line, lambda p: p["lon"])
    d = F.lit(metres / geo.METERS_PER_DEGREE_LAT)
    wide = d / F.cos(F.radians(F.greatest(F.abs(F.array_min(lats)), F.abs(F.array_max(lats)))))
    box = lines.where(F.size(line) > 0).select(key, *also, (F.array_min(lons) - wide).alias("w"), (F.array_min(lats) - d).alias("s"), (F.array_max(lons) + wide).alias("e"), (F.array_max(lats) + d).alias("n"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return box.withColumn("_x", F.explode(span("w", "e"))).withColumn("_y", F.explode(span("s", "n")))


def touching(lines: DataFrame, others: DataFrame, metres: float, size: float = 0.01, left: tuple = (), right: tuple = ()) -> DataFrame:
    """Pairs (id, other) whose bounds come within ``metres``, by tiles that both touch; each pair once, in the first
    tile of both. Columns of the lines (``left``) and of the others (``right``) come along, so pairs are not joined again."""
    a = _tiles(lines, "id", "points", metres, size, *left)
    b = _tiles(others.withColumnRenamed("id", "other"), "other", "points", 0.0, size, *right).withColumnsRenamed({c: f"o{c}" for c in "wsen"})
    met = graph.dealt(a, "_x", "_y").join(graph.dealt(b, "_x", "_y").hint("merge"), ["_x", "_y"]).where("w <= oe AND ow <= e AND s <= `on` AND os <= n")
    first = (F.col("_x") == F.floor(F.greatest("w", "ow") / size)) & (F.col("_y") == F.floor(F.greatest("s", "os") / size))
    return met.where(first).select("id", "other", *left, *right)


def _spans(metres: float):
    """A Column function of two lines: where, in metres along, the first lies within ``metres`` of the other."""

    @F.arrow_udf("array<struct<a:double,b:double>>")
    def run(left, right):
        import pyarrow as pa

        (pf, m), (qf, n) = _ragged(left), _ragged(right)
        zones = _zones(pf, m)
        p, q = _Flat(pf, m, zones), _Flat(qf, n, zones)
        out = [(np.zeros(0, int), np.zeros(0), np.zeros(0))]
        for rows, (v, w) in _blocks(m, n):
            lines, ways = p.padded(rows, v), q.padded(rows, w)
            at, low, high = planar.lengths_each(lines), ways.min(1) - metres, ways.max(1) + metres
            for i in range(v - 1):
                a, b = lines[:, i], lines[:, i + 1]
                near = np.flatnonzero((np.maximum(a, b) >= low).all(1) & (np.minimum(a, b) <= high).all(1) & (at[:, i + 1] > at[:, i]))
                if len(near):
                    lo, hi = planar.cut_each(a[near], b[near], ways[near], metres)
                    r, c = np.nonzero(hi > lo)
                    start, size = at[near, i], at[near, i + 1] - at[near, i]
                    out.append((rows[near[r]], start[r] + lo[r, c] * size[r], start[r] + hi[r, c] * size[r]))
        rows, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(rows, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(m)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(a[order]), pa.array(b[order])], ["a", "b"]))

    return run


def coverage(lines: DataFrame, ways: DataFrame, metres: float = COVER_M) -> DataFrame:
    """id and the share of each line (id, points) that lies within ``metres`` of any way (id, points). Ways are
    compared in parts: what each covers of a line becomes intervals, and these are united, so no line's ways
    have to meet in memory but as intervals."""
    pairs = touching(lines.withColumn("p", F.col("points")), ways.withColumn("q", F.col("points")), metres, left=("p",), right=("q",))
    spans = pairs.select("id", F.inline(_spans(metres)("p", "q")))
    united = merged_intervals(spans, "id", "a", "b")
    return lines.select("id", planar_length(F.col("points")).alias("length")).join(united, "id", "left").select("id", F.least(F.lit(1.0), F.when(F.col("length") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("length")).otherwise(0.0)).alias("coverage"))


def merged_intervals(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key and covered, the length of the union of its intervals, by a running reach over their starts."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(before), F.lit(float("-inf")))
    new = spans.select(key, F.greatest(F.col(end) - F.greatest(F.col(start), reach), F.lit(0.0)).alias("_new"))
    return new.groupBy(key).agg(F.sum("_new").alias("covered"))


def gate(rows: DataFrame, share: float = COVERED_SHARE, traces: int = 2) -> DataFrame:
    """``rows`` (coverage, traces) with state: covered, missing, or noise if too few traces are there."""
    return rows.withColumn("state", F.when(F.col("coverage") >= share, "covered").when(F.col("traces") >= traces, "missing").otherwise("noise"))


def matches(lines: DataFrame, midpoint: float = MIDPOINT_M, radius: float = OVERLAP_M, share: float = OVERLAP_SHARE, mean: float = MEAN_M) -> DataFrame:
    """Pairs a < b of lines (id, points) whose midpoints lie within ``midpoint`` metres, and of which the shorter
    lies to a share within ``radius`` of the longer or whose mean distance is ``mean`` or less."""
    middles = lines.select("id", at_fraction(F.col("points")).alias("m")).select("id", "m.lat", "m.lon")
    near = spatial.within(middles, middles, midpoint, once=True).select("a", "b")
    both = near.join(lines.select(F.col("id").alias("a"), F.col("points").alias("p")).hint("merge"), "a")
    both = graph.dealt(both, "b").join(graph.dealt(lines.select(F.col("id").alias("b"), F.col("points").alias("q")), "b").hint("merge"), "b")
    return both.where((overlap(F.col("p"), F.col("q"), radius) >= share) | (mean_distance(F.col("p"), F.col("q")) <= mean)).select("a", "b")


def clusters(lines: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """id, cluster (``cluster_0001`` and on, by smallest member) of lines (id, points): the longest line left
    claims all lines left that it matches, which is not transitive. Lines of one component of the matching
    pairs are claimed in one task; components are independent of each other."""
    from pyspark.sql.window import Window

    pairs = graph.written(matches(lines) if pairs is None else pairs)
    parts = graph.components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    kind = lines.schema["id"].dataType.simpleString()
    sized = lines.select("id", planar_length(F.col("points")).alias("length"))
    inside = sized.join(parts.select(F.col("node").alias("id"), "root"), "id")
    links = pairs.join(parts.select(F.col("node").alias("a"), F.col("root").alias("part")), "a")

    def claim(key, rows, own):
        partners: dict = {}
        for a, b in zip(own["a"], own["b"], strict=True):
            partners.setdefault(a, set()).add(b)
            partners.setdefault(b, set()).add(a)
        left, out = set(rows["id"]), []
        for seed in rows.sort_values(["length", "id"], ascending=[False, True])["id"]:
            if seed in left:
                members = {seed, *(partners.get(seed, set()) & left)}
                left -= members
                out += [(m, min(members)) for m in members]
        return _frame(out, ["id", "first"])

    claimed = graph.dealt(inside, "root").groupBy("root").cogroup(graph.dealt(links, "part").groupBy("part")).applyInPandas(claim, f"id {kind}, first {kind}")
    every = sized.select("id").join(claimed, "id", "left").select("id", F.coalesce("first", "id").alias("first"))
    # only the clusters' first members are put in one order
    names = every.select("first").distinct().withColumn("cluster", F.format_string("cluster_%04d", F.row_number().over(Window.orderBy("first"))))
    return every.join(names, "first").select("id", "cluster")


def rollup(lines: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each cluster of lines (id, file, points): lengths, the longest line (of equals the first id) as
    geometry, bounds, files, ids in order, traces (files) and segments."""
    rows = lines.join(members, "id").withColumn("m", planar_length(F.col("points")))
    lat, lon = F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"])
    return rows.groupBy("cluster").agg(
        F.min("m").alias("shortest_m"), F.max("m").alias("longest_m"), F.avg("m").alias("mean_m"), F.sum("m").alias("total_m"),
        F.min_by("points", F.struct((-F.col("m")).alias("m"), "id")).alias("points"),
        F.min(F.array_min(lon)).alias("west"), F.min(F.array_min(lat)).alias("south"), F.max(F.array_max(lon)).alias("east"), F.max(F.array_max(lat)).alias("north"),
        F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_list("id")).alias("ids"), F.count_distinct("file").alias("traces"), F.count("*").alias("segments"),
    )


def member_lines(cluster_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """cluster, pos, id, points of each cluster's members in the order of its ids."""
    return cluster_rows.select("cluster", F.posexplode("ids").alias("pos", "id")).join(lines.select("id", "points"), "id")


def near_pois(lines: DataFrame, pois: DataFrame, metres: float = POI_M, most: int = 3) -> DataFrame:
    """id, pois: of the places (id, name, lat, lon, importance) within ``metres`` of a line the ``most`` with the
    best score, importance over one more than the distance; of equals the smaller id."""
    points = pois.select("id", F.array(F.struct("lat", "lon")).alias("points"), "name", "importance")
    both = touching(lines.withColumn("line", F.col("points")), points.withColumn("poi", F.col("points")), metres, left=("line",), right=("poi", "name", "importance"))
    far = both.withColumn("metres", distance(F.col("poi"), F.col("line"))).where(F.col("metres") <= metres)
    rank = F.struct((-F.col("importance") / (1 + F.col("metres"))).alias("s"), "other", "name", "metres")
    return far.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(rank)), 1, most).alias("pois"))


def nearest_way(points: DataFrame, ways: DataFrame, metres: float) -> DataFrame:
    """id, way, metres: for each place (id, lat, lon) the nearest way (id, points) within ``metres``; of equally
    near ones the later id."""
    at = points.select("id", F.array(F.struct("lat", "lon")).alias("points"))
    pairs = touching(at.withColumn("p", F.col("points")), ways.withColumn("q", F.col("points")), metres, left=("p",), right=("q",))
    far = pairs.withColumn("metres", distance(F.col("p"), F.col("q"))).where(F.col("metres") <= metres)
    return far.groupBy("id").agg(F.min_by("other", F.struct("metres", -F.col("other"))).alias("way"), F.min("metres").alias("metres"))


def node_ways(snapped: DataFrame, refs: DataFrame) -> DataFrame:
    """id, ways of snapped places (id, node1, node2): the ways that hold either node, in order."""
    ends = snapped.select("id", F.explode(F.array("node1", "node2")).alias("node"))
    return ends.join(refs.select("way", "node"), "node").groupBy("id").agg(F.array_sort(F.collect_set("way")).alias("ways"))


def offsets(points: DataFrame, ways: DataFrame, tangent: bool = False) -> DataFrame:
    """way, file, signed, along, length of places (way, file, lat, lon) against their way (way, points): signed
    metres from it, left positive, and metres along it."""

    kind = "struct<signed:double,along:double,length:double>"

    def run(p, q):
        way = _flat(q, q)
        size = float(planar.lengths(way)[-1])
        s, along = planar.signed(_flat(p, q), way, min(1.0, size / 1000))
        return {"signed": float(s[0]), "along": float(along[0]), "length": size}

    def batch(p, q, m, n):
        return np.stack([*planar.signed_each(p[:, 0], q, n), planar.lengths_each(q)[:, -1]], 1)

    both = graph.dealt(points, "way").join(graph.dealt(ways, "way").hint("merge"), "way").withColumn("_p", F.array(F.struct("lat", "lon")))
    measure = _measure(run, kind) if tangent else _each_pair(batch, kind, like=1)
    return both.select("way", "file", measure("_p", "points").alias("o")).select("way", "file", "o.*")


def width_summary(rows: DataFrame) -> DataFrame:
    """One row: count, mean, median and the 2.5th and 97.5th percentile of the widths of all files."""
    w = tables.robust_width(rows.withColumn("_k", F.struct("way", "file")), "_k", "signed")
    ends = F.percentile("width", F.array(F.lit(0.025), F.lit(0.975)))
    return w.agg(F.count("*").alias("files"), F.avg("width").alias("mean"), F.median("width").alias("median"), ends.alias("e")).select("files", "mean", "median", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def width_bins(rows: DataFrame, length: float = 10.0) -> DataFrame:
    """way, bin, start_m, end_m, points, kept, median, mad, width of ``length`` metres along each way; bins without
    points have no width."""
    rows = graph.written(rows)  # read several times, and dear to measure
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / length)).cast("long")
    every = rows.groupBy("way").agg(F.max("length").alias("length")).select("way", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    at = rows.withColumn("_k", F.struct("way", F.least(F.floor(F.col("along") / length), n - 1).alias("bin")))
    w = tables.robust_width(at, "_k", "signed").select("_k.way", "_k.bin", "points", "kept", "median", "mad", "width")
    out = every.join(w, ["way", "bin"], "left")
    return out.select("way", "bin", (F.col("bin") * length).alias("start_m"), F.least((F.col("bin") + 1) * length, F.col("length")).alias("end_m"), F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("kept", F.lit(0)).alias("kept"), "median", "mad", "width")


def median_width(bins: DataFrame) -> DataFrame:
    """way, width: the median over bins that have one."""
    return bins.groupBy("way").agg(F.median("width").alias("width"))


def way_slice(refs: Column, a: Column, b: Column) -> Column:
    """The nodes between two of a way's, both included, whichever comes first; null if one is not there."""
    i, j = F.array_position(refs, a), F.array_position(refs, b)
    return F.when((i > 0) & (j > 0), F.slice(refs, F.least(i, j).cast("int"), (F.abs(i - j) + 1).cast("int")))
