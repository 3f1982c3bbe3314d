"""Loops in footpath networks: chains between junctions, bounded search for cycles, filters and ranking.

Edges are (area, u, v, length, grade) with u < v, nodes (area, node, lat, lon). An area is what one search
circle holds, so it fits a task; areas are searched in parallel. Empty areas give no loops.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo, parse, planar, tags
from wayfold.operators import graph
from wayfold.operators.ordered import metres

# Lengths in metres, angles in degrees, the beam.
RADIUS_M, TARGET_M, EPSILON_M, TOP, SHARE = 700.0, 883.0, 50.0, 10, 0.5
TURN_DEG, SHARP_DEG, GAP_M, SIDE_M, BAND_M, BEAM, PARK_SHARE = 30.0, 60.0, 15.0, 1.0, 40.0, 24, 0.5


@dataclass
class Network:
    """An area: places, and for each node its neighbours with length and grade."""

    at: dict
    near: dict = field(default_factory=dict)

    def add(self, u, v, length, grade=0):
        for a, b in ((u, v), (v, u)):
            self.near.setdefault(a, {})[b] = (length, grade)


def legs(ways: DataFrame) -> DataFrame:
    """way, grade, u, v, lat1, lon1, lat2, lon2: the legs between consecutive places of ways (way, tags, points
    with node, lat and lon)."""
    flat = ways.select("way", tags.road_grade(F.col("tags")).alias("grade"), F.col("points").alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))
    cut = flat.where(F.size("p") >= 2).select("way", "grade", F.explode(pairs).alias("l"))
    return cut.select("way", "grade", F.col("l.a.node").alias("u"), F.col("l.b.node").alias("v"), F.col("l.a.lat").alias("lat1"), F.col("l.a.lon").alias("lon1"), F.col("l.b.lat").alias("lat2"), F.col("l.b.lon").alias("lon2"))


def _leg_tiles(rows: DataFrame, size: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return rows.withColumn("_x", F.explode(span("lon1", "lon2"))).withColumn("_y", F.explode(span("lat1", "lat2")))


def clear_of_roads(paths: DataFrame, roads: DataFrame, size: float = 0.002) -> DataFrame:
    """The legs of paths that cross no road's leg of their own grade properly; legs meet in tiles that both
    touch, so only legs that lie near each other are compared."""
    key = ["way", "u", "v", "lat1", "lon1", "lat2", "lon2"]
    xy = lambda a, b: (F.col(a), F.col(b))
    a = _leg_tiles(paths, size)
    b = _leg_tiles(roads.select("grade", *[F.col(c).alias(f"r_{c}") for c in key[3:]]).withColumnsRenamed({f"r_{c}": c for c in key[3:]}), size).withColumnsRenamed({c: f"r_{c}" for c in key[3:]})
    met = a.join(b, ["grade", "_x", "_y"]).where(geo.segments_cross(xy("lon1", "lat1"), xy("lon2", "lat2"), xy("r_lon1", "r_lat1"), xy("r_lon2", "r_lat2")))
    return paths.join(met.select(*key).distinct(), key, "left_anti")


def edges(path_legs: DataFrame) -> DataFrame:
    """u < v, length, grade: one edge for each pair of nodes, the shortest of parallel ones and of equals that of
    the smaller way. Legs without length or with equal ends are left out."""
    length = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    rows = path_legs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct(length.alias("length"), "way", "grade").alias("e"))
    return rows.groupBy("u", "v").agg(F.min("e").alias("e")).select("u", "v", "e.length", "e.grade")


def footpaths(ways: DataFrame, lat: float, lon: float, radius: float = RADIUS_M) -> DataFrame:
    """The network inside a circle: legs of footpaths that are no crossings, with both ends inside, and that cross
    no road of their grade."""
    t = F.col("tags")
    paths, roads = legs(ways.where(tags.highway_in(t, tags.FOOTPATH_HIGHWAYS) & ~parse.is_crossing(t))), legs(ways.where(tags.highway_in(t, tags.ROADS)))
    inside = lambda i: geo.haversine(F.lit(float(lat)), F.lit(float(lon)), F.col(f"lat{i}"), F.col(f"lon{i}")) <= radius
    return edges(clear_of_roads(paths.where(inside(1) & inside(2)), roads))


def chains(net: Network) -> list[tuple]:
    """(first, last, length, nodes) of the runs between junctions, nodes of a degree other than two; a ring
    without one begins at its smallest node. In the order of their first and second nodes."""
    ends = {n for n, near in net.near.items() if len(near) != 2}
    seen: set = set()
    for n in sorted(net.near):  # a ring has no end: its smallest node becomes one
        if n in seen:
            continue
        stack, part = [n], {n}
        while stack:
            for m in net.near[stack.pop()]:
                if m not in part:
                    part.add(m)
                    stack.append(m)
        seen |= part
        if not part & ends:
            ends.add(min(part))
    out, used = [], set()
    for a in sorted(ends):
        for b in sorted(net.near[a]):
            if (min(a, b), max(a, b)) in used:
                continue
            run, total = [a], 0.0
            step = b
            while True:
                used.add((min(run[-1], step), max(run[-1], step)))
                total += net.near[run[-1]][step][0]
                run.append(step)
                if step in ends:
                    break
                one, two = net.near[step]
                step = two if one == run[-2] else one
            out.append((a, run[-1], total, tuple(run)))
    return out


def cycles(runs: list[tuple], least: float, most: float, beam: int = BEAM, band: float = BAND_M) -> list[tuple[float, tuple]]:
    """(length, steps) of simple cycles of chains, each found from its lowest junction, breadth first. A junction
    takes ``beam`` partial ways in each band of length, later ones are dropped; of cycles over the same
    chains the first stays. Steps are (chain, junction it is left from)."""
    number = {j: i for i, j in enumerate(sorted({c[0] for c in runs} | {c[1] for c in runs}))}
    out: dict[int, list] = {}
    for i, (a, b, _, _) in enumerate(runs):
        for x, y in {(number[a], number[b]), (number[b], number[a])} if a != b else {(number[a], number[a])}:
            out.setdefault(x, []).append((i, y))
    for near in out.values():
        near.sort()
    found: dict[frozenset, tuple[float, tuple]] = {}
    for start in range(len(number)):
        room = {(start, 0): beam - 1}
        todo = deque([(start, 0.0, ())])
        while todo:
            at, gone, steps = todo.popleft()
            used, passed = {c for c, _ in steps}, {j for _, j in steps} | {at}
            for c, end in out.get(at, ()):
                far = gone + runs[c][2]
                if c in used or far > most or end < start:
                    continue
                way = (*steps, (c, at))
                if end == start:
                    if far >= least:
                        found.setdefault(frozenset(used | {c}), (far, way))
                elif end not in passed:
                    slot = (end, int(far // band))
                    if room.setdefault(slot, beam) > 0:
                        room[slot] -= 1
                        todo.append((end, far, way))
    names = sorted(number)
    return [(far, tuple((c, names[j]) for c, j in way)) for far, way in found.values()]


def walked(runs: list[tuple], steps: tuple) -> list:
    """The nodes of a cycle, the first one again at its end."""
    out: list = []
    for c, begin in steps:
        nodes = runs[c][3]
        out += (nodes if nodes[0] == begin else nodes[::-1])[:-1]
    return [*out, out[0]]


def _turns(net: Network, loop: list) -> list[float | None]:
    """The change of heading at each place of a ring, none beside a leg under a metre."""
    p = np.array([net.at[n] for n in loop[:-1]])
    ahead = np.roll(p, -1, 0) - p
    middle = np.radians((np.roll(p, -1, 0) + p)[:, 0] / 2)
    after = np.radians(np.stack([ahead[:, 1] * np.cos(middle), ahead[:, 0]], 1)) * geo.EARTH_RADIUS_M
    before = np.roll(after, 1, 0)
    size = np.hypot(*after.T) >= 1
    turn = np.degrees(np.arctan2(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0], (before * after).sum(1)))
    return [t if a and b else None for t, a, b in zip(turn.tolist(), size, np.roll(size, 1), strict=True)]


def turn_count(net: Network, loop: list) -> int:
    return 0 if len(loop) < 4 else sum(t is not None and abs(t) >= TURN_DEG for t in _turns(net, loop))


def sharp_turns_meet(net: Network, loop: list) -> bool:
    """Whether two sharp turns lie closer than the least gap along the ring, over its closing place too."""
    if len(loop) < 4:
        return False
    along = np.append(0.0, np.cumsum([metres(*net.at[a], *net.at[b]) for a, b in zip(loop[:-1], loop[1:], strict=True)]))
    at = [along[i] for i, t in enumerate(_turns(net, loop)) if t is not None and abs(t) >= SHARP_DEG]
    return len(at) > 1 and min([b - a for a, b in zip(at, at[1:], strict=False)] + [along[-1] - at[-1] + at[0]]) < GAP_M


def crosses_road(net: Network, loop: list, arms: dict) -> bool:
    """Whether the ring changes sides of a road at a node that both share: its neighbours there lie clearly on
    opposite sides of an arm (lat, lon, grade) of the grade that the ring has before and after."""

    def leg(a, b):
        middle = math.radians((a[0] + b[0]) / 2)
        return math.radians(b[1] - a[1]) * math.cos(middle) * geo.EARTH_RADIUS_M, math.radians(b[0] - a[0]) * geo.EARTH_RADIUS_M

    body = loop[:-1]
    for i, node in enumerate(body):
        before, after = body[i - 1], body[(i + 1) % len(body)]
        grade = net.near[before][node][1]
        if node not in arms or grade != net.near[node][after][1]:
            continue
        for lat, lon, g in arms[node]:
            x, y = leg(net.at[node], (lat, lon))
            size = math.hypot(x, y)
            if g != grade or size < 1:
                continue
            sides = [(x * q - y * p) / size for p, q in (leg(net.at[node], net.at[n]) for n in (before, after))]
            if min(sides) < 0 < max(sides) and min(map(abs, sides)) >= SIDE_M:
                return True
    return False


def park_share(net: Network, loop: list, parks: list) -> float:
    """Share of the ring's nodes inside a park, given as (outer rings, inner rings) of (lon, lat)."""
    inside = [any(planar.in_rings(net.at[n][::-1], o, i) for o, i in parks) for n in loop[:-1]]
    return sum(inside) / max(len(inside), 1)


def best(net: Network, target: float = TARGET_M, epsilon: float = EPSILON_M, top: int = TOP, share: float = SHARE, parks=(), arms=None) -> list[dict]:
    """The loops of an area: fewest turns first, those in parks next, then the closest length, then the shorter.
    One that shares more than ``share`` of its length with a loop before it is left out."""
    runs = chains(net)
    ranked = []
    for far, steps in cycles(runs, target - epsilon, target + epsilon):
        loop = walked(runs, steps)
        if crosses_road(net, loop, arms or {}) or sharp_turns_meet(net, loop):
            continue
        ranked.append((turn_count(net, loop), park_share(net, loop, list(parks)) < PARK_SHARE, abs(far - target), far, steps, loop))
    out: list[dict] = []
    for turns, _, _, far, steps, loop in sorted(ranked, key=lambda r: r[:4]):
        own = {c for c, _ in steps}
        if any(sum(runs[c][2] for c in own & o["chains"]) > share * far for o in out):
            continue
        out.append({"rank": len(out), "length": far, "turns": turns, "nodes": loop, "chains": own})
        if len(out) == top:
            break
    return out


def networks(rows, places) -> Network:
    net = Network({n: (a, b) for n, a, b in zip(places["node"], places["lat"], places["lon"], strict=True)})
    for u, v, length, grade in zip(rows["u"], rows["v"], rows["length"], rows["grade"], strict=True):
        net.add(u, v, length, grade)
    return net


def find(edge_rows: DataFrame, nodes: DataFrame, target: float = TARGET_M, epsilon: float = EPSILON_M, top: int = TOP, share: float = SHARE) -> DataFrame:
    """area, rank, length, turns, nodes: the best loops of each area."""
    import pandas as pd

    kind, node = edge_rows.schema["area"].dataType.simpleString(), nodes.schema["node"].dataType.simpleString()

    def search(key, rows, places):
        found = best(networks(rows, places), target, epsilon, top, share) if len(rows) else []
        return pd.DataFrame([(key[0], r["rank"], r["length"], r["turns"], r["nodes"]) for r in found], columns=["area", "rank", "length", "turns", "nodes"])

    return edge_rows.groupBy("area").cogroup(nodes.groupBy("area")).applyInPandas(search, f"area {kind}, rank int, length double, turns int, nodes array<{node}>")


def loop_points(loops: DataFrame, nodes: DataFrame) -> DataFrame:
    """area, rank, pos, lat, lon of loops, in their order."""
    return loops.select("area", "rank", F.posexplode("nodes").alias("pos", "node")).join(nodes, ["area", "node"]).select("area", "rank", "pos", "lat", "lon")


def rings(parts: list[list]) -> list[list]:
    """Closed rings of four places or more from pieces that share ends, whichever way round they lie; pieces that
    close no ring are left out."""
    left, out = [list(p) for p in parts if len(p) > 1], []
    while left:
        ring = left.pop()
        while ring[0] != ring[-1]:
            for i, p in enumerate(left):
                if ring[-1] in (p[0], p[-1]):
                    ring += p[1:] if p[0] == ring[-1] else p[-2::-1]
                elif ring[0] in (p[0], p[-1]):
                    ring[:0] = p[:-1] if p[-1] == ring[0] else p[:0:-1]
                else:
                    continue
                del left[i]
                break
            else:
                break
        if ring[0] == ring[-1] and len(ring) >= 4:
            out.append(ring)
    return out


def stitched(members: DataFrame) -> DataFrame:
    """relation, role, ring (nodes) from members (relation, role, refs)."""

    @F.arrow_udf("array<array<long>>")
    def join(column):
        import pyarrow as pa

        return pa.array([rings(parts) for parts in column.to_pylist()], pa.list_(pa.list_(pa.int64())))

    # one call for many relations, which are too small to be frames of their own
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").isNull(), "pos", "refs"))), lambda m: m["refs"])
    whole = graph.dealt(members, "relation", "role").groupBy("relation", "role").agg(parts.alias("parts"))
    return whole.select("relation", "role", F.explode(join("parts")).alias("ring"))


def relation_ways(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """relation, pos, role, refs: the ways among relations' members; ways that are not there are left out."""
    members = relations.select(F.col("id").alias("relation"), F.posexplode("members").alias("pos", "m")).where("m.type = 'way'")
    return members.select("relation", "pos", "m.role", F.col("m.ref").alias("id")).join(ways.select("id", "refs"), "id").select("relation", "pos", "role", "refs")


def in_park_nodes(loops: DataFrame, nodes: DataFrame, parks: DataFrame) -> DataFrame:
    """area, rank, share: the share of each loop's nodes inside a park (outer ring of lat, lon structs). Nodes meet
    the parks whose bounds' tiles they lie in."""
    size = 0.01
    box = parks.withColumns({"_x": F.explode(F.sequence(F.floor(F.array_min(F.transform("ring", lambda p: p["lon"])) / size), F.floor(F.array_max(F.transform("ring", lambda p: p["lon"])) / size)))})
    box = box.withColumn("_y", F.explode(F.sequence(F.floor(F.array_min(F.transform("ring", lambda p: p["lat"])) / size), F.floor(F.array_max(F.transform("ring", lambda p: p["lat"])) / size))))
    at = loop_points(loops, nodes).withColumns({"_x": F.floor(F.col("lon") / size), "_y": F.floor(F.col("lat") / size)})
    met = at.join(box, ["_x", "_y"], "left").withColumn("_in", F.coalesce(geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring")), F.lit(False)))
    each = met.groupBy("area", "rank", "pos").agg(F.max("_in").alias("in"))
    return each.groupBy("area", "rank").agg(F.avg(F.col("in").cast("double")).alias("share"))


def road_arms(road_legs: DataFrame) -> DataFrame:
    """node, lat, lon, grade: the far ends of the roads' legs at each node."""
    one = road_legs.select(F.col("u").alias("node"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"), "grade")
    return one.unionByName(road_legs.select(F.col("v").alias("node"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), "grade")).distinct()


def loop_arms(loops: DataFrame, arms: DataFrame) -> DataFrame:
    """area, rank, pos, node and the road arms at the loops' nodes."""
    return loops.select("area", "rank", F.posexplode("nodes").alias("pos", "node")).join(arms, "node")


def ranked(loops: DataFrame, target: float = TARGET_M) -> DataFrame:
    """Loops (turns, in_park, length) in order: turns, park first, closeness to the target, length."""
    return loops.orderBy("turns", F.when(F.col("in_park"), 0).otherwise(1), F.abs(F.col("length") - target), "length")


def mean_colour(i: Column, n: int) -> Column:
    """Hue of the i-th of n, far from those before it: turns of the golden angle in degrees."""
    return F.pmod(i * F.lit(math.degrees(math.pi * (3 - math.sqrt(5)))), F.lit(360.0))
