"""Courses through places: thinning, splitting, solving by a given solver, merging routes, and markers.

A solver is a function from a list of (lat, lon) to the route's places, or none if there is no trip. A course is
what one group holds; courses run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo, geodesy
from wayfold.operators import graph

# Spacing in metres, sizes and shares of chunks, pixels.
SPACING_M, LEAST_SPLIT, LEAST_SHARE, RETRY, EXACT, PIXELS = 100.0, 4, 0.15, 0.85, 12, 80.0


def thinned(places: list, spacing: float = SPACING_M, most: int | None = None, centre: str = "median") -> list[int]:
    """Indices kept, in input order: from the farthest from the centre inwards (of equals the first), each that is
    farther than ``spacing`` from all kept before, until there are ``most``. With no spacing equal places
    still give one."""
    if most is not None and most < 1:
        raise ValueError("most must be 1 or more")
    if not places:
        return []
    p = np.array(places, float)
    middle = np.median(p, 0) if centre == "median" else p.mean(0)
    far = geodesy.inverse(p[:, 0], p[:, 1], np.full(len(p), middle[0]), np.full(len(p), middle[1]))[0]
    y, x = np.radians(p).T
    unit = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1)
    # the ellipsoid's distances lie within 0.7 % of the sphere's; only those about the spacing are solved
    least, beyond = (2 * geo.EARTH_RADIUS_M * math.sin(min(math.pi / 2, max(0.0, spacing * s + d) / 2 / geo.EARTH_RADIUS_M)) for s, d in ((0.99, -0.01), (1.01, 0.01)))
    kept, near = [], np.empty((len(p), 3))
    for i in np.lexsort((np.arange(len(p)), -far)).tolist():
        if kept:
            d = near[: len(kept)] - unit[i]
            chord = np.sqrt((d * d).sum(1)) * geo.EARTH_RADIUS_M
            if spacing > 0 and (chord < least).any():
                continue
            k = p[np.array(kept)[chord <= beyond]]
            if len(k) and (geodesy.inverse(np.full(len(k), p[i, 0]), np.full(len(k), p[i, 1]), k[:, 0], k[:, 1])[0] <= spacing).any():
                continue
        near[len(kept)] = unit[i]
        kept.append(i)
        if most is not None and len(kept) == most:
            break
    return sorted(kept)


def thin(points: DataFrame, course: str = "course", spacing: float = SPACING_M, most: int | None = None, centre: str = "median") -> DataFrame:
    """course, pos, lat, lon of the places that stay, course by course."""
    kind = points.schema[course].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        return g.iloc[thinned(list(zip(g["lat"], g["lon"], strict=True)), spacing, most, centre)]

    rows = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(course, "pos", "lat", "lon")
    return graph.dealt(rows, course).groupBy(course).applyInPandas(run, f"{course} {kind}, pos long, lat double, lon double")


def halves(places: list) -> tuple[list, list]:
    """Sorted by the wider axis (east to west if both are as wide) and then the other, and cut in the middle."""
    if len(places) < LEAST_SPLIT:
        raise ValueError("too few places to split")
    p = np.array(places, float)
    wide = np.ptp(p, 0)
    first, second = (1, 0) if wide[1] >= wide[0] else (0, 1)
    ordered = [tuple(x) for x in p[np.lexsort((np.arange(len(p)), p[:, second], p[:, first]))].tolist()]
    return ordered[: len(p) // 2], ordered[len(p) // 2 :]


def even(n: int, wanted: int) -> list[int]:
    return list(range(n)) if wanted >= n else [0] if wanted < 2 else sorted({round(i * (n - 1) / (wanted - 1)) for i in range(wanted)})


def retry_size(n: int) -> int:
    return max(2, min(n - 1, int(n * RETRY)))


def solved(places: list, solver: Callable) -> list[tuple[list, list]]:
    """(places, route) of the parts of a course. What has no trip is split, left part first; parts that cannot be
    split are tried with fewer and fewer places spread evenly, and pass through as they are if none helps."""
    out, todo = [], [list(places)]
    while todo:
        part = todo.pop()
        if not part:
            continue
        route = solver(part)
        if route is not None:
            out.append((part, list(route)))
        elif len(part) >= LEAST_SPLIT:
            left, right = halves(part)
            todo += [right, left]
        else:
            least, n = max(2, int(len(part) * LEAST_SHARE)), len(part)
            while route is None and n > least:
                n = max(least, retry_size(n))
                route = solver([part[i] for i in even(len(part), n)])
            out.append((part, list(part if route is None else route)))
    return out


def merged(parts: list[tuple[list, list]], solver: Callable, exact: int = EXACT) -> list[tuple[list, list]]:
    """As few routes as parts can be merged to: exactly up to ``exact`` parts, beyond that by merging the nearest
    parts whose union has a trip, again and again."""
    if len(parts) <= 1:
        return parts
    known: dict[frozenset, tuple | None] = {frozenset([i]): p for i, p in enumerate(parts)}

    def union(some: frozenset):
        if some not in known:
            places = [x for i in sorted(some) for x in parts[i][0]]
            route = solver(places)
            known[some] = None if route is None else (places, list(route))
        return known[some]

    if len(parts) <= exact:
        best: list[frozenset] = []

        def search(left: frozenset, chosen: list[frozenset]):
            nonlocal best
            if best and len(chosen) + bool(left) >= len(best):
                return
            if not left:
                best = list(chosen)
                return
            first, rest = min(left), sorted(left - {min(left)}, reverse=True)
            for size in range(len(rest), -1, -1):  # large sets first
                for more in combinations(rest, size):
                    some = frozenset({first, *more})
                    if union(some) is not None:
                        search(left - some, [*chosen, some])

        search(frozenset(range(len(parts))), [])
        return [union(s) for s in sorted(best, key=min)]
    groups = [frozenset([i]) for i in range(len(parts))]
    while True:
        middle = {g: np.mean(union(g)[0], 0) for g in groups}
        near = sorted(combinations(groups, 2), key=lambda ab: (float(np.hypot(*(middle[ab[0]] - middle[ab[1]]))), min(ab[0]), min(ab[1])))
        pair = next((ab for ab in near if union(ab[0] | ab[1]) is not None), None)
        if pair is None:
            return [union(g) for g in sorted(groups, key=min)]
        groups = [g for g in groups if g not in pair] + [pair[0] | pair[1]]


def routes(points: DataFrame, solver: Callable, course: str = "course") -> DataFrame:
    """course, route_id from 1, pos, lat, lon: each course solved, split where it must be, and merged."""
    kind = points.schema[course].dataType.simpleString()

    def run(key, g):
        g = g.sort_values("pos")
        made = merged(solved(list(zip(g["lat"], g["lon"], strict=True)), solver), solver)
        rows = [(key[0], i, j, a, b) for i, (_, route) in enumerate(made, 1) for j, (a, b) in enumerate(route)]
        return pd.DataFrame(rows, columns=[course, "route_id", "pos", "lat", "lon"])

    return points.select(course, "pos", "lat", "lon").groupBy(course).applyInPandas(run, f"{course} {kind}, route_id int, pos long, lat double, lon double")


def centroids(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def chunk_pairs(parts: DataFrame) -> DataFrame:
    """a < b and degrees of all pairs of a course's chunks (course, chunk, lat, lon), nearest first in each course."""
    other = parts.select("course", F.col("chunk").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = parts.withColumnRenamed("chunk", "a").join(other, "course").where("a < b")
    return pairs.select("course", "a", "b", F.hypot(F.col("lat2") - F.col("lat"), F.col("lon2") - F.col("lon")).alias("degrees"))


def markers(points: DataFrame, pixels: float = PIXELS) -> DataFrame:
    """view, pos, cluster: each place joins the first cluster whose centre is nearer than ``pixels``, else begins one.
    A centre moves to its sum with the place over the new size, as the map does it."""
    kind = points.schema["view"].dataType.simpleString()

    def run(key, g):
        groups: list[list[float]] = []
        out = []
        for pos, x, y in g.sort_values("pos")[["pos", "x", "y"]].itertuples(index=False, name=None):
            near = next((i for i, (cx, cy, _) in enumerate(groups) if np.hypot(cx - x, cy - y) < pixels), None)
            if near is None:
                groups.append([x, y, 1])
                near = len(groups) - 1
            else:
                cx, cy, n = groups[near]
                groups[near] = [(cx + x) / n, (cy + y) / n, n + 1]
            out.append((key[0], pos, near))
        return pd.DataFrame(out, columns=["view", "pos", "cluster"])

    return points.select("view", "pos", "x", "y").groupBy("view").applyInPandas(run, f"view {kind}, pos long, cluster int")


def numbered(rows: DataFrame, order: str, prefix: str = "img", key: str | None = None) -> DataFrame:
    """``rows`` with name, a prefix and a number of four digits in order, within a key."""
    by = Window.partitionBy(*([key] if key else [])).orderBy(order)
    return rows.withColumn("name", F.format_string(f"{prefix}%04d", F.row_number().over(by) - 1))


def download(selected: DataFrame, photos: DataFrame) -> DataFrame:
    """plan (none, single, multi) and the paths of the photos that are selected, in order."""
    some = photos.join(selected.select("path").distinct(), "path", "left_semi").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    n = F.size("paths")
    return some.select(F.when(n == 0, "none").when(n == 1, "single").otherwise("multi").alias("plan"), "paths")
