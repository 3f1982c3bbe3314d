"""Operators whose result at a point depends on what was kept before it.

Tracks are dealt by their key, sorted within a task and read as a stream with the state of one
track carried on, so a task never holds a whole track.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.operators import graph
from wayfold.operators.traces import CHUNK_M, TOLERANCE_M, with_steps


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """``geo.haversine`` of numbers."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, a)))


def streamed(points: DataFrame, track: str, columns: str, start: Callable, step: Callable) -> DataFrame:
    """Rows that ``step(state, pos, lat, lon)`` yields over each track's points in order, after its
    key; ``start()`` gives a track's first state. Points without coordinates are left out."""
    kind = points.schema[track].dataType.simpleString()
    names = [track, *[c.split()[0] for c in columns.split(",")]]

    def run(batches):
        import pandas as pd

        state, now, begun = None, None, False
        for batch in batches:
            out = []
            for key, pos, lat, lon in batch.itertuples(index=False, name=None):
                if not begun or key != now:
                    state, now, begun = start(), key, True
                out += [(key, *row) for row in step(state, pos, lat, lon)]
            yield pd.DataFrame(out, columns=names)

    rows = points.where("lat is not null and lon is not null").select(track, "pos", "lat", "lon").where(F.col(track).isNotNull())
    return graph.dealt(rows, track).sortWithinPartitions(track, "pos").mapInPandas(run, f"{track} {kind}, {columns}")


def without_near(points: DataFrame, tolerance: float = TOLERANCE_M, track: str = "file") -> DataFrame:
    """Points that are at least ``tolerance`` metres from the last one kept; the first is kept."""

    def step(state, pos, lat, lon):
        if not state or metres(*state, lat, lon) >= tolerance:
            state[:] = lat, lon
            yield pos, lat, lon

    return streamed(points, track, "pos long, lat double, lon double", list, step)


def chunks(points: DataFrame, length: float = CHUNK_M, track: str = "file") -> DataFrame:
    """Each point with its chunk: a chunk ends at the point where its own length reaches ``length``,
    which also begins the next one; a tail of one point is no chunk."""

    def step(state, pos, lat, lon):
        if state:
            chunk, run, at, held = state
            run += metres(*at[1:], lat, lon)
            if held:
                yield chunk, *at  # the boundary point, held until its chunk has a second one
            yield chunk, pos, lat, lon
            state[:] = (chunk + 1, 0.0, (pos, lat, lon), True) if run >= length else (chunk, run, (pos, lat, lon), False)
        else:
            state[:] = 0, 0.0, (pos, lat, lon), True

    return streamed(points, track, "chunk long, pos long, lat double, lon double", list, step)


def binned(points: DataFrame, length: float, track: str = "file") -> DataFrame:
    """Points of each track in bins of ``length`` along it; empty bins too, the end in the last."""
    along = with_steps(points, track)
    n = F.greatest(F.lit(1), F.ceil(F.max("cum_m") / length)).cast("long")
    every = along.groupBy(track).agg(n.alias("n")).select(track, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    counts = along.join(every.select(track, "n").distinct(), track).groupBy(track, F.least(F.floor(F.col("cum_m") / length), F.col("n") - 1).alias("bin")).agg(F.count("*").alias("points"))
    return every.drop("n").join(counts, [track, "bin"], "left").withColumn("points", F.coalesce("points", F.lit(0)))


def ring_turns(points: DataFrame, degrees: float = 30.0, track: str = "file") -> DataFrame:
    """Turns of each track as a ring: places where the heading changes by ``degrees`` or more,
    the one between the last leg and the first too. Fewer than three points make no turn."""
    by = Window.partitionBy(track).orderBy("pos")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), F.first("lat").over(whole), F.first("lon").over(whole))
    flat = points.select(track, "pos", x.alias("x"), y.alias("y"))

    def beside(c, side, end):
        return F.coalesce(side(c).over(by), end(c).over(whole))

    turn = geo.heading_change(
        F.col("x") - beside("x", F.lag, F.last), F.col("y") - beside("y", F.lag, F.last), beside("x", F.lead, F.first) - F.col("x"), beside("y", F.lead, F.first) - F.col("y")
    )
    return flat.withColumn("turn", turn).groupBy(track).agg(F.when(F.count("*") < 3, 0).otherwise(F.count_if(F.abs("turn") >= degrees)).alias("turns"))


def following(points: DataFrame, track: str = "file") -> DataFrame:
    """Each point with the next one of the whole table, across tracks in their order. Only the
    tracks' first rows are put in one order, never all points."""
    by = Window.partitionBy(track).orderBy("pos")
    inside = points.select(track, "pos", F.lead("pos").over(by).alias("next_pos"))
    first = points.groupBy(track).agg(F.min("pos").alias("first_pos"))
    borders = first.select(track, F.lead(track).over(Window.orderBy(track)).alias("t"), F.lead("first_pos").over(Window.orderBy(track)).alias("p"))
    out = inside.join(borders, track)
    return out.select(track, "pos", F.when(F.col("next_pos").isNull(), F.col("t")).otherwise(F.col(track)).alias("next_file"), F.coalesce("next_pos", "p").alias("next_pos"))
