"""Ordered operators over track points: one window per track, never over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo

SAMPLE_M, CHUNK_M, TOLERANCE_M = 300.0, 750.0, 0.5


def with_steps(points: DataFrame, track: str = "file", digits: int = 6) -> DataFrame:
    """Adds step_m, the distance to the point before (0 first), and cum_m, its running sum."""
    by = Window.partitionBy(track).orderBy("pos")
    before = geo.haversine(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon"))
    steps = points.withColumn("step_m", F.coalesce(F.round(before, digits), F.lit(0.0)))
    return steps.withColumn("cum_m", F.sum("step_m").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def samples(points: DataFrame, interval: float = SAMPLE_M, track: str = "file") -> DataFrame:
    """Segments that end at the first point past each multiple of ``interval``: first and middle
    point, number of points, distance at the end."""
    by = Window.partitionBy(track).orderBy("pos")
    past = with_steps(points, track).withColumn("bucket", F.floor(F.col("cum_m") / interval))
    seen = F.coalesce(F.max("bucket").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    closes = past.withColumn("closes", (F.col("bucket") > seen).cast("int"))
    parts = closes.withColumn("segment", F.coalesce(F.sum("closes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(track, "segment")
    placed = parts.withColumn("i", F.row_number().over(inside.orderBy("pos")) - 1).withColumn("n", F.count("*").over(inside))
    middle = F.col("i") == F.floor(F.col("n") / 2)
    return placed.groupBy(track, "segment").agg(
        F.count("*").alias("points"),
        F.min("pos").alias("first_pos"),
        F.max(F.when(middle, F.col("lat"))).alias("lat"),
        F.max(F.when(middle, F.col("lon"))).alias("lon"),
        F.max("cum_m").alias("end_m"),
    )


def spans(points: DataFrame, track: str = "file") -> DataFrame:
    """Bounds and independent medians of each track."""
    return points.groupBy(track).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max), ("median", F.median))], F.count("*").alias("points"))
