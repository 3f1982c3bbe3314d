"""Streams of track files, and the sessions of their points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import tracks


def arriving(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The points of GPX files as they arrive in a folder: each file is read once, whole, ``files_a_batch`` in a
    batch."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return tracks.points_of(source.option("pathGlobFilter", tracks.GLOB).option("maxFilesPerTrigger", files_a_batch).load(path))


def sessions(points: DataFrame, key: str = "name", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, points, bounds of sessions: points of a key (of any file) less than ``gap`` apart in time.
    A session is given out once no point may still join it; points more than ``late`` behind the latest are
    dropped, and so are points without a time. Works on a batch as well."""
    timed = points.where("time IS NOT NULL").withWatermark("time", late)
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    out = timed.groupBy(key, F.session_window("time", gap).alias("s")).agg(F.count("*").alias("points"), *bounds)
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "points", *[f"{n}_{c}" for c in ("lat", "lon") for n in ("min", "max")])
