"""GPX files: a file is parsed in one task, so points keep their track, segment and place in it.

Files are found by Spark (folders, globs, remote paths); ``.gz`` files are unpacked; bytes that are no UTF-8
become replacement characters; any namespace is read. A file that is no XML raises with its name. Rows come
with ``file`` (the path), so order them by file, track, segment and pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KINDS = {"trk": ("trk", "trkseg", "trkpt"), "rte": ("rte", None, "rtept"), "wpt": (None, None, "wpt")}
GLOB = "*.{gpx,gpx.gz,GPX}"
SCHEMA = "file string, kind string, name string, track int, segment int, pos long, lat double, lon double, ele double, time timestamp"


def parse(data: bytes, file: str, kinds=("trk",)):
    """Rows of ``SCHEMA`` from the bytes of a file."""
    import gzip
    from datetime import UTC, datetime
    from xml.etree import ElementTree

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        root = ElementTree.fromstring(data.decode("utf-8", "replace").encode())
    except ElementTree.ParseError as e:
        raise ValueError(f"{file}: {e}") from e

    def text(e, name):
        found = e.find(f"{{*}}{name}")
        return found.text.strip() if found is not None and found.text else None

    def when(t):
        if not t:
            return None
        try:
            value = datetime.fromisoformat(t.replace("Z", "+00:00"))
        except ValueError:
            return None
        return value if value.tzinfo else value.replace(tzinfo=UTC)

    def point(p, kind, name, track, segment, pos):
        ele = text(p, "ele")
        return file, kind, name, track, segment, pos, float(p.get("lat")), float(p.get("lon")), float(ele) if ele else None, when(text(p, "time"))

    for kind in kinds:
        outer, inner, leaf = KINDS[kind]
        groups = [root] if outer is None else root.findall(f"{{*}}{outer}")
        pos = 0
        for i, g in enumerate(groups):
            name = text(g, "name") if outer else None
            for j, s in enumerate(g.findall(f"{{*}}{inner}") if inner else [g]):
                for p in s.findall(f"{{*}}{leaf}"):
                    yield point(p, kind, name if outer else text(p, "name"), i, j, pos)
                    pos += 1


def read(spark: SparkSession, path: str, kinds=("trk",), recursive: bool = True, required: bool = False) -> DataFrame:
    """The points of all GPX files of a folder or glob: of tracks, or of routes (``rte``) and waypoints
    (``wpt``) too. A folder without files gives no rows, or raises if points are ``required``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    out = points_of(files.option("pathGlobFilter", GLOB).load(path), kinds)
    if required and not out.head(1):
        raise ValueError(f"{path} holds no points")
    return out


def points_of(files: DataFrame, kinds=("trk",)) -> DataFrame:
    """The points of files (path, content), a stream of them too."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(parse(data, file, kinds))
                for at in range(0, len(rows), 50_000):
                    columns = list(zip(*rows[at : at + 50_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def track_rows(points: DataFrame) -> DataFrame:
    """file, pos, lat, lon, time, ele of whole files: one order over their tracks and segments."""
    return points.select("file", "pos", "lat", "lon", "time", "ele")


def any_points(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon of track, route and waypoints; raises if there is none."""
    return read(spark, path, ("trk", "rte", "wpt"), required=True).select("file", "kind", "lat", "lon")


def geoparquet(spark: SparkSession, path: str) -> DataFrame:
    """source (the folder's name), row (its place in the file), name, city, points of line strings in WKB; rows
    without a geometry or with an empty one are left out. Other kinds of geometry raise."""

    @F.arrow_udf("array<struct<lat:double,lon:double>>")
    def points(column):
        import struct

        import numpy as np
        import pyarrow as pa

        def line(b):
            order = "<" if b[0] else ">"
            kind, n = struct.unpack(order + "II", b[1:9])
            if kind % 1000 != 2:
                raise ValueError(f"geometry kind {kind} is no line string")
            width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
            return [{"lat": y, "lon": x} for x, y in np.frombuffer(b, order + "f8", n * width, 9).reshape(n, width)[:, :2].tolist()]

        return pa.array([None if b is None else line(b) for b in column.to_pylist()], pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))

    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    named = rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("source"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "name", "city", "geometry")
    return named.where("geometry IS NOT NULL").withColumn("points", points("geometry")).drop("geometry").where(F.size("points") > 0)
