"""Tables, JSON payloads, polygons, saved state and photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """A CSV file with a header, quoted fields over several lines too. Raises with the sorted names of required
    columns that are not there."""
    reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    header = reader.csv(path).columns if schema else df.columns
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def polylines(spark: SparkSession, path: str, precision: int = 5) -> DataFrame:
    """file, line, points (lat, lon) of files that each hold one JSON array of encoded lines."""
    from wayfold.functions.geodesy import polyline

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("lines"))
    return texts.select("file", F.posexplode("lines").alias("line", "text")).select("file", "line", polyline(F.col("text"), precision).alias("points"))


WAYPOINT = "id string, name string, lat double, lon double, ele double, category string, tags map<string,string>, valid boolean, validation_reason string, description string"


def waypoints(spark: SparkSession, *paths: str) -> DataFrame:
    """The valid waypoints of the first payload that exists; one without a verdict is valid."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows = spark.read.option("multiLine", "true").schema(f"source string, count long, waypoints array<struct<{', '.join(c.replace(' ', ':', 1) for c in WAYPOINT.split(', '))}>>").json(path)
            return rows.select(F.inline("waypoints")).where(F.coalesce("valid", F.lit(True)))
    raise FileNotFoundError(", ".join(paths))


def cell_ids(spark: SparkSession, path: str) -> DataFrame:
    """cell, each once, of a JSON array of ids."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("cell")).distinct()


def state(spark: SparkSession, path: str) -> DataFrame:
    """What a sink saved as Parquet, nested columns as they were."""
    return spark.read.parquet(path)


def cached(spark: SparkSession, source: str, cache: str, make) -> DataFrame:
    """``make(spark, source)`` saved as Parquet; read from there as long as it is not older than the source."""
    def changed(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else -1

    if changed(f"{cache}/_SUCCESS") < changed(source):
        make(spark, source).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def ring(text: str) -> list[tuple[float, float]]:
    """(lon, lat) of the first ring of a polygon file, closed; raises under three places."""
    out: list[tuple[float, float]] = []
    for line in text.splitlines()[2:]:
        if line.strip() == "END":
            break
        if line.strip():
            lon, lat = map(float, line.split()[:2])
            out.append((lon, lat))
    if len(out) < 3:
        raise ValueError("a polygon needs three places")
    return out if out[0] == out[-1] else [*out, out[0]]


def poly(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, lon, lat of the first ring of polygon files."""

    @F.arrow_udf("array<struct<lon:double,lat:double>>")
    def parse(column):
        import pyarrow as pa

        return pa.array([[{"lon": x, "lat": y} for x, y in ring(t)] for t in column.to_pylist()], pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parse("value").alias("ring"))
    return texts.select("file", F.posexplode("ring").alias("pos", "p")).select("file", "pos", "p.lon", "p.lat")


def located(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Sorted paths of files with a suffix, in any case of letters, below a folder or of a glob; raises if there
    is none."""
    glob = "*.{" + ",".join({x for s in suffixes for x in (s.lstrip(".").lower(), s.lstrip(".").upper())}) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path").collect()
    if not rows:
        raise FileNotFoundError(f"no {', '.join(suffixes)} in {path}")
    return sorted(r.path for r in rows)


def resolved(explicit: str | None, city: str | None, country: str | None, exists) -> str:
    """The explicit extract if one is named, else the city's if it exists, else the country's; raises otherwise."""
    if explicit:
        if not exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    for path in (city, country):
        if path and exists(path):
            return path
    raise FileNotFoundError("no extract: name one, or provide that of the city or the country")


#: Tags of an image's directory and its directory of positions.
GPS, NS, LAT, EW, LON = 0x8825, 1, 2, 3, 4


def gps(data: bytes) -> tuple[float, float] | None:
    """(lat, lon) of the position in a JPEG's or TIFF's tags; none if there is none or it is broken."""
    import struct

    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                data = data[at + 10 : at + 2 + size]
                break
            at += 2 + size
        else:
            return None
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return None

    def directory(at):
        n = struct.unpack_from(order + "H", data, at)[0]
        return {e[0]: e[1:] for e in (struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i) for i in range(n))}

    def number(x):
        return struct.unpack(order + "I", x)[0]

    try:
        first = directory(number(data[4:8]))
        if GPS not in first:
            return None
        d = directory(number(first[GPS][2]))
        out = []
        for ref, value in ((NS, LAT), (EW, LON)):
            parts = struct.unpack_from(order + "6I", data, number(d[value][2]))
            degrees = sum(parts[2 * i] / parts[2 * i + 1] / 60**i for i in range(3))
            out.append(-degrees if d[ref][2][:1].upper() in (b"S", b"W") else degrees)
        return out[0], out[1]
    except (struct.error, KeyError, ZeroDivisionError):
        return None


def photos(spark: SparkSession, path: str) -> DataFrame:
    """path, lat, lon of the photos below a folder that know their position, in the order of paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,tif,tiff,JPG,JPEG,TIF,TIFF}").load(path)

    @F.arrow_udf("struct<lat:double,lon:double>")
    def position(content):
        import pyarrow as pa

        found = [gps(b) for b in content.to_pylist()]
        return pa.array([None if p is None else {"lat": p[0], "lon": p[1]} for p in found], pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))

    return files.select("path", position("content").alias("p")).where("p IS NOT NULL").select("path", "p.lat", "p.lon").orderBy("path")


def service(rows: DataFrame, answer, schema: str) -> DataFrame:
    """Rows that ``answer`` gives for each row of ``rows`` (a dict): what stands for a service, called by the task
    that holds the row. It may give none for a row, as for a place without a road."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(",")]
        for batch in batches:
            yield pd.DataFrame([r for row in batch.to_dict("records") for r in answer(row)], columns=names)

    return rows.mapInPandas(run, schema)


def unsnappable(rows: DataFrame, code: Column, ways: Column) -> DataFrame:
    """Without pairs that no road matches and points without ways."""
    return rows.where(~F.coalesce(code.isin("NoMatch", "NoSegment"), F.lit(False)) & (F.coalesce(F.size(ways), F.lit(0)) > 0))
