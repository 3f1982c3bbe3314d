"""A hexagonal grid on an equirectangular plane, and the character of its cells.

Cells are pointy-top hexagons in axial coordinates, named ``resolution:q:r``. One reference latitude holds
for a grid, so that its cells tile the plane; east to west they shrink with the cosine of their latitude.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from wayfold.functions import geo, planar, tags
from wayfold.functions.parse import endpoint_key
from wayfold.operators import graph

# Edge of a cell of resolution 9, width of the band along a coast, words in names, categories.
EDGE_M, COAST_M = 200.786148, 300.0
CAFE, BAR, HOTEL, SHOP, PARKING = ("cafe", "coffee"), ("bar", "pub", "club"), ("hotel", "hostel", "guest house", "resort", "motel"), ("shop", "market", "mall", "store"), ("parking", "car park")
LUXURY, LODGING, NIGHT, FOOD, RELIGIOUS, INDUSTRIAL, CIVIC, WALKABLE, SERVICES, SCENIC, QUIET, FAMILY, ROADS = tags.CATEGORIES
BUILT = (FAMILY, INDUSTRIAL, CIVIC, SERVICES, LODGING, LUXURY, RELIGIOUS, WALKABLE)
STREETS = (ROADS, FAMILY, WALKABLE, SERVICES)
COUNTS = ("poi_total", "food_count", "cafe_count", "bar_count", "hotel_count", "shop_count", "service_count", "culture_count", "parking_count")
SUMS = ("green_area_m2", "water_area_m2", "residential_area_m2", "industrial_area_m2", "building_area_m2", "road_length_m", "major_road_length_m", "footway_length_m")
#: Scores as signed sums of normalised fields.
SCORES = {
    "busy": (("poi_density", 1), ("intersection_count", 1)), "touristy": (("hotel_count", 1), ("culture_count", 1)), "foodie": (("food_count", 1), ("cafe_count", 1)), "nightlife": (("bar_count", 1),),
    "green_quiet": (("green_share", 1), ("major_road_length_m", -1)), "residential": (("residential_area_m2", 1),), "industrial": (("industrial_area_m2", 1),),
    "walkable": (("intersection_count", 1), ("footway_length_m", 1), ("major_road_length_m", -1)), "car_oriented": (("major_road_length_m", 1), ("parking_count", 1)),
}


@dataclass(frozen=True)
class Grid:
    resolution: int = 9
    lat0: float = 10.0

    @property
    def edge(self) -> float:
        return EDGE_M * math.sqrt(7.0) ** (9 - self.resolution)

    def xy(self, lat, lon):
        r = geo.EARTH_RADIUS_M
        return np.radians(lon) * math.cos(math.radians(self.lat0)) * r, np.radians(lat) * r

    def axial(self, lat: float, lon: float) -> tuple[int, int]:
        x, y = self.xy(lat, lon)
        return _rounded((math.sqrt(3) / 3 * x - y / 3) / self.edge, 2 / 3 * y / self.edge)

    def name(self, q: int, r: int) -> str:
        return f"{self.resolution}:{q}:{r}"

    def parts(self, cell: str) -> tuple[int, int]:
        _, q, r = cell.split(":")
        return int(q), int(r)

    def centre_xy(self, q, r) -> np.ndarray:
        return np.array([self.edge * math.sqrt(3) * (q + r / 2), self.edge * 1.5 * r])

    def corners_xy(self, q: int, r: int) -> np.ndarray:
        a = np.radians(60 * np.arange(6) - 30)
        return self.centre_xy(q, r) + self.edge * np.stack([np.cos(a), np.sin(a)], 1)

    def to_lat_lon(self, xy: np.ndarray) -> np.ndarray:
        r = geo.EARTH_RADIUS_M
        return np.stack([np.degrees(xy[..., 1] / r), np.degrees(xy[..., 0] / r / math.cos(math.radians(self.lat0)))], -1)

    def boundary(self, cell: str) -> np.ndarray:
        """Its six corners as (lat, lon)."""
        return self.to_lat_lon(self.corners_xy(*self.parts(cell)))

    def centre(self, cell: str) -> tuple[float, float]:
        return tuple(self.to_lat_lon(self.centre_xy(*self.parts(cell))).tolist())

    def area(self, cell: str) -> float:
        return 1.5 * math.sqrt(3) * self.edge**2 * math.cos(math.radians(self.centre(cell)[0])) / math.cos(math.radians(self.lat0))

    def path(self, a: str, b: str) -> list[str]:
        """The cells on a straight way from a to b, both included."""
        (q1, r1), (q2, r2) = self.parts(a), self.parts(b)
        n = max(abs(q2 - q1), abs(r2 - r1), abs(q1 + r1 - q2 - r2))
        steps = [_rounded(q1 + (q2 - q1) * i / n + 1e-9, r1 + (r2 - r1) * i / n + 1e-9) for i in range(n + 1)] if n else [(q1, r1)]
        return [self.name(*s) for s in steps]

    def cover(self, rings: list[np.ndarray]) -> dict[str, float]:
        """Cells that overlap a polygon of (lat, lon) rings, with the areas of the overlaps in the plane."""
        flat = [np.stack(self.xy(*np.asarray(r, float).T), 1) for r in rings]
        (x0, y0), (x1, y1) = flat[0].min(0), flat[0].max(0)
        out = {}
        for r in range(math.floor((y0 / self.edge - 1) / 1.5), math.ceil((y1 / self.edge + 1) / 1.5) + 1):
            row = math.sqrt(3) * self.edge
            for q in range(math.floor(x0 / row - r / 2 - 0.5), math.ceil(x1 / row - r / 2 + 0.5) + 1):
                cx, cy = self.centre_xy(q, r).tolist()
                if abs(2 * cx - x0 - x1) > x1 - x0 + row + 1e-3 or abs(2 * cy - y0 - y1) > y1 - y0 + 2 * self.edge + 1e-3:
                    continue  # their bounds do not meet
                cell = self.corners_xy(q, r)
                size = [abs(planar.signed_area(planar.clipped(ring, cell))) for ring in flat]
                if size[0] - sum(size[1:]) > planar.EPS:
                    out[self.name(q, r)] = size[0] - sum(size[1:])
        return out

    def cell(self, lat: Column, lon: Column) -> Column:
        """The name of a place's cell; null for a place without coordinates."""
        r = F.lit(geo.EARTH_RADIUS_M)
        x, y = F.radians(lon) * F.lit(math.cos(math.radians(self.lat0))) * r, F.radians(lat) * r
        fq, fr = (F.lit(math.sqrt(3) / 3) * x - y / 3) / F.lit(self.edge), F.lit(2 / 3) * y / F.lit(self.edge)
        fs = -fq - fr
        q, p, s = F.floor(fq + 0.5), F.floor(fr + 0.5), F.floor(fs + 0.5)
        dq, dr, ds = F.abs(q - fq), F.abs(p - fr), F.abs(s - fs)
        q2 = F.when((dq > dr) & (dq > ds), -p - s).otherwise(q)
        r2 = F.when((dr >= dq) & (dr > ds), -q - s).otherwise(p)
        return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(":", F.lit(str(self.resolution)), q2.cast("string"), r2.cast("string")))


def _rounded(fq: float, fr: float) -> tuple[int, int]:
    fs = -fq - fr
    q, r, s = math.floor(fq + 0.5), math.floor(fr + 0.5), math.floor(fs + 0.5)
    dq, dr, ds = abs(q - fq), abs(r - fr), abs(s - fs)
    if dq > dr and dq > ds:
        return -r - s, r
    return (q, -q - s) if dr > ds else (q, r)


def ring_area_m2(ring: np.ndarray) -> float:
    """Of (lon, lat) rows, equirectangular about their mean."""
    r = planar.open_ring(np.asarray(ring, float))
    lon, lat = np.radians(r).T
    return abs(planar.signed_area(np.stack([(lon - lon.mean()) * math.cos(lat.mean()), lat - lat.mean()], 1))) * geo.EARTH_RADIUS_M**2


def vertex_mean(geometry: dict) -> tuple[float, float] | None:
    """(lon, lat): the mean of a line's places or of a ring's, its closing place included; of several polygons
    weighted by area; null for anything else."""
    kind, c = geometry.get("type"), geometry.get("coordinates") or []
    if kind == "LineString" and c:
        return tuple(np.asarray(c, float)[:, :2].mean(0).tolist())
    if kind == "Polygon" and c and c[0]:
        return tuple(np.asarray(c[0], float)[:, :2].mean(0).tolist())
    if kind == "MultiPolygon":
        rings = [np.asarray(p[0], float)[:, :2] for p in c if p and p[0]]
        sizes = np.array([ring_area_m2(r) for r in rings])
        if len(rings) and sizes.sum() > 0:
            return tuple((np.array([r.mean(0) for r in rings]) * sizes[:, None]).sum(0) / sizes.sum())
    return None


def line_length_m(c: np.ndarray) -> float:
    p = np.radians(np.asarray(c, float))
    if len(p) < 2:
        return 0.0
    d = np.diff(p, axis=0)
    a = np.sin(d[:, 1] / 2) ** 2 + np.cos(p[:-1, 1]) * np.cos(p[1:, 1]) * np.sin(d[:, 0] / 2) ** 2
    return float(2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1))).sum())


def polygon_shares(rings: list, grid: Grid) -> dict[str, float]:
    """A polygon's area in m2 dealt to the cells that it overlaps, so that the parts add up to the whole; to the
    cell of its vertex mean if none does."""
    total = max(0.0, ring_area_m2(rings[0]) - sum(ring_area_m2(h) for h in rings[1:]))
    cover = grid.cover([np.asarray(r, float)[:, 1::-1] for r in rings])
    weight = sum(cover.values())
    if not weight:
        lon, lat = np.asarray(rings[0], float)[:, :2].mean(0)
        return {grid.name(*grid.axial(lat, lon)): total}
    return {c: total * w / weight for c, w in cover.items()}


def line_shares(coordinates: list, grid: Grid) -> dict[str, float]:
    """A line's length in metres, each leg dealt in equal parts to the cells between its ends."""
    out: dict[str, float] = {}
    for a, b in zip(coordinates[:-1], coordinates[1:], strict=True):
        path = grid.path(grid.name(*grid.axial(a[1], a[0])), grid.name(*grid.axial(b[1], b[0])))
        for cell in path:
            out[cell] = out.get(cell, 0.0) + line_length_m(np.array([a, b])) / len(path)
    return out


def measured(rows: DataFrame, grid: Grid) -> DataFrame:
    """``rows`` (name, category, tags, geometry as GeoJSON text) with cell, kind, length_m, ends, area_parts and
    line_parts. Rows without a vertex mean have a null cell; text that is no geometry raises."""
    kind = "struct<cell:string,kind:string,length_m:double,ends:array<struct<lon:double,lat:double>>,area_parts:array<struct<cell:string,size:double>>,line_parts:array<struct<cell:string,size:double>>>"

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def measure(column):
        import pyarrow as pa

        out = []
        for text in column.to_pylist():
            g = json.loads(text) if text else {}
            centre = vertex_mean(g) if isinstance(g, dict) else None
            row = {"cell": None, "kind": g.get("type"), "length_m": 0.0, "ends": [], "area_parts": [], "line_parts": []}
            if centre:
                row["cell"] = grid.name(*grid.axial(centre[1], centre[0]))
                if g["type"] == "LineString":
                    c = g["coordinates"]
                    row["length_m"] = line_length_m(c)
                    row["ends"] = [{"lon": p[0], "lat": p[1]} for p in (c[0], c[-1])] if len(c) > 1 else []
                    row["line_parts"] = [{"cell": k, "size": v} for k, v in line_shares(c, grid).items()]
                else:
                    shares: dict[str, float] = {}
                    for polygon in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]:
                        for k, v in polygon_shares(polygon, grid).items():
                            shares[k] = shares.get(k, 0.0) + v
                    row["area_parts"] = [{"cell": k, "size": v} for k, v in shares.items()]
            out.append(row)
        return pa.array(out, arrow)

    return rows.withColumn("_m", measure("geometry")).select("name", "category", "tags", "_m.*")


def poi_mix(category: Column, name: Column) -> dict[str, Column]:
    """The conditions of the nine counters."""
    lower, c = F.lower(F.coalesce(name, F.lit(""))), category
    has = lambda terms: tags._has(lower, terms)
    return dict(zip(COUNTS, (F.lit(True), c == FOOD, (c == FOOD) & has(CAFE), (c == NIGHT) | has(BAR), c.isin(LODGING, LUXURY) | has(HOTEL), (c == WALKABLE) | has(SHOP), c.isin(SERVICES, CIVIC), c.isin(RELIGIOUS, CIVIC, SCENIC), has(PARKING)), strict=True))


def land(category: Column, name: Column, tag_map: Column) -> dict[str, Column]:
    """The conditions of the five sums of areas."""
    water = tags.is_water(tag_map, name)
    return dict(zip(SUMS[:5], ((category == QUIET) | ((category == SCENIC) & ~water), (category == SCENIC) & water, category == FAMILY, category == INDUSTRIAL, category.isin(*BUILT)), strict=True))


def features(rows: DataFrame, grid: Grid) -> DataFrame:
    """cell, counts, sums, intersection_count from name, category, tags, geometry: three kinds of rows in long
    form, added up by cell. Counts and whole lengths go to the cell of the vertex mean."""
    # measured by all tasks, not those of a small file, and once for the four reads below
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = graph.written(measured(rows.repartition(n), grid))
    zero = lambda names: [F.lit(0.0).alias(n) for n in names]
    is_line, cat = F.col("kind") == "LineString", F.col("category")
    when = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    mix, areas = poi_mix(cat, F.col("name")), land(cat, F.col("name"), F.col("tags"))
    long_line = is_line & (F.size("ends") == 2)
    points = m.where("cell IS NOT NULL").select("cell", *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in mix.items()], *zero(SUMS[:5]), when(long_line & cat.isin(*STREETS), F.col("length_m")).alias(SUMS[5]), when(long_line & (cat == ROADS), F.col("length_m")).alias(SUMS[6]), when(long_line & tags.highway_in(F.col("tags"), tags.DEDICATED_FOOTWAYS), F.col("length_m")).alias(SUMS[7]))
    no_counts = [F.lit(0).cast("long").alias(n) for n in COUNTS]
    polygons = m.select("name", "category", "tags", F.inline("area_parts")).select("cell", *no_counts, *[when(c, F.col("size")).alias(n) for n, c in areas.items()], *zero(SUMS[5:]))
    coast = tags.is_coastline(F.col("tags")) & (cat == SCENIC) & tags.is_water(F.col("tags"), F.col("name"))
    coasts = m.where(coast).select(F.inline("line_parts")).select("cell", *no_counts, F.lit(0.0).alias(SUMS[0]), (F.col("size") * COAST_M).alias(SUMS[1]), *zero(SUMS[2:]))
    sums = points.unionByName(polygons).unionByName(coasts).groupBy("cell").agg(*[F.sum(n).alias(n) for n in COUNTS + SUMS])
    ends = m.where(long_line & cat.isin(*STREETS)).select("cell", F.explode("ends").alias("e"))
    shared = ends.groupBy("cell", endpoint_key(F.col("e.lon"), F.col("e.lat")).alias("key")).agg(F.count("*").alias("n")).groupBy("cell").agg(F.count_if(F.col("n") >= 2).alias("intersection_count"))
    return sums.join(shared, "cell", "left").withColumn("intersection_count", F.coalesce("intersection_count", F.lit(0)))


def derived(cells: DataFrame, grid: Grid) -> DataFrame:
    """``cells`` with the fields that follow from the sums and the cell's area; water is capped by that area."""
    parts = F.split("cell", ":")
    lat = F.degrees(F.lit(grid.edge * 1.5) * parts[2].cast("double") / F.lit(geo.EARTH_RADIUS_M))
    area = F.lit(1.5 * math.sqrt(3) * grid.edge**2 / math.cos(math.radians(grid.lat0))) * F.cos(F.radians(lat))
    c = cells.withColumn("_a", area).withColumn("water_area_m2", F.least("water_area_m2", "_a"))
    kinds = sum((F.col(n) > 0).cast("int") for n in COUNTS[1:8])
    return c.withColumns({
        "poi_density": F.col("poi_total") / (F.col("_a") / 1e6), "food_share": F.col("food_count") / F.greatest("poi_total", F.lit(1)), "green_share": F.col("green_area_m2") / F.col("_a"),
        "building_coverage": F.col("building_area_m2") / F.col("_a"), "walkability_proxy": F.col("intersection_count") + F.col("footway_length_m") / 100,
        "car_orientation": F.col("major_road_length_m") / F.greatest("road_length_m", F.lit(1.0)), "diversity": kinds,
    }).drop("_a")


def scores(cells: DataFrame) -> DataFrame:
    """cell and its scores, from fields normalised over ``cells``; see ``tables.minmax``."""
    from wayfold.operators.tables import minmax

    fields = sorted({f for parts in SCORES.values() for f, _ in parts})
    n = minmax(cells.select("cell", *fields), fields)
    return n.select("cell", *[sum(F.lit(sign) * F.col(f"n_{f}") for f, sign in parts).alias(name) for name, parts in SCORES.items()])


def within_centre(cells: DataFrame, grid: Grid, lat: float | None, lon: float | None, km: float | None) -> DataFrame:
    """Cells whose centre lies within ``km``; all if a parameter is missing; a negative radius raises."""
    if lat is None or lon is None or km is None:
        return cells
    if km < 0:
        raise ValueError("the radius must not be negative")
    q, r = (F.split("cell", ":")[i].cast("double") for i in (1, 2))
    y, x = F.lit(grid.edge * 1.5) * r, F.lit(grid.edge * math.sqrt(3)) * (q + r / 2)
    clat, clon = F.degrees(y / F.lit(geo.EARTH_RADIUS_M)), F.degrees(x / F.lit(geo.EARTH_RADIUS_M * math.cos(math.radians(grid.lat0))))
    return cells.where(geo.haversine(F.lit(float(lat)), F.lit(float(lon)), clat, clon) <= km * 1000)


def on_track(cells: DataFrame, track: DataFrame) -> DataFrame:
    """Cells that are among ``track`` (cell)."""
    return cells.join(track.select("cell").distinct(), "cell", "left_semi")


def track_cells(points: DataFrame, grid: Grid, track: str = "file") -> DataFrame:
    """The cells that tracks pass: of consecutive different cells the way between them, each cell once a track."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(track).orderBy("pos")
    cell = points.withColumn("cell", grid.cell(F.col("lat"), F.col("lon"))).where("cell IS NOT NULL")
    legs = cell.select(track, "cell", F.coalesce(F.lag("cell").over(by), F.col("cell")).alias("before")).distinct()

    @F.arrow_udf("array<string>")
    def between(a, b):
        import pyarrow as pa

        return pa.array([grid.path(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.string()))

    return legs.select(track, F.explode(between("before", "cell")).alias("cell")).distinct()
