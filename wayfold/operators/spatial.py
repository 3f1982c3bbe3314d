"""Distance joins by grid cells: an equi-join on cells, then the exact distance. Never a cross join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.operators import graph


#: Height of the bands of latitude that have cells of their own width.
BAND = 1.0


def _width(band, metres: float):
    """Degrees of longitude that are ``metres`` or more anywhere in the band or one beside it; a whole circle
    near the poles."""
    far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) + 1, F.lit(90 / BAND)) * BAND
    shrunk = F.cos(F.radians(far))
    return F.when(shrunk < 0.01, 360.0).otherwise(F.least(F.lit(360.0), F.lit(metres / geo.METERS_PER_DEGREE_LAT * 1.02) / shrunk))


def within(left: DataFrame, right: DataFrame, metres: float, once: bool = False) -> DataFrame:
    """Pairs (a, b, metres) of left (id, lat, lon) and right within a distance, anywhere on the globe; with
    ``once`` only those with a < b. Cells are as high as the distance and as wide as it is in their band of
    latitude; a right row lies in one cell of its own band, a left row looks for it in the cells beside its
    own, in the bands beside its own and across the meridian where longitudes wrap. Rows without
    coordinates have no partner; equal rows are partners each."""
    height = min(metres / geo.METERS_PER_DEGREE_LAT * 1.02, BAND)
    if metres / geo.METERS_PER_DEGREE_LAT * 1.02 > BAND:
        raise ValueError("distances beyond a band of latitude are not supported")

    def wrapped(x, width):
        n = F.floor(F.lit(360.0) / width)  # whole cells around the globe, the last one wider
        return F.when(n < 3, 0).otherwise(F.pmod(x, n))

    def cell_x(lon, width):
        n = F.floor(F.lit(360.0) / width)
        return F.when(n < 3, 0).otherwise(F.least(F.floor(F.pmod(lon, F.lit(360.0)) / width), n - 1))

    band, cy = F.floor(F.col("lat") / BAND), F.floor(F.col("lat") / height)
    b = right.select(F.col("id").alias("b"), "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    b = b.select("*", *_unit("lat", "lon", "2"), band.alias("_band"), cell_x(F.col("lon"), _width(band, metres)).alias("_cx"), cy.alias("_cy"))
    a = left.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).where("lat1 IS NOT NULL AND lon1 IS NOT NULL")
    near = lambda x: F.array_distinct(F.array(F.floor((x - height) / BAND), F.floor(x / BAND), F.floor((x + height) / BAND)))
    a = a.select("*", *_unit("lat1", "lon1", "1"), F.explode(near(F.col("lat1"))).alias("_band"))
    width = _width(F.col("_band"), metres)
    own = cell_x(F.col("lon1"), width)
    a = a.select("*", F.explode(F.array_distinct(F.array(wrapped(own - 1, width), own, wrapped(own + 1, width)))).alias("_cx"), F.floor(F.col("lat1") / height).alias("_y"))
    a = a.select("*", F.explode(F.array(F.col("_y") - 1, F.col("_y"), F.col("_y") + 1)).alias("_cy"))
    # both sides are dealt by cell and merged: Spark takes them for small enough to broadcast, and what a merge gives out is
    # no measure of the work, so their number of partitions is held
    cell = ["_band", "_cx", "_cy"]
    pairs = graph.dealt(a, *cell).join(graph.dealt(b, *cell).hint("merge"), cell)
    pairs = pairs.where(F.col("a") < F.col("b")) if once else pairs
    # the chord settles all but a thin shell about the distance; only what lies there is measured to be told apart
    chord = sum((F.col(f"_{c}1") - F.col(f"_{c}2")) * (F.col(f"_{c}1") - F.col(f"_{c}2")) for c in "xyz")
    arc = metres / geo.EARTH_RADIUS_M
    most, least = (arc * (1 + 1e-9) + 1e-12) ** 2, max(0.0, 2 * math.sin(arc / 2) * (1 - 1e-9) - 1e-12) ** 2
    h = _haversine()
    return pairs.where(chord <= most).where((chord <= least) | (h <= metres)).select("a", "b", h.alias("metres"))


def _unit(lat: str, lon: str, end: str) -> list[Column]:
    """The place on the unit sphere, and the cosine of its latitude."""
    y, x = F.radians(lat), F.radians(lon)
    return [(F.cos(y) * F.cos(x)).alias(f"_x{end}"), (F.cos(y) * F.sin(x)).alias(f"_y{end}"), F.sin(y).alias(f"_z{end}"), F.cos(y).alias(f"_c{end}")]


def _haversine() -> Column:
    """``geo.haversine`` to the bit, of rows with coordinates and the cosines of their latitudes."""
    dy, dx = F.sin(F.radians(F.col("lat") - F.col("lat1")) / 2), F.sin(F.radians(F.col("lon") - F.col("lon1")) / 2)
    return 2 * F.lit(geo.EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.pow(dy, F.lit(2.0)) + F.col("_c1") * F.col("_c2") * F.pow(dx, F.lit(2.0)), F.lit(1.0))))


def nearest(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """For each left id the nearest other right id within a distance; of equal distances the later id. A left
    id without one gives no row. Distances are tried from one at which cells hold few right rows up to ``metres``,
    four times as far each time, and only by rows that found none, so that dense places do not meet as squares. Of right
    rows at one place the two latest ids are enough."""
    by_id = Window.partitionBy("lat", "lon").orderBy(F.desc("id"))
    places = right.select("id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL AND id IS NOT NULL").distinct()
    places = graph.written(places.withColumn("_n", F.row_number().over(by_id)).where("_n <= 2").drop("_n"))
    todo, found = left.select("id", "lat", "lon"), None
    radius = metres / 2 ** _halvings(places, metres)
    while True:
        todo = graph.written(todo)
        pairs = within(todo, places, radius).where(F.col("a") != F.col("b"))
        near = pairs.groupBy("a").agg(F.min_by("b", F.struct("metres", -F.col("b"))).alias("b"), F.min("metres").alias("metres"))
        if radius >= metres or (found is not None and todo.isEmpty()):
            return near if found is None else found.unionByName(near)
        near = graph.written(near)
        found = near if found is None else found.unionByName(near)
        todo, radius = todo.join(near.select(F.col("a").alias("id")).hint("merge"), "id", "left_anti"), min(metres, radius * 4)


def _halvings(places: DataFrame, metres: float, most: int = 16, few: int = 4) -> int:
    """How often a distance is halved until a cell of its size holds ``few`` other rows or less, as a row sees it."""
    side = lambda k: F.lit(metres / geo.METERS_PER_DEGREE_LAT / 2**k)
    wide = F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("lat") / side(k)).alias("y"), F.floor(F.col("lon") * wide / side(k)).alias("x")) for k in range(0, most + 1, 2)]))
    held = places.select(cells.alias("c")).groupBy("c").agg(F.count("*").alias("n")).groupBy("c.k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("seen"))
    return min((r["k"] for r in held.collect() if r["seen"] <= few + 1), default=0 if places.isEmpty() else most)
