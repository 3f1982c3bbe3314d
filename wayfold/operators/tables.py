"""Relational operators: robust widths, duplicates, way geometry, relations, cells, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robust_width(values: DataFrame, key: str, value: str, times: float = 3.0) -> DataFrame:
    """Median, MAD, the rows within ``times`` MAD of the median (all if it is 0), and the distance
    between the 5th and 95th percentile of their absolute values."""
    medians = values.groupBy(key).agg(F.median(value).alias("median"), F.count("*").alias("points"))
    off = values.join(medians, key).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mads = off.groupBy(key).agg(F.median("off").alias("mad"))
    kept = off.join(mads, key).where((F.col("mad") == 0) | (F.col("off") <= times * F.col("mad")))
    ends = F.percentile(F.abs(F.col(value)), F.array(F.lit(0.05), F.lit(0.95)))
    out = kept.groupBy(key, "median", "mad", "points").agg(F.count("*").alias("kept"), ends.alias("e"))
    return out.select(key, "points", "kept", "median", "mad", (F.col("e")[1] - F.col("e")[0]).alias("width"))


def drop_repeated(rows: DataFrame, name: str, exempt: str = "Unknown") -> DataFrame:
    """Without all rows whose name occurs more than once, but for the exempt one. Rows without a name are
    not the same place, and stay."""
    often = rows.where(F.col(name).isNotNull() & (F.col(name) != exempt)).groupBy(name).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(often, name, "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, with its columns."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def way_lines(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, points (array in order) of (way, pos, node) and nodes; missing nodes are left out."""
    found = refs.join(nodes, "node").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("points"))
    return found.where(F.size("points") >= 2)


def complete_relations(members: DataFrame, present: DataFrame) -> DataFrame:
    """relation of (relation, member) all of whose members are in ``present`` (member)."""
    missing = members.join(present, "member", "left_anti").select("relation").distinct()
    return members.select("relation").distinct().join(missing, "relation", "left_anti")


def cells(places: DataFrame, size: float) -> DataFrame:
    """Square cells of ``size`` degrees: counts by category and their diversity."""
    cell = places.withColumn("cx", F.floor(F.col("lon") / size)).withColumn("cy", F.floor(F.col("lat") / size))
    out = cell.groupBy("cx", "cy").agg(F.count("*").alias("places"), F.count_if(F.col("kind") == "food").alias("food"), F.count_if(F.col("kind") == "road").alias("road"), F.count_if(F.col("kind") == "quiet").alias("quiet"))
    return out.withColumn("diversity", sum((F.col(c) > 0).cast("long") for c in ("food", "road", "quiet")))


def minmax(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``n_<field>`` in 0 to 1 over the whole table; 0 for a flat field, one whose extremes differ by a
    billionth of the larger or less. The extremes are one row. Null values stay null."""
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in fields for n, f in (("lo", F.min), ("hi", F.max))])
    wide = rows.crossJoin(F.broadcast(ends))
    scaled = [F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") <= 1e-9 * F.greatest(F.abs(F.col(f"hi_{c}")), F.abs(F.col(f"lo_{c}"))), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(f"n_{c}") for c in fields]
    return wide.select(*rows.columns, *scaled)


def numbered_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """Equal slugs get _02, _03... in order."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("slug", F.when(n == 1, F.col(slug)).otherwise(F.format_string("%s_%02d", F.col(slug), n)))
