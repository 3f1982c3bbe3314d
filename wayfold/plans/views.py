"""Geometry over the driver's tables, in Spark and as the same SQL for the oracle.

Coordinates come from integer arithmetic, one division and one addition, so both engines agree to
the bit. One SQL text serves both, as the views use only what the dialects share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """SELECT user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_id, value,
  event_type FROM events"""
TRACE = f"""SELECT file, pos, event_id, value, event_type, 106.7E0 + ((pos * 37 + file * 101) % 1000) / 100000E0 AS lon,
  10.77E0 + ((pos * 53 + file * 211) % 1000) / 100000E0 AS lat FROM ({POINTS}) p0"""
PLACES = """SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size,
  106.6E0 + ((p_partkey * 7919) % 20011) / 100000E0 AS lon, 10.7E0 + ((p_partkey * 104729) % 20021) / 100000E0 AS lat FROM part"""
REFS = """SELECT l_orderkey AS way, l_partkey AS node, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS pos
  FROM lineitem"""
EDGES = f"""SELECT DISTINCT least(node, nxt) AS u, greatest(node, nxt) AS v FROM
  (SELECT node, lead(node) OVER (PARTITION BY way ORDER BY pos, node) AS nxt FROM ({REFS}) r0) e0 WHERE nxt IS NOT NULL AND nxt <> node"""
MEMBERS = "SELECT DISTINCT l_suppkey AS relation, l_partkey AS member FROM lineitem"

VIEWS = {"trace": (TRACE, ("events",)), "places": (PLACES, ("part",)), "refs": (REFS, ("lineitem",)), "edges": (EDGES, ("lineitem",)), "members": (MEMBERS, ("lineitem",))}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(" ".join(sql.replace(f"FROM {t}", f"FROM {{{t}}}") for t in tables), **frames)
