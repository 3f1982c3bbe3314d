"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A row descends three levels. At each, every child draws ``-ln(u) / weight`` with ``u`` hashed
from the row's key and the child's own name, and the smallest draw wins. A child's draw depends
on nothing but its own weight, so a change of weights moves rows only into or out of the subtrees
whose weights change. A shard that is added hangs at the root as a region of its own: the old
draws stay as they are, so rows move into the new shard and nowhere else.

Everything is DataFrame expressions. Null keys are a key like any other, rows with the same key
share a shard, empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import pick, read, written

SHARDS, PER_RACK, RACKS = 24, 4, 2
#: Parts of a shard that are numbered on their own, so that no task sorts a whole shard.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` is a tuple of (shard, weight) pairs: rack k of region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, (((shard, weight),),)))


def layout(shards: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> Tree:
    """Equal shards dealt in order to racks of ``per_rack`` and regions of ``racks``."""
    in_racks = [tuple((s, 1.0) for s in range(at, min(at + per_rack, shards))) for at in range(0, shards, per_rack)]
    return Tree(tuple(tuple(in_racks[at : at + racks]) for at in range(0, len(in_racks), racks)))


def _weight(node) -> float:
    return node[1] if isinstance(node[0], int) else sum(_weight(x) for x in node)


def _draw(key: list[Column], name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return -F.log(u) / F.lit(weight)


def _descend(key: list[Column], node, name: str) -> Column:
    """The shard of ``key`` below ``node``."""
    if isinstance(node[0], int):
        return F.lit(node[0])
    if len(node) == 1:
        return _descend(key, node[0], f"{name}/0")
    draws = [_draw(key, f"{name}/{i}" if not isinstance(x[0], int) else f"shard {x[0]}", _weight(x)) for i, x in enumerate(node)]
    below = [_descend(key, x, f"{name}/{i}") for i, x in enumerate(node)]
    least = F.least(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(draws)])["i"]
    return F.element_at(F.array(*below), least + 1)


def shard_of(tree: Tree, *key: Column) -> Column:
    """The shard of a row: a function of ``key`` and the tree alone."""
    return _descend([F.coalesce(k.cast("string"), F.lit("\x00null")) for k in key], tree.regions, "").cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], parts: int = SLOT_PARTS) -> DataFrame:
    """``df`` with ``slot``, gapless from 0 in each shard. Shards are numbered in ``parts`` parts, by
    a hash of ``order``, and each part begins where those before it end: what one task sorts is a
    part, and what is counted in order is a row per part."""
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = cut.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order))
    numbered = cut.withColumn("_i", inside)
    out = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("slot", (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_part", "_i", "_s", "_p", "_start")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.
    Null texts have no bytes and checksum 0."""
    tree = layout(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(tree, F.col("doc_id")).alias("shard"),
        shard_of(tree.grown(shards), F.col("doc_id")).alias("grown_shard"),
    )
    return with_slots(written(slim, "shards"), "shard", ["doc_id", "text_crc32", "size"])


def op8(spark, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
