"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has 64 bits: a bit is 1 if more than half of its word shingles' hashes have it.
Equal fingerprints are one node. For linked fingerprints, the differences in the three segments of
a ring add up to the budget at most, so from some segment on every chain of consecutive segments
stays within its share of the budget: the first segment is equal, and the first two together
differ in one bit at most. Fingerprints are indexed under those two segments, each probes its own
value and those with one more bit set, and the full Hamming distance decides. Where more
fingerprints than ``CROWD`` share a key, the chain goes on: of the halves of the third segment one
differs in half of what is left at most, and joins the key. Components come from alternating
large-star and small-star rounds over the links, each a written table.

Texts without words have fingerprint zero. Null texts are empty. Null ids never are a component's
id unless all its ids are null; equal rows are members of one component; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import discard, identified, keep_rows, keyed_join, one_of_equals, pick, read, written

SHINGLE, SEED, BUDGET = 3, 42, 2
#: First bit and bits of each segment of the ring.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one key that are compared with each other.
CROWD = 48


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    last = ends[min(shingle, len(words)) - 1 :] - 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(shingle: int = SHINGLE):
    """An Arrow function from a text to its fingerprint."""

    @F.arrow_udf("long")
    def of(text):
        import pyarrow as pa

        return pa.array([fingerprint(t or b"", shingle) for t in text.cast(pa.binary()).to_pylist()], pa.int64())

    return of


def _cut(x: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1))


def _raised(x: Column, bits: int) -> Column:
    """x, and x with each one of its zero bits set."""
    ones = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(bits)]), lambda m: x.bitwiseAND(m) == 0)
    return F.concat(F.array(x), F.transform(ones, lambda m: x.bitwiseOR(m)))


def links(nodes: DataFrame) -> DataFrame:
    """a < b for all pairs of distinct fingerprints ``fp`` that differ in ``BUDGET`` bits at most."""
    index, probes = [], []
    for i in range(3):
        (at, bits), (at2, bits2), (at3, bits3) = (SEGMENTS[(i + j) % 3] for j in range(3))
        first = F.lit(i << 44).cast("long") + F.shiftleft(_cut(F.col("fp"), at, bits), 22)
        second, third = _cut(F.col("fp"), at2, bits2), _cut(F.col("fp"), at3, bits3)
        index.append(nodes.select("fp", (first + second).alias("key"), third.alias("third")))
        # a pair whose second segments differ is found from the side that has the 0 bit
        own = nodes.select("fp", third.alias("third"), F.posexplode(_raised(second, bits2)).alias("way", "v"), first.alias("first"))
        probes.append(own.select("fp", "third", (F.col("first") + F.col("v")).alias("key"), (F.col("way") == 0).alias("same")))
    index = index[0].unionByName(index[1]).unionByName(index[2])
    probes = probes[0].unionByName(probes[1]).unionByName(probes[2])
    crowded = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key")
    crowded = written(crowded, "crowded")

    def met(i: DataFrame, p: DataFrame, on: list[str]) -> DataFrame:
        # Spark's estimate leaves out the rows that explode adds: without the hint the probes may be broadcast
        both = i.withColumnRenamed("fp", "y").join(p.withColumnRenamed("fp", "x").hint("merge"), on)
        near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BUDGET
        # equal keys meet from both sides: one is enough
        return both.where(near & (F.col("x") != F.col("y")) & (~F.col("same") | (F.col("x") < F.col("y")))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    found = met(index.join(crowded, "key", "left_anti").drop("third"), probes.drop("third"), ["key"])
    if crowded.head(1):
        dense_i = index.join(crowded, "key", "left_semi")
        dense_p = probes.join(crowded, "key", "left_semi")
        halves = lambda x: F.array(F.struct(F.lit(0).alias("half"), _cut(x, 0, 11).alias("h")), F.struct(F.lit(1).alias("half"), _cut(x, 11, 11).alias("h")))
        dense_i = dense_i.select("fp", "key", F.inline(halves(F.col("third"))))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(11)])
        dense_p = dense_p.select("fp", "key", "same", F.inline(halves(F.col("third"))))
        dense_p = dense_p.select("fp", "key", "same", "half", F.explode(F.transform(flips, lambda m: F.col("h").bitwiseXOR(m))).alias("h"))
        found = found.unionByName(met(dense_i, dense_p, ["key", "half", "h"]))
    return found.distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node that it reaches."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    now = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(most):
        last, now = now, written(stars(stars(now, True), False), "stars")
        discard(last)
        state = mark(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {most} rounds")


def grouped(rows: DataFrame) -> DataFrame:
    """fp, root: the component of every fingerprint of ``rows`` (fp)."""
    nodes = written(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(nodes))
    return written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``."""
    of = fingerprints(shingle)
    rows = written(pick(docs, "doc_id", "text").select("doc_id", of("text").alias("fp")), "simhash")
    roots = grouped(rows)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("m")).join(roots, "fp").groupBy("root").agg(F.min("m").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id")
    return keyed_join(rows, ids, ["fp"], rows.groupBy("fp").agg(F.count("*").alias("n"))).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one of each component: that with the smallest id, of equal ids the one
    with the least hash of its text, and one of rows that are equal in both."""
    of = fingerprints(shingle)

    def decide(plain: DataFrame, old) -> DataFrame:
        numbered = identified(plain, old("doc_id"), old("text"))
        rows = written(numbered.select("uid", "rid", old("doc_id").alias("doc_id"), of(old("text")).alias("fp")), "simhash")
        order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "rid")).alias("first")
        firsts = rows.groupBy("fp").agg(order).join(grouped(rows), "fp").groupBy("root").agg(F.min("first").alias("first"))
        repeats = rows.groupBy("uid", "rid").agg(F.count("*").alias("copies"))
        return one_of_equals(numbered, written(firsts.select("first.uid", "first.rid").join(repeats, ["uid", "rid"]), "kept"))

    return keep_rows(docs, decide)
