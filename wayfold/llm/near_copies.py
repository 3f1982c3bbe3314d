"""Near copies by the Jaccard similarity of word shingles, exactly: no pair at ``LEAST`` or more is lost.

A text's set holds 64-bit hashes of its runs of ``shingle`` words (of all words, if they are fewer),
ASCII letters in lower case. Texts with equal sets are one node. Sets are put in one order that all
share, rare shingles first: two sets of similarity 0.8 have their first common shingle among the
first n // 5 + 1 of the larger and the first n // 9 + 1 of the smaller set, so only sets that share
such a shingle, and fit in size and in what is left after it, can be near. What is common is
estimated from a sample of the texts; that decides the order and so the work, never the result.

Each set also has a sketch of ``BITS`` bits, in which every shingle turns one bit over: two sketches
differ in no more bits than the sets differ in shingles, so pairs whose sketches differ in more than
similar sets can are dropped inside the join and never become rows. The others are compared in full.

Texts are told apart by a hash of their bytes, not by their place in the table, so a table that is
split differently when it is read again gives the same rows.

The first pairs are those of op2's method: texts whose SimHash fingerprints over the same shingles the
ring of segments links. Each is confirmed by the sets, as no number of bits stands for a similarity.

What is still apart is joined by hubs. Each shingle has a few: the most central sets, whose first shingles
most others have too, so that they lie between the copies of a large group, and two at random. A set is
compared with the ``TRIED`` hubs that it shares most shingles with and with the most central one. After ``ROUNDS`` of that, all pairs that
lie in different components are compared, which completes the result: no link is lost that the
fingerprints do not show.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import discard, identified, keep_rows, keyed_join, mix, one_of_equals, texts_of, word_hashes, written
from wayfold.llm.simhash import components, fingerprint, links

#: Rows of which one is sampled for the order, and shingles that are held as common, at most.
SAMPLE, COMMON = 8, 1 << 20
#: Hubs that a set is compared with in a round, and rounds; these order the work and change no result.
TRIED, ROUNDS = 3, 1
BITS = 512
#: Places of texts that are broadcast to find the texts; more are shuffled.
FEW = 1 << 18


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = mix(h ^ w[j : len(w) - k + 1 + j]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """The parities of a set's hashes by their first bits, as 64-bit integers."""
    odd = np.bincount((h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _hashes(df: DataFrame, k: int) -> DataFrame:
    """h, the shingles of uid, text; those of a uid that a task has met already are left out."""

    def of(batches):
        import pyarrow as pa

        met: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [np.zeros(0, np.uint64)]
                for uid, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    if uid not in met:
                        met.add(uid)
                        found.append(shingles(text, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    return df.select("uid", "text").mapInArrow(of, "h long")


def _common(df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled rows have, sorted, with the count of each."""
    sample = _hashes(df.where(F.xxhash64("uid") % SAMPLE == 0), k)
    counts = written(sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 2"), "common")
    least, held = 3, 0
    for n, many in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        held += many
        if held > COMMON:
            least = n + 1
            break
    top = counts.where(F.col("n") >= least).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(df: DataFrame, k: int) -> DataFrame:
    """From uid, rid, doc_id, text: uid, rid, doc_id, digest and size n of the set, and where the task meets
    the text first, the set's first n // 5 + 1 hashes in the common order, its sketch, the text's fingerprint and the packed text."""
    held = df.sparkSession.sparkContext.broadcast(_common(df, k))

    def of(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(3)
        keys, counts = held.value
        met: dict[int, tuple[bytes, int]] = {}

        def prefix(h):
            rank = np.zeros(len(h), np.int64)
            if len(keys):
                found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                rank = np.where(keys[found] == h, counts[found], 0)
            return h[np.argsort(rank, kind="stable")[: len(h) // 5 + 1]].view(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                digests, sizes, firsts, sketches, prints, packed = [], [], [], [], [], []
                for uid, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    known = met.get(uid)
                    if known is None:
                        h = shingles(text, k)
                        known = met[uid] = (xxhash.xxh128_digest(h.tobytes()), len(h))
                        firsts.append(prefix(h))
                        sketches.append(sketch(h))
                        prints.append(fingerprint(text, k))
                        packed.append(press.compress(text))
                    else:
                        firsts.append(None)
                        sketches.append(None)
                        prints.append(None)
                        packed.append(None)
                    digests.append(known[0])
                    sizes.append(known[1])
                arrays = [part.column(0), part.column(1), part.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(prints, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "rid", "doc_id", "digest", "n", "first", "sketch", "fp", "packed"])

    kinds = f"uid long, rid long, doc_id {df.schema['doc_id'].dataType.simpleString()}, digest binary, n int, first array<long>, sketch array<long>, fp long, packed binary"
    return df.select("uid", "rid", "doc_id", "text").mapInArrow(of, kinds)


def _fit():
    """Whether sizes nx, ny, the places i, j of a common shingle and sketches sx, sy allow 0.8."""
    smaller, larger, both = F.least("nx", "ny"), F.greatest("nx", "ny"), F.col("nx") + F.col("ny")
    left = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j"))
    differ = reduce(add, [F.bit_count(F.get("sx", F.lit(w)).bitwiseXOR(F.get("sy", F.lit(w)))) for w in range(BITS // 64)])
    return (5 * smaller >= 4 * larger) & (9 * left >= 4 * both) & (9 * differ <= both)


def similar(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b of the pairs x, y of ``texts`` (place, packed) whose sets have a similarity of 0.8 or more, as a
    table. Only texts of pairs move, and packed; the sets are made again where a pair meets."""

    def check(batches):
        import pyarrow as pa
        import zstandard

        press, held = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            a, b = [], []
            for x, y, px, py in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if y not in held:  # pairs come sorted by y
                    held = {y: shingles(press.decompress(py), k)}
                hx, hy = shingles(press.decompress(px), k), held[y]
                at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
                if 9 * int((hy[at] == hx).sum()) >= 4 * (len(hx) + len(hy)):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = written(pairs, "pairs")
    some = written(pairs.select(F.col("x").alias("place")).unionByName(pairs.select(F.col("y").alias("place"))).distinct(), "places")
    wanted = texts.select("place", "packed").join(F.broadcast(some) if some.count() <= FEW else some, "place", "left_semi")
    met = written(wanted, "texts")
    one = met.select(F.col("place").alias("x"), F.col("packed").alias("px"))
    two = met.select(F.col("place").alias("y"), F.col("packed").alias("py"))
    both = pairs.join(one, "x").join(two, "y").sortWithinPartitions("y").select("x", "y", "px", "py")
    near = written(both.mapInArrow(check, "a long, b long"), "edges")
    discard(pairs, some, met)
    return near


def _linked(nodes: DataFrame) -> DataFrame:
    """x, y: sets of ``nodes`` (place, n, fp) whose fingerprints are linked. Of sets with one fingerprint
    the first stands for it, and the others are paired with that."""
    some = nodes.where("n > 0").select("fp", "place")
    firsts = written(some.groupBy("fp").agg(F.min("place").alias("x"), F.count("*").alias("n")), "fingerprints")
    ends = firsts.select(F.col("fp").alias("b"), F.col("x").alias("y"))
    pairs = links(firsts.select("fp")).join(firsts.select(F.col("fp").alias("a"), "x"), "a").join(ends, "b").select("x", "y")
    same = keyed_join(some, firsts.select("fp", "x"), ["fp"], firsts.select("fp", "n")).where("place <> x").select("x", F.col("place").alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(same)


def _hubs(x: DataFrame, seed: int) -> DataFrame:
    """x, y: each set of ``x`` (key, x, nx, sx, i, small, central, root) with the hubs, in other components,
    that it shares most keys with, and the most central one."""

    def hub(order, pick):
        return pick(F.struct(order.alias("h"), F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("i").alias("j"), F.col("root").alias("other"), F.col("sx").alias("sy"), "central"))

    chance, half = F.xxhash64(F.lit(seed), "root", "x"), F.pmod(F.xxhash64(F.lit(seed), "root"), F.lit(2))
    # the central hubs of a key are of two components
    orders = [(chance, F.min), (chance, F.max), *[(F.when(half == i, F.col("central")), F.max) for i in range(2)]]
    ends = [hub(order, f).alias(f"hub{i}") for i, (order, f) in enumerate(orders)]
    keys = written(x.groupBy("key").agg(F.count("*").alias("n"), *ends), "hubs")
    hubs = keys.select("key", F.array_distinct(F.array("hub0", "hub1", "hub2", "hub3")).alias("hubs"))
    met = keyed_join(x, hubs, ["key"], keys.select("key", "n")).select("x", "nx", "sx", "i", "root", F.inline("hubs"))
    fit = met.where((F.col("root") != F.col("other")) & _fit()).groupBy("x", "y").agg(F.count("*").alias("n"), F.max("central").alias("central"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "central", "y")), False), 1, TRIED).alias("best")
    best = fit.groupBy("x").agg(best, F.max(F.struct("central", "n", "y")).alias("top"))
    pairs = best.select("x", F.explode(F.array_union("best.y", F.array("top.y"))).alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def grouped(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """node, root for every node with a near copy, from a row per node, place, n, first, sketch, fp, and
    their ``texts`` (place, packed)."""
    spread = nodes.where("n > 0").select(F.col("place").alias("x"), F.col("n").alias("nx"), F.posexplode("first").alias("i", "key"))
    spread = spread.withColumn("small", F.expr("i <= nx div 9"))
    keys = written(spread.groupBy("key").agg(F.count("*").alias("n"), F.max("small").alias("s")).where("n > 1 AND s").select("key", "n"), "keys")
    sketches = nodes.select(F.col("place").alias("x"), F.col("sketch").alias("sx"))
    # how many sets share the first n // 9 + 1: an edit puts rare ones there
    central = F.coalesce(F.sum(F.when(F.col("small"), F.col("n"))).over(Window.partitionBy("x")), F.lit(0)).alias("central")
    shared = keyed_join(spread, keys, ["key"], keys).select("key", "x", "nx", "i", "small", central)
    x = written(shared.join(sketches, "x").withColumn("root", F.col("x")), "shared")
    discard(keys)
    edges = roots = None
    for turn in range(1 + ROUNDS):
        found = similar(_hubs(x, turn) if turn else _linked(nodes), texts, k)
        edges = found if edges is None else edges.unionByName(found)
        roots = written(components(edges), "roots")
        rooted = x.drop("root").join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
        several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
        before, x = x, written(rooted.join(several, "key", "left_semi"), "apart")
        discard(before)
    y = x.select("key", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("sx").alias("sy"), F.col("i").alias("j"), F.col("root").alias("other"))
    # the smaller set is x; of equal sizes that with the smaller place
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    met = x.where("small").join(y, "key").where(order & (F.col("root") != F.col("other")) & _fit())
    found = similar(met.select("x", "y").distinct(), texts, k)
    discard(x)
    return written(components(edges.unionByName(found)), "components") if found.head(1) else roots


def one_of_each(docs: DataFrame, k: int) -> DataFrame:
    """The rows of ``docs`` with one of each component of near copies: that with the smallest id, of
    equal ids the one with the least hash of its text, and one of rows that are equal in both. A null
    id loses to any other. Texts without words, null ones too, are one component."""

    def decide(plain: DataFrame, old) -> DataFrame:
        numbered = identified(plain, old("doc_id"), old("text"))
        texts = numbered.select("uid", "rid", old("doc_id").alias("doc_id"), old("text").alias("text"))
        # the place of a text in this table, which is read from now on, is what pairs are made of
        sets = written(prefixes(texts, k).withColumns({"place": F.monotonically_increasing_id(), "head": F.col("first").isNotNull()}), "shingles")
        order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "rid")).alias("first")
        node = F.min(F.when(F.col("head"), F.col("place"))).alias("node")
        nodes = written(sets.groupBy("digest").agg(node, order), "nodes")
        heads = sets.select("place", "n", "first", "sketch", "fp").join(nodes.select(F.col("node").alias("place")), "place", "left_semi")
        heads = written(heads, "heads")
        roots = grouped(heads, sets, k)
        discard(heads)
        firsts = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        repeats = sets.groupBy("uid", "rid").agg(F.count("*").alias("copies")).where("copies > 1")
        kept = firsts.select("first.uid", "first.rid").join(repeats, ["uid", "rid"], "left").select("uid", "rid", F.coalesce("copies", F.lit(1)).alias("copies"))
        kept = written(kept, "kept")
        discard(sets)
        return one_of_equals(numbered, kept)

    return keep_rows(docs, decide)
