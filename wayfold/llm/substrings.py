"""Substring dedup: prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words. In each window one place is the anchor: where its
smallest hash of ``prefix`` words stands, the leftmost of equals. Equal windows have their anchor
at the same offset, so the suffixes that begin at anchors are enough, and a suffix brings along
the words before it that its windows begin with (its context).

1. Anchors are written once. Equal contexts become one with a count, so thousands of copies cost
   what one costs; a prefix that occurs once has no internal node and is left.
2. Contexts are grouped by prefix. Groups larger than ``GROUP`` contexts are split by longer
   prefixes: their windows, told apart by the anchor's offset and read outward from the anchor,
   take ``STEP`` words more at a time until a group fits, at last the whole window, where a group
   is a count; so no task holds more than ``GROUP`` of one group.
3. Each group's suffixes are sorted, with the lengths of their common prefixes: the suffix tree
   of the group as arrays, and one of the reversed words before the anchors. A window repeats if
   the node of its forward part and the node of its backward part share two occurrences or more:
   an internal node of the window's depth.
4. Repeated windows go back to their documents, which drop the words that they cover.

Trees compare 64-bit hashes of words. Null and short texts have no window; several rows with one
id are judged each on its own text; a repeat inside a document counts; empty tables give empty
results. Texts are numbered once, in a written table of packed texts that all else reads, so the
result does not depend on how ``docs`` is split when it is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import discard, keyed_join, mix, pick, read, texts_of, word_hashes, written

WINDOW, PREFIX = 35, 8
#: Contexts of one prefix that a task holds at once.
GROUP = 1 << 15
#: Words by which the prefixes of groups that do not fit become longer.
STEP = 6
#: Contexts whose trees are built together.
CHUNK = 1 << 17

_C = np.uint64(0x9E3779B97F4A7C15)
_CI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(c: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, c, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def anchors(h: np.ndarray, window: int = WINDOW, prefix: int = PREFIX):
    """Of word hashes: anchor places, first and last start of the windows of each, the hash of the
    prefix there and that of the context."""
    n = len(h)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(h * _powers(_C, n), dtype=np.uint64))
        inverse = _powers(_CI, n)
        part = lambda a, b: (sums[b] - sums[a]) * inverse[a]
        starts = np.arange(n - prefix + 1)
        grams = mix(part(starts, starts + prefix))
        wide = np.lib.stride_tricks.sliding_window_view(grams, window - prefix + 1)
        at = wide.argmin(1) + np.arange(len(wide))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        p = at[first]
        context = mix(part(first, last + window) ^ mix((p - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
    return p, first, last, grams[p], context


def _places(packed: DataFrame, window: int, prefix: int) -> DataFrame:
    """uid, at, key, ctx: the anchors of all texts; at packs place, words before it, windows."""

    def find(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            uids, out = batch.column(0).to_numpy(), [[], [], [], []]
            for uid, text in zip(uids, batch.column(1).to_pylist(), strict=True):
                p, first, last, key, ctx = anchors(word_hashes(press.decompress(text).split()), window, prefix)
                for column, values in zip(out, (np.full(len(p), uid), p << 20 | (p - first) << 10 | (last - first), key.view(np.int64), ctx.view(np.int64)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["uid", "at", "key", "ctx"])

    return packed.select("uid", "packed").mapInArrow(find, "uid long, at long, key long, ctx long")


def _packed(docs: DataFrame) -> DataFrame:
    """The text as compressed bytes: what the joins by document move."""

    @F.arrow_udf("binary")
    def pack(text):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(3)
        return pa.array([press.compress(t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.binary())

    return docs.withColumn("packed", pack("text")).drop("text")


def _contexts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the contexts ``wanted`` (uid, at, key, ctx, n, crowded): rows of key, ctx, n,
    before, windows, words, crowded."""

    def cut(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, list_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = word_hashes(press.decompress(packed).split())
                for w in list_:
                    p, before, windows = w["at"] >> 20, w["at"] >> 10 & 1023, w["at"] & 1023
                    words = h[p - before : p - before + windows + window].astype(">u8")
                    rows.append((w["key"], w["ctx"], w["n"], before, windows, words.tobytes(), w["crowded"]))
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["key", "ctx", "n", "before", "windows", "words", "crowded"])

    lists = wanted.groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("at", "key", "ctx", "n", "crowded")).alias("wanted"))
    both = docs.join(lists, F.col("uid") == F.col("u")).select("packed", "wanted")
    return both.mapInArrow(cut, "key long, ctx long, n long, before int, windows int, words binary, crowded boolean")


def repeated(key: np.ndarray, n: np.ndarray, before: np.ndarray, windows: np.ndarray, words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Of contexts: a bit mask of their windows that occur twice or more, by suffix arrays of the
    words after and before the anchors. Rows of one key must all be there."""
    rows, most = len(key), int(before.max()) if len(key) else 0
    if not rows:
        return np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, rows) // 8
    flat, starts = np.frombuffer(b"".join(words), ">u8"), np.append(0, np.cumsum(lengths)[:-1])
    group = np.unique(key, return_inverse=True)[1]

    def tree(depth: int, step: int):
        """Node number of each row's path at every depth; words beyond a context read as 0."""
        table = np.zeros((rows, depth + 1), ">u8")
        table[:, 0] = group
        for d in range(depth):
            place = before + d if step > 0 else before - 1 - d
            inside = (place >= 0) & (place < lengths)
            table[inside, d + 1] = flat[starts[inside] + place[inside]]
        order = np.argsort(np.ascontiguousarray(table).view(np.dtype((np.void, 8 * (depth + 1)))).ravel(), kind="stable")
        ordered = table[order]
        differ = ordered[1:] != ordered[:-1]
        common = np.where(differ.any(1), differ.argmax(1), depth + 1)  # columns that adjacent suffixes share
        nodes = np.zeros((depth + 1, rows), np.int64)
        for d in range(depth + 1):
            nodes[d, order] = np.append(0, np.cumsum(common <= d))
        return nodes

    forward, backward = tree(window, 1), tree(most, -1)
    out = np.zeros(rows, np.int64)
    for offset in range(most + 1):
        has = np.flatnonzero((before - windows <= offset) & (offset <= before))
        if not len(has):
            continue
        nodes = forward[window - offset][has] * rows + backward[offset][has]
        inverse = np.unique(nodes, return_inverse=True)[1]
        twice = np.bincount(inverse, weights=n[has])[inverse] >= 2
        out[has[twice]] |= np.int64(1) << (before[has[twice]] - offset)
    return out


def _trees(contexts: DataFrame, window: int) -> DataFrame:
    """key, ctx, i, bits: the repeated windows of contexts (group, key, ctx, at, n, before, windows, words) by
    the trees of their groups; ``i`` is ``at``, the place of a context's first window."""

    def build(batches):
        import pyarrow as pa

        def done(parts):
            group, key, ctx, at, n, before, windows = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(7))
            words = [w for p in parts for w in p.column(7).to_pylist()]
            bits = repeated(group, n, before.astype(np.int64), windows.astype(np.int64), words, window)
            has = bits != 0
            return pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (key, ctx, at, bits)], names=["key", "ctx", "i", "bits"])

        held, rows = [], 0
        for batch in batches:  # sorted by group: whole ones are cut off as soon as there are enough rows
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = joined.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield done([joined.slice(0, cut)])
                    held, rows = [joined.slice(cut)], len(joined) - cut
        if rows:
            yield done([b for b in held if len(b)])

    wanted = contexts.select("group", "key", "ctx", "at", "n", "before", "windows", "words")
    return wanted.repartition("group").sortWithinPartitions("group").mapInArrow(build, "key long, ctx long, i int, bits long")


def _outward(contexts: DataFrame, window: int) -> DataFrame:
    """A row for each window of crowded contexts: key, ctx, at (its number in the context), n, before, words
    and path, its words from the anchor to its end and then from the anchor to its beginning."""

    def cut(batches):
        import pyarrow as pa

        names = ["key", "ctx", "at", "n", "before", "words", "path"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = []
            for key, ctx, n, before, windows, words in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                h = np.frombuffer(words, ">u8")
                for i in range(windows + 1):
                    w, at = h[i : i + window], before - i
                    rows.append((key, ctx, i, n, at, w.tobytes(), np.concatenate([w[at:], w[:at][::-1]]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    wanted = contexts.select("key", "ctx", "n", "before", "windows", "words")
    return wanted.mapInArrow(cut, "key long, ctx long, at int, n long, before int, words binary, path binary")


def _flags(contexts: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """key, ctx, bits: the repeated windows of contexts."""
    parts = [_trees(contexts.where("NOT crowded").withColumns({"group": F.col("key"), "at": F.lit(0)}), window)]
    rows, length = contexts.where("crowded"), prefix
    if rows.head(1):
        rows = written(_outward(rows, window), "windows")
        while True:
            length = min(length + STEP, window)
            rows = rows.withColumn("group", F.xxhash64("key", "before", F.substring("path", 1, 8 * length)))
            if length == window:  # a group is one window, which repeats if it stands twice
                twice = rows.groupBy("group").agg(F.sum("n").alias("all")).where("all > 1").select("group")
                sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
                found = keyed_join(rows, twice, ["group"], sizes, "left_semi")
                parts.append(found.select("key", "ctx", F.col("at").alias("i"), F.lit(1).cast("long").alias("bits")))
                break
            sizes = written(rows.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("all > 1"), "sizes")
            fits = sizes.where(F.col("m") <= group).select("group")
            parts.append(_trees(rows.join(fits, "group", "left_semi").withColumn("windows", F.lit(0)), window))
            crowded = sizes.where(F.col("m") > group)
            if not crowded.head(1):
                break
            rows = written(keyed_join(rows, crowded.select("group"), ["group"], crowded.select("group", F.col("m").alias("n")), "left_semi").drop("group"), "windows")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("key", "ctx").agg(F.bit_or(F.expr("shiftleft(bits, i)")).alias("bits"))


def _strip(joined: DataFrame, kind: str, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept from doc_id, packed, flags."""

    def strip(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, flags in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = press.decompress(packed).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for f in flags or ():
                    first = (f["at"] >> 20) - (f["at"] >> 10 & 1023)
                    for i in range((f["at"] & 1023) + 1):
                        if f["bits"] >> i & 1:
                            gone[first + i] += 1
                            gone[first + i + window] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]) if flags else b" ".join(words)
                out.append((len(words), int(covered.sum()), kept))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = joined.select("doc_id", "packed", "flags").mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def deduplicated(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the text without the words of repeated windows."""
    if not 0 < prefix <= window < prefix + 62:
        raise ValueError("the windows of an anchor must fit a 62-bit mask: prefix <= window < prefix + 62")
    numbered = pick(docs, "doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    packed = written(_packed(numbered), "packed")
    places = written(_places(packed, window, prefix), "anchors")
    distinct = written(places.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("one")), "distinct")
    keys = written(distinct.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("n")).where("all > 1"), "prefixes")
    again = keys.select("key", (F.col("n") > group).alias("crowded"))
    marked = keyed_join(distinct, again, ["key"], keys.select("key", "n")).select("one.uid", "one.at", "key", "ctx", "n", "crowded")
    contexts = written(_contexts(packed, marked, window), "contexts")
    flags = written(_flags(contexts, window, prefix, group), "flags")
    discard(contexts)
    sizes = distinct.join(flags, ["key", "ctx"], "left_semi").select("key", "ctx", "n")
    hits = keyed_join(places, flags, ["key", "ctx"], sizes)
    back = hits.groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("at", "bits")).alias("flags"))
    kind = numbered.schema["doc_id"].dataType.simpleString()
    return _strip(packed.join(back, F.col("uid") == F.col("u"), "left"), kind, window)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
