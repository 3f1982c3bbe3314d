"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, edit verification.

Items and windows of documents are sequences of normalised words (lower case, letters, digits and
anything beyond ASCII). The CGK walk reads a sequence step by step, staying on a word or going on
by a random bit of step and word, and puts out the word that it is on; few edits become few
differing outputs. Items are cut into pieces of about ``PIECE`` words, as a walk loses its way the more
edits it passes: of the pieces of an item with d edits, one has its share of d at most. Each of
``REPEATS`` tables has a walk and a sample of outputs of its own; a window whose sample equals a
piece's is a candidate, and the exact word edit distance of the whole item to any stretch of the
document there decides: at most ``1 - SIMILARITY`` of the item's words.

Windows are piece-sized: pieces whose lengths lie within a quarter of each other share windows of
the shortest length, and walks that sample the outputs over that length. Which windows are walked
follows from a bound that loses none: d edits leave all but 2 d of the word pairs of the piece's
beginning, so a window with fewer distinct pairs that occur in the benchmark cannot match. Items
are the query set and are sent to the tasks in blocks of ``BLOCK`` words at most, one pass over
the documents for each block; if there are several, each pass is written and its block released.

Null and empty texts match nothing, nor do items without words; equal items are each reported,
equal documents too; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayfold.llm.common import discard, keep_rows, mix, pick, read, texts_of, word_hashes, written

SIMILARITY = 0.8
#: Walks, and outputs that each samples: an item at the greatest distance is missed with less than
#: 1 in 100, by any kind of edit, at 14 to 200 words (measured in tests/llm).
REPEATS, SAMPLED = 16, 2
#: Words of a piece of an item, about.
PIECE = 20
#: Lengths of pieces that share windows: the longest over the shortest.
SPREAD = 1.25
#: Steps of a walk for each word of the window; a walk passes half a word a step.
STEPS = 1.5
#: Words of a block of items.
BLOCK = 1 << 18

_PAD = np.uint64(0)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def budget(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of n words may have."""
    return int(n * (1 - similarity) + 1e-9)


def sampled_walk(h: np.ndarray, starts: np.ndarray, length: int, seed: int, sampled: int = SAMPLED, mixed: np.ndarray | None = None) -> np.ndarray:
    """The sampled outputs, as one key, of the walk that begins at each of ``starts`` in the word
    hashes ``h``; those must go on for ``STEPS * length`` places (zeros stand for no word)."""
    steps = max(1, int(STEPS * length))
    at = set(np.random.default_rng([seed, length]).choice(steps, size=min(sampled, steps), replace=False).tolist())
    bits = walk_bits(h, seed) if mixed is None else mixed
    place, key = starts.astype(np.int64), np.full(len(starts), seed, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(max(at) + 1):
            if step in at:
                key = mix(key * np.uint64(31) + h[place])
            place += (bits[place] >> np.uint64(step & 63) & np.uint64(1)).astype(np.int64)
    return key


def walk_bits(h: np.ndarray, seed: int) -> np.ndarray:
    """For each word the random bits by which a walk stays or goes on, one for each step."""
    return mix(h ^ mix(np.full(1, seed + 1, np.uint64)))


def pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def lacking(item: np.ndarray, text: np.ndarray) -> int:
    """How many of ``item`` are nowhere in ``text``."""
    if not len(text):
        return len(item)
    ordered = np.sort(text)
    return int((ordered[np.minimum(np.searchsorted(ordered, item), len(ordered) - 1)] != item).sum())


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to a stretch of ``text``, and its first and last place + 1."""
    m = len(text)
    steps = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), steps.copy()
    scale = 4 * (m + 2)
    for i, w in enumerate(item.tolist(), 1):
        packed = row * scale + start
        change = np.append(np.int64(i * scale), np.minimum(packed[1:] + scale, packed[:-1] + np.where(text == w, 0, scale)))
        # insertions: the least of what stands to the left and its distance
        packed = np.minimum.accumulate(change - steps * scale) + steps * scale
        row, start = packed // scale, packed % scale
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def pieces(n: int, size: int = PIECE) -> list[tuple[int, int]]:
    """First place and place after the last of the pieces of n words, nearly equal in length."""
    parts = max(1, round(n / size))
    cuts = [n * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


@dataclass
class Kind:
    """Pieces that share windows of ``length`` words: the pairs a window must hold, and for each repeat
    the sorted keys with the items they belong to and the pieces' places in them."""

    length: int
    least: int
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class Index:
    """A block of items."""

    def __init__(self, ids: list, items: list[np.ndarray], similarity: float = SIMILARITY, repeats: int = REPEATS, sampled: int = SAMPLED):
        self.ids, self.items, self.similarity, self.repeats, self.sampled = ids, items, similarity, repeats, sampled
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *[pairs(h) for h in items if len(h) > 1]]))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.single = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h in items if len(h) == 1]]))
        cut = [(i, a, items[i][a:b]) for i, h in enumerate(items) if len(h) for a, b in pieces(len(h))]
        cut.sort(key=lambda x: len(x[2]))
        self.pad = int(STEPS * max((len(h) for _, _, h in cut), default=1)) + 2
        self.kinds: list[Kind] = []
        at = 0
        while at < len(cut):
            length = len(cut[at][2])
            upto = at
            while upto < len(cut) and len(cut[upto][2]) <= max(length, int(length * SPREAD) if length > 1 else 1):
                upto += 1
            members, at = cut[at:upto], upto

            def must(i, h, length=length):
                # of the first pairs of a piece, distinct ones, 2 of each of its edits at most can be gone
                return len(np.unique(pairs(h[:length]))) - 2 * (budget(len(items[i]), similarity) * len(h) // len(items[i]))

            least = min(must(i, h) for i, _, h in members) if length > 1 else 0
            joined = np.concatenate([np.append(h, np.zeros(self.pad, np.uint64)) for _, _, h in members])
            starts = np.append(0, np.cumsum([len(h) + self.pad for _, _, h in members])[:-1])
            owner, place = np.array([i for i, _, _ in members]), np.array([a for _, a, _ in members])
            keys = []
            for r in range(repeats):
                k = sampled_walk(joined, starts, length, r, sampled)
                by = np.argsort(k, kind="stable")
                keys.append((k[by], owner[by], place[by]))
            self.kinds.append(Kind(length, least, keys))

    def starts(self, h: np.ndarray, kind: Kind, known: np.ndarray) -> np.ndarray:
        """Starts of the windows that can match; ``known``: running sums of known distinct pairs."""
        if kind.length == 1:
            return np.flatnonzero(np.isin(h, self.single))
        last = np.minimum(np.arange(len(h)) + kind.length - 1, len(known) - 1)
        # a pair that stood two places before, or fewer, is not counted again: two at most at the window's edge
        return np.flatnonzero(known[last] - known[np.minimum(np.arange(len(h)), len(known) - 1)] + 2 >= kind.least)

    def known(self, h: np.ndarray) -> np.ndarray:
        pair = pairs(h)
        may = self.filter[(pair & np.uint64((1 << 20) - 1)).astype(np.int64)]
        near = np.flatnonzero(may)
        at = np.minimum(np.searchsorted(self.pairs, pair[near]), len(self.pairs) - 1)
        may[near] = self.pairs[at] == pair[near]
        for back in (1, 2):
            may[back:] &= pair[back:] != pair[:-back]
        return np.append(0, np.cumsum(may))

    def matches(self, texts: list[np.ndarray]):
        """(text number, item number, first word, last word + 1, distance) for every text of word
        hashes and item that it holds: the best place."""
        wanted: list[list[np.ndarray]] = [[] for _ in self.kinds]
        parts, bases, numbers, size = [], [], [], 0
        for number, h in enumerate(texts):
            if not len(h):
                continue
            known, any_ = self.known(h), False
            for kind, out in zip(self.kinds, wanted, strict=True):
                if kind.length > 1 and known[-1] + 2 < kind.least:
                    continue
                found = self.starts(h, kind, known)
                if len(found):
                    out.append(found + size)
                    any_ = True
            if any_:
                parts += [h, np.zeros(self.pad, np.uint64)]
                bases.append(size)
                numbers.append(number)
                size += len(h) + self.pad
        if not parts:
            return
        joined, base = np.concatenate(parts), np.array(bases)
        candidates: dict[tuple[int, int], set[int]] = {}
        for r in range(self.repeats):
            bits = walk_bits(joined, r)
            for kind, out in zip(self.kinds, wanted, strict=True):
                if not out:
                    continue
                places = np.concatenate(out)
                keys, owner, place = kind.keys[r]
                for at in range(0, len(places), 1 << 18):
                    s = places[at : at + (1 << 18)]
                    k = sampled_walk(joined, s, kind.length, r, self.sampled, bits)
                    lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                    for j in np.flatnonzero(hi > lo).tolist():
                        text = int(np.searchsorted(base, s[j], "right")) - 1
                        for i, p in zip(owner[lo[j] : hi[j]].tolist(), place[lo[j] : hi[j]].tolist(), strict=True):
                            # where the item would begin; a piece can stand earlier by as much as is missing before it
                            candidates.setdefault((text, i), set()).add(max(0, int(s[j]) - bases[text] - p))
        for (text, i), places in candidates.items():
            h, item = texts[numbers[text]], self.items[i]
            edits, best, upto = budget(len(item), self.similarity), None, -1
            for s in sorted(places):
                if s < upto:  # already inside the stretch that was compared
                    continue
                lo, upto = max(0, s - edits), s + len(item)
                stretch = h[lo : upto + len(item) + 2 * edits]
                # an edit is needed for each word that the stretch lacks, and one for two pairs of words
                if lacking(item, stretch) > edits or lacking(pairs(item), pairs(stretch)) > 2 * edits:
                    continue
                d, first, last = infix_distance(item, stretch)
                if d <= edits and (best is None or d < best[3]):
                    best = (i, lo + first, lo + last, d)
            if best:
                yield (numbers[text], *best)


def blocks(benchmark: DataFrame, most: int = BLOCK):
    """Items in blocks of ``most`` words (or one item, if it is longer), read one block at a time."""
    ids, items, held = [], [], 0
    for row in pick(benchmark, "item_id", "text").toLocalIterator():
        h = word_hashes(words((row["text"] or "").encode()))
        if ids and held + len(h) > most:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row["item_id"])
        items.append(h)
        held += len(h)
    if ids:
        yield ids, items


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repeats: int = REPEATS, sampled: int = SAMPLED, block: int = BLOCK) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, first_word, last_word, distance
    and similarity."""
    spark = docs.sparkSession
    slim = pick(docs, "doc_id", "text")
    doc, item = slim.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    kinds = f"doc_id {doc}, item_id {item}, first_word long, last_word long, distance long, similarity double"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def found(shared):
        def find(batches):
            import pyarrow as pa

            index = Index(*shared.value, similarity, repeats, sampled)
            for batch in batches:
                rows = []
                texts = texts_of(batch)
                for at in range(0, len(texts), 1000):
                    for j, i, first, last, d in index.matches([word_hashes(words(t)) for t in texts[at : at + 1000]]):
                        rows.append(dict(zip(schema.names, (batch.column(0)[at + j].as_py(), index.ids[i], first, last - 1, d, 1 - d / len(index.items[i])), strict=True)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return slim.mapInArrow(find, kinds)

    out = None
    for shared, part in _passes(spark, benchmark, block, found):
        if part is None:
            return out if out is not None else spark.createDataFrame([], kinds)
        if shared is not None:  # more blocks follow: this one's rows are written and its items released
            part = written(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _passes(spark: SparkSession, benchmark: DataFrame, block: int, use):
    """(broadcast, ``use`` of it) for each block of items but the last, which comes as (None, ``use`` of
    it) as its broadcast has to stay; (None, None) if there is no item."""
    held = None
    for one in blocks(benchmark, block):
        if held is not None:
            shared = spark.sparkContext.broadcast(held)
            yield shared, use(shared)
        held = one
    yield None, None if held is None else use(spark.sparkContext.broadcast(held))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item. Each row is judged by its text alone, so nothing is joined
    back; with several blocks of items each pass reads what the one before has left."""

    def holds(shared):
        made: list[Index] = []  # one for each worker

        @F.arrow_udf("boolean")
        def of(text):
            import pyarrow as pa

            if not made:
                made.append(Index(*shared.value))
            index, out = made[0], np.zeros(len(text), bool)
            texts = [t or b"" for t in text.cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), 1000):
                for j, *_ in index.matches([word_hashes(words(t)) for t in texts[at : at + 1000]]):
                    out[at + j] = True
            return pa.array(out)

        return of

    def decide(plain: DataFrame, old) -> DataFrame:
        left, last = plain, None
        for shared, flag in _passes(docs.sparkSession, benchmark, block, holds):
            if flag is None:
                return left
            left = left.where(~flag(old("text")))
            if shared is not None:
                left = written(left, "clean")
                shared.destroy()
                if last is not None:
                    discard(last)
                last = left
        return left

    return keep_rows(docs, decide)
