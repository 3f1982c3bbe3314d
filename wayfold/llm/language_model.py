"""LM scoring with a hashed maximum-entropy model.

The probability of a token is that of its class times that of the token within the class, each a
softmax of summed features: the word before, the word before that (a skip), and both (the
2-gram), hashed to rows of weights with a column for each class, or for each member of a class. The
most frequent ``CLASSES * MEMBERS`` tokens are in classes by rank; all others are one more class,
within which a token has its smoothed relative frequency.

Training is distributed: from shared weights each task makes gradient updates over its part of
the training documents, and the tasks' changes of a row are averaged by the tokens that touched it,
summed where the row is shuffled to. Scoring is in batches of sparse rows. Counts are of all
training tokens. Tokens that make up more than one in ``COMMON`` of all, so at most ``COMMON`` of
them, are sent to the tasks with their counts; the others are looked up by a join.

Null texts are empty and have the end token alone; null ids are training documents; equal rows get
equal scores; without training tokens every base score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import mix, pick, read, texts_of, word_hashes, written
from wayfold.llm.quality import held_out

CLASSES, MEMBERS = 63, 64
COMMON = 1 << 21
#: Rows of weights: for classes by word before, skipped word and both; for members by word before and skipped word.
ROWS = (1 << 12, 1 << 12, 1 << 13, 1 << 13, 1 << 12)
FIRST = np.append(0, np.cumsum(ROWS)[:-1])
WIDTH = 64
RATE, BATCH, ROUNDS = 0.3, 4096, 1
#: Training tasks at most: what they send does not grow beyond that times the weights.
TASKS = 4096
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
START = np.uint64(0)


def tokens(text: bytes) -> np.ndarray:
    return np.append(word_hashes(text.lower().split()), END)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default):
    if not len(keys):
        return np.full(len(wanted), default, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class Weights:
    """Vocabulary (sorted hashes with their slots), frequencies as biases, and the rows."""

    words: np.ndarray
    slots: np.ndarray  # class * MEMBERS + member
    class_bias: np.ndarray
    member_bias: np.ndarray
    rows: list[np.ndarray]

    @staticmethod
    def start(top: list[tuple[int, int]], total: int) -> Weights:
        """From (hash, count) of the most frequent tokens, most frequent first."""
        h = np.array([x for x, _ in top], np.int64).view(np.uint64)
        n = np.array([c for _, c in top], np.float64)
        slots = np.arange(len(top))
        member = np.full((CLASSES + 1) * MEMBERS, -1e9)
        member[: len(top)] = np.log(n + 0.5)
        sums = np.zeros(CLASSES + 1)
        np.add.at(sums, slots // MEMBERS, n + 0.5)
        sums[CLASSES] = max(total - n.sum(), 0) + 0.5
        bias = np.where(sums > 0, np.log(np.maximum(sums, 1e-9)), -1e9)
        order = np.argsort(h)
        return Weights(h[order], slots[order], bias.astype(np.float32), member.reshape(-1, MEMBERS).astype(np.float32), [np.zeros((r, WIDTH), np.float32) for r in ROWS])


def stream(texts: list[bytes]):
    """Token hashes of the texts, the one and two before each, and the number of its text."""
    parts = [tokens(t) for t in texts]
    lengths = np.array([len(p) for p in parts])
    h = np.concatenate(parts)
    first = np.append(0, np.cumsum(lengths)[:-1])
    one, two = np.append(START, h[:-1]), np.append([START, START], h[:-2])[: len(h)]
    one[first] = START
    two[first] = START
    two[(first + 1)[lengths > 1]] = START
    return h, one, two, np.repeat(np.arange(len(texts)), lengths)


def features(slot: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Row numbers in each table; ``slot``: -1 for tokens of no class."""
    with np.errstate(over="ignore"):
        a, b = mix(one + np.uint64(1)), mix(two + np.uint64(2))
        c = (np.maximum(slot, 0) // MEMBERS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = (a, b, mix(a * np.uint64(3) + b), mix(a + c), mix(b + c))
    return [(k % np.uint64(r)).astype(np.int64) for k, r in zip(keys, ROWS, strict=True)]


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def added(first: np.ndarray, *rest: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``first``, to which is added for each (table, rows) those rows of the table."""
    for table, rows in rest:
        first += table.take(rows, axis=0)
    return first


def probabilities(w: Weights, slot: np.ndarray, f: list[np.ndarray]):
    """Class probabilities, and members' for the tokens ``inside`` a class."""
    p = added(w.rows[0].take(f[0], axis=0), (w.rows[1], f[1]), (w.rows[2], f[2]))
    p += w.class_bias
    inside = np.flatnonzero(slot >= 0)
    q = added(w.member_bias.take(slot[inside] // MEMBERS, axis=0), (w.rows[3], f[3][inside]), (w.rows[4], f[4][inside]))
    return softmax(p), inside, softmax(q)


def grouped(rows: np.ndarray, g: np.ndarray, single: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``rows``, how often each stands there and the sums of its rows of ``g``: the first
    ``single`` of each are added at once, and only what longer runs have beyond them run by run."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # all tables have under 2**15 rows
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n = np.diff(np.append(first, len(rows)))
    sums = g.take(order[first], axis=0)
    for k in range(1, single):
        more = np.flatnonzero(n > k)
        sums[more] += g.take(order[first[more] + k], axis=0)
    more = np.flatnonzero(n > single)
    if len(more):
        rest = n[more] - single
        begin = np.append(0, np.cumsum(rest)[:-1])
        at = np.arange(rest.sum()) + np.repeat(first[more] + single - begin, rest)
        sums[more] += np.add.reduceat(g.take(order[at], axis=0), begin)
    return ordered[first], n, sums


def update(w: Weights, squares: list[np.ndarray], touched: list[np.ndarray], slot: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """One gradient step on a batch of tokens, with a rate for each row that falls as it learns."""
    f = features(slot, one, two)
    p, inside, q = probabilities(w, slot, f)
    p[np.arange(len(p)), np.where(slot >= 0, slot // MEMBERS, CLASSES)] -= 1
    q[np.arange(len(q)), slot[inside] % MEMBERS] -= 1
    for i, (rows, g) in enumerate([(f[0], p), (f[1], p), (f[2], p), (f[3][inside], q), (f[4][inside], q)]):
        if not len(rows):
            continue
        at, n, summed = grouped(rows, g)
        squares[i][at] += np.einsum("ij,ij->i", summed, summed)
        touched[i][at] += n
        summed *= (RATE / np.sqrt(squares[i][at] + np.float32(1e-6)))[:, None]
        w.rows[i][at] -= summed


def counted(docs: DataFrame) -> DataFrame:
    """h, c: how often each token stands in ``docs`` (text)."""

    def count(batches):
        import pyarrow as pa

        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(parts, keys, n):
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            every, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return every, np.bincount(inverse, np.concatenate([n, c]).astype(np.float64), len(every)).astype(np.int64)

        parts, held = [], 0
        for batch in batches:
            for text in texts_of(batch):
                parts.append(tokens(text))
                held += len(parts[-1])
                if held > 4_000_000:
                    keys, n = merged(parts, keys, n)
                    parts, held = [], 0
            if len(keys) > 8_000_000:  # more than a task should hold: the shuffle adds the rest
                yield pa.RecordBatch.from_pydict({"h": keys.view(np.int64), "c": n})
                keys, n = keys[:0], n[:0]
        if parts:
            keys, n = merged(parts, keys, n)
        for at in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_pydict({"h": keys[at : at + 200_000].view(np.int64), "c": n[at : at + 200_000]})

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def trained(docs: DataFrame, w: Weights, rounds: int = ROUNDS) -> Weights:
    """``w`` after distributed gradient updates over all of ``docs`` (text)."""
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(w)

        def learn(batches, shared=shared):
            import pyarrow as pa

            w = shared.value
            start = w.rows
            w = Weights(w.words, w.slots, w.class_bias, w.member_bias, [r.copy() for r in start])
            squares, touched = [np.zeros(r, np.float32) for r in ROWS], [np.zeros(r, np.int64) for r in ROWS]
            for batch in batches:
                texts = texts_of(batch)
                for at in range(0, len(texts), 200):
                    h, one, two, _ = stream(texts[at : at + 200])
                    slot = lookup(w.words, w.slots, h, -1)
                    for a in range(0, len(h), BATCH):
                        update(w, squares, touched, slot[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH])
            for i, t in enumerate(touched):
                rows = np.flatnonzero(t)
                change = (w.rows[i][rows] - start[i][rows]) * t[rows, None].astype(np.float32)
                for a in range(0, len(rows), 5000):
                    part = rows[a : a + 5000]
                    values = [x.tobytes() for x in change[a : a + 5000].astype("<f4")]
                    yield pa.RecordBatch.from_arrays([pa.array(part + FIRST[i]), pa.array(t[part]), pa.array(values, pa.binary())], names=["row", "n", "change"])

        # At most a row for each row of weights: a task holds no more than the weights.
        def add(batches):
            import pyarrow as pa

            n, sums = np.zeros(sum(ROWS), np.int64), np.zeros((sum(ROWS), WIDTH))
            for batch in batches:
                row = batch.column(0).to_numpy()
                change = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4")
                np.add.at(n, row, batch.column(1).to_numpy())
                np.add.at(sums.ravel(), (row[:, None] * WIDTH + np.arange(WIDTH)).ravel(), change)
            rows = np.flatnonzero(n)
            values = (sums[rows] / n[rows, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=["row", "change"])

        sent = docs.select("text").coalesce(TASKS).mapInArrow(learn, "row long, n long, change binary")
        table = sent.repartition("row").mapInArrow(add, "row long, change binary").toArrow()
        rows = np.concatenate(w.rows)
        rows[table.column("row").to_numpy()] += np.frombuffer(b"".join(table.column("change").to_pylist()), "<f4").reshape(-1, WIDTH)
        w = Weights(w.words, w.slots, w.class_bias, w.member_bias, np.split(rows, FIRST[1:]))
    return w


def scored(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """A row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 1)).withColumn("uid", F.monotonically_increasing_id())
    train = rows.where(~F.col("held_out"))
    counts = written(counted(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    top = [(r["h"], r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(CLASSES * MEMBERS).collect()]
    w = trained(train, Weights.start(top, total))
    often = F.col("c") * F.lit(common) >= F.lit(total)
    table = counts.where(often).toArrow()
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    rare_tokens, rare_distinct = total - sum(c for _, c in top), distinct - len(top)
    base_all = float(np.log10(total + 0.5 * (distinct + 1)))
    rare_all = float(np.log10(rare_tokens + 0.5 * (rare_distinct + 1)))
    shared = spark.sparkContext.broadcast((w, h[order], table.column("c").to_numpy()[order]))

    def score(batches):
        import pyarrow as pa

        w, common_h, common_c = shared.value
        for batch in batches:
            every = texts_of(batch)
            for at in range(0, len(every), 500):
                texts = every[at : at + 500]
                h, one, two, number = stream(texts)
                slot, c = lookup(w.words, w.slots, h, -1), lookup(common_h, common_c, h, 0)
                log = np.zeros(len(h))
                for a in range(0, len(h), BATCH):
                    s = slot[a : a + BATCH]
                    p, inside, q = probabilities(w, s, features(s, one[a : a + BATCH], two[a : a + BATCH]))
                    log[a : a + BATCH] = np.log10(np.maximum(p[np.arange(len(s)), np.where(s >= 0, s // MEMBERS, CLASSES)], 1e-30))
                    log[a + inside] += np.log10(np.maximum(q[np.arange(len(q)), s[inside] % MEMBERS], 1e-30))
                known, total_of = c > 0, lambda x: np.bincount(number, x, len(texts))  # noqa: B023
                logs = np.log10(c + 0.5)
                rare = slot < 0
                tail = np.split(h[~known].view(np.int64), np.cumsum(np.bincount(number[~known], minlength=len(texts)))[:-1])
                arrays = [batch.column(i).slice(at, len(texts)) for i in range(3)]
                arrays += [pa.array(total_of(x).astype(np.int64)) for x in (np.ones(len(h)), known, rare)]
                arrays += [pa.array(total_of(x)) for x in (np.where(known, logs, 0.0), np.where(known & rare, logs, 0.0), log)]
                arrays.append(pa.array([t.tolist() for t in tail], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "doc_id", "held_out", "n", "known", "rare", "logs", "rare_logs", "model", "tail"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = f"uid long, doc_id {kind}, held_out boolean, n long, known long, rare long, logs double, rare_logs double, model double, tail array<long>"
    measured = written(rows.select("uid", "doc_id", "held_out", "text").mapInArrow(score, names), "scores")
    tail = measured.select("uid", F.explode("tail").alias("h"))
    seen = tail.join(counts.where(~often), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = seen.groupBy(F.col("uid").alias("u")).agg(F.sum(F.log10(F.col("c") + 0.5)).alias("s"), F.sum((F.col("c") > 0).cast("long")).alias("k"))
    out = measured.drop("tail").join(sums, F.col("uid") == F.col("u"), "left")
    more = F.coalesce("s", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n") * F.lit(base_all)).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + more - F.col("rare") * F.lit(rare_all)).alias("score"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
