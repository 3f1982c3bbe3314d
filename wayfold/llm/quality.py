"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its hashed word 1- and 2-grams and byte 3-grams, and one of
the share of its 2-grams that repeat a word, in tenths. Each is scaled by its class log-count ratio, and a linear hinge-loss model is fitted by dual coordinate
descent; a logistic curve over margins of rows that took no part in the fit makes a probability.

The model is fitted on at most ``sample`` labelled rows, the first by a hash of their id, in a task
of its own; the driver gets the weights. A document's labels, language, source and id never enter a score. Empty and null texts have no
features and get the score of the bias. Without rows of both classes every score is the share of
label 1, counting one more of each. Rows with equal ids are scored each on its own text; for the
fit one of them is used. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import keep_rows, mix, pick, read, word_hashes

BITS = 18
#: Labelled rows that the fit uses, at most.
SAMPLE = 6000
#: Feature numbers of all these rows, at most: what the fitting task holds, in 4 bytes each.
NUMBERS = 1 << 26
EPOCHS, C, SMOOTH = 12, 1.0, 1.0


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers below 2**BITS."""
    words = word_hashes(text.split())
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        parts = [mix(words), mix(words[:-1] * np.uint64(3) + words[1:])]
        if len(words) > 1:
            parts.append(mix(np.full(1, (1 << 41) + int(10 * np.mean(words[:-1] == words[1:])), np.uint64)))
        if len(raw) > 2:
            parts.append(mix(raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16) | np.uint64(1 << 40)))
    found = np.sort((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32))
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of features, already scaled by their ratios
    bias: float
    slope: float
    offset: float

    def score(self, text: bytes) -> float:
        found = features(text)
        margin = self.bias + (float(self.weights[found].sum()) / len(found) ** 0.5 if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Rows of feature numbers with labels 0 or 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        share = float(((y > 0).sum() + 1) / (len(y) + 2))
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: max(1, len(rows) // 5)].tolist()) if len(rows) >= 50 else set()
    train = [i for i in order.tolist() if i not in held]
    counts = {s: np.full(1 << BITS, SMOOTH) for s in (-1.0, 1.0)}
    for i in train:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    value = lambda i: ratio[rows[i]] / max(1.0, len(rows[i])) ** 0.5
    squares = {i: float(value(i) @ value(i)) + 1.0 for i in train}
    w, bias, alpha = np.zeros(1 << BITS), 0.0, dict.fromkeys(train, 0.0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(train).tolist():
            f, v = rows[i], value(i)
            gradient = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), C)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    held = sorted(held) or train
    margins = np.array([float(w[rows[i]] @ value(i)) + bias for i in held])
    slope, offset = _logistic(margins, (y[held] > 0).astype(float))
    return Model((w * ratio).astype(np.float32), bias, slope, offset)


def _logistic(x: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (x, t), with targets drawn in a little."""
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -500, 500)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - t) + 1e-6 * z)
        z = z - np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return max(float(z[0]), 1e-6), float(z[1])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the checksum of the id as text leaves that remainder; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, numbers: int = NUMBERS) -> Model:
    """Fit on the first ``sample`` labelled documents that are not held out, by a hash of their id, and
    of these on as many as have ``numbers`` feature numbers together (one at least). One task holds
    them, as 32-bit integers, and the driver gets the finished model alone."""
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"), 3, 1))
    texts = pick(docs, "doc_id", "text")
    there = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(texts.select("doc_id"), "doc_id", "left_semi")
    wanted = there.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(sample)
    found = texts.join(F.broadcast(wanted), "doc_id")

    @F.arrow_udf("array<int>")
    def of(text):
        import pyarrow as pa

        return pa.array([features(t or b"").astype(np.int32) for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))

    def fitted(batches):
        import pyarrow as pa

        rows, y, held, full = [], [], 0, False
        for batch in batches:
            for quality, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += len(f)
                full = full or (held > numbers and bool(rows))
                if not full:
                    rows.append(np.array(f.values, np.int32))
                    y.append(quality)
        m = fit(rows, np.array(y, np.int64))
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.astype("<f4").tobytes()], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    rows = found.select("o", "doc_id", "quality", of("text").alias("f")).groupBy("o", "doc_id").agg(F.max("quality").alias("quality"), F.max("f").alias("f"))
    one = rows.repartition(1).sortWithinPartitions("o", "doc_id").select("quality", "f")
    got = one.mapInArrow(fitted, "weights binary, bias double, slope double, offset double").collect()
    # a table without rows may have no task at all
    return Model(np.frombuffer(got[0]["weights"], "<f4"), *got[0][1:]) if got else fit([], np.zeros(0, np.int64))


def scorer(spark: SparkSession, model: Model):
    """An Arrow function from a text to its score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text):
        import pyarrow as pa

        return pa.array([shared.value.score(t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.float64())

    return score


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = scorer(spark, trained(docs, read(spark, sf_dir, "labels")))
    out = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def kept_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as label 1."""
    score = scorer(docs.sparkSession, trained(docs, labels))
    return keep_rows(docs, lambda plain, old: plain.where(score(old("text")) >= 0.5))
