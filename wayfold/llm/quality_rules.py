"""Quality rules: counts of a text, and bands of its n-gram perplexity by language.

The model is a modified Kneser-Ney model of character 3-grams. Spark counts the n-grams of all
documents (each task sums its own before the shuffle); continuation counts, the three discounts
of each order and the normalisers follow from the counts with group-bys. A character is a 21-bit
code point, so an n-gram is one integer and the model is sorted integer arrays that a binary
search reads. No n-gram is left out: a model of more than ``ENTRIES`` 3-grams, too large for arrays
in every task, stays a table, to which the n-grams of the documents are joined; the results are the
same.

A text's perplexity is that of a character. For each language, the median and the median absolute
deviation of its logarithm over all documents give a lower and an upper bound; documents beyond
them are rejected, besides those that fail the base rules. Texts without characters have no
perplexity and fail the base rule for words. Null texts are empty, null languages are a language
of their own, equal rows are judged alike, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import keyed_join, pick, read, texts_of, written

#: 3-grams up to which the model is arrays in every task, and beyond which it is a table.
ENTRIES = 1 << 21
#: How many median deviations a log perplexity may lie below or above the median of its language:
#: chosen by the labels of sf0.1, to reject junk while less than 1 % of clean documents go.
#: The distance that holds instead where the deviation is 0, to a cell of the histogram.
BELOW, ABOVE, LEAST = 8.0, 6.0, 0.15
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Bits of a code point; the number that stands for the place before a text and after it.
POINT, EDGE = 21, 0x1FFFFF


def points(text: bytes) -> np.ndarray:
    """Code points with two edges before and one after; white space runs are one space."""
    joined = b" ".join(text.split()).decode("utf-8", "replace")
    inner = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.concatenate([[EDGE, EDGE], inner, [EDGE]]) if len(inner) else np.zeros(0, np.int64)


def grams(p: np.ndarray) -> np.ndarray:
    """The 3-grams that end at each place but the first two."""
    return p[:-2] << (2 * POINT) | p[1:-1] << POINT | p[2:]


def counted(docs: DataFrame) -> DataFrame:
    """gram, n: the 3-grams of all texts."""

    def count(batches):
        import pyarrow as pa

        def summed(keys, n):
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        keys, n, buffer, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for text in texts_of(batch):
                p = points(text)
                if len(p):
                    buffer.append(grams(p))
                    held += len(p)
                if held > 4_000_000:
                    k, c = np.unique(np.concatenate(buffer), return_counts=True)
                    keys, n = summed(np.concatenate([keys, k]), np.concatenate([n, c]))
                    buffer, held = [], 0
        if buffer:
            k, c = np.unique(np.concatenate(buffer), return_counts=True)
            keys, n = summed(np.concatenate([keys, k]), np.concatenate([n, c]))
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_pydict({"gram": keys[at : at + 100_000], "n": n[at : at + 100_000]})

    return pick(docs, "text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class KneserNey:
    """For orders 3, 2 and 1: sorted n-grams with their discounted probability, and sorted contexts
    with the weight they leave to the order below."""

    grams: tuple[np.ndarray, ...]
    shares: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    back: tuple[np.ndarray, ...]
    floor: float  # probability of a character never seen

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def log10(self, g: np.ndarray) -> float:
        """Sum of log10 probabilities of the last characters of 3-grams."""
        distinct, n = np.unique(g, return_counts=True)
        mask = lambda bits: (1 << bits) - 1
        p = self._find(self.grams[2], self.shares[2], distinct & mask(POINT), 0.0) + self.floor
        for order in (1, 0):
            below = distinct & mask(POINT * (3 - order))
            p = self._find(self.grams[order], self.shares[order], below, 0.0) + self._find(self.contexts[order], self.back[order], below >> POINT, 1.0) * p
        return float(n @ np.log10(p))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney smoothing, from the counts of counts."""
    row = counts.agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).head()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


def levels(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], float]:
    """For orders 3, 2 and 1 the tables (gram, share) and (context, back), and the floor, from gram, n of
    order 3. The lower orders count in how many contexts an n-gram occurs."""
    tables, level, floor = [], counts, 1e-7
    for order in (3, 2, 1):
        d = _discounts(level)
        discount = F.least(F.col("n").cast("double"), F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))
        context = F.shiftright("gram", POINT) if order > 1 else F.lit(0).cast("long")
        # what the n-grams of a context lose goes to the order below
        sums = written(level.groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.sum(discount).alias("lost")), "contexts")
        shares = level.withColumn("context", context).join(sums, "context").select("gram", ((F.col("n") - discount) / F.col("all")).alias("share"))
        tables.append((shares, sums.select("context", (F.col("lost") / F.col("all")).alias("back"))))
        if order > 1:
            low = (1 << POINT * (order - 1)) - 1
            level = written(level.groupBy(F.col("gram").bitwiseAND(F.lit(low)).alias("gram")).agg(F.count("*").alias("n")), "counts")
        else:
            left = sums.head()
            floor = (left["lost"] / left["all"] if left and left["all"] else 1.0) / (1 << POINT)
    return tables, float(floor)


def model(counts: DataFrame) -> KneserNey:
    """As arrays."""
    tables, floor = levels(counts)

    def arrays(df: DataFrame):
        rows = df.toArrow().sort_by(df.columns[0])
        return [rows.column(i).to_numpy() for i in (0, 1)]

    grams, contexts = [arrays(g) for g, _ in tables], [arrays(c) for _, c in tables[:2]]
    return KneserNey(*(tuple(x[i] for x in part) for part in (grams, contexts) for i in (0, 1)), floor)


def log_table(counts: DataFrame) -> DataFrame:
    """gram, log10 of its last character's probability, for all 3-grams of ``counts``."""
    tables, floor = levels(counts)
    p = tables[2][0].select(F.col("gram").alias("last"), (F.col("share") + F.lit(floor)).alias("p"))
    for order in (2, 3):
        shares, contexts = tables[3 - order]
        below = F.col("gram").bitwiseAND(F.lit((1 << POINT * (order - 1)) - 1))
        rows = shares.withColumns({"last": below, "context": F.shiftright("gram", POINT)}).join(p, "last").join(contexts, "context")
        p = written(rows.select(F.col("gram").alias("last"), (F.col("share") + F.col("back") * F.col("p")).alias("p")), "probabilities")
    return p.select(F.col("last").alias("gram"), F.log10("p").alias("log"))


def rules(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    chars = sum(text.count(bytes([c])) for c in SYMBOLS)
    points_in_words = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in b" \t\n\r\x0b\x0c")
    seen, twice = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                twice += 1
            elif not line.isspace() and line:
                seen.add(line)
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        keys = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        starts = order[np.append(same, False) | np.append(False, same)]
        again = np.zeros(len(words), bool)
        for j in range(3):
            again[starts + j] = True
        repeated = int(again.sum())
    return len(words), points_in_words, chars, twice, repeated


def judged(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """A row per document: the counts, base_failed, log10 perplexity, and kept."""
    counts = written(counted(docs), "counts")
    lm = docs.sparkSession.sparkContext.broadcast(model(counts)) if counts.count() <= entries else None
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            found, perplexity, held = [], [], []
            for text in texts_of(batch):
                found.append(rules(text))
                g = grams(points(text)) if text.split() else np.zeros(0, np.int64)
                perplexity.append(-lm.value.log10(g) / len(g) if lm and len(g) else None)
                held.append(None if lm else [{"gram": k, "n": n} for k, n in zip(*(x.tolist() for x in np.unique(g, return_counts=True)), strict=True)])
            columns = list(map(list, zip(*found, strict=True))) or [[]] * 5
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], pa.array(perplexity, pa.float64())]
            arrays.append(pa.array(held, pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", *names, "log_perplexity", "grams"])

    slim = pick(docs, "doc_id", "lang", "text")
    kinds = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang {slim.schema['lang'].dataType.simpleString()}"
    measured = slim.mapInArrow(measure, f"{kinds}, {', '.join(f'{n} long' for n in names)}, log_perplexity double, grams array<struct<gram:long,n:long>>")
    rows = written(measured.withColumn("uid", F.monotonically_increasing_id()), "rules")
    if lm is None:
        each = rows.select("uid", F.inline("grams"))
        found = keyed_join(each, log_table(counts), ["gram"], each.groupBy("gram").agg(F.count("*").alias("n")))
        sums = found.groupBy(F.col("uid").alias("u")).agg((-F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("lp"))
        rows = written(rows.join(sums, F.col("uid") == F.col("u"), "left").withColumn("log_perplexity", F.col("lp")).drop("u", "lp"), "rules")
    limits = bands(rows.where(f"n_words >= {MIN_WORDS}")).withColumnRenamed("lang", "l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    return out.select("doc_id", *names, failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_perplexity", "lower", "upper")


def bands(rows: DataFrame, step: float = 0.002) -> DataFrame:
    """lang, lower, upper from lang, log_perplexity. Medians are read from histograms whose cells
    are ``step`` wide, so what is counted is cells and not documents."""

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        cells = df.groupBy("lang", F.floor(F.col(value) / step).alias("cell")).agg(F.count("*").alias("n"))
        by = Window.partitionBy("lang")
        summed = cells.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
        return summed.where("2 * upto >= all").groupBy("lang").agg(((F.min("cell") + 0.5) * step).alias(name))

    known = rows.where("log_perplexity IS NOT NULL").select("lang", "log_perplexity")
    middle = median(known, "log_perplexity", "middle")
    far = known.join(middle.withColumnRenamed("lang", "m"), F.col("lang").eqNullSafe(F.col("m"))).withColumn("far", F.abs(F.col("log_perplexity") - F.col("middle")))
    spread = median(far, "far", "spread").withColumnRenamed("lang", "s")
    both = middle.join(spread, F.col("lang").eqNullSafe(F.col("s")))
    wide = lambda times: F.when(F.col("spread") < step, F.lit(LEAST)).otherwise(times * F.col("spread"))
    return both.select("lang", (F.col("middle") - wide(BELOW)).alias("lower"), (F.col("middle") + wide(ABOVE)).alias("upper"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))
